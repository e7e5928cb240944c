"""Knowledge-base tables: upserts, links, quarantine, relinking, plans and health.

Keys are ids; every "first" or "last" has an explicit order column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.constants import AUTO_KEEP, LOW, MISSING_ENTITY, MISSING_PLANNER, QUARANTINE
from quarrystone.functions.text import is_missing, strip, text_or_empty
from quarrystone.functions.values import confidence
from quarrystone.operators.work import folder, written


def keep_first(rows: DataFrame, keys: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    """First row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def last_link(links: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return links.groupBy(key).agg(F.max_by(value, order).alias(value))


def members(rows: DataFrame, links: DataFrame, key: str, project: Column) -> DataFrame:
    return rows.join(links.filter(project).select(key).distinct(), key, "left_semi")


def non_members(rows: DataFrame, links: DataFrame, key: str, project: Column) -> DataFrame:
    return rows.join(links.filter(project).select(key).distinct(), key, "left_anti")


def exclusive_members(rows: DataFrame, links: DataFrame, key: str, project: Column) -> DataFrame:
    """Rows linked to the project and to no other."""
    return non_members(members(rows, links, key, project), links, key, ~project)


def upsert(base: DataFrame, batch: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows of ``base`` with values of ``batch`` where it has the key and a value, and the batch's new keys.

    The batch has each key once at most.
    """
    new = batch.select(*keys, *[F.col(v).alias(f"_n_{v}") for v in values], F.lit(True).alias("_in"))
    d = base.select(*keys, *values).join(new, list(keys), "full_outer")
    return d.select(*keys, *[F.coalesce(f"_n_{v}", v).alias(v) for v in values])


def replace_partition(base: DataFrame, batch: DataFrame, partition: str, values: Sequence) -> DataFrame:
    """All rows of the partitions ``values`` go, the batch's come."""
    return base.filter(~F.coalesce(F.col(partition).isin(*values), F.lit(False))).unionByName(batch)


def match_any(rows: DataFrame, names: DataFrame, columns: Sequence[str], name: str, order: str) -> DataFrame:
    """First row, by ``order``, that has the name in any of ``columns``.

    The smallest order of each key comes first, which combines before the shuffle; only rows that hold it meet the names, so
    no task gets all rows of a key.
    """
    keys = F.explode(F.array_distinct(F.array(*[F.col(c) for c in columns])))
    least = rows.select(F.col(order).alias("_order"), keys.alias("_key")).filter(F.col("_key").isNotNull()).groupBy("_key").agg(F.min("_order").alias("_least"))
    asked = least.join(names.select(F.col(name).alias("_name")).distinct(), F.col("_key") == F.col("_name"), "left_semi")
    spread = rows.withColumn("_of", keys).filter(F.col("_of").isNotNull())
    # Two keys of the join, so a frequent name is spread by the order of its rows.
    found = spread.join(asked, (F.col("_of") == F.col("_key")) & F.col(order).eqNullSafe(F.col("_least")))
    return found.groupBy(F.col("_key").alias(name)).agg(F.min_by(F.struct(*[F.col(c) for c in rows.columns]), order).alias("row")).select(name, "row.*")


def absent(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct rows of the batch that are not known."""
    return batch.subtract(known.select(*batch.columns))


def insert_absent(base: DataFrame, batch: DataFrame, key: Column, other: Column) -> DataFrame:
    """Rows of the batch whose key the base lacks."""
    return batch.withColumn("_k", other).join(base.select(key.alias("_k")).distinct(), "_k", "left_anti").drop("_k")


def new_ids(batch: DataFrame, base: DataFrame, column: str, prefix: str, order: Sequence[str]) -> DataFrame:
    """Ids after the base's largest number, in order; the base's maximum is one row."""
    top = base.agg(F.coalesce(F.max(F.regexp_extract(F.col(column), "([0-9]+)$", 1).try_cast("long")), F.lit(0)).alias("_top"))
    # Running numbers of a whole batch: ranges are counted, then numbered within.
    ranged = batch.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id())
    # Written once, as ranges may fall otherwise when they are made again.
    ranged = written(ranged, folder(batch.sparkSession), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_n"))
    d = ranged.withColumn("_w", within).join(F.broadcast(before), "_part").join(F.broadcast(top), F.lit(True))
    return d.withColumn(column, F.format_string(f"{prefix}%03d", F.col("_top") + F.col("_before") + F.col("_w"))).drop("_part", "_n", "_w", "_before", "_top")


def merge_aliases(current: Column, new: Column) -> Column:
    """Aliases of both lists, missing markers dropped, each once without regard to case."""
    split = lambda x: F.filter(F.transform(F.split(text_or_empty(x), ","), strip), lambda a: ~F.lower(a).isin(*MISSING_ENTITY))
    add = lambda acc, a: F.when(F.exists(acc, lambda b: F.lower(b) == F.lower(a)), acc).otherwise(F.array_append(acc, a))
    return F.array_join(F.aggregate(F.concat(split(current), split(new)), F.array().cast("array<string>"), add), ", ")


def overall_confidence(assignment: Column, values: Sequence[Column], confidences: Sequence[Column]) -> Column:
    """Assignment confidence times the mean confidence of the fields, missing ones as 0, to four places."""
    parts = [F.when(is_missing(F.lower(text_or_empty(v)), MISSING_ENTITY), 0.0).otherwise(confidence(c)) for v, c in zip(values, confidences)]
    return F.format_string("%.4f", confidence(assignment) * (sum(parts[1:], parts[0]) / len(parts)))


def write_back(rows: DataFrame, updates: DataFrame, key: str, field: str, longer_by: int | None = None) -> DataFrame:
    """Field (and its confidence) after repair: more confidence, or missing before; descriptions by length."""
    c = f"{field} (C)"
    u = updates.select(F.col(key).alias("_k"), F.col(field).alias("_v"), F.col(c).alias("_c"))
    d = rows.join(u, F.col(key) == F.col("_k"), "left")
    has = ~is_missing(F.lower(text_or_empty("_v")), MISSING_ENTITY)
    if longer_by is None:
        take = has & ((confidence("_c") > confidence(F.col(f"`{c}`"))) | is_missing(F.lower(text_or_empty(F.col(f"`{field}`"))), MISSING_ENTITY))
    else:
        take = has & (F.length("_v") > F.length(text_or_empty(F.col(f"`{field}`"))) + longer_by)
    take = F.coalesce(take, F.lit(False))
    return d.withColumns({field: F.when(take, F.col("_v")).otherwise(F.col(f"`{field}`")), c: F.when(take, F.col("_c")).otherwise(F.col(f"`{c}`"))}).drop("_k", "_v", "_c")


def quarantine(rows: DataFrame, links: DataFrame, key: str, conf: str, least: float = QUARANTINE) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(kept rows, quarantined rows, kept links, quarantined links); a confidence that is no number is 1."""
    low = confidence(conf, 1.0) < least
    out = rows.filter(low)
    gone = out.select(key).distinct()
    return rows.filter(~low), out, links.join(gone, key, "left_anti"), links.join(gone, key, "left_semi")


def resolve_chains(pairs: DataFrame, dropped: str = "dropped", kept: str = "kept", steps: int = 64) -> DataFrame:
    """(dropped, root) of dropped-to-kept pointers: pointer jumping, a join a step, until nothing moves.

    Of several pointers of one row the smallest counts; a cycle ends at its smallest member.
    """
    links = pairs.filter(F.col(dropped) != F.col(kept)).groupBy(dropped).agg(F.min(kept).alias("to"))
    links = links.withColumn("low", F.least(F.col(dropped), F.col("to")))
    path = folder(pairs.sparkSession)
    for step in range(steps):
        links = written(links, path, f"links-{step}")
        up = links.select(F.col(dropped).alias("_d"), F.col("to").alias("_t"), F.col("low").alias("_l"))
        moved = links.join(up, F.col("to") == F.col("_d"), "left")
        # A pointer that comes back to its own row is in a cycle: it stays at the smallest row seen.
        if moved.filter("_d is not null and low <> least(low, _l) or (_d is not null and _t <> to and to <> low)").isEmpty():
            break
        links = moved.select(dropped, F.coalesce("_t", "to").alias("to"), F.least("low", F.coalesce("_l", "low")).alias("low"))
    cyclic = links.alias("x").join(links.select(F.col(dropped).alias("_d")), F.col("to") == F.col("_d"), "left")
    return cyclic.select(dropped, F.when(F.col("_d").isNotNull(), F.col("low")).otherwise(F.col("to")).alias("root"))


def relink(links: DataFrame, roots: DataFrame, key: str, comment: str, dropped: str = "dropped", note: str = "[RELINKED from {}]") -> DataFrame:
    """Links of dropped rows point to their root, with a note; links that come to be equal stay once."""
    before, after = note.split("{}")
    d = links.join(roots.withColumnRenamed(dropped, "_d"), F.col(key) == F.col("_d"), "left")
    text = F.concat(F.lit(before), F.col(key), F.lit(after))
    noted = F.when(F.col("root").isNotNull() & ~text_or_empty(comment).contains(text), strip(F.concat_ws(" ", F.col(comment), text))).otherwise(F.col(comment))
    return d.withColumn(comment, noted).withColumn(key, F.coalesce("root", key)).drop("_d", "root")


def singleton_verdict(conf: Column, exists: Column, in_project: Column) -> Column:
    """KEEP, DROP or LOST of a row without duplicates; null answers keep it, as does high confidence."""
    return F.when(conf >= AUTO_KEEP, "KEEP").when(exists == F.lit(False), "DROP").when((exists == F.lit(True)) & (in_project == F.lit(False)), "LOST").otherwise("KEEP")


def route_singletons(rows: DataFrame, links: DataFrame, key: str, project: str, action: str = "action") -> DataFrame:
    """UNLINK where other projects hold the row, else DELETE or REASSIGN; KEEP as it is."""
    fan = links.groupBy(key).agg(F.countDistinct(project).alias("_projects"))
    d = rows.join(fan, key, "left")
    shared = F.coalesce("_projects", F.lit(0)) > 1
    route = F.when(F.col(action) == "KEEP", "KEEP").when(shared, "UNLINK").when(F.col(action) == "DROP", "DELETE").otherwise("REASSIGN")
    return d.withColumn("route", route).drop("_projects")


def low_confidence(rows: DataFrame, key: str, project: str, fields: Sequence[str], least: float = LOW) -> DataFrame:
    """(key, project, field) of cells below ``least``; confidences that are no numbers are 0."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), confidence(F.col(f"`{f} (C)`")).alias("confidence")) for f in fields])
    return rows.select(key, project, F.inline(cells)).filter(F.col("confidence") < least)


def project_health(rows: DataFrame, key: str, project: str, fields: Sequence[str], least: float = LOW, rerun_pct: float = 30) -> DataFrame:
    """Per project: rows, rows with a low cell, status and the three most frequent defects with their share."""
    low = low_confidence(rows, key, project, fields, least)
    position = F.array_position(F.array(*map(F.lit, fields)), F.col("field"))
    counts = low.groupBy(project, "field").agg(F.count(F.lit(1)).alias("n"))
    totals = rows.groupBy(project).agg(F.count(F.lit(1)).alias("total"))
    bad = low.groupBy(project).agg(F.countDistinct(key).alias("low_conf"))
    top = counts.withColumn("_r", F.row_number().over(Window.partitionBy(project).orderBy(F.desc("n"), position))).filter("_r <= 3").join(totals, project)
    text = F.concat(F.col("field"), F.lit(" ("), F.floor(F.col("n") * 100.0 / F.col("total")).cast("string"), F.lit("%)"))
    defects = top.groupBy(project).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", text.alias("t")))), lambda x: x["t"]), ", ").alias("defects"))
    d = totals.join(bad, project, "left").join(defects, project, "left").na.fill({"low_conf": 0, "defects": "None"})
    return d.withColumn("status", F.when(F.col("low_conf") * 100.0 / F.col("total") > rerun_pct, "RERUN").otherwise("OK"))


def merge_targets(jobs: DataFrame, project: str, mode: str, time: str, excluded: Sequence = ()) -> DataFrame:
    """Projects with more than one gathering run, the last one after the last merge."""
    gathers = F.col(mode).isin("AGENT", "HARVEST")
    d = jobs.filter(F.col(project).isNotNull() & ~F.col(project).isin(*excluded) if excluded else F.col(project).isNotNull())
    d = d.groupBy(project).agg(F.count_if(gathers).alias("runs"), F.max(F.when(gathers, F.col(time))).alias("last_run"), F.max(F.when(F.col(mode) == "MERGE", F.col(time))).alias("last_merge"))
    return d.filter((F.col("runs") > 1) & (F.col("last_merge").isNull() | (F.col("last_run") > F.col("last_merge"))))


def repair_targets(needs: DataFrame, jobs: DataFrame, project: str, mode: str, time: str, pct: float = 30, least: int = 2) -> DataFrame:
    """Projects where more than ``pct`` % of more than ``least`` rows need repair and no repair followed the last other run.

    ``needs`` has a row for each dataset: project and needs_repair (0 or 1).
    """
    share = needs.groupBy(project).agg(F.sum("needs_repair").alias("need"), F.count(F.lit(1)).alias("total"))
    last = jobs.groupBy(project).agg(F.max(F.when(F.col(mode) == "REPAIR", F.col(time))).alias("last_repair"), F.max(F.when(F.col(mode).isin("AGENT", "HARVEST", "MERGE"), F.col(time))).alias("last_other"))
    d = share.withColumn("pct", F.col("need") * 100.0 / F.col("total")).filter((F.col("pct") > pct) & (F.col("total") > least)).join(last, project, "left")
    due = F.col("last_repair").isNull() | F.coalesce(F.col("last_repair") < F.col("last_other"), F.lit(False))
    return d.filter(due)


def planner_missing(rows: DataFrame, fields: Sequence[str]) -> Column:
    """Whether any of ``fields`` is missing or below 0.8, as the planner sees it."""
    tests = [F.lower(strip(text_or_empty(F.col(f"`{f}`")))).isin(*MISSING_PLANNER) | (confidence(F.col(f"`{f} (C)`")) < LOW) for f in fields]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def unrun_projects(projects: DataFrame, done: DataFrame, project: str, method: str) -> DataFrame:
    """Active projects without a completed run: method -1 and the lost project excluded."""
    name = F.regexp_replace(F.upper(strip(text_or_empty(project))), "^PROJ_", "")
    number = F.coalesce(F.regexp_replace(text_or_empty(method), "[^0-9-]", "").try_cast("int"), F.lit(1))
    d = projects.withColumn("_p", F.concat(F.lit("PROJ_"), name)).filter((number != -1) & ~name.isin("", "LOST"))
    return d.join(done.select(F.col(project).alias("_p")).distinct(), "_p", "left_anti").drop("_p")


def link_fan_out(links: DataFrame, key: str, project: str) -> DataFrame:
    return links.groupBy(key).agg(F.countDistinct(project).alias("projects"))


def wipe(table: DataFrame) -> DataFrame:
    """An empty table of the same columns."""
    return table.limit(0)
