"""The catalog of cells: guarded updates, gates, gap audits, metrics and reports.

Cells are a long table (project_id, dataset_name, field, value, confidence, ord); updates are folded
in order of ``ord`` within one cell.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.constants import COLLECTION_KEYWORDS, EXACT_COLLECTIONS, GATE, INVALID_NAMES, LEAF_PATTERNS, LOCK, MISSING_CELL, PROVIDER_KEYWORDS
from quarrystone.functions.text import any_of, clean_url, in_scope, strip, text_or_empty, tidy_url, is_banned_url
from quarrystone.functions.values import cell_missing, confidence, similarity
from quarrystone.operators.work import few

CELL = "struct<value:string,confidence:double>"


def _missing(x: Column) -> Column:
    return F.coalesce(x, F.lit("")).isin(*MISSING_CELL)


def takes(current: Column, new: Column, lock: float = LOCK) -> Column:
    """Whether a cell takes an update: a missing one takes any value, another takes more confidence while not locked."""
    empty = _missing(current["value"])
    locked = (current["confidence"] >= lock) & ~empty
    return ~locked & ((empty & ~_missing(new["value"])) | (~empty & (new["confidence"] > current["confidence"])))


def fold_updates(updates: DataFrame, keys: Sequence[str], order: str, start: tuple[str, float] = ("[missing]", 0.0), lock: float = LOCK) -> DataFrame:
    """Final cell of each key after its updates (value, confidence) in order, with the number that was taken.

    A key's updates are sorted and folded in one row; the number of updates of one cell bounds it.
    """
    u = F.struct(F.col(order).alias("o"), F.col("value"), F.col("confidence"))
    state = lambda v, c, n: F.struct(v.alias("value"), c.cast("double").alias("confidence"), n.cast("long").alias("taken"))
    begin = state(F.lit(start[0]), F.lit(start[1]), F.lit(0))
    folded = F.aggregate(F.array_sort(F.collect_list(u)), begin, lambda s, x: F.when(takes(s, x, lock), state(x["value"], x["confidence"], s["taken"] + 1)).otherwise(s))
    return updates.groupBy(*keys).agg(folded.alias("_c")).select(*keys, "_c.value", "_c.confidence", "_c.taken")


def upsert_cells(cells: DataFrame, updates: DataFrame, keys: Sequence[str], order: str, allow_new: bool = True, lock: float = LOCK) -> DataFrame:
    """Catalog after a batch: present cells come first in each fold, names out of scope are refused."""
    name = keys[-2] if len(keys) > 1 else keys[0]
    old = cells.select(*keys, "value", "confidence", F.lit(None).cast("long").alias("_o"))
    new = updates.filter(in_scope(name)).select(*keys, "value", "confidence", F.col(order).cast("long").alias("_o"))
    if not allow_new:
        new = new.join(cells.select(*keys).distinct(), list(keys), "left_semi")
    u = F.struct(F.col("_o").isNotNull().alias("is_new"), F.col("_o").alias("o"), "value", "confidence")
    state = lambda v, c: F.struct(v.alias("value"), c.cast("double").alias("confidence"))
    step = lambda s, x: F.when(~x["is_new"] | takes(s, x, lock), state(x["value"], x["confidence"])).otherwise(s)
    folded = F.aggregate(F.array_sort(F.collect_list(u)), state(F.lit("[missing]"), F.lit(0.0)), step)
    return old.unionByName(new).groupBy(*keys).agg(folded.alias("_c")).select(*keys, "_c.value", "_c.confidence")


def classify_results(results: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """FILL, CONFIRM, REFINE or KEEP of each new (value, confidence) against the present cell, and whether it is taken."""
    old = cells.select(*keys, F.struct(F.col("value"), F.col("confidence")).alias("_old"))
    d = results.join(old, list(keys), "left").withColumn("_old", F.coalesce("_old", F.struct(F.lit("[missing]").alias("value"), F.lit(0.0).alias("confidence"))))
    new = F.struct(F.col("value"), F.col("confidence"))
    same = F.lower(strip(F.col("_old.value"))) == F.lower(strip(text_or_empty("value")))
    fill = _missing(F.col("_old.value")) & ~_missing(F.col("value"))
    kind = F.when(fill, "FILL").when(same, "CONFIRM").when(F.col("confidence") >= F.col("_old.confidence"), "REFINE").otherwise("KEEP")
    return d.withColumn("kind", kind).withColumn("taken", (F.col("kind") != "KEEP") & takes(F.col("_old"), new)).drop("_old")


def candidate_cells(datasets: DataFrame, fields: DataFrame, cells: DataFrame, name: str = "dataset_name", lock: float = LOCK) -> DataFrame:
    """All (dataset, field) pairs whose cell is below the lock; fields are the schema's few rows, a thousand at most."""
    known = [r["field"] for r in few(fields.select("field").distinct(), 1_000)]
    grid = datasets.select(name).distinct().withColumn("field", F.explode(F.array(*map(F.lit, known)) if known else F.array().cast("array<string>")))
    joined = grid.join(cells.select(name, "field", "confidence"), [name, "field"], "left")
    return joined.withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).filter(F.col("confidence") < lock)


def gap_audit(cells: DataFrame, threshold: float, fields: Sequence[str] | None = None, types: DataFrame | None = None, name: str = "dataset_name") -> DataFrame:
    """Cells below a threshold; without collections and providers if ``types`` (name, type) is given."""
    d = cells.filter(F.col("confidence") < threshold)
    if fields:
        d = d.filter(F.col("field").isin(*fields))
    if types is not None:
        d = d.join(types.filter(F.col("type").isin("Collection", "Provider")).select(name), name, "left_anti")
    return d.select(name, "field", "confidence")


def relevance_gate(rows: DataFrame, column: str, gate: float = GATE) -> DataFrame:
    return rows.filter(confidence(column) >= gate)


def needs_repair(cells: DataFrame, name: str, thresholds: dict[str, float], default: float) -> DataFrame:
    """Datasets with a cell that is missing or below its field's threshold."""
    limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv]), F.col("field")), F.lit(default)) if thresholds else F.lit(default)
    return cells.groupBy(name).agg(F.max((cell_missing("value") | (F.col("confidence") < limit)).cast("int")).alias("needs_repair"))


def metrics(cells: DataFrame, name: str = "dataset_name") -> DataFrame:
    """Average confidence, share of filled cells and number of datasets; zeros for an empty catalog."""
    filled = (~cell_missing("value")).cast("double")
    d = cells.agg(F.avg("confidence").alias("avg_conf"), F.avg(filled).alias("completeness"), F.countDistinct(name).alias("count"))
    return d.select(F.coalesce("avg_conf", F.lit(0.0)).alias("avg_conf"), F.coalesce("completeness", F.lit(0.0)).alias("completeness"), "count")


def completion(cells: DataFrame, name: str = "dataset_name", high: float = 0.80) -> DataFrame:
    return cells.groupBy(name).agg((F.avg((F.col("confidence") >= high).cast("double")) * 100).alias("completeness_pct"))


def repair_delta(before: DataFrame, after: DataFrame, name: str = "dataset_name") -> DataFrame:
    """Metrics before, after and their difference, a row each."""
    a = metrics(before, name).withColumns({"_a": F.lit(1)})
    b = metrics(after, name).select(*[F.col(c).alias(f"{c}_after") for c in ("avg_conf", "completeness", "count")])
    d = a.join(F.broadcast(b), F.lit(True))
    row = lambda c: F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("before"), F.col(f"{c}_after").cast("double").alias("after"), (F.col(f"{c}_after") - F.col(c)).cast("double").alias("delta"))
    return d.select(F.inline(F.array(*[row(c) for c in ("avg_conf", "completeness", "count")])))


def report(cells: DataFrame, fields: Sequence[str], name: str = "dataset_name", high: float = 0.80) -> DataFrame:
    """One row a dataset, one column a field, and the share of cells of high confidence as text."""
    wide = cells.groupBy(name).pivot("field", list(fields)).agg(F.max_by("value", F.struct("confidence", "value")))
    return wide.join(completion(cells, name, high), name).withColumn("completeness", F.format_string("%.1f%%", "completeness_pct")).drop("completeness_pct")


def lock_fields(cells: DataFrame, types: DataFrame, fields: Sequence[str], name: str = "dataset_name") -> DataFrame:
    """Missing cells of collections and providers in ``fields`` become ``[Skipped]`` with confidence 1."""
    d = cells.join(types.select(name, "type"), name, "left")
    skip = F.col("type").isin("Collection", "Provider") & F.col("field").isin(*fields) & cell_missing("value")
    skip = F.coalesce(skip, F.lit(False))
    return d.withColumns({"value": F.when(skip, "[Skipped]").otherwise(F.col("value")), "confidence": F.when(skip, 1.0).otherwise(F.col("confidence"))}).drop("type")


def entity_type(name: Column | str) -> Column:
    """Dataset, Collection, Provider by name, null where the name says nothing: leaf patterns, exact names, keywords, overrides."""
    s = strip(F.lower(text_or_empty(name)))
    leaf = reduce(lambda a, b: a | b, [s.rlike(p) for p in LEAF_PATTERNS])
    exact = ~leaf & s.isin(*EXACT_COLLECTIONS)
    collection = exact | (~leaf & any_of(s, COLLECTION_KEYWORDS))
    provider = ~leaf & ~collection & any_of(s, PROVIDER_KEYWORDS)
    family = s.contains("pems") | s.contains("ett") | (s.rlike(r"\bm\b") & (F.length(s) > 4))
    return F.when(leaf | (family & ~collection), "Dataset").when(collection, "Collection").when(provider, "Provider")


def self_references(rows: DataFrame, name: str, terms: Sequence[Column], least: float = 0.9) -> DataFrame:
    """Adds ``self_reference``: whether a name is one of a project's own terms, with or without ``dataset``, or all but one.

    Terms of more than three characters also count by a ratio above ``least``; they are few, and texts of the row's project.
    """
    d = rows.withColumn("_name", strip(F.lower(text_or_empty(name))))
    found = F.lit(False)
    for k, term in enumerate(terms):
        d = d.withColumn(f"_term{k}", strip(F.lower(text_or_empty(term))))
        own = F.col(f"_term{k}")
        # Only pairs whose lengths allow the ratio, and that are not decided yet, are compared.
        near = (F.length(own) > 3) & (2 * F.least(F.length(own), F.length("_name")) > least * (F.length(own) + F.length("_name")))
        d = d.withColumn(f"_ratio{k}", F.when(near & (own != F.col("_name")), similarity("_name", f"_term{k}")))
        same = (own != "") & ((F.col("_name") == own) | (F.col("_name") == F.concat(own, F.lit(" dataset"))))
        found = found | same | F.coalesce(F.col(f"_ratio{k}") > least, F.lit(False))
    return d.withColumn("self_reference", found).select(*rows.columns, "self_reference")


def demoted(rows: DataFrame, name: str, terms: Sequence[Column], conf: str) -> DataFrame:
    """Rows with the assignment confidence of self-references set to ``0.0``."""
    d = self_references(rows, name, terms)
    return d.withColumn(conf, F.when(F.col("self_reference"), "0.0").otherwise(F.col(conf))).drop("self_reference")


def effective_name(*candidates: Column, aliases: Column | None = None, at: int = 1, invalid: Sequence[str] = INVALID_NAMES) -> Column:
    """First valid name of several; the aliases' first valid entry stands at place ``at``."""
    ok = lambda c: ~F.lower(c).isin(*invalid) & ~c.startswith("DS_")
    found = [F.when(ok(strip(text_or_empty(c))), strip(text_or_empty(c))) for c in candidates]
    if aliases is not None:
        listed = F.filter(F.transform(F.split(text_or_empty(aliases), ","), strip), ok)
        found.insert(at, F.get(listed, 0))
    return F.coalesce(*found, strip(text_or_empty(candidates[0])))


def wipe_fields(cells: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Cells of ``fields`` become missing, whatever their confidence."""
    hit = F.col("field").isin(*fields)
    return cells.withColumn("value", F.when(hit, "[missing]").otherwise(F.col("value"))).withColumn("confidence", F.when(hit, 0.0).otherwise(F.col("confidence")))


def clean_url_cells(cells: DataFrame, fields: Sequence[str]) -> DataFrame:
    """URL cells tidied; those of banned domains become missing."""
    hit = F.col("field").isin(*fields)
    banned = hit & is_banned_url("value")
    value = F.when(banned, "[missing]").when(hit & (strip(text_or_empty("value")) != ""), tidy_url("value")).otherwise(F.col("value"))
    return cells.select(*[c for c in cells.columns if c not in ("value", "confidence")], value.alias("value"), F.when(banned, 0.0).otherwise(F.col("confidence")).alias("confidence"))


def exact_dedupe(cells: DataFrame, name: Column, order: str) -> DataFrame:
    """Cells of items with the same effective name folded into the first item, in order.

    A missing value takes the other's cell, and a cell of greater confidence replaces it.
    """
    key = F.lower(strip(name))
    d = cells.withColumn("_key", key).filter(~F.col("_key").isin(*INVALID_NAMES))
    none = lambda v: F.coalesce(v, F.lit("")).isin("", "[missing]")
    state = lambda v, c: F.struct(v.alias("value"), c.cast("double").alias("confidence"))
    step = lambda s, x: F.when((none(s["value"]) & ~none(x["value"])) | (x["confidence"] > s["confidence"]), state(x["value"], x["confidence"])).otherwise(s)
    all_ = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "value", "confidence")))
    folded = F.aggregate(F.slice(F.col("_all"), 2, 1 << 30), state(F.col("_all")[0]["value"], F.col("_all")[0]["confidence"]), step)
    return d.groupBy("_key", "field").agg(all_.alias("_all")).select(F.col("_key").alias("name"), "field", folded.alias("_c")).select("name", "field", "_c.value", "_c.confidence")


def golden_fastpath(cells: DataFrame, golden: DataFrame, name: str, keys: Sequence[Column], order: str, least: float = 0.85) -> DataFrame:
    """Golden values for catalog cells: ``golden`` rows (field, value, confidence) match by any of ``keys``.

    Keys and names are compared by their letters and digits; the most confident row wins, the
    earliest of those that tie.
    """
    from quarrystone.functions.text import alphanumeric

    ready = golden.filter((F.col("confidence") >= least) & ~cell_missing("value"))
    spread = ready.withColumn("_key", F.explode(F.array_distinct(F.array(*[alphanumeric(k) for k in keys])))).filter("_key <> ''")
    best = Window.partitionBy("_key", "field").orderBy(F.desc("confidence"), F.asc(order))
    top = spread.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("_key", "field", F.col("value").alias("golden_value"))
    return cells.withColumn("_key", alphanumeric(name)).join(top, ["_key", "field"], "left").drop("_key")


def similar_url(a: Column, b: Column) -> Column:
    return clean_url(a) == clean_url(b)
