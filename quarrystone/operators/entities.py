"""Entity resolution: pair rules, blocking, leader groups and record fusion.

Records have an id, a name (variant or else canonical), type, counts of time points (t) and
variables (v), and primary and data URLs.  A pair is decided by the first rule that holds.  Rules of
weak evidence need a provider's word; without one they are no match, so results are deterministic.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.constants import MISSING_ENTITY
from quarrystone.functions.text import clean_name, clean_url, distinct_variants, first_integer, is_generic_url, strip, text_or_empty
from quarrystone.functions.values import confidence, similarity
from quarrystone.operators import name_join
from quarrystone.operators.work import folder, written

#: Names of a block, on average, whose pairs are compared in one task.
BLOCK = 1_000
#: Ratios at which closest matches are sought by a join, falling.
THRESHOLDS = (0.9, 0.81)
ARBITRATED = ("WEAK", "MISMATCH", "FINGERPRINT")


def prepared(records: DataFrame, id_: str, name: Column, type_: Column, t: Column, v: Column, url: Column, data_url: Column, order: Sequence[Column], descending: bool = False) -> DataFrame:
    """Compared forms of the records, numbered in ``order``, or against it (ties by id, ascending)."""
    d = records.select(
        F.col(id_).alias("id"), text_or_empty(name).alias("name"), clean_name(name).alias("clean"), F.lower(strip(text_or_empty(type_))).alias("type"),
        first_integer(t).alias("t"), first_integer(v).alias("v"), clean_url(url).alias("url"), clean_url(data_url).alias("data_url"), *[o.alias(f"_o{k}") for k, o in enumerate(order)],
    )
    # Ranks of all records: ranges are sorted, ids rise within and over them.
    keys = [(F.desc if descending else F.asc)(f"_o{k}") for k in range(len(order))] + [F.asc("id")]
    ranked = d.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("ord", F.monotonically_increasing_id()).drop(*[f"_o{k}" for k in range(len(order))])
    # Written once, as numbers may fall otherwise when they are made again.
    return written(ranked, folder(records.sparkSession), "ranked")


def reason(pairs: DataFrame, later: str = "b", leader: str = "a") -> DataFrame:
    """Adds ``reason`` (empty for no match) and ``matched``: pairs have the prepared columns with both prefixes."""
    x, y = (lambda c: F.col(f"{later}_{c}")), (lambda c: F.col(f"{leader}_{c}"))
    cx, cy = x("clean"), y("clean")
    d = pairs.withColumn("_ratio", F.when((cx != "") & (cy != ""), similarity(cx, cy)).otherwise(0.0))
    r = F.col("_ratio")
    same_url = ((x("url") == y("url")) & ~is_generic_url(x("url"))) | ((x("data_url") == y("data_url")) & ~is_generic_url(x("data_url")))
    print_ = (x("t") > 10) & (y("t") > 10) & (x("v") > 0) & (y("v") > 0) & (x("t") == y("t")) & (x("v") == y("v")) & (r >= 0.40)
    least = F.when((F.length(cx) <= 8) | (F.length(cy) <= 8), 0.90).otherwise(0.82)
    inside = (F.length(cx) > 4) & (F.length(cy) > 4) & (cx.contains(cy) | cy.contains(cx))
    prefix = (F.length(cx) > 3) & (F.length(cy) > 3) & (cx.startswith(cy) | cy.startswith(cx))
    rule = (
        F.when(distinct_variants(x("name"), y("name")), "HARD_DISCRIMINATOR_CONFLICT")
        .when(same_url, "EXACT_URL_MATCH_WEAK_NAME").when(print_, "FINGERPRINT_STRONG")
        .when((cx == cy) & (cx != ""), "EXACT_NAME").when(r >= 0.90, "FUZZY_STRONG")
        .when((r >= least) | inside, "FUZZY_WEAK").when(prefix, "PREFIX_MATCH_WEAK").otherwise("")
    )
    known = lambda c: ~c.isin(*MISSING_ENTITY)
    clash = known(x("type")) & known(y("type")) & (x("type") != y("type"))
    full = F.when((rule != "") & (rule != "HARD_DISCRIMINATOR_CONFLICT") & clash, F.concat(rule, F.lit("_TYPE_MISMATCH"))).otherwise(rule)
    sure = ~(full.contains("WEAK") | full.contains("MISMATCH") | full.contains("FINGERPRINT"))
    return d.withColumn("reason", full).withColumn("needs_provider", (full != "") & (full != "HARD_DISCRIMINATOR_CONFLICT") & ~sure).withColumn("matched", (full != "") & (full != "HARD_DISCRIMINATOR_CONFLICT") & sure).drop("_ratio")


def candidate_pairs(d: DataFrame, fuzzy: bool = True, weak: bool = False) -> DataFrame:
    """Pairs (a earlier, b later) that some sure rule could match, with ``weak`` any rule, each once.

    Equal clean names, URLs and counts meet by equi joins.  For the fuzzy rules the distinct clean names
    are joined by similarity (``name_join``), for weak ones also by one name inside the other, and
    only the pairs that hold go back to their records.
    """
    left, right = (d.select(*[F.col(c).alias(f"{p}_{c}") for c in d.columns]) for p in ("a", "b"))
    keys = [
        F.when(F.col("clean") != "", F.concat(F.lit("n:"), "clean")),
        F.when(~is_generic_url("url"), F.concat(F.lit("u:"), "url")),
        F.when(~is_generic_url("data_url"), F.concat(F.lit("d:"), "data_url")),
        F.when((F.col("t") > 10) & (F.col("v") > 0), F.concat_ws(":", F.lit("f"), "t", "v")),
    ]
    spread = d.select("id", "ord", F.explode(F.array_compact(F.array(*keys))).alias("k"))
    a, b = (spread.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "ord", "k")]) for p in ("a", "b"))
    ids = a.join(b, (F.col("a_k") == F.col("b_k")) & (F.col("a_ord") < F.col("b_ord"))).select("a_id", "b_id")
    if fuzzy:
        names = name_join.numbered(d.filter("clean <> ''").select(F.col("clean").alias("name")), folder(d.sparkSession))
        found = name_join.similar(names, 0.82 if weak else 0.90)
        if weak:
            found = found.union(name_join.contained(names))
        of = d.join(names, d["clean"] == names["name"]).select("nid", "id", "ord")
        x, y = (of.select(F.col("nid").alias(p), F.struct("ord", "id").alias(f"{p}_r")) for p in ("x", "y"))
        met = found.join(x, "x").join(y, "y").select(F.least("x_r", "y_r").alias("a"), F.greatest("x_r", "y_r").alias("b"))
        ids = ids.union(met.select("a.id", "b.id"))
    return ids.distinct().join(left, "a_id").join(right, "b_id")


def matches(d: DataFrame, arbiter: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(a_id, b_id, a_ord, b_ord, reason) of matching pairs; ``arbiter`` may turn weak ones into matches."""
    judged = reason(candidate_pairs(d, weak=arbiter is not None))
    if arbiter:
        judged = arbiter(judged)
    return judged.filter("matched").select("a_id", "b_id", "a_ord", "b_ord", "reason")


def leader_groups(d: DataFrame, found: DataFrame) -> DataFrame:
    """(id, leader): each record joins the first earlier leader that it matches, else leads.

    A record leads unless it matches an earlier leader, so decisions run in order along match edges:
    each round decides the records all of whose earlier matches are decided, with one join.
    Rounds are bounded by the longest chain of matches.
    """
    path = folder(d.sparkSession)
    d = written(d.select("id"), path, "ids")
    left = written(found.select(F.col("b_id").alias("id"), F.col("a_id").alias("other"), F.col("a_ord").alias("at")), path, "edges")
    decided = written(d.join(left.select("id").distinct(), "id", "left_anti").select("id", F.col("id").alias("leader")), path, "decided-0")
    step = 0
    while not left.isEmpty():
        step += 1
        known = left.join(decided.select(F.col("id").alias("other"), "leader"), "other", "left")
        leads = F.col("leader") == F.col("other")
        judged = known.groupBy("id").agg(F.count_if(F.col("leader").isNull()).alias("unknown"), F.min_by(F.when(leads, F.col("other")), F.when(leads, F.col("at"))).alias("leader"))
        new = judged.filter("unknown = 0").select("id", F.coalesce("leader", "id").alias("leader"))
        decided = written(decided.unionByName(new), path, f"decided-{step}")
        left = written(left.join(decided.select("id"), "id", "left_anti"), path, f"left-{step}")
    return decided


def fuse(groups: DataFrame, records: DataFrame, id_: str, order: str, urls: Sequence[str] = (), texts: Sequence[str] = (), others: Sequence[str] = ()) -> DataFrame:
    """Golden record of each group: its leader's cells after all other members', in order.

    ``groups`` has (id, leader).  URL cells gain new targets, texts the longer one, other cells the
    more certain value; a cell of confidence 1 stays.  Confidences are the columns ``<field> (C)``.
    """
    d = groups.join(records, groups["id"] == records[id_]).drop(groups["id"])
    none = lambda v: F.coalesce(v, F.lit("")).isin(*MISSING_ENTITY)
    state = lambda v, c: F.struct(v.alias("value"), c.cast("double").alias("confidence"))

    def url_step(s, x):
        target = F.regexp_extract(x["value"], r'(?i)=HYPERLINK\("([^"]+)"', 1)
        base = F.when(target != "", target).otherwise(x["value"])
        add = state(F.concat(s["value"], F.lit(' & " | Alt: '), F.replace(base, F.lit('"'), F.lit('""')), F.lit('"')), F.greatest(s["confidence"], x["confidence"]))
        return F.when(none(x["value"]), s).when(none(s["value"]), state(x["value"], x["confidence"])).when(s["value"].contains(base), s).otherwise(add)

    def text_step(s, x):
        longer = state(x["value"], F.greatest(s["confidence"], x["confidence"]))
        return F.when(none(x["value"]), s).when(none(s["value"]), state(x["value"], x["confidence"])).when(F.length(x["value"]) > F.length(s["value"]), longer).otherwise(s)

    def other_step(s, x):
        take = (x["confidence"] == 1.0) | (none(s["value"]) & ~none(x["value"])) | (~none(x["value"]) & (x["confidence"] > s["confidence"]))
        return F.when(take, state(x["value"], x["confidence"])).otherwise(s)

    def certain(step):
        return lambda s, x: F.when(s["confidence"] == 1.0, s).otherwise(step(s, x))

    kinds = [*((f, url_step) for f in urls), *((f, text_step) for f in texts), *((f, other_step) for f in others)]
    cells = [F.struct(F.when(F.col(id_) == F.col("leader"), 0).otherwise(1).alias("late"), F.col(order).alias("o"), strip(text_or_empty(F.col(f"`{f}`"))).alias("value"), confidence(F.col(f"`{f} (C)`")).alias("confidence")) for f, _ in kinds]
    listed = d.groupBy("leader").agg(F.count(F.lit(1)).alias("members"), *[F.array_sort(F.collect_list(c)).alias(f"_l{k}") for k, c in enumerate(cells)])
    out = [F.col("leader"), F.col("members")]
    for k, (f, step) in enumerate(kinds):
        a = F.col(f"_l{k}")
        folded = F.aggregate(F.slice(a, 2, 1 << 30), state(a[0]["value"], a[0]["confidence"]), certain(step))
        out += [folded["value"].alias(f), folded["confidence"].alias(f"{f} (C)")]
    return listed.select(*out)


def merge_summary(groups: DataFrame, names: DataFrame, id_: str, name: str) -> DataFrame:
    """Per leader: number of members and the absorbed names, sorted."""
    d = groups.join(names, groups["id"] == names[id_])
    absorbed = F.when(F.col("id") != F.col("leader"), F.col(name))
    return d.groupBy("leader").agg(F.count(F.lit(1)).alias("members"), F.array_join(F.array_sort(F.collect_set(absorbed)), ", ").alias("absorbed"))


def _beating(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple]:
    """(name, job, match, score, ord) of the best of ``right`` for each name of ``left``, if it can beat or tie its ``low``.

    Common characters bound the ratio from above, as each is matched once at most.
    """
    names = [*left["name"], *right["name"]]
    at = {c: k for k, c in enumerate(sorted(set("".join(names))))}
    counts = np.zeros((len(names), max(len(at), 1)), np.int32)
    for k, name in enumerate(names):
        for c in name:
            counts[k, at[c]] += 1
    theirs, jobs, others = counts[len(left) :], right["job"].to_numpy(), right["name"].tolist()
    ids, ords = right["id"].tolist(), right["ord"].tolist()
    size, matcher = theirs.sum(1), difflib.SequenceMatcher(None)
    for k, (name, job, low) in enumerate(zip(left["name"], left["job"], left["low"])):
        total = size + len(name)
        bound = np.where(total > 0, 2.0 * np.minimum(theirs, counts[k]).sum(1) / np.maximum(total, 1), 1.0)
        best = None
        able = np.flatnonzero((bound > 0) & (bound >= low) & (jobs != job))
        for m in able[np.argsort(-bound[able], kind="stable")].tolist():
            if bound[m] < low:
                break
            matcher.set_seqs(name, others[m])
            score = matcher.ratio()
            if score > 0 and (score > low or (score == low and (best is None or ords[m] < best[4]))):
                low, best = score, (name, job, ids[m], score, ords[m])
        if best:
            yield best


def closest_match(rows: DataFrame, id_: str, name: str, job: str, order: str) -> DataFrame:
    """For each record the most similar name of another job, the earliest of equals; null where none is similar at all.

    Thresholds fall: equal names, then ratios of ``THRESHOLDS`` by ``name_join``.  All pairs of a ratio
    at a threshold are seen there, so a name whose best reaches it is done; those left ask at the
    next.  Names that are like no other, with a best below the last threshold, have no join that
    leaves out most of the others: they, and no others, meet all names in pairs of blocks of about
    ``BLOCK``, where only names are compared whose common characters allow more than what is known.

    A name sends its two earliest jobs only, as one of them is not the asking one.
    """
    s = F.lower(strip(text_or_empty(name)))
    d = rows.select(F.col(id_).alias("id"), s.alias("name"), F.col(job).alias("job"), F.col(order).alias("ord"))
    path = folder(rows.sparkSession)
    names = name_join.numbered(d, path)
    asked = d.filter("job is not null").groupBy("name", "job").agg(F.min("ord").alias("ord"), F.min_by("id", "ord").alias("id"))
    asked = written(asked.join(names, "name").select("nid", "name", "job", "ord", "id"), path, "asked")
    two = lambda x, key, *by: x.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*by))).filter("_r <= 2").drop("_r")
    offered = written(two(asked, "nid", "ord"), path, "offered")
    theirs = offered.select(F.col("nid").alias("y"), F.col("job").alias("_job"), F.col("ord").alias("_ord"), F.col("id").alias("match"))

    def top(found: DataFrame) -> DataFrame:
        """Of (x, _job, match, score, _ord) the best of each x, and the best of another job."""
        jobs = found.groupBy("x", "_job").agg(F.max_by(F.struct("score", "_ord", "match"), F.struct("score", -F.col("_ord"))).alias("m")).select("x", "_job", "m.*")
        return two(jobs, "x", F.desc("score"), "_ord")

    best = written(top(names.select(F.col("nid").alias("x"), F.col("nid").alias("y"), F.lit(1.0).alias("score")).join(theirs, "y").drop("y")), path, "best-0")

    def answers() -> DataFrame:
        mine = asked.select(F.col("nid").alias("x"), "name", "job")
        other = mine.join(best, "x", "left").filter(F.col("_job").isNull() | (F.col("_job") != F.col("job")))
        one = other.groupBy("x", "name", "job").agg(F.max_by(F.struct("match", "score", "_ord"), F.struct("score", -F.col("_ord"))).alias("m"))
        return mine.join(one.select("x", "job", "m.*"), ["x", "job"], "left")

    reached = 1.0
    for step, least in enumerate(THRESHOLDS, 1):
        left = answers().filter(F.coalesce("score", F.lit(0.0)) < reached).select(F.col("x").alias("nid")).distinct()
        pairs = name_join.named(name_join.candidates(names, least, written(left, path, f"left-{step}")), names, least)
        scored = pairs.withColumn("score", similarity("x_name", "y_name")).filter("score > 0").select("x", "y", "score")
        best, reached = written(top(best.unionByName(scored.join(theirs, "y").drop("y"))), path, f"best-{step}"), least
    found = written(answers(), path, "found")
    rest = found.filter(F.coalesce("score", F.lit(0.0)) < reached).select("name", "job", F.coalesce("score", F.lit(0.0)).alias("low"))
    k = offered.count() // BLOCK + 1
    blocks = rest.count() // BLOCK + 1
    dealt = lambda n: F.pmod(F.xxhash64("name", "job"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = offered.select("name", "job", "ord", "id").withColumn("j", dealt(k)).withColumn("i", every(blocks))
    left = rest.withColumn("i", dealt(blocks)).withColumn("j", every(k))
    types = {f.name: f.dataType.simpleString() for f in d.schema}
    out = f"name string, job {types['job']}, match {types['id']}, score double, _ord {types['ord']}"

    def beating(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_beating(a, b)) if len(a) and len(b) else [], columns=["name", "job", "match", "score", "_ord"])

    more = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(beating, out)
    known = found.filter("score > 0").select("name", "job", "match", "score", "_ord").unionByName(more)
    known = known.groupBy("name", "job").agg(F.max_by(F.struct("match", "score"), F.struct("score", -F.col("_ord"))).alias("m")).select("name", "job", "m.*")
    return d.join(known, ["name", "job"], "left").select("id", "match", "score")


def duplicate_blocks(rows: DataFrame, id_: str, key: Column) -> DataFrame:
    """Keys of several rows: number of rows and smallest id."""
    return rows.groupBy(key.alias("block")).agg(F.count(F.lit(1)).alias("n"), F.min(id_).alias("first_id")).filter("n > 1")


def arbitrate(pairs: DataFrame, provider: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None) -> DataFrame:
    """Weak matches by a provider's word, asked once for each distinct pair of names; none without one."""
    if provider is None:
        return pairs
    asked = pairs.filter("needs_provider").select(F.least("a_name", "b_name").alias("x"), F.greatest("a_name", "b_name").alias("y"), "reason").distinct()
    said = asked.mapInPandas(provider, "x string, y string, reason string, same boolean")
    on = (F.least("a_name", "b_name") == F.col("x")) & (F.greatest("a_name", "b_name") == F.col("y")) & (pairs["reason"] == F.col("_why"))
    joined = pairs.join(said.select("x", "y", F.col("reason").alias("_why"), "same"), on, "left")
    return joined.withColumn("matched", F.col("matched") | (F.col("needs_provider") & F.coalesce("same", F.lit(False)))).drop("x", "y", "_why", "same")
