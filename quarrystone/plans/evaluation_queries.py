"""Queries that score extraction runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions.text import or_not_specified
from quarrystone.operators import evaluation, inventory

from .fixtures import t


def jury_vote(spark, d):
    facts = t(spark, d, "events").select("user_id", F.hour("ts").cast("long").alias("hour"), F.col("event_type").alias("norm_value"))
    out = evaluation.consensus(evaluation.jury_vote(facts, ["user_id", "hour"]), ["user_id", "hour"])
    return out.withColumn("vote_pct", F.round("vote_pct", 6))


_VOTE = """
WITH v AS (SELECT user_id, hour(ts) AS hour, event_type AS norm_value, count(*) AS votes FROM events GROUP BY ALL),
a AS (SELECT *, CAST(sum(votes) OVER (PARTITION BY user_id, hour) AS BIGINT) AS total_votes FROM v)
SELECT user_id, hour, norm_value, votes, total_votes, round(votes / total_votes, 6) AS vote_pct FROM a QUALIFY row_number() OVER (PARTITION BY user_id, hour ORDER BY votes DESC, norm_value) = 1
"""


def novel_verdict(spark, d):
    facts = t(spark, d, "documents").select("source", "lang", (F.col("doc_id") % 7).alias("run"))
    return evaluation.reality(facts, "source", "lang", "run")


def run_numbering(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey")
    return evaluation.run_numbers(o, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


def _scored(spark, d):
    """Documents with a label: the golden value is the quality, the extracted one follows from the length."""
    docs = t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    j = t(spark, d, "labels").join(docs, "doc_id")
    golden = F.when(F.col("quality") == 1, "good").otherwise("not specified")
    said = F.when(F.col("n_chars") % 5 == 0, "not specified").when(F.col("n_chars") % 7 == 0, "fine").otherwise("good")
    return j.select("doc_id", "lang", "source", golden.alias("golden"), said.alias("value"))


_SCORED = """s AS (SELECT lang, source, CASE WHEN quality = 1 THEN 'good' ELSE 'not specified' END AS golden, CASE WHEN n_chars % 5 = 0 THEN 'not specified' WHEN n_chars % 7 = 0 THEN 'fine' ELSE 'good' END AS value FROM labels JOIN documents USING (doc_id)),
k AS (SELECT *, CASE WHEN golden = value THEN CASE WHEN golden = 'not specified' THEN 'TN' ELSE 'TP' END WHEN value = 'not specified' THEN 'FN' ELSE 'FP' END AS st FROM s),
c AS (SELECT source, lang, count(*) FILTER (WHERE st = 'TP') AS tp, count(*) FILTER (WHERE st = 'FP') AS fp, count(*) FILTER (WHERE st = 'FN') AS fn, count(*) FILTER (WHERE st = 'TN') AS tn FROM k GROUP BY ALL),
p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c),
m AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM p)"""


def _confusion(spark, d):
    s = _scored(spark, d).withColumn("status", evaluation.status(F.col("value"), F.col("golden"), F.lit(False)))
    return evaluation.confusion(s, ["source", "lang"])


def confusion(spark, d):
    c = _confusion(spark, d)
    return c.select("source", "lang", "tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1", "hallucination_rate")])


def leaderboard(spark, d):
    b = evaluation.f1_leaderboard(_confusion(spark, d), "source", "lang")
    return b.select("source", *[F.round(x, 6).alias(x) for x in ("mean_f1", "std_f1", "mean_precision")], "runs")


def two_level(spark, d):
    s = _scored(spark, d).withColumn("truth", F.when(F.col("golden") == "good", "good").otherwise(""))
    return evaluation.run_precision(s, "source", "lang", "truth", F.col("value") == F.col("truth"), F.col("value") == "fine")


_TWO = """
WITH s AS (SELECT source, lang, CASE WHEN quality = 1 THEN 'good' ELSE '' END AS truth, CASE WHEN n_chars % 5 = 0 THEN 'not specified' WHEN n_chars % 7 = 0 THEN 'fine' ELSE 'good' END AS value FROM labels JOIN documents USING (doc_id)),
r AS (SELECT source, lang, count(*) AS n, count(*) FILTER (WHERE truth <> '') AS gradable, count(*) FILTER (WHERE truth <> '' AND value = truth) AS correct, count(*) FILTER (WHERE value = 'fine') AS severe FROM s GROUP BY ALL),
p AS (SELECT *, CASE WHEN gradable > 0 THEN correct / gradable * 100 ELSE 0 END AS precision FROM r)
SELECT source, count(*) AS runs, round(avg(n), 1) AS avg_yield, round(avg(correct), 1) AS avg_correct, round(avg(n) - avg(correct) - avg(severe), 1) AS avg_errors, round(avg(severe), 1) AS avg_severe, round(avg(precision), 2) AS precision FROM p GROUP BY source
"""


def melt(spark, d):
    return evaluation.melt(t(spark, d, "part"), ["p_partkey"], ["p_name", "p_brand", "p_type"]).select("p_partkey", "field", "norm_value")


def adjudicated(spark, d):
    """Votes of line items on a part's return flag against a golden flag that follows from its size.

    Customers, with votes of their orders' states, have no golden row, and suppliers no vote.
    """
    li = t(spark, d, "lineitem").select(F.lit("part").alias("kind"), F.col("l_partkey").alias("id"), F.lower("l_returnflag").alias("norm_value"))
    o = t(spark, d, "orders").select(F.lit("customer").alias("kind"), F.col("o_custkey").alias("id"), F.lower("o_orderstatus").alias("norm_value"))
    vote = evaluation.consensus(evaluation.jury_vote(li.unionByName(o), ["kind", "id"]), ["kind", "id"])
    flag = lambda x: F.when(F.col(x) % 2 == 0, "n").otherwise("r").alias("golden")
    p = t(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), flag("p_size"))
    s = t(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), flag("s_nationkey"))
    out = evaluation.adjudicate(vote, p.unionByName(s), ["kind", "id"], hallucinated=F.col("id") % 101 == 0)
    return out.groupBy("action", "truth").agg(F.count(F.lit(1)).alias("n"))


_ADJ = """
WITH v AS (SELECT kind, id, nv, count(*) AS votes FROM (SELECT 'part' AS kind, l_partkey AS id, lower(l_returnflag) AS nv FROM lineitem UNION ALL SELECT 'customer', o_custkey, lower(o_orderstatus) FROM orders) GROUP BY ALL),
a AS (SELECT *, votes / sum(votes) OVER (PARTITION BY kind, id) AS pct FROM v QUALIFY row_number() OVER (PARTITION BY kind, id ORDER BY votes DESC, nv) = 1),
g AS (SELECT 'part' AS kind, p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'n' ELSE 'r' END AS golden FROM part UNION ALL SELECT 'supplier', s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'n' ELSE 'r' END FROM supplier),
b AS (SELECT coalesce(a.id, g.id) AS id, coalesce(nv, '') AS c, coalesce(golden, '') AS g, coalesce(pct, 0) AS p FROM a FULL JOIN g ON a.kind = g.kind AND a.id = g.id),
k AS (SELECT *, CASE WHEN id % 101 = 0 THEN 'Hallucinated Dataset' WHEN g = c AND g <> '' THEN 'Match' WHEN g = '' AND p >= 0.5 THEN 'Novel Discovery (Merge)' WHEN g = '' THEN 'Weak Novel (Ignore)' WHEN c <> '' AND p >= 0.6 THEN 'Conflict (Repair KB)' WHEN c <> '' THEN 'GoldenKB Maintained (Weak Conflict)' ELSE 'GoldenKB Maintained (No Extraction)' END AS action FROM b)
SELECT action, CASE WHEN action IN ('Hallucinated Dataset', 'Weak Novel (Ignore)') THEN '' WHEN action IN ('Novel Discovery (Merge)', 'Conflict (Repair KB)') THEN c ELSE g END AS truth, count(*) AS n FROM k GROUP BY ALL
"""


def presence(spark, d):
    a = t(spark, d, "customer").filter("c_acctbal > 0").select(F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).alias("nation"), F.col("c_mktsegment").alias("segment")).distinct()
    b = t(spark, d, "supplier").select(F.when(F.col("s_nationkey") != 3, F.col("s_nationkey")).alias("nation"), F.lit("BUILDING").alias("segment")).distinct()
    return evaluation.presence(a, b, ["nation", "segment"])


def rosetta(spark, d, mode="lenient"):
    """Nation names said for customers, with aliases known to mean the same."""
    nation = t(spark, d, "nation")
    c = t(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    said = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("Rep. "), "n_name")).when(F.col("c_custkey") % 4 == 1, F.lower("n_name")).when(F.col("c_custkey") % 4 == 2, F.lit("none")).otherwise("elsewhere")
    facts = c.select(F.col("c_nationkey").alias("ds"), F.lit("name").alias("attr"), said.alias("value"))
    golden = nation.filter("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("ds"), F.lit("name").alias("attr"), F.col("n_name").alias("golden"))
    alias = nation.select(F.col("n_nationkey").alias("ds"), F.lit("name").alias("attr"), F.concat(F.lit("rep. "), F.lower("n_name")).alias("value"))
    return evaluation.score(facts, golden, alias, ["ds", "attr"], mode).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _rosetta_sql(mode):
    alike = "CASE WHEN g = 'not specified' THEN 'True Negative' ELSE 'True Positive' END" if mode == "strict" else "'True Positive'"
    return f"""
WITH f AS (SELECT n_name, CASE c_custkey % 4 WHEN 0 THEN 'Rep. ' || n_name WHEN 1 THEN lower(n_name) WHEN 2 THEN 'not specified' ELSE 'elsewhere' END AS v, CASE WHEN n_nationkey % 5 <> 0 THEN n_name ELSE 'not specified' END AS g FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT CASE WHEN lower(v) = lower(g) THEN CASE WHEN g = 'not specified' THEN 'True Negative' ELSE 'True Positive' END WHEN lower(v) = 'rep. ' || lower(n_name) THEN {alike} WHEN v = 'not specified' AND g <> 'not specified' THEN 'False Negative' ELSE 'False Positive' END AS status, count(*) AS n FROM f GROUP BY 1
"""


def fractions(spark, d):
    return evaluation.fractions(t(spark, d, "orders"), "o_orderstatus").withColumn("pct", F.round("pct", 6))


def without_agent(spark, d):
    """Documents of sources that no golden source knows, unless an agent found them."""
    docs = t(spark, d, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 3 == 0, "Deep Research").otherwise("RAG").alias("found_by"))
    known = spark.createDataFrame([(f"src{k}",) for k in range(6)], "source string")
    return evaluation.without_agent_finds(docs, known, "source", "found_by").groupBy("source", "found_by").agg(F.count(F.lit(1)).alias("n"))


def matrix(spark, d):
    o = t(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    m = inventory.completion_matrix(o, ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], "o_custkey")
    return m.select("o_orderpriority", *[F.col(c).cast("long").alias(c.lower() + "_runs") for c in ("F", "O", "P")])


def missing(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("nation"))
    s = t(spark, d, "customer").select(F.col("c_mktsegment").alias("segment")).distinct()
    actual = t(spark, d, "customer").filter("c_acctbal > 9500").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return inventory.missing_combinations([n, s], actual)


def jobs(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "ts")
    return inventory.anchored_jobs(e, "user_id", "ts", "event_id").groupBy("user_id", "job").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


_JOBS = """
WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
j AS (
  SELECT user_id, event_id, k, ts AS started, CAST(1 AS BIGINT) AS job FROM e WHERE k = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.k, CASE WHEN epoch_us(e.ts) - epoch_us(j.started) > 14400000000 THEN e.ts ELSE j.started END, CASE WHEN epoch_us(e.ts) - epoch_us(j.started) > 14400000000 THEN j.job + 1 ELSE j.job END
  FROM j JOIN e ON e.user_id = j.user_id AND e.k = j.k + 1)
SELECT user_id, job, count(*) AS n, min(event_id) AS first_event FROM j GROUP BY ALL
"""


def phases(spark, d):
    e = t(spark, d, "events")
    p = inventory.phase_roi(e.withColumn("secs", F.col("event_id") % 60 + 1), "event_type", F.floor("value") - 5, "secs", "event_id")
    return p.select("event_type", "net_added", "seconds", F.round("velocity", 6).alias("velocity"), F.round("time_pct", 6).alias("time_pct"), "best")


_PHASES = """
WITH p AS (SELECT event_type, CAST(sum(greatest(floor(value) - 5, 0)) AS BIGINT) AS net_added, CAST(sum(event_id % 60 + 1) AS BIGINT) AS seconds, min(event_id) AS f FROM events GROUP BY event_type),
v AS (SELECT *, CASE WHEN seconds > 0 THEN net_added * 60 / seconds ELSE 0 END AS velocity FROM p)
SELECT event_type, net_added, seconds, round(velocity, 6) AS velocity, round(seconds * 100 / sum(seconds) OVER (), 6) AS time_pct, row_number() OVER (ORDER BY velocity DESC, f) = 1 AS best FROM v
"""


def timings(spark, d):
    s = inventory.timing_stats(t(spark, d, "events"), "event_type", "value")
    return s.select("event_type", "calls", *[F.round(x, 4).alias(x) for x in ("total", "mean", "sd")])


def families(spark, d):
    e = t(spark, d, "events")
    return inventory.family_totals(e, "event_type", ["click", "view"], F.lit(1))


def series(spark, d):
    """Samples of a user, every seventh one a mark instead of a number."""
    e = t(spark, d, "events").select("user_id", F.when(F.col("event_id") % 7 == 0, "CONTAINER_DEAD").otherwise(F.col("event_id").cast("string")).alias("sample"))
    return inventory.sampled_peaks(e, "user_id", "sample").withColumn("mean", F.round("mean", 6))


def golden_last(spark, d):
    return evaluation.last_wins(t(spark, d, "orders"), ["o_custkey"], "o_orderstatus", "o_orderkey")


def normal_values(spark, d):
    p = t(spark, d, "part").select("p_partkey", or_not_specified(F.when(F.col("p_partkey") % 5 == 0, F.lit(" None ")).otherwise(F.concat(F.lit("  "), "p_name"))).alias("value"))
    return p


QUERIES = {
    "eval_jury_vote": (jury_vote, _VOTE),
    "eval_novel_verdict": (novel_verdict, "WITH n AS (SELECT count(*) AS total_runs FROM (SELECT DISTINCT lang, doc_id % 7 FROM documents)), r AS (SELECT source, count(DISTINCT (lang, doc_id % 7)) AS runs FROM documents GROUP BY source) SELECT source, runs, total_runs, CASE WHEN runs >= greatest(3.0, total_runs * 0.15) THEN 'REAL_DISCOVERY' ELSE 'HALLUCINATED_DATASET' END AS verdict FROM r, n"),
    "eval_run_numbers": (run_numbering, "SELECT o_custkey, o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS run FROM orders"),
    "eval_confusion": (confusion, f"WITH {_SCORED} SELECT source, lang, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(CASE WHEN tp + fp + fn + tn > 0 THEN fp / (tp + fp + fn + tn) ELSE 0 END, 6) AS hallucination_rate FROM m"),
    "eval_f1_leaderboard": (leaderboard, f"WITH {_SCORED} SELECT source, round(avg(f1), 6) AS mean_f1, round(coalesce(stddev_samp(f1), 0), 6) AS std_f1, round(avg(precision), 6) AS mean_precision, count(DISTINCT lang) AS runs FROM m GROUP BY source"),
    "eval_two_level_precision": (two_level, _TWO),
    "eval_golden_melt": (melt, "SELECT p_partkey, f AS field, lower(v) AS norm_value FROM (SELECT p_partkey, unnest(['p_name', 'p_brand', 'p_type']) AS f, unnest([p_name, p_brand, p_type]) AS v FROM part) WHERE v <> ''"),
    "eval_adjudicate_outer": (adjudicated, _ADJ),
    "eval_presence": (presence, "WITH a AS (SELECT DISTINCT CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS nation, c_mktsegment AS segment FROM customer WHERE c_acctbal > 0), b AS (SELECT DISTINCT CASE WHEN s_nationkey <> 3 THEN s_nationkey END AS nation, 'BUILDING' AS segment FROM supplier) SELECT nation, segment, CASE WHEN max(x) = 1 AND max(y) = 1 THEN 'both' WHEN max(x) = 1 THEN 'left_only' ELSE 'right_only' END AS side FROM (SELECT *, 1 AS x, 0 AS y FROM a UNION ALL SELECT *, 0, 1 FROM b) GROUP BY nation, segment"),
    "eval_rosetta_lenient": (rosetta, _rosetta_sql("lenient")),
    "eval_rosetta_strict": (lambda s, d: rosetta(s, d, "strict"), _rosetta_sql("strict")),
    "eval_verdict_fractions": (fractions, "SELECT o_orderstatus, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM orders GROUP BY o_orderstatus"),
    "eval_without_agent_finds": (without_agent, "SELECT source, CASE WHEN doc_id % 3 = 0 THEN 'Deep Research' ELSE 'RAG' END AS found_by, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 OR source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5') GROUP BY ALL"),
    "eval_golden_last_wins": (golden_last, "SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey"),
    "eval_normal_values": (normal_values, "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'not specified' ELSE trim(p_name) END AS value FROM part"),
    "runs_completion_matrix": (matrix, "SELECT o_orderpriority, count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'F') AS f_runs, count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'O') AS o_runs, count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'P') AS p_runs FROM orders GROUP BY o_orderpriority"),
    "runs_missing_combinations": (missing, "SELECT n_nationkey AS nation, s AS segment FROM nation, (SELECT DISTINCT c_mktsegment AS s FROM customer) WHERE (n_nationkey, s) NOT IN (SELECT (c_nationkey, c_mktsegment) FROM customer WHERE c_acctbal > 9500)"),
    "runs_anchored_jobs": (jobs, _JOBS),
    "runs_phase_roi": (phases, _PHASES),
    "runs_timing_stats": (timings, "SELECT event_type, count(value) AS calls, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, round(CASE WHEN count(value) > 1 THEN stddev_pop(value) END, 4) AS sd FROM events GROUP BY event_type"),
    "runs_family_totals": (families, "SELECT count(*) FILTER (WHERE event_type LIKE '%click%') AS click, count(*) FILTER (WHERE event_type LIKE '%view%') AS view FROM events"),
    "runs_sampled_series": (series, "WITH s AS (SELECT user_id, CASE WHEN event_id % 7 <> 0 THEN CAST(event_id AS DOUBLE) END AS v FROM events) SELECT user_id, count(v) AS samples, max(v) AS peak, round(avg(v), 6) AS mean, count(*) - count(v) AS marks FROM s GROUP BY user_id"),
}
