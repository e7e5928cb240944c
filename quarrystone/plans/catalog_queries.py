"""Queries over the catalog of cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions.constants import MISSING_CELL
from quarrystone.functions.values import confidence
from quarrystone.operators import catalog

from .fixtures import CELLS, cells, t, updates

_M = ", ".join("'" + x.replace("'", "''") + "'" for x in MISSING_CELL)
FIELDS = ["Domain", "Total Variables", "Frequency"]


def cell_fold(spark, d):
    return catalog.fold_updates(updates(spark, d), ["dataset_name", "field"], "ord")


_FOLD = f"""
WITH RECURSIVE u AS (
  SELECT 'user ' || user_id AS dataset_name, event_type AS field, CASE WHEN event_id % 4 = 0 THEN '[missing]' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS value, (event_id * 37 % 97) / 100.0 AS confidence,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events),
f AS (
  SELECT dataset_name, field, '[missing]' AS value, CAST(0 AS DOUBLE) AS confidence, CAST(0 AS BIGINT) AS taken, CAST(0 AS BIGINT) AS k, n FROM u WHERE k = 1
  UNION ALL
  SELECT dataset_name, field, CASE WHEN take THEN nv ELSE value END, CASE WHEN take THEN nc ELSE confidence END, taken + CASE WHEN take THEN 1 ELSE 0 END, k + 1, n
  FROM (SELECT f.*, u.value AS nv, u.confidence AS nc,
               NOT (f.confidence >= 0.95 AND f.value NOT IN ({_M})) AND ((f.value IN ({_M}) AND u.value NOT IN ({_M})) OR (f.value NOT IN ({_M}) AND u.confidence > f.confidence)) AS take
        FROM f JOIN u ON u.dataset_name = f.dataset_name AND u.field = f.field AND u.k = f.k + 1))
SELECT dataset_name, field, value, confidence, taken FROM f WHERE k = n
"""


def cell_upsert(spark, d):
    new = updates(spark, d).filter("field = 'click'").select("dataset_name", "field", "value", "confidence", "ord")
    first = new.groupBy("dataset_name", "field").agg(F.min_by("value", "ord").alias("value"), F.lit(0.4).alias("confidence"))
    return catalog.upsert_cells(first, new, ["dataset_name", "field"], "ord")


_UPSERT = f"""
WITH RECURSIVE u AS (
  SELECT 'user ' || user_id AS dataset_name, event_type AS field, CASE WHEN event_id % 4 = 0 THEN '[missing]' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS value, (event_id * 37 % 97) / 100.0 AS confidence,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'click'),
f AS (
  SELECT dataset_name, field, value, CAST(0.4 AS DOUBLE) AS confidence, CAST(0 AS BIGINT) AS k, n FROM u WHERE k = 1
  UNION ALL
  SELECT dataset_name, field, CASE WHEN take THEN nv ELSE value END, CASE WHEN take THEN nc ELSE confidence END, k + 1, n
  FROM (SELECT f.*, u.value AS nv, u.confidence AS nc,
               NOT (f.confidence >= 0.95 AND f.value NOT IN ({_M})) AND ((f.value IN ({_M}) AND u.value NOT IN ({_M})) OR (f.value NOT IN ({_M}) AND u.confidence > f.confidence)) AS take
        FROM f JOIN u ON u.dataset_name = f.dataset_name AND u.field = f.field AND u.k = f.k + 1))
SELECT dataset_name, field, value, confidence FROM f WHERE k = n
"""


def results(spark, d):
    c = cells(spark, d).filter("field <> 'Domain'")
    n = F.length("dataset_name") * 3 + F.col("nation") * 7
    new = c.select("dataset_name", "field", F.when(F.col("nation") % 3 == 0, F.upper("value")).when(F.col("nation") % 3 == 1, F.lit("weekly")).otherwise("[missing]").alias("value"), (n % 100 / 100.0).alias("confidence"))
    return catalog.classify_results(new, c, ["dataset_name", "field"]).groupBy("kind", "taken").agg(F.count(F.lit(1)).alias("n"))


_RESULTS = f"""
WITH {CELLS},
r AS (SELECT dataset_name, field, value AS ov, confidence AS oc, CASE nation % 3 WHEN 0 THEN upper(value) WHEN 1 THEN 'weekly' ELSE '[missing]' END AS value, ((length(dataset_name) * 3 + nation * 7) % 100) / 100.0 AS confidence FROM cells WHERE field <> 'Domain'),
k AS (SELECT *, CASE WHEN ov IN ({_M}) AND value NOT IN ({_M}) THEN 'FILL' WHEN lower(trim(ov)) = lower(trim(value)) THEN 'CONFIRM' WHEN confidence >= oc THEN 'REFINE' ELSE 'KEEP' END AS kind FROM r)
SELECT kind, kind <> 'KEEP' AND NOT (oc >= 0.95 AND ov NOT IN ({_M})) AND ((ov IN ({_M}) AND value NOT IN ({_M})) OR (ov NOT IN ({_M}) AND confidence > oc)) AS taken, count(*) AS n FROM k GROUP BY ALL
"""


def cell_metrics(spark, d):
    m = catalog.metrics(cells(spark, d))
    return m.select(F.round("avg_conf", 6).alias("avg_conf"), F.round("completeness", 6).alias("completeness"), "count")


def dataset_completion(spark, d):
    return catalog.completion(cells(spark, d)).withColumn("completeness_pct", F.round("completeness_pct", 6))


def gap_audit(spark, d):
    kinds = t(spark, d, "customer").select(F.col("c_name").alias("dataset_name"), F.when(F.col("c_custkey") % 11 == 0, "Collection").when(F.col("c_custkey") % 13 == 0, "Provider").otherwise("Dataset").alias("type"))
    return catalog.gap_audit(cells(spark, d), 0.8, ["Domain", "Frequency"], kinds)


def candidate_cells(spark, d):
    c = cells(spark, d)
    fields = spark.createDataFrame([(f,) for f in [*FIELDS, "License"]], "field string")
    return catalog.candidate_cells(c, fields, c)


def needs_repair(spark, d):
    return catalog.needs_repair(cells(spark, d), "dataset_name", {"Domain": 0.9, "Frequency": 0.5}, 0.8)


def relevance_gate(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 17 == 0, "n/a").otherwise((F.col("n_chars") % 100 / 100.0).cast("string")).alias("score"))
    return catalog.relevance_gate(docs, "score").select("doc_id", confidence("score").alias("score"))


def entity_types(spark, d):
    """Names built so that every rule applies to some."""
    p = t(spark, d, "part")
    words = ["ETTh1 {}", "{} archive", "Monash", "PeMS-SF {}", "bank of {}", "{} m series", "solar {}", "{} library of kaggle", "plain {}", "noaa {}"]
    k = (F.col("p_partkey") % len(words)).cast("int")
    name = F.replace(F.element_at(F.array(*map(F.lit, words)), k + 1), F.lit("{}"), F.col("p_name"))
    return p.select("p_partkey", name.alias("name")).withColumn("type", catalog.entity_type("name"))


_TYPES = r"""
WITH n AS (SELECT p_partkey, replace(['ETTh1 {}', '{} archive', 'Monash', 'PeMS-SF {}', 'bank of {}', '{} m series', 'solar {}', '{} library of kaggle', 'plain {}', 'noaa {}'][CAST(p_partkey % 10 AS INT) + 1], '{}', p_name) AS name FROM part),
s AS (SELECT *, lower(trim(name)) AS s FROM n),
l AS (SELECT *, regexp_matches(s, '\bett[hm][0-9]\b|\bpems[-_ ]?(sf|bay|0)\b|san francisco traffic|traffic \(pems\)|\becl\b|electricity consuming load|exchange rate|illness|weather \(mpi|taxi|solar') AS leaf,
   s IN ('pems', 'ett', 'monash', 'utsd', 'tslib', 'm3', 'm4', 'm5', 'gefcom', 'lotsa', 'timebench', 'chronos', 'gluonts', 'timeseriesclassification') AS exact_,
   regexp_matches(s, 'archive|repository|library|collection|benchmark|corpus|unified time series|benchmark suite|competition|dataset suite') AS coll,
   regexp_matches(s, 'ecmwf|bank|reserve|authority|commission|physionet|kaggle|caltrans|nrel|noaa|google|microsoft|uci') AS prov,
   contains(s, 'pems') OR contains(s, 'ett') OR (regexp_matches(s, '\bm\b') AND length(s) > 4) AS family FROM s)
SELECT p_partkey, name, CASE WHEN leaf OR (family AND NOT (NOT leaf AND (exact_ OR coll))) THEN 'Dataset' WHEN exact_ OR coll THEN 'Collection' WHEN prov THEN 'Provider' END AS type FROM l
"""


def report(spark, d):
    r = catalog.report(cells(spark, d), FIELDS)
    return r.select("dataset_name", F.col("Domain").alias("domain"), F.col("Total Variables").alias("total_variables"), F.col("Frequency").alias("frequency"), "completeness")


def locked_fields(spark, d):
    kinds = t(spark, d, "customer").select(F.col("c_name").alias("dataset_name"), F.when(F.col("c_custkey") % 3 == 0, "Collection").otherwise("Dataset").alias("type"))
    return catalog.lock_fields(cells(spark, d), kinds, ["Frequency"]).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 6).alias("confidence"))


def wiped_fields(spark, d):
    return catalog.metrics(catalog.wipe_fields(cells(spark, d), ["Domain"])).select(F.round("avg_conf", 6).alias("avg_conf"), F.round("completeness", 6).alias("completeness"), "count")


def repair_delta(spark, d):
    c = cells(spark, d)
    r = catalog.repair_delta(catalog.wipe_fields(c, ["Domain"]), c)
    return r.select("metric", *[F.round(x, 6).alias(x) for x in ("before", "after", "delta")])


def exact_dedupe(spark, d):
    """Customers of a segment and nation as items of one name, in order of their keys."""
    c = t(spark, d, "customer")
    items = F.array(F.struct(F.lit("id").alias("field"), F.when(F.col("c_custkey") % 3 == 0, "[missing]").otherwise(F.col("c_name")).alias("value"), (F.col("c_custkey") % 10 / 10.0).alias("confidence")))
    long = c.select(F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("name"), "c_custkey", F.inline(items))
    return catalog.exact_dedupe(long, F.col("name"), "c_custkey")


_DEDUPE = """
WITH RECURSIVE u AS (
  SELECT lower(c_mktsegment || ' ' || c_nationkey) AS name, CASE WHEN c_custkey % 3 = 0 THEN '[missing]' ELSE c_name END AS value, (c_custkey % 10) / 10.0 AS confidence,
         row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS k, count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) AS n FROM customer),
f AS (
  SELECT name, value, confidence, k, n FROM u WHERE k = 1
  UNION ALL
  SELECT f.name, CASE WHEN take THEN nv ELSE value END, CASE WHEN take THEN nc ELSE confidence END, k + 1, n
  FROM (SELECT f.*, u.value AS nv, u.confidence AS nc, (f.value = '[missing]' AND u.value <> '[missing]') OR u.confidence > f.confidence AS take FROM f JOIN u ON u.name = f.name AND u.k = f.k + 1) f)
SELECT name, 'id' AS field, value, confidence FROM f WHERE k = n
"""


def fastpath(spark, d):
    """Parts' golden cells found by name, brand or type."""
    p = t(spark, d, "part")
    golden = p.select("p_partkey", "p_name", "p_brand", "p_type", F.lit("Size").alias("field"), F.col("p_size").cast("string").alias("value"), (F.col("p_partkey") * 3 % 101 / 100.0).alias("confidence"))
    names = p.select(F.upper("p_name").alias("name"), F.lit("Size").alias("field")).union(p.select("p_brand", F.lit("Size"))).distinct()
    return catalog.golden_fastpath(names, golden, "name", [F.col("p_name"), F.col("p_brand"), F.col("p_type")], "p_partkey").select("name", "golden_value")


_FASTPATH = """
WITH g AS (SELECT p_partkey, CAST(p_size AS VARCHAR) AS value, (p_partkey * 3 % 101) / 100.0 AS confidence, unnest(list_distinct([regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'), regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g'), regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g')])) AS k FROM part WHERE (p_partkey * 3 % 101) / 100.0 >= 0.85),
b AS (SELECT * FROM g WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY confidence DESC, p_partkey) = 1),
n AS (SELECT DISTINCT upper(p_name) AS name FROM part UNION SELECT DISTINCT p_brand FROM part)
SELECT name, b.value AS golden_value FROM n LEFT JOIN b ON b.k = regexp_replace(lower(name), '[^a-z0-9]', '', 'g')
"""

QUERIES = {
    "catalog_cell_fold": (cell_fold, _FOLD),
    "catalog_cell_upsert": (cell_upsert, _UPSERT),
    "catalog_result_kinds": (results, _RESULTS),
    "catalog_cell_metrics": (cell_metrics, f"WITH {CELLS} SELECT round(avg(confidence), 6) AS avg_conf, round(avg(CASE WHEN value NOT IN ({_M}) THEN 1.0 ELSE 0.0 END), 6) AS completeness, count(DISTINCT dataset_name) AS count FROM cells"),
    "catalog_completion": (dataset_completion, f"WITH {CELLS} SELECT dataset_name, round(avg(CASE WHEN confidence >= 0.8 THEN 1.0 ELSE 0.0 END) * 100, 6) AS completeness_pct FROM cells GROUP BY dataset_name"),
    "catalog_gap_audit": (gap_audit, f"WITH {CELLS} SELECT dataset_name, field, confidence FROM cells WHERE confidence < 0.8 AND field IN ('Domain', 'Frequency') AND dataset_name NOT IN (SELECT c_name FROM customer WHERE c_custkey % 11 = 0 OR c_custkey % 13 = 0)"),
    "catalog_candidate_cells": (candidate_cells, f"WITH {CELLS}, g AS (SELECT DISTINCT dataset_name, f AS field FROM cells, (SELECT unnest(['Domain', 'Total Variables', 'Frequency', 'License']) AS f)) SELECT g.dataset_name, g.field, coalesce(c.confidence, 0.0) AS confidence FROM g LEFT JOIN cells c USING (dataset_name, field) WHERE coalesce(c.confidence, 0.0) < 0.95"),
    "catalog_needs_repair": (needs_repair, f"WITH {CELLS} SELECT dataset_name, max(CASE WHEN value IN ({_M}) OR confidence < CASE field WHEN 'Domain' THEN 0.9 WHEN 'Frequency' THEN 0.5 ELSE 0.8 END THEN 1 ELSE 0 END) AS needs_repair FROM cells GROUP BY dataset_name"),
    "catalog_relevance_gate": (relevance_gate, "SELECT doc_id, (n_chars % 100) / 100.0 AS score FROM documents WHERE doc_id % 17 <> 0 AND (n_chars % 100) / 100.0 >= 0.4"),
    "catalog_entity_types": (entity_types, _TYPES),
    "catalog_report": (report, f"WITH {CELLS} SELECT dataset_name, max(value) FILTER (WHERE field = 'Domain') AS domain, max(value) FILTER (WHERE field = 'Total Variables') AS total_variables, max(value) FILTER (WHERE field = 'Frequency') AS frequency, printf('%.1f%%', avg(CASE WHEN confidence >= 0.8 THEN 1.0 ELSE 0.0 END) * 100) AS completeness FROM cells GROUP BY dataset_name"),
    "catalog_locked_fields": (locked_fields, f"WITH {CELLS}, k AS (SELECT *, field = 'Frequency' AND value = '[missing]' AND CAST(regexp_extract(dataset_name, '[0-9]+') AS BIGINT) % 3 = 0 AS skip FROM cells) SELECT field, CASE WHEN skip THEN '[Skipped]' ELSE value END AS value, count(*) AS n, round(sum(CASE WHEN skip THEN 1.0 ELSE confidence END), 6) AS confidence FROM k GROUP BY 1, 2"),
    "catalog_wiped_fields": (wiped_fields, f"WITH {CELLS} SELECT round(avg(CASE WHEN field = 'Domain' THEN 0.0 ELSE confidence END), 6) AS avg_conf, round(avg(CASE WHEN field <> 'Domain' AND value NOT IN ({_M}) THEN 1.0 ELSE 0.0 END), 6) AS completeness, count(DISTINCT dataset_name) AS count FROM cells"),
    "catalog_repair_delta": (repair_delta, f"WITH {CELLS}, m AS (SELECT avg(CASE WHEN field = 'Domain' THEN 0.0 ELSE confidence END) AS a0, avg(confidence) AS a1, avg(CASE WHEN field <> 'Domain' AND value NOT IN ({_M}) THEN 1.0 ELSE 0.0 END) AS c0, avg(CASE WHEN value NOT IN ({_M}) THEN 1.0 ELSE 0.0 END) AS c1, CAST(count(DISTINCT dataset_name) AS DOUBLE) AS n FROM cells) SELECT 'avg_conf' AS metric, round(a0, 6) AS before, round(a1, 6) AS after, round(a1 - a0, 6) AS delta FROM m UNION ALL SELECT 'completeness', round(c0, 6), round(c1, 6), round(c1 - c0, 6) FROM m UNION ALL SELECT 'count', n, n, 0.0 FROM m"),
    "catalog_exact_dedupe": (exact_dedupe, _DEDUPE),
    "catalog_golden_fastpath": (fastpath, _FASTPATH),
}
