"""Queries of upkeep: discovery rows, reconciliation, truth maps and repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions import text
from quarrystone.operators import catalog, maintenance
from quarrystone.operators.intervals import interval_stats
from quarrystone.operators.phases import Phases
from quarrystone.sources import pages

from .fixtures import CELLS, JOBS, cells, jobs, t


def discovered(spark, d):
    """Part names as finds, with types and confidences of all kinds."""
    p = t(spark, d, "part")
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (F.col("p_partkey") % k + 1).cast("int"))
    rows = p.select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, "varies").otherwise(F.concat(F.lit(" "), "p_name")).alias("name"), F.when(F.col("p_partkey") % 3 == 0, "0.97").otherwise("0.2").alias("conf"), pick(["collection", "evaluation script", "real-world dataset", "provider"], 4).alias("kind"))
    return maintenance.discovered(rows, "name", "conf", "kind", taxonomy=True)


_DISCOVERED = """
SELECT p_partkey, trim(p_name) AS name, CASE WHEN p_partkey % 3 = 0 THEN 0.97 ELSE 0.95 END AS conf, CASE p_partkey % 4 WHEN 0 THEN 'Collection' WHEN 2 THEN 'Dataset' ELSE 'Provider' END AS kind
FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 4 <> 1 AND length(trim(p_name)) >= 2
"""


def reconcile(spark, d):
    """Suppliers as the base, shifted ones as a batch: two thirds match."""
    s = t(spark, d, "supplier")
    conf = lambda n: (F.col("s_suppkey") * n % 101 / 100.0).cast("string")
    base = s.select(F.format_string("DS_%03d", "s_suppkey").alias("DatasetID"), F.col("s_suppkey").alias("o"), F.lit("S").alias("Canonical Name"), F.col("s_name").alias("Variant Name"), F.lit("").alias("Aliases"), F.lit("d").alias("Description"), F.lit("old").alias("Domain"), conf(7).alias("Domain (C)"))
    batch = s.filter("s_suppkey % 3 <> 0").select(F.lit("s").alias("Canonical Name"), F.when(F.col("s_suppkey") % 3 == 1, F.lower("s_name")).otherwise(F.concat(F.lit("New "), "s_name")).alias("Variant Name"), F.lit("").alias("Aliases"), F.repeat(F.lit("x"), F.col("s_suppkey").cast("int") % 20).alias("Description"), F.lit("new").alias("Domain"), conf(11).alias("Domain (C)"))
    r = maintenance.reconcile(base, batch, ["Domain"], "o")
    return r.select(F.col("DatasetID").alias("id"), F.col("Variant Name").alias("name"), F.col("Aliases").alias("aliases"), F.length("Description").cast("long").alias("n"), F.col("Domain").alias("domain"), F.col("Domain (C)").alias("conf"))


_RECONCILE = """
WITH s AS (SELECT s_suppkey AS k, s_name, (s_suppkey * 7 % 101) / 100.0 AS oc, (s_suppkey * 11 % 101) / 100.0 AS nc, s_suppkey % 20 AS n FROM supplier), m AS (SELECT max(k) AS m FROM s)
SELECT printf('DS_%03d', k) AS id, s_name AS name, CASE WHEN k % 3 = 1 THEN lower(s_name) ELSE '' END AS aliases, CAST(CASE WHEN k % 3 = 1 AND n > 11 THEN n ELSE 1 END AS BIGINT) AS n, CASE WHEN k % 3 = 1 AND nc > oc THEN 'new' ELSE 'old' END AS domain, CAST(CASE WHEN k % 3 = 1 AND nc > oc THEN nc ELSE oc END AS VARCHAR) AS conf FROM s
UNION ALL SELECT printf('DS_%03d', m + row_number() OVER (ORDER BY lower(s_name))), 'New ' || s_name, '', CAST(n AS BIGINT), 'new', CAST(nc AS VARCHAR) FROM s, m WHERE k % 3 = 2
"""


def truth(spark, d):
    facts = t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    known = t(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("truth"), "s_suppkey")
    return maintenance.map_truth(facts, known, ["nation"], "truth", "s_suppkey")


def raw_values(spark, d):
    won = t(spark, d, "customer").select(F.lower("c_mktsegment").alias("norm_value")).distinct()
    raw = t(spark, d, "customer").select(F.lower("c_mktsegment").alias("norm_value"), F.col("c_name").alias("raw"), "c_custkey")
    return maintenance.with_raw_values(won, raw, ["norm_value"], "c_custkey")


def filled(spark, d):
    a = t(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = t(spark, d, "supplier").select(F.col("s_name").alias("name"))
    return maintenance.union_filled([a, b]).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


def completed(spark, d):
    j = jobs(spark, d).withColumn("status", F.when(F.minute("ts") % 3 == 0, "COMPLETED (ok)").when(F.minute("ts") % 3 == 1, "FAILED"))
    return maintenance.completed(j, "status", "mode", ["AGENT", "HARVEST"]).groupBy("project").agg(F.count(F.lit(1)).alias("n"))


def zombies(spark, d):
    c = cells(spark, d).filter("field = 'Domain'").select("dataset_name", F.lit("Primary URL").alias("field"), F.when(F.col("nation") % 3 == 0, "https://arxiv.org/abs/1").when(F.col("nation") % 3 == 1, "https://data.org/x").otherwise("[missing]").alias("value"))
    kinds = t(spark, d, "customer").select(F.col("c_name").alias("dataset_name"), F.when(F.col("c_custkey") % 4 == 0, "Provider").otherwise("Dataset").alias("type"))
    return maintenance.without_data_url(c, kinds)


def chain(spark, d):
    """Customers' cells under names that need cleaning; pairs of customers come to one name."""
    c = t(spark, d, "customer").select((F.col("c_custkey") / 2).cast("long").alias("k"), "c_custkey")
    name = F.concat(F.when(F.col("c_custkey") % 2 == 0, "google/").otherwise(""), F.lit("Series number "), F.col("k").cast("string"), F.lit("_x"))
    rows = c.select(name.alias("dataset_name"), F.lit("Domain").alias("field"), F.when(F.col("c_custkey") % 2 == 0, "[missing]").otherwise("energy").alias("value"), (F.col("c_custkey") % 10 / 10.0).alias("confidence"), F.col("c_custkey").alias("ord"))
    return maintenance.maintain(rows).filter("field = 'Domain'").select("name", "value", "confidence")


_CHAIN = """
WITH c AS (SELECT CAST(floor(c_custkey / 2) AS BIGINT) AS k, c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '[missing]' ELSE 'energy' END AS v, (c_custkey % 10) / 10.0 AS c FROM customer),
p AS (SELECT k, max(v) FILTER (WHERE c_custkey % 2 = 0) AS ev, max(c) FILTER (WHERE c_custkey % 2 = 0) AS ec, max(v) FILTER (WHERE c_custkey % 2 = 1) AS ov, max(c) FILTER (WHERE c_custkey % 2 = 1) AS oc FROM c GROUP BY k)
SELECT 'series number ' || k || '_x' AS name, coalesce(ov, ev) AS value, CASE WHEN ov IS NOT NULL THEN oc ELSE ec END AS confidence FROM p
"""


def simple_queries(spark, d):
    p = t(spark, d, "part").select("p_partkey", text.simple_query(F.concat(F.lit('Search for "'), "p_name", F.lit('" OR site:a.org size details about it'))).alias("q"), text.tidy_cell(F.concat(F.lit("**"), "p_brand", F.lit(" (Collection)**"))).alias("cell"))
    return p


def page_counts(spark, d):
    """Pages that show a count of instances, some a count of features and some a table of variables."""
    k = F.col("page_id")
    shown = F.when(k % 3 == 0, F.concat(F.lit("<div><p>Number of Features</p><p>7, then "), (k % 50 + 1).cast("string"), F.lit(" in all</p></div>"))).when(k % 3 == 1, F.concat(F.lit("<table><tr><th>Variable</th></tr>"), F.repeat(F.lit("<tr><td>x</td></tr>"), (k % 7 + 1).cast("int")), F.lit("</table>"))).otherwise("")
    p = t(spark, d, "pages").select("page_id", F.concat(F.lit("<div><p>Instances</p><p>1 of "), (k + 10).cast("string"), F.lit(" rows</p></div>"), "html", shown).alias("html"))
    return p.select("page_id", pages.page_numbers("html").alias("n")).select("page_id", "n.instances", "n.features")


def provider_answers(spark, d):
    e = t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, '{"is_same": true}').when(F.col("event_id") % 3 == 1, 'I say {"is_same": false}.').otherwise("no").alias("a"))
    return e.select("event_id", maintenance.provider_says(F.col("a"), "is_same").alias("same"))


def samples_in_jobs(spark, d):
    """Views and clicks as samples of a machine, purchases and errors as its jobs, some of minutes and some of days."""
    e = t(spark, d, "events").select("event_id", "event_type", "value", (F.col("user_id") % 10).alias("machine"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    seconds = F.col("event_id") % 977
    ran = e.filter(F.col("event_type").isin("purchase", "error")).select(F.col("event_id").alias("job"), "machine", F.col("at").alias("start"), (F.col("at") + seconds * seconds).alias("end"))
    return interval_stats(e.filter(F.col("event_type").isin("view", "click")).select("machine", "at", "value"), ran, "at", "start", "end", "value", ["job"], ["machine"])


_SAMPLES = """
WITH e AS (SELECT event_id, event_type, value, user_id % 10 AS machine, epoch_us(ts) / 1e6 AS x FROM events),
j AS (SELECT event_id AS job, machine, x AS a, x + (event_id % 977) * (event_id % 977) AS b FROM e WHERE event_type IN ('purchase', 'error'))
SELECT job, count(*) AS n, max(value) AS most, min(value) AS least FROM j JOIN e ON e.machine = j.machine AND x BETWEEN a AND b WHERE event_type IN ('view', 'click') GROUP BY job
"""


def profiled(spark, d):
    """The phases of a chain over orders, with the rows and a sum that their own jobs saw."""
    o = t(spark, d, "orders")
    seen = Phases({"keys": F.sum("o_custkey")})
    seen.chain(o, [("read", lambda x: x), ("open", lambda x: x.filter("o_orderstatus = 'O'")), ("known", lambda x: x.join(t(spark, d, "customer").filter("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi"))])
    seen.run("by customer", o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), {"most": F.max("n")})
    return seen.report(spark).select("phase", F.col("place").cast("long").alias("place"), "rows", F.col("metrics")["keys"].cast("long").alias("keys"), F.col("metrics")["most"].cast("long").alias("most"), (F.col("seconds") > 0).alias("timed"))


_PROFILED = """
WITH o AS (SELECT * FROM orders WHERE o_orderstatus = 'O'), k AS (SELECT * FROM o WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)), g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT 'read' AS phase, 0::BIGINT AS place, count(*) AS rows, sum(o_custkey)::BIGINT AS keys, NULL::BIGINT AS most, true AS timed FROM orders
UNION ALL SELECT 'open', 1, count(*), sum(o_custkey)::BIGINT, NULL, true FROM o UNION ALL SELECT 'known', 2, count(*), sum(o_custkey)::BIGINT, NULL, true FROM k
UNION ALL SELECT 'by customer', 3, count(*), sum(o_custkey)::BIGINT, max(n), true FROM g
"""


def demoted(spark, d):
    """Finds of a customer's project: its own name in five spellings, of which three are the project itself."""
    c = t(spark, d, "customer").select("c_custkey", "c_name", F.lit("0.7").alias("conf"))
    k = F.col("c_custkey") % 5
    name = F.when(k == 0, F.upper("c_name")).when(k == 1, F.concat("c_name", F.lit(" Dataset "))).when(k == 2, F.concat("c_name", F.lit("x"))).when(k == 3, F.concat("c_name", F.lit(" and twelve others beside"))).otherwise(F.lit("other"))
    return catalog.demoted(c.withColumn("name", name), "name", [F.col("c_name"), F.lit("")], "conf").select("c_custkey", "conf")


def audited(spark, d):
    """Parts' names and variants of them audited: what was dropped, for what reason, and what it changed."""
    p = t(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"), F.max("p_retailprice").alias("price"))
    both = p.select(F.col("k").alias("DatasetID"), F.col("p_name").alias("Variant Name"), "price").union(p.select(F.col("k") + 1_000_000, F.concat("p_name", F.lit("s")), "price"))
    conf = lambda n: (F.col("DatasetID") * n % 97 / 100.0).cast("string")
    r = both.select("DatasetID", "Variant Name", conf(7).alias("Overall Confidence"), F.lit("J1").alias("Job_Updated"), F.repeat(F.lit("d"), (F.col("DatasetID") % 13).cast("int")).alias("Description"), F.concat(F.lit("u"), F.col("DatasetID") % 3).alias("Other URL"), F.col("price").cast("string").alias("Domain"), conf(11).alias("Domain (C)"))
    clean, dropped = maintenance.audit_deduplicated(r)
    return dropped.select("dropped", "kept", "reason", "notes").unionByName(clean.select(F.lit(None).cast("long").alias("dropped"), F.col("DatasetID").alias("kept"), F.lit("kept").alias("reason"), F.col("Description").alias("notes")))


QUERIES = {
    "catalog_demoted": (demoted, "SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 1, 2) THEN '0.0' ELSE '0.7' END AS conf FROM customer"),
    "entity_audit_dedup": (audited, None),
    "runs_samples_in_jobs": (samples_in_jobs, _SAMPLES),
    "runs_observed_phases": (profiled, _PROFILED),
    "kb_discovered": (discovered, _DISCOVERED),
    "kb_reconcile": (reconcile, _RECONCILE),
    "eval_map_truth": (truth, "SELECT c_custkey, c_nationkey AS nation, coalesce(s, '') AS truth FROM customer LEFT JOIN (SELECT s_nationkey, arg_max(s_name, s_suppkey) AS s FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey"),
    "eval_raw_values": (raw_values, "SELECT lower(c_mktsegment) AS norm_value, arg_min(c_name, c_custkey) AS raw FROM customer GROUP BY 1"),
    "runs_union_filled": (filled, "SELECT segment, count(*) AS n FROM (SELECT c_mktsegment AS segment FROM customer UNION ALL SELECT 'Unknown' FROM supplier) GROUP BY segment"),
    "runs_completed": (completed, f"WITH {JOBS} SELECT project, count(*) AS n FROM jobs WHERE minute(ts) % 3 = 0 AND mode IN ('AGENT', 'HARVEST') GROUP BY project"),
    "catalog_without_data_url": (zombies, "SELECT c_name AS dataset_name FROM customer WHERE c_nationkey % 3 <> 1 AND c_custkey % 4 <> 0"),
    "catalog_maintain": (chain, _CHAIN),
    "text_simple_queries": (simple_queries, "SELECT p_partkey, p_name || '  size' AS q, p_brand AS cell FROM part"),
    "page_counts": (page_counts, "SELECT page_id, page_id + 10 AS instances, CASE page_id % 3 WHEN 0 THEN page_id % 50 + 1 WHEN 1 THEN page_id % 7 + 1 END AS features FROM pages"),
    "entity_provider_answers": (provider_answers, "SELECT event_id, event_id % 3 = 0 AS same FROM events"),
}
