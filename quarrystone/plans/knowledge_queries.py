"""Queries over knowledge-base tables and entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions.text import normalize
from quarrystone.functions.values import similarity
from quarrystone.operators import entities
from quarrystone.operators import knowledge_base as kb

from .fixtures import JOBS, jobs, t


def link_last(spark, d):
    o = t(spark, d, "orders")
    last = kb.last_link(o, "o_custkey", "o_orderpriority", "o_orderkey")
    c = t(spark, d, "customer").select("c_custkey")
    return c.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("o_orderpriority", F.lit("Unknown")).alias("project"))


def _links(spark, d):
    return t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")


def members(spark, d):
    return kb.members(t(spark, d, "customer").select("c_custkey", "c_name"), _links(spark, d), "c_custkey", F.col("o_orderstatus") == "P")


def non_members(spark, d):
    return kb.non_members(t(spark, d, "customer").select("c_custkey", "c_name"), _links(spark, d), "c_custkey", F.col("o_orderstatus") == "P")


def exclusive(spark, d):
    return kb.exclusive_members(t(spark, d, "customer").select("c_custkey", "c_name"), _links(spark, d), "c_custkey", F.col("o_orderstatus") == "F")


def quarantine(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, "?").otherwise((F.col("c_custkey") % 100 / 100.0).cast("string")).alias("conf"))
    links = _links(spark, d)
    kept, out, kept_links, out_links = kb.quarantine(c, links, "c_custkey", "conf")
    n = lambda df, name: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))
    return n(kept, "kept").union(n(out, "quarantined")).union(n(kept_links, "kept links")).union(n(out_links, "quarantined links"))


_QUARANTINE = """
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 1.0 ELSE (c_custkey % 100) / 100.0 END < 0.5 AS low FROM customer), l AS (SELECT o_custkey, coalesce(low, false) AS low FROM orders LEFT JOIN c ON c_custkey = o_custkey)
SELECT 'kept' AS part, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM c WHERE NOT low UNION ALL SELECT 'quarantined', count(*), CAST(sum(c_custkey) AS BIGINT) FROM c WHERE low
UNION ALL SELECT 'kept links', count(*), CAST(sum(o_custkey) AS BIGINT) FROM l WHERE NOT low UNION ALL SELECT 'quarantined links', count(*), CAST(sum(o_custkey) AS BIGINT) FROM l WHERE low
"""


def upsert(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    batch = c.filter("c_custkey % 3 = 0").select((F.col("c_custkey") + 600).alias("c_custkey"), F.upper("c_name").alias("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.lit("NEW")).alias("c_mktsegment"))
    return kb.upsert(c, batch, ["c_custkey"], ["c_name", "c_mktsegment"])


def replace_partition(spark, d):
    e = t(spark, d, "events").select("event_id", "event_type")
    batch = e.filter("event_id % 50 = 0").select("event_id", F.lit("click").alias("event_type"))
    return kb.replace_partition(e, batch, "event_type", ["click"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def match_any(spark, d):
    p = t(spark, d, "part")
    names = p.select(F.col("p_brand").alias("name")).union(p.select("p_type")).union(p.select("p_name")).distinct()
    return kb.match_any(p.select("p_partkey", "p_name", "p_type", "p_brand"), names, ["p_name", "p_type", "p_brand"], "name", "p_partkey").select("name", "p_partkey")


def insert_absent(spark, d):
    base = t(spark, d, "supplier").select("s_name")
    batch = t(spark, d, "customer").select(F.concat(F.lit("SUPPLIER#"), F.lpad((F.col("c_custkey") % 300).cast("string"), 9, "0")).alias("s_name"), "c_custkey")
    first = kb.keep_first(batch, [F.lower("s_name")], ["c_custkey"])
    return kb.insert_absent(base, first, F.lower("s_name"), F.lower("s_name"))


def new_ids(spark, d):
    base = t(spark, d, "supplier").select(F.format_string("DS_%03d", F.col("s_suppkey")).alias("id"))
    return kb.new_ids(t(spark, d, "region").select("r_regionkey", "r_name"), base, "id", "DS_", ["r_regionkey"])


def aliases(spark, d):
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", kb.merge_aliases(F.concat(F.col("n_name"), F.lit(", unknown,"), F.col("r_name")), F.concat(F.lower("r_name"), F.lit(",none, x"), F.col("n_nationkey").cast("string"))).alias("aliases"))


def overall(spark, d):
    c = t(spark, d, "customer")
    conf = lambda n: (F.col("c_custkey") * n % 101 / 100.0).cast("string")
    value = F.when(F.col("c_custkey") % 4 == 0, "N/A").otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", kb.overall_confidence(F.lit("0.8"), [value, F.col("c_name")], [conf(7), conf(11)]).alias("overall"))


def write_back(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 6 == 0, "").otherwise(F.col("c_mktsegment")).alias("Domain"), (F.col("c_custkey") % 10 / 10.0).cast("string").alias("Domain (C)"))
    u = t(spark, d, "customer").filter("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 8 == 0, "unknown").otherwise("fixed").alias("Domain"), F.lit("0.5").alias("Domain (C)"))
    return kb.write_back(c, u, "c_custkey", "Domain").select("c_custkey", F.col("Domain").alias("domain"), F.col("Domain (C)").alias("conf"))


def relink_chain(spark, d):
    """Nations point to half their number; links of customers follow to the root."""
    n = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("dropped"), F.floor(F.col("n_nationkey") / 2).cast("long").alias("kept")).filter("dropped > 1 and dropped <> 7")
    roots = kb.resolve_chains(n)
    links = t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("nation"), F.lit("").alias("note"))
    return kb.relink(links, roots, "nation", "note").groupBy("nation").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("note").alias("notes"))


_RELINK = """
WITH RECURSIVE c AS (SELECT n_nationkey AS k, n_nationkey AS r FROM nation UNION ALL SELECT k, CAST(floor(r / 2) AS INT) FROM c WHERE r > 1 AND r <> 7),
f AS (SELECT k, min(r) AS r FROM c GROUP BY k)
SELECT CAST(r AS BIGINT) AS nation, count(*) AS n, count(DISTINCT CASE WHEN r <> k THEN k ELSE -1 END) AS notes FROM customer JOIN f ON k = c_nationkey GROUP BY r
"""


def singletons(spark, d):
    c = t(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 100 / 100.0).alias("conf"))
    exists = F.when(F.col("c_custkey") % 3 == 0, F.lit(False)).when(F.col("c_custkey") % 3 == 1, F.lit(True))
    inside = F.col("c_custkey") % 2 == 0
    acted = c.withColumn("action", kb.singleton_verdict(F.col("conf"), exists, inside))
    return kb.route_singletons(acted, _links(spark, d), "c_custkey", "o_orderstatus").groupBy("action", "route").agg(F.count(F.lit(1)).alias("n"))


_SINGLES = """
WITH a AS (SELECT c_custkey, CASE WHEN (c_custkey % 100) / 100.0 >= 0.98 THEN 'KEEP' WHEN c_custkey % 3 = 0 THEN 'DROP' WHEN c_custkey % 3 = 1 AND c_custkey % 2 <> 0 THEN 'LOST' ELSE 'KEEP' END AS action FROM customer),
f AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS p FROM orders GROUP BY o_custkey)
SELECT action, CASE WHEN action = 'KEEP' THEN 'KEEP' WHEN coalesce(p, 0) > 1 THEN 'UNLINK' WHEN action = 'DROP' THEN 'DELETE' ELSE 'REASSIGN' END AS route, count(*) AS n FROM a LEFT JOIN f ON o_custkey = c_custkey GROUP BY ALL
"""


def _quality_rows(spark, d):
    k = F.col("c_custkey")
    conf = lambda n: F.when(k % 10 == n, "x").otherwise((k * n % 101 / 100.0).cast("string"))
    return t(spark, d, "customer").select("c_custkey", "c_nationkey", *[conf(n).alias(f"{f} (C)") for n, f in ((3, "Domain"), (7, "Total Variables"), (9, "Primary URL"), (5, "Num Time Points"))])


FIELDS = ["Domain", "Total Variables", "Primary URL", "Num Time Points"]


def health(spark, d):
    return kb.project_health(_quality_rows(spark, d), "c_custkey", "c_nationkey", FIELDS, 0.2)


_HEALTH = """
WITH c AS (SELECT c_custkey, c_nationkey, unnest(['Domain', 'Total Variables', 'Primary URL', 'Num Time Points']) AS field, unnest([1, 2, 3, 4]) AS pos, unnest([3, 7, 9, 5]) AS m FROM customer),
l AS (SELECT * FROM c WHERE CASE WHEN c_custkey % 10 = m THEN 0.0 ELSE (c_custkey * m % 101) / 100.0 END < 0.2),
n AS (SELECT c_nationkey, field, pos, count(*) AS n FROM l GROUP BY ALL), tot AS (SELECT c_nationkey, count(*) AS total FROM customer GROUP BY 1), low AS (SELECT c_nationkey, count(DISTINCT c_custkey) AS low_conf FROM l GROUP BY 1),
top AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, pos) <= 3),
def AS (SELECT c_nationkey, string_agg(field || ' (' || CAST(floor(n * 100.0 / total) AS BIGINT) || '%)', ', ' ORDER BY n DESC, pos) AS defects FROM top JOIN tot USING (c_nationkey) GROUP BY 1)
SELECT c_nationkey, total, coalesce(low_conf, 0) AS low_conf, coalesce(defects, 'None') AS defects, CASE WHEN coalesce(low_conf, 0) * 100.0 / total > 30 THEN 'RERUN' ELSE 'OK' END AS status FROM tot LEFT JOIN low USING (c_nationkey) LEFT JOIN def USING (c_nationkey)
"""


def merge_targets(spark, d):
    return kb.merge_targets(jobs(spark, d), "project", "mode", "ts", ["PROJ_3"]).select("project", "runs")


def repair_targets(spark, d):
    needs = t(spark, d, "customer").select(F.concat(F.lit("PROJ_"), F.col("c_nationkey").cast("string")).alias("project"), (F.col("c_custkey") % 5 < F.col("c_nationkey") % 4).cast("int").alias("needs_repair"))
    return kb.repair_targets(needs, jobs(spark, d), "project", "mode", "ts").select("project", "need", "total", F.round("pct", 6).alias("pct"))


def unrun(spark, d):
    p = t(spark, d, "nation").select(F.concat(F.lit(" proj_"), F.col("n_nationkey").cast("string")).alias("project"), F.when(F.col("n_nationkey") % 7 == 0, "-1").otherwise("method 2").alias("method"))
    done = t(spark, d, "supplier").filter("s_nationkey % 3 = 0").select(F.concat(F.lit("PROJ_"), F.col("s_nationkey").cast("string")).alias("project"))
    return kb.unrun_projects(p, done, "project", "method").select(F.trim("project").alias("project"))


def fan_out(spark, d):
    return kb.link_fan_out(_links(spark, d), "c_custkey", "o_orderstatus")


def dedupe_first(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text", "lang")
    return kb.keep_first(docs, [F.md5(F.lower(F.trim("text")))], ["doc_id"]).select("doc_id", "lang")


def new_brands(spark, d):
    sold = t(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    p = t(spark, d, "part")
    return kb.absent(p.select("p_name", "p_brand"), p.join(sold, "p_partkey", "left_semi").filter("p_size > 25"))


def _parts(spark, d):
    """Distinct part names as records, with variants."""
    p = t(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    rec = p.select(F.col("k").alias("id"), F.concat("p_name", F.when(F.col("k") % 3 == 0, " dataset").otherwise("")).alias("name")).union(p.select(F.col("k") + 1_000_000, F.concat("p_name", F.lit("s"))))
    none = F.lit("")
    return entities.prepared(rec, "id", F.col("name"), none, none, none, none, none, [F.col("id")])


def fuzzy_pairs(spark, d):
    return entities.matches(_parts(spark, d)).select("a_id", "b_id", "reason")


def groups(spark, d):
    p = _parts(spark, d)
    return entities.leader_groups(p, entities.matches(p)).select("id", "leader")


def fused(spark, d):
    """Customers of a nation fused into the one with the smallest key; the longest name stays."""
    c = t(spark, d, "customer").select("c_custkey", "c_nationkey", F.concat("c_name", F.lpad(F.lit(""), 0, "x"), F.repeat(F.lit("x"), (F.col("c_custkey") % 17).cast("int"))).alias("Description"), F.lit("0.5").alias("Description (C)"), F.col("c_mktsegment").alias("Domain"), (F.col("c_custkey") * 7 % 89 / 100.0).cast("string").alias("Domain (C)"))
    g = c.select(F.col("c_custkey").alias("id"), "c_nationkey").join(c.groupBy(F.col("c_nationkey").alias("_n")).agg(F.min("c_custkey").alias("leader")), F.col("c_nationkey") == F.col("_n")).select("id", "leader")
    out = entities.fuse(g, c, "c_custkey", "c_custkey", texts=["Description"], others=["Domain"])
    return out.select("leader", "members", F.col("Description").alias("description"), F.col("Domain").alias("domain"), F.col("Domain (C)").alias("domain_c"))


_FUSED = """
WITH RECURSIVE c AS (SELECT c_custkey, c_nationkey, c_name || repeat('x', CAST(c_custkey % 17 AS INT)) AS de, c_mktsegment AS dv, (c_custkey * 7 % 89) / 100.0 AS dc, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k, count(*) OVER (PARTITION BY c_nationkey) AS n, min(c_custkey) OVER (PARTITION BY c_nationkey) AS leader FROM customer),
f AS (SELECT c_nationkey, leader, n, k, de, dv, dc FROM c WHERE k = 1
      UNION ALL SELECT f.c_nationkey, f.leader, f.n, c.k, CASE WHEN length(c.de) > length(f.de) THEN c.de ELSE f.de END, CASE WHEN c.dc > f.dc THEN c.dv ELSE f.dv END, CASE WHEN c.dc > f.dc THEN c.dc ELSE f.dc END FROM f JOIN c ON c.c_nationkey = f.c_nationkey AND c.k = f.k + 1)
SELECT leader, n AS members, de AS description, dv AS domain, dc AS domain_c FROM f WHERE k = n
"""


def blocks(spark, d):
    return entities.duplicate_blocks(t(spark, d, "documents"), "doc_id", F.md5(normalize("text")))


def closest(spark, d):
    p = t(spark, d, "part").groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("k"))
    return entities.closest_match(p, "k", "p_name", "p_brand", "k").select("id", "match", F.round("score", 6).alias("score"))


def merge_summary(spark, d):
    p = _parts(spark, d)
    return entities.merge_summary(entities.leader_groups(p, entities.matches(p)), p.select(F.col("id").alias("_id"), "name"), "_id", "name").filter("members > 1")


def name_similarity(spark, d):
    n = t(spark, d, "nation").select("n_name")
    r = t(spark, d, "region").select("r_name")
    return n.join(F.broadcast(r), F.lit(True)).select("n_name", "r_name", F.round(similarity(F.lower("n_name"), F.lower("r_name")), 6).alias("ratio"))


QUERIES = {
    "kb_link_last_wins": (link_last, "SELECT c_custkey, coalesce(p, 'Unknown') AS project FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey"),
    "kb_members": (members, "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "kb_non_members": (non_members, "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "kb_exclusive_members": (exclusive, "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F')"),
    "kb_quarantine": (quarantine, _QUARANTINE),
    "kb_upsert": (upsert, "WITH b AS (SELECT c_custkey + 600 AS k, upper(c_name) AS n, CASE WHEN c_custkey % 2 = 0 THEN 'NEW' END AS s FROM customer WHERE c_custkey % 3 = 0) SELECT coalesce(c_custkey, k) AS c_custkey, coalesce(n, c_name) AS c_name, coalesce(s, c_mktsegment) AS c_mktsegment FROM customer FULL JOIN b ON k = c_custkey"),
    "kb_replace_partition": (replace_partition, "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT event_id, event_type FROM events WHERE event_type <> 'click' UNION ALL SELECT event_id, 'click' FROM events WHERE event_id % 50 = 0) GROUP BY event_type"),
    "kb_match_any": (match_any, "WITH k AS (SELECT p_partkey, unnest([p_name, p_type, p_brand]) AS name FROM part) SELECT name, min(p_partkey) AS p_partkey FROM k GROUP BY name"),
    "kb_insert_absent": (insert_absent, "WITH b AS (SELECT 'SUPPLIER#' || lpad(CAST(c_custkey % 300 AS VARCHAR), 9, '0') AS s_name, min(c_custkey) AS c_custkey FROM customer GROUP BY 1) SELECT s_name, c_custkey FROM b WHERE lower(s_name) NOT IN (SELECT lower(s_name) FROM supplier)"),
    "kb_new_ids": (new_ids, "SELECT r_regionkey, r_name, printf('DS_%03d', (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY r_regionkey)) AS id FROM region"),
    "kb_merge_aliases": (aliases, "SELECT n_nationkey, n_name || ', ' || r_name || ', x' || n_nationkey AS aliases FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "kb_overall_confidence": (overall, "SELECT c_custkey, printf('%.4f', 0.8 * ((CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE (c_custkey * 7 % 101) / 100.0 END + (c_custkey * 11 % 101) / 100.0) / 2)) AS overall FROM customer"),
    "kb_write_back": (write_back, "WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE c_mktsegment END AS v, (c_custkey % 10) / 10.0 AS c, c_custkey % 2 = 0 AND c_custkey % 8 <> 0 AS has FROM customer) SELECT c_custkey, CASE WHEN has AND (0.5 > c OR v = '') THEN 'fixed' ELSE v END AS domain, CASE WHEN has AND (0.5 > c OR v = '') THEN '0.5' ELSE CAST(c AS VARCHAR) END AS conf FROM c"),
    "kb_relink_chain": (relink_chain, _RELINK),
    "kb_singletons": (singletons, _SINGLES),
    "kb_project_health": (health, _HEALTH),
    "kb_merge_targets": (merge_targets, f"WITH {JOBS}, p AS (SELECT project, count(*) FILTER (WHERE mode IN ('AGENT', 'HARVEST')) AS runs, max(ts) FILTER (WHERE mode IN ('AGENT', 'HARVEST')) AS r, max(ts) FILTER (WHERE mode = 'MERGE') AS m FROM jobs WHERE project <> 'PROJ_3' GROUP BY 1) SELECT project, runs FROM p WHERE runs > 1 AND (m IS NULL OR r > m)"),
    "kb_repair_targets": (repair_targets, f"WITH {JOBS}, n AS (SELECT 'PROJ_' || c_nationkey AS project, CAST(sum(CASE WHEN c_custkey % 5 < c_nationkey % 4 THEN 1 ELSE 0 END) AS BIGINT) AS need, count(*) AS total FROM customer GROUP BY 1), l AS (SELECT project, max(ts) FILTER (WHERE mode = 'REPAIR') AS a, max(ts) FILTER (WHERE mode IN ('AGENT', 'HARVEST', 'MERGE')) AS b FROM jobs GROUP BY 1) SELECT n.project, need, total, round(need * 100.0 / total, 6) AS pct FROM n LEFT JOIN l USING (project) WHERE need * 100.0 / total > 30 AND total > 2 AND (a IS NULL OR coalesce(a < b, false))"),
    "kb_unrun_projects": (unrun, "SELECT 'proj_' || n_nationkey AS project FROM nation WHERE n_nationkey % 7 <> 0 AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey % 3 = 0)"),
    "kb_link_fan_out": (fan_out, "SELECT o_custkey AS c_custkey, count(DISTINCT o_orderstatus) AS projects FROM orders GROUP BY 1"),
    "kb_dedupe_keep_first": (dedupe_first, "SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY lower(trim(text, ' '))"),
    "kb_new_names": (new_brands, "SELECT p_name, p_brand FROM part EXCEPT SELECT p_name, p_brand FROM part WHERE p_size > 25 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)"),
    "entity_fuzzy_pairs": (fuzzy_pairs, None),
    "entity_leader_groups": (groups, None),
    "entity_merge_summary": (merge_summary, None),
    "entity_golden_fusion": (fused, _FUSED),
    "entity_duplicate_blocks": (blocks, "SELECT md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS block, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1"),
    "entity_closest_match": (closest, None),
    "entity_name_similarity": (name_similarity, None),
}
