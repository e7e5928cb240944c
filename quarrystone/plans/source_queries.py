"""Queries over sources and sinks, file names, sheets and small column functions."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrystone.functions import text, values
from quarrystone.functions.constants import SCHEMA_MAP, TABS
from quarrystone.operators import catalog, evaluation, inventory, maintenance, retrieval
from quarrystone.operators.work import folder
from quarrystone.sources import cascade, data_files, documents, harvest, pages, runs, sheets, store, tables
from quarrystone.sources.providers import HashedWords, Seeded, first_ready

from .fixtures import t


def _pick(xs, key):
    return F.element_at(F.array(*map(F.lit, xs)), (F.col(key) % len(xs) + 1).cast("int"))


def table_round_trip(spark, d):
    """A tab is written, written anew, gets a row and a row that must be there."""
    root = folder(spark)
    tables.write_table(t(spark, d, "region").select(F.col("r_name").alias("ProjectID")), root, "Projects")
    n = t(spark, d, "nation").select(F.concat(F.lit("PROJ_"), F.col("n_nationkey").cast("string")).alias("ProjectID"), F.col("n_name").alias("Name"), F.when(F.col("n_nationkey") % 5 == 0, "=1+1").otherwise("d").alias("Description"))
    tables.write_table(n, root, "Projects")
    tables.append_row(spark, root, "Projects", {"ProjectID": "PROJ_X", "Name": ["a", "b"]})
    full = sheets.ensure_row(sheets.ensure_row(tables.read_table(spark, root, "Projects"), "ProjectID", "PROJ_LOST", {"Name": "lost"}), "ProjectID", "PROJ_X", {"Name": "other"})
    return full.select(F.col("ProjectID").alias("project"), F.col("Name").alias("name"), F.col("Description").alias("description"), F.col("Type").alias("type"))


_ROUND_TRIP = """
SELECT 'PROJ_' || n_nationkey AS project, n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN '''=1+1' ELSE 'd' END AS description, '' AS type FROM nation
UNION ALL SELECT 'PROJ_X', '["a", "b"]', '', '' UNION ALL SELECT 'PROJ_LOST', 'lost', '', ''
"""


def concurrent_writers(spark, d):
    """Four writers upsert a quarter of the suppliers each into one tab, all at once; half of them under the lease."""
    root = folder(spark)
    s = t(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("PROJ_"), F.col("s_suppkey").cast("string")).alias("ProjectID"), F.col("s_name").alias("Name"))
    parts = [s.filter(F.col("s_suppkey") % 4 == k).drop("s_suppkey") for k in range(4)]

    def write(k):
        change = lambda now: now.join(parts[k].select("ProjectID"), "ProjectID", "left_anti").unionByName(tables.conform(parts[k], now.columns))
        if k % 2:
            with store.Lease(spark, root):
                tables.update_table(spark, root, "Projects", change)
        else:
            tables.update_table(spark, root, "Projects", change)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    return tables.read_table(spark, root, "Projects").select(F.col("ProjectID").alias("project"), F.col("Name").alias("name"))


class _Lost(Exception):
    pass


def resumed_rounds(spark, d):
    """Orders come to their customers' totals in four rounds; the writer is lost in the third, another one goes on."""
    at = store.Store(spark, folder(spark))
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    seen = []

    def start():
        return o.limit(0).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("most"))

    def step(now, k):
        if k == 3 and not seen:
            seen.append(k)
            raise _Lost
        more = o.filter(F.col("o_orderkey") % 4 == k - 1).select("o_custkey", F.lit(1).cast("long").alias("n"), F.col("o_totalprice").alias("most"))
        return now.unionByName(more).groupBy("o_custkey").agg(F.sum("n").alias("n"), F.max("most").alias("most"))

    try:
        at.iterate("totals", start, step, 4)
    except _Lost:
        pass
    return at.iterate("totals", start, step, 4)


def wiped(spark, d):
    root = folder(spark)
    tables.write_table(t(spark, d, "nation").select(F.col("n_name").alias("ProjectID")), root, "Projects")
    tables.wipe_tables(spark, root)
    parts = [tables.read_table(spark, root, tab).agg(F.lit(tab).alias("tab"), F.count(F.lit(1)).alias("n")) for tab in TABS]
    return reduce(lambda a, b: a.union(b), parts)


def exported_runs(spark, d):
    """Wide rows go out as CSV, with numbers that are none, and come back as facts."""
    path = f"{folder(spark)}/Bench_UTSD_x"
    p = t(spark, d, "part")
    wide = p.select(F.col("p_name").alias("Dataset Name"), F.col("p_brand").alias("Domain"), F.when(F.col("p_partkey") % 3 == 0, float("nan")).otherwise(F.col("p_retailprice")).alias("Number of Time Points"), F.when(F.col("p_partkey") % 4 == 0, 'a "quoted", one').otherwise(F.col("p_type")).alias("Type"))
    runs.export(wide, path, {"Project": "UTSD", "Benchmark_Model": "m"})
    f = runs.facts(runs.read_runs(spark, [path]))
    return f.groupBy("project", "field").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("norm_value").alias("n_values"))


_EXPORTED = """
SELECT 'unknown' AS project, field, count(*) AS n, count(DISTINCT v) AS n_values
FROM (SELECT unnest(['Domain', 'Num Time Points', 'Type']) AS field, unnest([lower(p_brand), CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_retailprice AS VARCHAR) END, CASE WHEN p_partkey % 4 = 0 THEN 'a "quoted", one' ELSE lower(p_type) END]) AS v FROM part) WHERE v IS NOT NULL GROUP BY field
"""


def empty_export(spark, d):
    path = f"{folder(spark)}/empty"
    runs.export(t(spark, d, "nation").filter("n_nationkey < 0").select("n_name"), path, {"Project": "UTSD"}, {"Project": "UTSD", "n_name": "[no datasets]"})
    return runs.read_csv(spark, path).select(F.col("Project").alias("project"), F.col("n_name").alias("name"))


def ordered_actions(spark, d):
    """Actions on orders are written in order of action and project, and read back with their places."""
    path = f"{folder(spark)}/actions"
    rows = t(spark, d, "orders").select(_pick(["Repair", "Merge", "Keep"], "o_orderkey").alias("action"), F.concat(F.lit("P"), F.col("o_custkey") % 50).alias("project"), F.concat(F.col("o_orderpriority"), F.lit(', "'), "o_orderstatus", F.lit('"\nend')).alias("note"), F.col("o_orderkey").alias("key"))
    runs.export_ordered(rows, path, ["action", "project", "key"])
    return runs.read_ordered(spark, path).select("position", "action", "project", "note", F.col("key").cast("long").alias("key"))


_ORDERED = """
WITH a AS (SELECT ['Repair', 'Merge', 'Keep'][o_orderkey % 3 + 1] AS action, 'P' || (o_custkey % 50) AS project, o_orderpriority || ', "' || o_orderstatus || '"' || chr(10) || 'end' AS note, CAST(o_orderkey AS BIGINT) AS key FROM orders)
SELECT row_number() OVER (ORDER BY action, project, key) AS position, action, project, note, key FROM a
"""


def log_heads(spark, d):
    """Logs are written, one a region; their heads name the project."""
    path = folder(spark) + "/logs"
    r = t(spark, d, "region").select("r_regionkey", F.concat(F.lit("start\nSTARTING PROJECT: "), _pick(["utsd_1", "LOTSA", "M2", "nowhere", "Tempo"], "r_regionkey"), F.lit("\n"), F.repeat(F.lit("x"), 100)).alias("value"))
    r.write.partitionBy("r_regionkey").text(path)
    logs = runs.read_logs(spark, path, 40).withColumn("r_regionkey", F.regexp_extract("file", "r_regionkey=([0-9]+)", 1).cast("int"))
    return logs.select("r_regionkey", F.length("text").cast("long").alias("n"), text.project_in_text("text").alias("project"))


def pipe_facts(spark, d):
    n = t(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("{'dataset': '"), "n_name", F.lit("', 'field': 'Domain', 'value': 'v'}"))).when(F.col("n_nationkey") % 3 == 1, F.concat(F.col("n_name"), F.lit(" | Type | w"))).otherwise("plain words").alias("text"))
    return runs.pipe_facts(runs.lines(n, "n_nationkey", "text"), "n_nationkey").select("n_nationkey", "dataset", "field", "value")


def inspected_files(spark, d):
    """A delimited file with a header and one of numbers alone."""
    path = folder(spark) + "/files"
    p = t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice").coalesce(1)
    p.write.option("header", True).csv(f"{path}/with")
    t(spark, d, "region").select("r_regionkey", F.col("r_regionkey").cast("double").alias("x")).coalesce(1).write.option("sep", "\t").csv(f"{path}/without")
    files = data_files.inspect_files(spark, path, "*.csv")
    return files.select("status", "file_type", F.col("column_count").cast("long").alias("columns"), F.array_join("headers_sample", ",").alias("headers"), F.col("data_type_estimate").alias("kind"), F.col("preview_rows_parsed").cast("long").alias("n"))


_INSPECTED = """
SELECT 'SUCCESS' AS status, 'DELIMITED' AS file_type, 3 AS columns, 'p_partkey,p_size,p_retailprice' AS headers, 'Multivariate' AS kind, least(count(*), 1000) AS n FROM part
UNION ALL SELECT 'SUCCESS', 'DELIMITED', 2, 'col_0,col_1', 'Multivariate', count(*) FROM region
"""

def many_inspected(spark, d):
    """The line items of each shipping month as CSV files of at most a thousand rows, inspected by their heads."""
    path = folder(spark)
    l = t(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_orderkey", "l_quantity", "l_returnflag")  # noqa: E741
    l.write.partitionBy("month").option("header", True).option("maxRecordsPerFile", 1000).csv(f"{path}/files")
    found = data_files.inspect_files(spark, f"{path}/files", "*.csv").filter(F.col("bytes_read") <= data_files.HEAD + 512)
    month = F.regexp_extract("path", "month=([0-9-]+)", 1)
    return found.groupBy(month.alias("month"), "status", "file_type").agg(F.max("column_count").cast("long").alias("columns"), F.max(F.array_join("headers_sample", ",")).alias("headers"), F.max("data_type_estimate").alias("kind"), F.sum("preview_rows_parsed").alias("n"))


def archives(spark, d):
    """All customers in ZIP files written by the tasks that read them, inspected by the archives' directories."""
    path = folder(spark)
    c = t(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    written = data_files.write_archives(c, f"{path}/zips").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("rows")).first()
    found = data_files.inspect_files(spark, f"{path}/zips", "*.zip")
    whole = found.agg(F.count(F.lit(1)).alias("found"), F.sum("preview_rows_parsed").alias("n"), F.max("column_count").cast("long").alias("columns"), F.max(F.array_join("headers_sample", ",")).alias("headers"), F.max("file_type").alias("file_type"), F.max("extracted_file_name").alias("member"))
    return whole.select((F.col("found") == written["n"]).alias("all_found"), F.lit(written["rows"]).alias("written"), "n", "columns", "headers", "file_type", "member")


#: File names with the folder, whether administrative, whether of a run and the class, worked out by hand.
FILES = (
    ("Bench_UTSD_q_20260701_1200.csv", "run1", False, True, "Data CSV"),
    ("Bench_UTSD_q_20260707_1200.csv", "run2", False, True, "Data CSV"),
    ("UTSD_20260702_ConsoleLog.txt", "Colab", False, True, "TXT-Log"),
    ("notes.md", "Ignored", True, False, "Other"),
    ("utsd_vram.csv", "VRAM", False, True, "VRAM CSV"),
    ("m2_final.csv", "run1", False, True, "Data CSV"),
    ("am2_final.csv", "Trash_Bin", False, False, "Data CSV"),
    ("leaderboard_utsd.csv", "Trash_Bin", True, False, "Data CSV"),
    ("GoldenKB_utsd.csv", "Ignored", True, False, "Data CSV"),
    ("x.pdf", "Trash_Bin", True, False, "Other"),
    ("lotsa_checkpoint.csv", "Trash_Bin", False, True, "Checkpoint CSV"),
    ("cascade_anything.log", "Trash_Bin", False, False, "Log"),
)

WORKSPACE = text.Workspace(
    admin_words=("leaderboard", "inventory", "goldenkb", "token"),
    spent_words=("checkpoint", "leaderboard", "ablation"),
    kept_words=("goldenkb",),
    kept_files=("makefile",),
    projects=("utsd", "lotsa", "timebench", "tempo", "m2", "m6"),
    folders=(("Colab", ("cloud", "colab", "20260702")), ("run2", ("run2", "20260707", "20260708"))),
)


def _files(spark, d):
    return t(spark, d, "orders").select("o_orderkey", _pick([f[0] for f in FILES], "o_orderkey").alias("file"))


def file_folders(spark, d):
    return _files(spark, d).select("o_orderkey", text.workspace_folder("file", WORKSPACE).alias("folder"), text.is_admin_file("file", WORKSPACE).alias("admin"), text.is_run_file("file", WORKSPACE).alias("of_run"))


def file_types(spark, d):
    return inventory.class_counts(_files(spark, d), "file")


def _listed(k):
    return "[" + ", ".join(repr(f[k]) for f in FILES) + f"][CAST(o_orderkey % {len(FILES)} + 1 AS INT)]"


FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "yyyyMMdd_HHmm", "'soon'")


def parsed_times(spark, d):
    o = t(spark, d, "orders")
    shown = reduce(lambda a, k: a.when(F.col("o_orderkey") % len(FORMATS) == k, F.date_format("o_orderdate", FORMATS[k])), range(len(FORMATS)), F)
    return o.select("o_orderkey", F.date_format(text.parsed_time(F.concat(F.lit(" "), shown)), "yyyy-MM-dd HH:mm").alias("time"))


_TIMES = """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d 00:00') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M') END AS time FROM orders
"""


def first_gaps(spark, d):
    g = t(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("round"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return inventory.first_gaps(g, "round", "at")


def _rounds(spark, d):
    e = t(spark, d, "events").select("user_id", F.dayofmonth("ts").alias("day"))
    return e.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("gaps"))


def stalls(spark, d):
    return inventory.stalls(_rounds(spark, d), "user_id", "day", "gaps").select("user_id", "day", "closed", "stalled")


_STALLS = """
WITH r AS (SELECT user_id, day(ts) AS day, count(*) AS gaps FROM events GROUP BY ALL), c AS (SELECT *, lag(gaps) OVER w - gaps AS closed FROM r WINDOW w AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, CAST(day AS INT) AS day, closed, coalesce(sum(CASE WHEN closed < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0) = 3 AS stalled FROM c
"""


def dimensions(spark, d):
    p = t(spark, d, "part")
    entry = F.concat(F.lit("'"), F.col("p_brand"), F.lit("': "), F.col("p_size").cast("string"))
    v = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("{'Brand': 1, "), entry, F.lit("}"))).when(F.col("p_partkey") % 5 == 1, F.lit("{'zz': 1}")).when(F.col("p_partkey") % 5 == 2, F.lit("1-5")).when(F.col("p_partkey") % 5 == 3, F.concat(F.lit("{"), entry, F.lit("oops}"))).otherwise(F.concat(F.lit("sizes: {'a': 1, "), entry, F.lit("} rows")))
    return p.select("p_partkey", values.dimension_text(v, F.col("p_brand")).alias("value"))


_DIMENSIONS = "SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN '[extraction_error: dict_returned]' WHEN 2 THEN '1-5' WHEN 3 THEN '[extraction_error: complex_string]' ELSE CAST(p_size AS VARCHAR) END AS value FROM part"


def small_functions(spark, d):
    s = t(spark, d, "supplier")
    k = F.col("s_suppkey").cast("string")
    return s.select(
        "s_suppkey", text.mapped_key(F.concat(F.lit(" Dataset "), F.when(F.col("s_suppkey") % 2 == 0, "Name").otherwise("Id")), SCHEMA_MAP).alias("key"), text.squeeze(F.concat(F.lit("a  \t b\n\n\n\n"), k)).alias("squeezed"),
        text.sheet_id(F.concat(F.lit("https://docs.x/spreadsheets/d/ab-"), k, F.lit("/edit"))).alias("sheet"), text.file_name_part(F.concat(F.lit("a b/"), k, F.lit(".é"))).alias("part"),
        text.arxiv_id(F.concat(F.lit("see arxiv.org/pdf/2106.1"), F.lpad(k, 4, "0"), F.lit("v2"))).alias("paper"), text.fill_template(F.lit("about {name} or {name}"), F.col("s_name")).alias("filled"),
    )


_SMALL = """
SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'variantname' ELSE 'datasetid' END AS key, 'a b' || chr(10) || chr(10) || s_suppkey AS squeezed, 'ab-' || s_suppkey AS sheet, 'a_b_' || s_suppkey || '__' AS part, '2106.1' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS paper, 'about ' || s_name || ' or ' || s_name AS filled FROM supplier
"""


def _sheet(spark, d):
    k = F.col("n_nationkey")
    cells = F.array(F.concat(F.lit(" proj_"), F.lower("n_name")), F.concat(F.col("n_name"), F.lit(", other")), F.concat(F.lit("http://a.org/"), k.cast("string"), F.lit(", junk https://b.org")), F.when(k % 2 == 0, "about").otherwise(""), F.when(k % 3 == 0, "-1").otherwise("x"))
    return t(spark, d, "nation").select("n_nationkey", F.slice(cells, 1, F.when(k % 7 == 0, 2).otherwise(5)).alias("cells"))


def sheet_projects(spark, d):
    p = sheets.projects(_sheet(spark, d), "cells")
    return p.select("id", "names", F.array_join("links", " ").alias("links"), F.col("method").cast("long").alias("method"), "context")


_PROJECTS = """
SELECT 'PROJ_' || upper(n_name) AS id, n_name || ', other' AS names, CASE WHEN n_nationkey % 7 = 0 THEN '' ELSE 'http://a.org/' || n_nationkey || ' https://b.org' END AS links, CASE WHEN n_nationkey % 7 <> 0 AND n_nationkey % 3 = 0 THEN -1 ELSE 1 END AS method, n_name || ', other' || CASE WHEN n_nationkey % 7 <> 0 AND n_nationkey % 2 = 0 THEN ' - about' ELSE '' END AS context FROM nation
"""


def sheet_resolved(spark, d):
    n = t(spark, d, "nation").select(F.concat(F.lit("PROJ_"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.col("n_name"), F.lit(", all")).alias("names"), F.concat(F.lit("see http://x.org/"), F.col("n_nationkey").cast("string"), F.lit(" and http://y.org")).alias("note"))
    by_id, by_name = sheets.resolve(n, "id", "names", "proj_3"), sheets.resolve(n, "id", "names", "All")
    return by_id.withColumn("asked", F.lit("id")).union(by_name.withColumn("asked", F.lit("name"))).select("asked", "id", F.array_join("urls", " ").alias("urls"))


def cited(spark, d):
    n = t(spark, d, "nation").select("n_nationkey", F.format_string("as [%d], [%d] and [%d]", F.col("n_nationkey") % 5, F.col("n_nationkey") % 3, F.col("n_nationkey") + 90).alias("text"))
    refs = t(spark, d, "region").select(F.col("r_regionkey").alias("ref"), F.col("r_name").alias("entry"))
    return sheets.cited(n, refs, "n_nationkey", "text").select("n_nationkey", F.array_join("entries", "; ").alias("entries"))


_CITED = """
SELECT n_nationkey, string_agg(r_name, '; ' ORDER BY r_regionkey) AS entries FROM nation JOIN region ON r_regionkey IN (n_nationkey % 5, n_nationkey % 3) GROUP BY n_nationkey
"""


def in_project(spark, d):
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    project = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("the "), F.upper("n_name"), F.lit(" set"))).when(F.col("n_nationkey") % 3 == 1, F.col("r_name")).otherwise(" ")
    return n.select("n_nationkey", sheets.in_project(F.lower("n_name"), project).alias("inside"))


def error_rate(spark, d):
    e = t(spark, d, "events").withColumn("verdict", F.when(F.col("event_id") % 4 == 0, "Semantic Match (too strict)").when(F.col("event_id") % 4 == 1, "True Conflict"))
    matched = maintenance.semantic_matches(e, "verdict").select("event_id", F.lit(True).alias("same"))
    checked = e.join(matched, "event_id", "left").withColumn("same", F.coalesce("same", F.lit(False)))
    return evaluation.verdict_error_rate(checked, F.col("same")).select("n", F.round("rate", 9).alias("rate"))


def new_documents(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.concat_ws(":", F.md5("text"), "lang").alias("ref"), F.when(F.col("doc_id") % 4 != 0, F.col("text")).alias("content"))
    return retrieval.new_documents(x, x.filter("doc_id % 3 = 0"), "ref", "content", "doc_id").select("doc_id", "ref")


_NEW_DOCUMENTS = """
WITH x AS (SELECT doc_id, md5(text) || ':' || lang AS ref, doc_id % 4 <> 0 AND text <> '' AS full_ FROM documents)
SELECT min(doc_id) AS doc_id, ref FROM x WHERE full_ AND ref NOT IN (SELECT ref FROM x WHERE doc_id % 3 = 0) GROUP BY ref
"""


def effective_names(spark, d):
    c = t(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select("c_custkey", catalog.effective_name(F.when(k % 3 == 0, "unknown").otherwise(F.col("c_name")), F.when(k % 2 == 0, "DS_001").otherwise(F.col("c_mktsegment")), aliases=F.when(k % 5 != 0, F.concat(F.lit("n/a, "), F.col("c_mktsegment"), F.lit("_alias")))).alias("name"))


_EFFECTIVE = "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name WHEN c_custkey % 5 <> 0 THEN c_mktsegment || '_alias' WHEN c_custkey % 2 = 0 THEN 'unknown' ELSE c_mktsegment END AS name FROM customer"


def audited_results(spark, d):
    c = t(spark, d, "customer")
    r = retrieval.audited(F.when(F.col("c_custkey") % 4 == 0, "N/A").otherwise(F.col("c_mktsegment")), F.lit(0.7), F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, 0.5), F.array(F.lit("s1"), F.lit("s2"), F.lit("s3"), F.lit("s4")))
    return c.select("c_custkey", r.alias("r")).select("c_custkey", "r.value", "r.confidence", F.col("r.telemetry_context").alias("telemetry"))


_AUDITED = """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '[missing]' ELSE c_mktsegment END AS value, CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE 0.7 END AS confidence, 'Rationale: ' || c_name || chr(10) || 'Top Score: ' || CASE WHEN c_custkey % 2 = 0 THEN '0.50' ELSE '0.00' END || chr(10) || 'Sources: [''s1'', ''s2'', ''s3'']' AS telemetry FROM customer
"""


def grounding(spark, d):
    n = t(spark, d, "nation")
    listed = F.concat(F.lit("see https://github.com/"), F.lower("n_name"), F.lit(" and http://x.org/a, http://y.org/p.pdf https://github.com/"), F.lower("n_name"))
    return n.select("n_nationkey", F.array_join(retrieval.preflight_urls(listed), " ").alias("urls"), retrieval.grounding_text(F.col("n_name"), F.lit("d"), F.array(F.lit("u1"), F.lit("u2"), F.lit("u3")), 2).alias("grounding"))


_GROUNDING = """
SELECT n_nationkey, CASE WHEN contains(n_name, ' ') THEN 'https://github.com/' || split_part(lower(n_name), ' ', 1) || ' http://y.org/p.pdf' ELSE 'https://github.com/' || lower(n_name) || ' http://y.org/p.pdf' END AS urls, 'Project: ' || n_name || chr(10) || 'Description: d' || chr(10) || 'URLs: u1, u2' AS grounding FROM nation
"""


def standard_records(spark, d):
    n = t(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("Name"), F.lower("n_name").alias("title"))
    r = pages.standard_keys(n, {"id": ("ID", "n_nationkey"), "name": ("name", "TITLE"), "area": ("area",)})
    return r.select("id", "name", F.col("area").cast("string").alias("area"), pages.variable_table(F.array(F.lit("a"), F.lit("b")), F.array(F.array(F.col("name"), F.lit("1")))).alias("shown"))


_STANDARD_RECORDS = "SELECT n_nationkey AS id, n AS name, CAST(NULL AS VARCHAR) AS area, '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n || ' | 1 |' AS shown FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE lower(n_name) END AS n FROM nation)"


def audit(spark, d):
    """Customers of a nation audited into the one with the smallest key."""
    c = t(spark, d, "customer").select("c_custkey", "c_nationkey", F.repeat(F.lit("x"), (F.col("c_custkey") * 7 % 23).cast("int")).alias("Description"), F.concat(F.lit("u"), (F.col("c_custkey") % 3).cast("string"), F.lit(", u"), (F.col("c_custkey") % 5).cast("string")).alias("URL"), F.col("c_mktsegment").alias("Domain"), (F.col("c_custkey") * 7 % 89 / 100.0).cast("string").alias("Domain (C)"))
    g = c.select(F.col("c_custkey").alias("id"), "c_nationkey").join(c.groupBy(F.col("c_nationkey").alias("_n")).agg(F.min("c_custkey").alias("leader")), F.col("c_nationkey") == F.col("_n")).select("id", "leader")
    kept, log = maintenance.audit_fused(g, c, "c_custkey", "c_custkey", ["URL"], ["Description"], ["Domain"])
    said = log.groupBy("leader").agg(F.count_if(F.col("notes").contains("Upgraded Domain")).alias("upgrades"), F.count_if(F.col("notes").contains("Added URL")).alias("additions"), F.count_if(F.col("notes").contains("Description")).alias("texts"))
    return kept.join(said, "leader").select("leader", F.length("Description").cast("long").alias("n"), F.size(F.split("URL", r"[,|]")).cast("long").alias("urls"), F.col("Domain").alias("domain"), "upgrades", "additions", "texts")


_AUDIT = """
WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_custkey * 7 % 23 AS len, c_mktsegment AS dom, (c_custkey * 7 % 89) / 100.0 AS conf, min(c_custkey) OVER (PARTITION BY c_nationkey) AS leader, 'u' || c_custkey % 3 AS a, 'u' || c_custkey % 5 AS b FROM customer),
w AS (SELECT *, max(conf) OVER p AS best, max(CASE WHEN len > 0 THEN len END) OVER p AS longest FROM c WINDOW p AS (PARTITION BY n ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT n, k, unnest([a, b]) AS u FROM c), f AS (SELECT n, u, min(k) AS k FROM i GROUP BY ALL), s AS (SELECT DISTINCT n, k FROM f)
SELECT w.leader, CAST(coalesce(max(len), 0) AS BIGINT) AS n, CAST(any_value(x.urls) + any_value(x.again) AS BIGINT) AS urls, arg_max(dom, conf * 1000000 - w.k / 1000000.0) AS domain, count(*) FILTER (WHERE w.k <> w.leader AND conf > best) AS upgrades, count(*) FILTER (WHERE w.k <> w.leader AND s.k IS NOT NULL) AS additions, count(*) FILTER (WHERE w.k <> w.leader AND len > 0 AND (longest IS NULL OR len > longest)) AS texts
FROM w LEFT JOIN s ON s.n = w.n AND s.k = w.k JOIN (SELECT c.n, (SELECT count(DISTINCT u) FROM i WHERE i.n = c.n) AS urls, max(CASE WHEN k = leader AND a = b THEN 1 ELSE 0 END) AS again FROM c GROUP BY c.n) x ON x.n = w.n GROUP BY w.leader
"""


def repaired_links(spark, d):
    """Primary links of customers: papers, data, ZIP files of a repository, or none; a search found some."""
    k = F.col("c_custkey")
    c = t(spark, d, "customer")
    value = F.when(k % 4 == 0, "https://arxiv.org/abs/1").when(k % 4 == 1, "https://data.org/x").when(k % 4 == 2, "https://archive.ics.uci.edu/a.zip").otherwise("[missing]")
    cells = c.select(F.col("c_name").alias("dataset_name"), F.lit("Link to Data (Actual Source)").alias("field"), value.alias("value"), F.lit(0.5).alias("confidence"))
    types = c.select(F.col("c_name").alias("dataset_name"), F.when(k % 5 == 0, "Provider").otherwise("Dataset").alias("type"))
    found = c.filter("c_custkey % 3 <> 0").select(F.col("c_name").alias("dataset_name"), F.inline(F.array(F.struct(F.lit("https://doi.org/1").alias("url"), F.lit(0).alias("rank")), F.struct(F.concat(F.lit("https://archive.ics.uci.edu/dataset/"), k.cast("string")).alias("url"), F.lit(1).alias("rank")))))
    return maintenance.repair_archive_links(maintenance.repair_links(cells, types, found), found).select("dataset_name", "value", "confidence")


_REPAIRED = """
SELECT c_name AS dataset_name, CASE WHEN c_custkey % 3 <> 0 AND (c_custkey % 4 = 2 OR (c_custkey % 4 IN (0, 3) AND c_custkey % 5 <> 0)) THEN 'https://archive.ics.uci.edu/dataset/' || c_custkey WHEN c_custkey % 4 = 0 THEN 'https://arxiv.org/abs/1' WHEN c_custkey % 4 = 1 THEN 'https://data.org/x' WHEN c_custkey % 4 = 2 THEN 'https://archive.ics.uci.edu/a.zip' ELSE '[missing]' END AS value,
  CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 4 = 2 THEN 0.98 WHEN c_custkey % 3 <> 0 AND c_custkey % 4 IN (0, 3) AND c_custkey % 5 <> 0 THEN 0.95 ELSE 0.5 END AS confidence FROM customer
"""


def embedded_texts(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text")
    e = first_ready([HashedWords()]).apply(docs)
    return e.select("doc_id", F.size("embedding").cast("long").alias("size"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("length"))


def chunks_with_overlap(spark, d):
    c = retrieval.chunks(t(spark, d, "documents"), "doc_id", "text", 256, 50)
    return c.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


def registry_entries(spark, d):
    """Pages with a registry pasted in: a decoy table, a larger one with a table in a cell, and references."""
    k = F.col("page_id").cast("string")
    row = lambda *cells: F.concat(F.lit("<tr>"), *[x for c in cells for x in (F.lit("<td>"), c if isinstance(c, Column) else F.lit(c), F.lit("</td>"))], F.lit("</tr>"))
    decoy = F.lit("<table><tr><td>a</td><td>b</td><td>c</td><td>d</td></tr><tr><td>e</td><td>f</td><td>g</td></tr></table>")
    rows = [row("Name", "x", "y"), row(F.concat(F.lit("Set "), k), "-", "plain"), row(F.concat(F.lit("Deep "), k), "<table><tr><td>in</td><td>ner</td></tr></table>", F.concat(F.lit("as <b>[2]</b> and [1], not ["), k, F.lit("0]"))), row("two", "cells"), row("", "no", "name")]
    refs = F.concat(F.lit("<ul><li>[1] first of "), k, F.lit("<li> [2]  second </ul><p>[3] third</p>"))
    pages = t(spark, d, "pages").select("page_id", F.concat("html", decoy, F.lit("<table>"), *rows, F.lit("</table>"), refs).alias("html"))
    return documents.entries(pages, "page_id", "html").select("page_id", "name", "description", "augmented")


_REGISTRY = """
SELECT page_id, 'Set ' || page_id AS name, 'plain' AS description, 'plain' AS augmented FROM pages
UNION ALL SELECT page_id, 'Deep ' || page_id, d, d || chr(10) || chr(10) || 'References:' || chr(10) || '[1]: first of ' || page_id || chr(10) || '[2]: second' FROM (SELECT page_id, 'as [2] and [1], not [' || page_id || '0]' AS d FROM pages)
"""


def names_in_documents(spark, d):
    """Openings of the benchmark's items in all documents."""
    names = t(spark, d, "benchmark").select("item_id", F.substring("text", 1, 40).alias("name"))
    return documents.names_in_texts(names, t(spark, d, "documents"), "item_id", "name", "doc_id", "text")


def _harvested(found):
    """Records of pages with a data script pasted in; every two pages in turn share an id, every ninth has none."""
    k = F.col("page_id")
    script = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props": {"pageProps": {"dataset": {"ID": '), F.floor(k / 2).cast("string"), F.lit(', "Name": "n'), k.cast("string"), F.lit('", "Types": "Text", "Abstract": "a"}}}}</script>'))
    r = found.select("page_id", F.concat("html", F.when(k % 9 != 0, script).otherwise("")).alias("html")).select("page_id", pages.repository_record(pages.embedded_json("html")).alias("r"))
    return r.select(F.col("r.id").alias("id"), "page_id", F.col("r.name").alias("name"))


_HARVESTED = "SELECT page_id // 2 AS id, min(page_id) AS page_id, 'n' || min(page_id) AS name FROM pages WHERE page_id % 9 <> 0 GROUP BY 1"


def harvest_batch(spark, d):
    return harvest.first_records(_harvested(harvest.read_pages(spark, f"{d}/pages.parquet")), "id", "page_id")


def harvest_streamed(spark, d):
    path = folder(spark)
    return harvest.harvest_stream(_harvested(harvest.stream_pages(spark, f"{d}/pages.parquet")), store.Store(spark, f"{path}/kb"), "records", "id", "page_id", f"{path}/checkpoint")


CASCADE = (("first", 90, 3000), ("second", 120, 3000), ("third", 160, 3000))


def cascade_answers(spark, d):
    """Every document's text asked of three providers in turn, again with less of it where none answers."""
    asked = cascade.Cascade([(n, Seeded(n, fails, 20, most)) for n, fails, most in CASCADE], store.Store(spark, folder(spark)), batches=4)
    got = cascade.with_answers(t(spark, d, "documents").select("doc_id", "text"), asked, lambda c: F.concat(F.lit("Context: "), c), "text", (4000, 1500, 200), key="doc_id")
    return got.select("doc_id", F.get_json_object("answer", "$.value").alias("value"), "attempt")


def _asked_sql():
    short = lambda n: f"CASE WHEN length(text) > {n} THEN left(text, {n}) || '... [TRUNCATED]' ELSE text END"
    fails = lambda p: " AND ".join(f"(length({p}) > {most} OR ('0x' || left(md5('{n}' || {p}), 2))::INTEGER < {bad})" for n, bad, most in CASCADE)
    prompts = ", ".join(f"'Context: ' || {short(n)} AS p{k}" for k, n in enumerate((4000, 1500, 200), 1))
    case = lambda x: "CASE " + " ".join(f"WHEN NOT ({fails(f'p{k}')}) THEN {x(k)}" for k in (1, 2, 3)) + " END"
    return f"SELECT doc_id, {case(lambda k: f'left(md5(p{k}), 8)')} AS value, {case(str)} AS attempt FROM (SELECT doc_id, {prompts} FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))"


QUERIES = {
    "harvest_records": (harvest_batch, _HARVESTED),
    "harvest_stream": (harvest_streamed, _HARVESTED),
    "registry_entries": (registry_entries, _REGISTRY),
    "registry_names_in_texts": (names_in_documents, "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, left(b.text, 40)) WHERE b.text <> ''"),
    "provider_cascade": (cascade_answers, _asked_sql()),
    "kb_table_round_trip": (table_round_trip, _ROUND_TRIP),
    "kb_concurrent_writers": (concurrent_writers, "SELECT 'PROJ_' || s_suppkey AS project, s_name AS name FROM supplier"),
    "kb_resumed_rounds": (resumed_rounds, "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY o_custkey"),
    "kb_wiped_tables": (wiped, "SELECT unnest([" + ", ".join(repr(x) for x in TABS) + "]) AS tab, CAST(0 AS BIGINT) AS n"),
    "runs_exported_facts": (exported_runs, _EXPORTED),
    "runs_empty_export": (empty_export, "SELECT 'UTSD' AS project, '[no datasets]' AS name"),
    "runs_first_gaps": (first_gaps, "SELECT l_orderkey % 50 AS round, l_orderkey * 10 + l_linenumber AS at FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey % 50 ORDER BY l_orderkey * 10 + l_linenumber) <= 15"),
    "runs_stalls": (stalls, _STALLS),
    "eval_ordered_actions": (ordered_actions, _ORDERED),
    "log_heads": (log_heads, "SELECT r_regionkey, CAST(40 AS BIGINT) AS n, ['UTSD', 'LOTSA', 'M2', 'Unknown', 'TEMPO'][r_regionkey % 5 + 1] AS project FROM region"),
    "log_pipe_facts": (pipe_facts, "SELECT n_nationkey, n_name AS dataset, CASE WHEN n_nationkey % 3 = 0 THEN 'Domain' ELSE 'Type' END AS field, CASE WHEN n_nationkey % 3 = 0 THEN 'v' ELSE 'w' END AS value FROM nation WHERE n_nationkey % 3 <> 2"),
    "file_inspections": (inspected_files, _INSPECTED),
    "file_many_inspections": (many_inspected, "SELECT strftime(l_shipdate, '%Y-%m') AS month, 'SUCCESS' AS status, 'DELIMITED' AS file_type, 3 AS columns, 'l_orderkey,l_quantity,l_returnflag' AS headers, 'Multivariate' AS kind, count(*) AS n FROM lineitem GROUP BY 1"),
    "file_archives": (archives, "SELECT true AS all_found, count(*) AS written, count(*) AS n, 3 AS columns, 'c_custkey,c_acctbal,c_mktsegment' AS headers, 'ZIP' AS file_type, 'data.csv' AS member FROM customer"),
    "file_folders": (file_folders, f"SELECT o_orderkey, {_listed(1)} AS folder, {_listed(2)} AS admin, {_listed(3)} AS of_run FROM orders"),
    "file_type_counts": (file_types, f"SELECT {_listed(4)} AS type, count(*) AS n FROM orders GROUP BY 1"),
    "text_parsed_times": (parsed_times, _TIMES),
    "text_dimensions": (dimensions, _DIMENSIONS),
    "text_small_functions": (small_functions, _SMALL),
    "sheet_projects": (sheet_projects, _PROJECTS),
    "sheet_resolved": (sheet_resolved, "SELECT a AS asked, 'PROJ_' || n_nationkey AS id, 'http://x.org/' || n_nationkey || ' http://y.org' AS urls FROM nation, (SELECT unnest(['id', 'name']) AS a) WHERE a = 'name' OR n_nationkey = 3"),
    "sheet_cited": (cited, _CITED),
    "sheet_in_project": (in_project, "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN true WHEN 1 THEN contains(lower(r_name), lower(n_name)) OR contains(lower(n_name), lower(r_name)) ELSE false END AS inside FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "eval_verdict_error_rate": (error_rate, "SELECT count(*) AS n, round(avg(CASE WHEN event_id % 4 = 0 THEN 1.0 ELSE 0.0 END), 9) AS rate FROM events"),
    "catalog_effective_names": (effective_names, _EFFECTIVE),
    "catalog_audited_results": (audited_results, _AUDITED),
    "catalog_repaired_links": (repaired_links, _REPAIRED),
    "entity_audit": (audit, _AUDIT),
    "page_standard_records": (standard_records, _STANDARD_RECORDS),
    "search_new_documents": (new_documents, _NEW_DOCUMENTS),
    "search_grounding": (grounding, _GROUNDING),
    "search_embedded_texts": (embedded_texts, None),
    "search_chunks_with_overlap": (chunks_with_overlap, None),
}
