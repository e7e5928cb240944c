"""Queries over text, pages, logs and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions import text, values
from quarrystone.operators import inventory, retrieval
from quarrystone.operators.search_index import SearchIndex
from quarrystone.operators.work import folder
from quarrystone.sources import pages, runs, sheets
from quarrystone.sources.store import Store
from quarrystone.sources.tables import conform, header_rows

from .fixtures import t


def clean_names(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.concat_ws(" ", F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, "Dataset (old)").otherwise("time-series v2"), F.lit("x_y")).alias("name"))
    return p.select("p_partkey", text.clean_name("name").alias("clean"), text.compact_key(F.concat(F.col("name"), F.lit(".csv (C)"))).alias("key"), text.alphanumeric("name").alias("alnum"))


_NAMES = r"""
WITH n AS (SELECT p_partkey, p_name || ' ' || CASE WHEN p_partkey % 2 = 0 THEN 'Dataset (old)' ELSE 'time-series v2' END || ' x_y' AS name FROM part)
SELECT p_partkey, array_to_string(list_filter(string_split_regex(regexp_replace(lower(trim(name)), '\(.*?\)', '', 'g'), '[\s_\-]+'), lambda w: w NOT IN ('dataset', 'data', 'benchmark', 'collection', 'repository', 'archive', 'series', 'time', 'prediction', 'forecasting', 'competition') AND regexp_matches(w, '^[a-z0-9]+$')), ' ') AS clean,
  regexp_replace(replace(replace(lower(name), '.csv', ''), ' (c)', ''), '[^a-z0-9]', '', 'g') AS key, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS alnum FROM n
"""


def variants(spark, d):
    """Names against the next ones by number: trailing numbers, discriminators, short names."""
    p = t(spark, d, "part").select("p_partkey", F.concat(F.col("p_name"), F.lit(" "), F.element_at(F.array(*map(F.lit, ["hourly", "daily 2", "x", "7", "m4"])), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("a"), F.concat(F.col("p_name"), F.lit(" "), F.element_at(F.array(*map(F.lit, ["daily", "daily 3", "y", "8", "m4"])), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("b"))
    return p.select("p_partkey", text.distinct_variants("a", "b").alias("distinct_variants"))


def digits(spark, d):
    s = t(spark, d, "supplier")
    return s.select("s_suppkey", text.first_integer(F.concat(F.lit("about 1,2"), F.col("s_suppkey").cast("string"), F.lit(" of 77"))).alias("n"), text.first_integer("s_name").alias("of_name"), text.first_integer(F.lit("none")).alias("none"))


def plausible(spark, d):
    p = t(spark, d, "part")
    unit = F.element_at(F.array(*map(F.lit, ["", " thousand", " million", " billion", "k"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    v = F.concat(F.lit("1 to "), F.col("p_size").cast("string"), unit)
    return p.select("p_partkey", values.plausibility(F.lit("Number of Time Points"), v).alias("veto"), F.round(values.largest_number(v), 3).alias("largest"))


_PLAUSIBLE = """
WITH p AS (SELECT p_partkey, greatest(p_size, 1) * CASE p_partkey % 5 WHEN 1 THEN 1e3 WHEN 2 THEN 1e6 WHEN 3 THEN 1e9 WHEN 4 THEN 1e3 ELSE 1 END AS v FROM part)
SELECT p_partkey, CASE WHEN v < 1 THEN 'Below Min' WHEN v > 100000000 THEN 'Above Max' ELSE '' END AS veto, round(v, 3) AS largest FROM p
"""


def urls(spark, d):
    p = t(spark, d, "pages").select("page_id", F.concat(F.lit("['"), F.upper("url"), F.when(F.col("page_id") % 2 == 0, "?q=1").otherwise("//"), F.lit("']")).alias("u"))
    return p.select("page_id", text.clean_url("u").alias("clean"), text.is_generic_url(text.clean_url("u")).alias("generic"), text.is_paper_url("u").alias("paper"), text.tidy_url(F.concat(F.lit("[x]("), F.lower("u"), F.lit("), y"))).alias("tidy"))


def page_links(spark, d):
    return t(spark, d, "pages").select("page_id", F.array_join(pages.links("html"), " ").alias("links"), F.size(pages.links("html")).cast("long").alias("n"))


def page_text(spark, d):
    return pages.with_text(t(spark, d, "pages").select("page_id", "html"), "html")


def loaded_pages(spark, d):
    p = t(spark, d, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    return pages.loaded(p, "text", 100).select("page_id")


def file_registry(spark, d):
    """File names built from orders, with every model, context and date."""
    o = t(spark, d, "orders")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("o_orderkey") % len(xs) + 1).cast("int"))
    name = F.concat(F.lit("runs/"), pick(["run2", "final", "recovery"]), F.lit("/Bench_"), pick(["UTSD", "kaggle", "LOTSA", "M2", "M2-M6"]), F.lit("_"), pick(["Qwen2.5-32B_32k", "gemma-27b_131072", "deepseek-qwen-64k", "flash", "pro"]), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd_HHmm"), pick([".csv", "_vram.csv", "_checkpoint.csv", ".log", ".txt", ".md"]))
    r = inventory.registry(o.select("o_orderkey", name.alias("path")), "path")
    return r.select("o_orderkey", "type", "project", "model", "context", F.col("run").cast("long").alias("run"), F.date_format("time", "yyyy-MM-dd HH:mm").alias("time"))


_REGISTRY = r"""
WITH p AS (SELECT o_orderkey, 'runs/' || ['run2', 'final', 'recovery'][CAST(o_orderkey % 3 + 1 AS INT)] || '/' AS dir, 'Bench_' || ['UTSD', 'kaggle', 'LOTSA', 'M2', 'M2-M6'][CAST(o_orderkey % 5 + 1 AS INT)] || '_' || ['Qwen2.5-32B_32k', 'gemma-27b_131072', 'deepseek-qwen-64k', 'flash', 'pro'][CAST(o_orderkey % 5 + 1 AS INT)] || '_' || strftime(o_orderdate, '%Y%m%d_%H%M') || ['.csv', '_vram.csv', '_checkpoint.csv', '.log', '.txt', '.md'][CAST(o_orderkey % 6 + 1 AS INT)] AS f, o_orderdate FROM orders),
s AS (SELECT *, lower(dir || f) AS s, upper(dir || f) AS u FROM p),
m AS (SELECT *, CASE WHEN contains(s, 'pro') OR contains(s, 'monolithic') THEN 'Cloud-Pro' WHEN contains(s, 'flash') OR contains(s, 'cascade') OR contains(s, 'consolelog') THEN 'Cloud-Flash' WHEN contains(s, 'deepseek') OR contains(s, 'r1') THEN 'DeepSeek' WHEN contains(s, 'qwen') THEN 'Qwen' WHEN contains(s, 'gemma') THEN 'Gemma' ELSE 'Unknown' END AS model, regexp_replace(s, '(32|31|27|14|7|70|1\.5)b', '', 'g') AS c,
  regexp_extract(lower(f), '202[6-9]([0-9]{2})([0-9]{2})_[0-9]{4}', 1) AS mo, regexp_extract(lower(f), '202[6-9]([0-9]{2})([0-9]{2})_[0-9]{4}', 2) AS dy FROM s)
SELECT o_orderkey, CASE WHEN contains(s, 'vram') AND s LIKE '%.csv' THEN 'VRAM CSV' WHEN contains(s, 'checkpoint') AND s LIKE '%.csv' THEN 'Checkpoint CSV' WHEN s LIKE '%.csv' THEN 'Data CSV' WHEN s LIKE '%.log' THEN 'Log' WHEN s LIKE '%.txt' THEN 'TXT-Log' ELSE 'Other' END AS type,
  CASE WHEN contains(u, 'KAG') THEN 'KAGGLETS' WHEN contains(u, 'UTSD') THEN 'UTSD' WHEN contains(u, 'TIMEBENCH') THEN 'TIMEBENCH' WHEN contains(u, 'LOTSA') THEN 'LOTSA' WHEN contains(u, 'TEMPO') THEN 'TEMPO' WHEN contains(u, 'TSFM') THEN 'TSFM' WHEN contains(u, 'M2') AND NOT contains(u, 'M6') THEN 'M2' WHEN contains(u, 'M6') THEN 'M6' ELSE 'Unknown' END AS project, model,
  CASE WHEN model IN ('Cloud-Pro', 'Cloud-Flash') THEN 'Cloud' WHEN contains(c, '131') OR contains(c, '128') OR contains(c, 'titan') THEN '131K' WHEN contains(c, '65') OR contains(c, '64') THEN '64K' WHEN contains(c, '32') THEN '32K' ELSE 'Unknown' END AS context,
  CAST(CASE WHEN contains(s, 'run3') OR contains(s, 'recovery') THEN 3 WHEN contains(s, 'run2') THEN 2 WHEN contains(s, 'run1') THEN 1 WHEN mo = '07' AND dy >= '09' THEN 3 WHEN mo = '07' AND dy IN ('07', '08') THEN 2 ELSE 1 END AS BIGINT) AS run, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS time FROM m
"""


def json_props(spark, d):
    e = t(spark, d, "events").select("event_id", F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")).alias("answer"))
    return e.select("event_id", F.get_json_object(text.strip_fences("answer"), "$.k").cast("long").alias("k"))


def json_recovered(spark, d):
    """Answers with a cut trailing thought and a comma too many."""
    e = t(spark, d, "events").select("event_id", F.concat(F.lit("Sure: {\"v\": [1,2,], \"k\": "), (F.col("event_id") % 9).cast("string"), F.lit(",}\n thought: {\"k\": 0}")).alias("answer"))
    return e.select("event_id", F.get_json_object(values.json_text("answer"), "$[1]").cast("long").alias("second"))


def parsed_answers(spark, d):
    e = t(spark, d, "events")
    a = F.concat(F.lit('{"value": "see https://a.org/x'), F.col("event_id").cast("string"), F.lit(', ok", "confidence": '), (F.col("event_id") % 120).cast("string"), F.lit("}"))
    p = e.select("event_id", values.parsed_answer(a, F.lit("Primary URL")).alias("p"))
    return p.select("event_id", F.col("p.value").alias("value"), F.round("p.confidence", 6).alias("confidence"))


def hyperlinks(spark, d):
    p = t(spark, d, "pages").select("page_id", F.concat(F.lit('=HYPERLINK("'), F.col("url"), F.lit('", "page '), F.col("page_id").cast("string"), F.lit('")')).alias("f"))
    return p.select("page_id", text.hyperlink_urls("f").alias("urls"), text.hyperlink_label("f").alias("label"), text.guard_formula(F.concat(F.lit(" -"), F.col("page_id").cast("string"))).alias("guarded"), text.text_or_missing(F.when(F.col("page_id") % 2 == 0, F.lit("  "))).alias("missing"))


def _log(spark, d):
    """One log a region, with a table of its nations."""
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = F.concat(F.lit("| "), F.col("n_name"), F.lit(" | "), F.col("n_nationkey").cast("string"), F.lit(" | a | b |"))
    body = n.groupBy("r_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))), lambda x: x["row"]), "\n").alias("rows"))
    head = F.concat(F.lit("start\nProcessing Project: "), F.col("r_name"), F.lit("\n| Dataset Name | Key | Note |\n|---|---|---|\n"))
    return body.select(F.col("r_name").alias("file"), F.concat(head, F.col("rows"), F.lit("\nend")).alias("text"))


def markdown(spark, d):
    return runs.markdown_tables(runs.lines(_log(spark, d), "file", "text"), "file").select("file", "project", "dataset", "field", "value")


_MARKDOWN = """
SELECT r_name AS file, split_part(r_name, ' ', 1) AS project, n_name AS dataset, unnest(['Key', 'Note']) AS field, unnest([CAST(n_nationkey AS VARCHAR), 'a | b']) AS value FROM nation JOIN region ON n_regionkey = r_regionkey
"""


def islands(spark, d):
    lines = runs.lines(_log(spark, d), "file", "text")
    return inventory.islands(lines, "file", "line_no", runs.is_row(F.col("line"))).filter("island is not null").groupBy("file", "island").agg(F.count(F.lit(1)).alias("n"))


def research(spark, d):
    n = t(spark, d, "nation")
    report = F.concat(F.lit("intro\nDataset Name ||| Frequency\n--- ||| ---\n"), F.col("n_name"), F.lit(" ||| "), F.when(F.col("n_nationkey") % 2 == 0, "daily").otherwise("hourly"), F.lit("\n\nx ||| y"))
    return runs.research_table(runs.lines(n.select("n_nationkey", report.alias("text")), "n_nationkey", "text"), "n_nationkey").select("n_nationkey", "field", "value", "confidence")


def facts(spark, d):
    p = t(spark, d, "part")
    wide = p.select(F.col("p_name").alias("Dataset Name"), F.col("p_brand").alias("Domain"), F.col("p_size").cast("string").alias("Number of Time Points"), F.lit("0.5").alias("Domain (C)"), F.when(F.col("p_partkey") % 4 == 0, "unknown").otherwise(F.col("p_type")).alias("Type"), F.lit("RAG").alias("Discovery Source"), F.lit("x/Bench_UTSD_q_20260701_1200.csv").alias("_path"))
    f = runs.facts(wide)
    return f.groupBy("project", "stamp", "field").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("norm_value").alias("n_values"), F.count("confidence").alias("n_confidences"))


_FACTS = """
SELECT 'utsd' AS project, '20260701_1200' AS stamp, field, count(*) AS n, count(DISTINCT lower(v)) AS n_values, count(*) FILTER (WHERE field = 'Domain') AS n_confidences
FROM (SELECT unnest(['Domain', 'Num Time Points', 'Type']) AS field, unnest([p_brand, CAST(p_size AS VARCHAR), CASE WHEN p_partkey % 4 = 0 THEN 'unknown' ELSE p_type END]) AS v FROM part) WHERE v <> 'unknown' GROUP BY field
"""


def sheet_hints(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("row"), F.array(F.lit("dataset"), F.col("n_name"), F.lit("hint"), F.when(F.col("n_nationkey") % 2 == 0, "more").otherwise(" ")).alias("cells"))
    return sheets.hints(n, "cells", "row")


def sheet_header(spark, d):
    """Each customer is a sheet of its orders, some of which name columns; the header is the one that names most."""
    k = F.col("o_orderkey") % 7
    named = F.when(k == 3, F.array(F.lit("id"), F.lit("name"), F.col("o_orderstatus"))).when(k == 5, F.array(F.lit("name"), F.col("o_orderpriority"), F.lit("name")))
    rows = t(spark, d, "orders").select("o_custkey", "o_orderkey", F.coalesce(named, F.array("o_orderstatus", "o_orderpriority")).alias("cells"))
    found = header_rows(rows, "o_custkey", "cells", "o_orderkey", ["id", "name", "note"])
    return found.select(F.col("sheet").cast("long").alias("sheet"), F.col("row").cast("long").alias("row"), F.col("overlap").cast("long").alias("overlap"))


_SHEET_HEADER = """
WITH r AS (SELECT o_custkey, o_orderkey, CASE o_orderkey % 7 WHEN 3 THEN 2 WHEN 5 THEN 1 ELSE 0 END AS overlap, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY overlap DESC, o_orderkey) AS best FROM r WHERE k <= 10)
SELECT CAST(o_custkey AS BIGINT) AS sheet, CAST(o_orderkey AS BIGINT) AS row, CAST(overlap AS BIGINT) AS overlap FROM b WHERE best = 1
"""


def conformed(spark, d):
    return conform(t(spark, d, "nation").withColumnRenamed("n_name", "Name"), ["Name", "n_nationkey", "Type"]).select(F.col("Name").alias("name"), F.col("n_nationkey").alias("key"), F.col("Type").alias("type"))


def standard_names(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", F.concat(F.element_at(F.array(*map(F.lit, ["google/", "", "thuml/"])), (F.col("s_suppkey") % 3 + 1).cast("int")), F.col("s_name"), F.element_at(F.array(*map(F.lit, [" (Subset)", "-small", " (a UTSD part)", "_full_x"])), (F.col("s_suppkey") % 4 + 1).cast("int"))).alias("n"))
    return s.select("s_suppkey", text.standard_name("n").alias("name"))


_STANDARD = """
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 3 THEN s_name || '_x' ELSE s_name END AS name FROM supplier
"""


def frequencies(spark, d):
    e = t(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, ["taken every 15 minutes", "HOURLY load", "10-minute data", "none", "a Weekly series"])), (F.col("event_id") % 5 + 1).cast("int")).alias("x"))
    return e.select("event_id", text.frequency("x").alias("frequency"))


def chunked(spark, d):
    c = retrieval.chunks(t(spark, d, "documents"), "doc_id", "text", 256)
    return c.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


def templates(spark, d):
    p = t(spark, d, "documents").select("doc_id", retrieval.document_text(F.concat(F.lit("http://x/"), F.repeat(F.lit("y"), 200)), F.col("source"), F.col("lang"), F.col("text")).alias("x"))
    return p.select("doc_id", F.md5("x").alias("digest"))


def vector_top(spark, d):
    """The stated query set is every vector whose id is divisible by 50; the index is all vectors."""
    e = t(spark, d, "embeddings")
    r = retrieval.vector_top_k(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 5)
    return r.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


_VECTOR = """
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, v.vec_id) AS rank, v.vec_id, round(s, 6) AS score
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) v, LATERAL (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0) q, LATERAL (SELECT list_cosine_similarity(v.e, q.e) AS s)
QUALIFY rank <= 5
"""


def _bm25(spark, d, k=5):
    q = t(spark, d, "benchmark").select("item_id", F.col("text").alias("q"))
    return retrieval.bm25_top_k(t(spark, d, "documents"), q, "doc_id", "text", "item_id", "q", k)


def bm25(spark, d):
    return _bm25(spark, d)


def indexed(spark, d):
    """All documents come to an index in two batches; every benchmark item is searched in it."""
    index, docs = SearchIndex(Store(spark, folder(spark))), t(spark, d, "documents")
    for part in (docs.filter("doc_id % 3 = 0"), docs.filter("doc_id % 3 <> 0")):
        index.add(part, "doc_id", "text")
    found = index.search(t(spark, d, "benchmark"), "item_id", "text", 5)
    return found.select("query_id", "rank", F.col("id").alias("doc_id"), "score")


_BM25_BASE = """
w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM benchmark),
p AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM w),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY ALL),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s)"""


def hybrid(spark, d):
    """Documents stand for the vectors of their number; three by vector, the rest by BM25."""
    e = t(spark, d, "embeddings")
    v = retrieval.vector_top_k(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 3).withColumnRenamed("vec_id", "doc_id")
    return retrieval.hybrid_top_k(v, _bm25(spark, d), "doc_id", 6).select("query_id", "rank", "doc_id", F.col("source").cast("long").alias("source"))


_HYBRID = f"""
WITH {_BM25_BASE},
v AS (SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, v.vec_id) AS rank, v.vec_id AS doc_id
      FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) v, LATERAL (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0) q, LATERAL (SELECT list_cosine_similarity(v.e, q.e) AS s) QUALIFY rank <= 3),
u AS (SELECT query_id, doc_id, min((source, rank)) AS pos FROM (SELECT query_id, doc_id, 0 AS source, rank FROM v UNION ALL SELECT query_id, doc_id, 1, rank FROM r WHERE rank <= 5) GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos, doc_id) AS rank, doc_id, CAST(pos[1] AS BIGINT) AS source FROM u QUALIFY rank <= 6
"""


def multi_query(spark, d):
    r = _bm25(spark, d).withColumn("topic", F.col("query_id") % 4).withColumn("query_no", F.col("query_id"))
    return retrieval.multi_query_union(r, "topic", "query_no", "doc_id", 8).select("topic", "rank", "doc_id")


_MULTI = f"""
WITH {_BM25_BASE}, u AS (SELECT query_id % 4 AS topic, doc_id, min((query_id, rank)) AS pos FROM r WHERE rank <= 5 GROUP BY ALL)
SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY pos, doc_id) AS rank, doc_id FROM u QUALIFY rank <= 8
"""


def contexts(spark, d):
    r = _bm25(spark, d).join(t(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return retrieval.context(r, "query_id", "rank", "text", 200, 700).select("query_id", F.md5("context").alias("digest"), F.length("context").cast("long").alias("n"))


_CONTEXT = f"""
WITH {_BM25_BASE}, c AS (SELECT query_id, substr(string_agg(substr(text, 1, 200), chr(10) || chr(10) ORDER BY rank), 1, 700) AS c FROM r JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY query_id)
SELECT query_id, md5(c) AS digest, length(c) AS n FROM c
"""


def best_files(spark, d):
    """Pages whose own links come before those of a listing."""
    p = t(spark, d, "pages").select("page_id", F.concat("html", F.lit('<a href="../">up</a><a href="b.txt">b</a><a href="f'), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".csv").otherwise(".zip"), F.lit('">x</a><a href="README.md">r</a><a href="last.CSV">l</a>')).alias("html"))
    return pages.best_file(p, "page_id", "html")


def embedded(spark, d):
    """Pages with a data script behind their own; every third has none, as the pages themselves."""
    k = F.col("page_id")
    script = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props": {"pageProps": {"dataset": {"ID": '), k.cast("string"), F.lit(', "Name": " n'), k.cast("string"), F.when(k % 2 == 0, '", "Types": "Multivariate, Time-Series').otherwise('", "Types": "Text'), F.lit('", "Abstract": "taken every 5 minutes"}}}}</script>'))
    n = t(spark, d, "pages").select("page_id", F.concat("html", F.when(k % 3 != 0, script).otherwise("")).alias("html"))
    r = n.select("page_id", pages.repository_record(pages.embedded_json("html")).alias("r"))
    return r.select("page_id", F.col("r.id").alias("id"), F.col("r.name").alias("name"), F.col("r.frequency").alias("frequency"), pages.is_time_series(F.col("r.types")).alias("series"))


QUERIES = {
    "text_clean_names": (clean_names, _NAMES),
    "text_distinct_variants": (variants, "SELECT p_partkey, p_partkey % 5 <> 4 AND (p_partkey % 5 IN (0, 1, 3) OR length(p_name) + 2 <= 6) AS distinct_variants FROM part"),
    "text_first_integer": (digits, "SELECT s_suppkey, CAST('12' || s_suppkey AS BIGINT) AS n, CAST(regexp_extract(s_name, '[0-9]+') AS BIGINT) AS of_name, CAST(-1 AS BIGINT) AS none FROM supplier"),
    "text_plausibility": (plausible, _PLAUSIBLE),
    "text_clean_urls": (urls, "WITH u AS (SELECT page_id, regexp_replace(split_part(lower(url), '?', 1), '/+$', '') AS c, lower(url) || CASE WHEN page_id % 2 = 0 THEN '?q=1' ELSE '//' END AS l FROM pages) SELECT page_id, CASE WHEN page_id % 2 = 0 THEN c ELSE c END AS clean, length(c) < 15 OR regexp_matches(c, 'search|query|google\\.com|bing\\.com|kaggle\\.com|archive\\.ics\\.uci\\.edu|zenodo\\.org|github\\.com|timeseriesclassification\\.com|huggingface\\.co|hf\\.co') AS generic, regexp_matches(l, 'arxiv\\.org|doi\\.org|researchgate\\.net|ieeexplore\\.ieee\\.org|sciencedirect\\.com|springer\\.com|nature\\.com|acm\\.org|semanticscholar\\.org') AS paper, '[x]([''' || l || ''']' || '), y' AS tidy FROM u"),
    "text_page_links": (page_links, "WITH l AS (SELECT page_id, regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']([^\"''#]+)[\"'']', 1) AS l FROM pages), o AS (SELECT page_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM l) SELECT page_id, array_to_string(l, ' ') AS links, len(l) AS n FROM o"),
    "text_page_text": (page_text, None),
    "text_loaded_pages": (loaded_pages, "SELECT page_id FROM pages WHERE len(string_split_regex(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), '\\s+')) >= 100"),
    "text_file_registry": (file_registry, _REGISTRY),
    "text_json_props": (json_props, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "text_json_recovered": (json_recovered, "SELECT event_id, CAST(2 AS BIGINT) AS second FROM events"),
    "text_parsed_answers": (parsed_answers, "SELECT event_id, 'https://a.org/x' || event_id AS value, round(least(1.0, CASE WHEN event_id % 120 > 10 THEN (event_id % 120) / 100.0 WHEN event_id % 120 > 1 THEN (event_id % 120) / 10.0 ELSE event_id % 120 END), 6) AS confidence FROM events"),
    "text_hyperlinks": (hyperlinks, "SELECT page_id, url AS urls, 'page ' || page_id AS label, ''' -' || page_id AS guarded, '[missing]' AS missing FROM pages"),
    "text_standard_names": (standard_names, _STANDARD),
    "text_frequencies": (frequencies, "SELECT event_id, CASE event_id % 5 WHEN 0 THEN '15 minutes' WHEN 1 THEN 'Hourly' WHEN 2 THEN '10-minute' WHEN 4 THEN 'Weekly' END AS frequency FROM events"),
    "log_markdown_tables": (markdown, _MARKDOWN),
    "log_islands": (islands, "SELECT r_name AS file, CAST(1 AS BIGINT) AS island, count(*) + 2 AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "log_research_table": (research, "SELECT n_nationkey, unnest(['Dataset Name', 'Frequency']) AS field, unnest([n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'daily' ELSE 'hourly' END]) AS value, 0.85 AS confidence FROM nation"),
    "runs_facts": (facts, _FACTS),
    "sheet_hints": (sheet_hints, "SELECT 'dataset' AS type, n_name AS keyword, h AS hint, 'HINT_' || n_nationkey || '_' || k AS ref_id FROM (SELECT *, unnest(['hint', CASE WHEN n_nationkey % 2 = 0 THEN 'more' ELSE ' ' END]) AS h, unnest([0, 1]) AS k FROM nation) WHERE trim(h) <> ''"),
    "sheet_header_row": (sheet_header, _SHEET_HEADER),
    "sheet_conformed": (conformed, "SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS key, '' AS type FROM nation"),
    "search_chunks": (chunked, None),
    "search_document_text": (templates, "SELECT doc_id, md5('Title: ' || source || chr(10) || 'URL: http://x/' || repeat('y', 141) || chr(10) || 'Context: ' || lang || chr(10) || 'Content: ' || text) AS digest FROM documents"),
    "search_vector_top_k": (vector_top, _VECTOR),
    "search_bm25_top_k": (bm25, f"WITH {_BM25_BASE} SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 5"),
    "search_index_top_k": (indexed, f"WITH {_BM25_BASE} SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 5"),
    "search_hybrid_top_k": (hybrid, _HYBRID),
    "search_multi_query": (multi_query, _MULTI),
    "search_contexts": (contexts, _CONTEXT),
    "page_best_files": (best_files, "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'f' || page_id || '.csv' ELSE 'last.CSV' END AS file FROM pages"),
    "page_embedded_json": (embedded, "SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN page_id END AS id, CASE WHEN page_id % 3 <> 0 THEN 'n' || page_id ELSE '' END AS name, CASE WHEN page_id % 3 <> 0 THEN '5 minutes' END AS frequency, page_id % 3 <> 0 AND page_id % 2 = 0 AS series FROM pages"),
}
