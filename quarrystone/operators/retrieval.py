"""Text indexing and retrieval: templates, chunks, vector, BM25 and hybrid search, contexts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quarrystone.functions.text import strip, text_or_empty, urls_of
from quarrystone.functions.values import cell_missing

from .term_scores import K1, QUERY_BLOCK, Asked, B, Best, arrow_kind, asked_blocks, counted, weigher, whole_words
from .work import folder, written

CHUNK_WORDS = 1024
#: Vectors of the index that meet a block of queries at once.
INDEX_ROWS = 4096


def document_text(url: Column, title: Column, kind: Column, content: Column) -> Column:
    """Template of an indexed document; labels of bounded length."""
    return F.concat_ws("\n", F.concat(F.lit("Title: "), F.substring(text_or_empty(title), 1, 150)), F.concat(F.lit("URL: "), F.substring(text_or_empty(url), 1, 150)), F.concat(F.lit("Context: "), F.substring(text_or_empty(kind), 1, 50)), F.concat(F.lit("Content: "), text_or_empty(content)))


def new_documents(batch: DataFrame, indexed: DataFrame, ref: str, content: str, order: str) -> DataFrame:
    """First row of each reference not yet indexed, with content."""
    d = batch.filter(F.coalesce(F.col(content), F.lit("")) != "").join(indexed.select(ref).distinct(), ref, "left_anti")
    return d.withColumn("_r", F.row_number().over(Window.partitionBy(ref).orderBy(order))).filter("_r = 1").drop("_r")


def chunks(docs: DataFrame, id_: str, text: str, size: int = CHUNK_WORDS, overlap: int = 0) -> DataFrame:
    """(id, chunk, text): whole sentences packed in order, up to ``size`` words; a longer sentence is its own chunk.

    A token is a word between white space; sentences end at ``.``, ``!`` or ``?`` before white space, or at a line feed.
    A chunk repeats the last sentences of the one before that have ``overlap`` words together at most and
    leave room for the next sentence.
    """
    parts = F.filter(F.split(text_or_empty(text), r"(?<=[.!?])\s+|\n+"), lambda s: strip(s) != "")
    words = lambda s: F.size(F.split(strip(s), r"\s+"))
    sized = F.transform(parts, lambda s: F.struct(words(s).alias("n"), s.alias("s")))
    # Where each chunk begins and ends, as numbers of sentences; the texts are put together once, behind the fold.
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("first"), F.lit(0).alias("n"), F.array().cast("array<struct<first:int,last:int>>").alias("done"))

    def step(a, x):
        fits = (a["n"] == 0) | (a["n"] + x["n"] <= size)
        go = F.struct((a["at"] + 1).alias("at"), a["first"].alias("first"), (a["n"] + x["n"]).alias("n"), a["done"].alias("done"))
        closed = F.struct(a["first"].alias("first"), a["at"].alias("last"))
        back = F.aggregate(
            F.reverse(F.slice(F.col("_s"), a["first"] + 1, a["at"] - a["first"])),
            F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"), F.lit(True).alias("on")),
            lambda b, y: F.when(b["on"] & (b["n"] + y["n"] <= overlap) & (b["n"] + y["n"] + x["n"] <= size), F.struct((b["k"] + 1).alias("k"), (b["n"] + y["n"]).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(b["k"].alias("k"), b["n"].alias("n"), F.lit(False).alias("on"))),
        )
        k, n = (back["k"], back["n"]) if overlap else (F.lit(0), F.lit(0))
        cut = F.struct((a["at"] + 1).alias("at"), (a["at"] - k).alias("first"), (n + x["n"]).alias("n"), F.array_append(a["done"], closed).alias("done"))
        return F.when(fits, go).otherwise(cut)

    end = lambda a: F.when(a["n"] > 0, F.array_append(a["done"], F.struct(a["first"].alias("first"), a["at"].alias("last")))).otherwise(a["done"])
    d = docs.select(F.col(id_), sized.alias("_s"))
    d = d.select(id_, "_s", F.posexplode(F.aggregate("_s", start, step, end)).alias("chunk", "_c"))
    return d.select(id_, "chunk", F.array_join(F.transform(F.slice("_s", F.col("_c.first") + 1, F.col("_c.last") - F.col("_c.first")), lambda x: x["s"]), " ").alias("text"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norms: Column | None = None) -> Column:
    """Cosine of two vectors; ``norms`` is the product of their lengths where it is known."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(dot, norm(a) * norm(b) if norms is None else norms)


def top_k(scored: DataFrame, query: str, score: str, tie: str, k: int) -> DataFrame:
    w = Window.partitionBy(query).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= max(1, k))


def vector_top_k(index: DataFrame, queries: DataFrame, id_: str, vector: str, k: int = 10) -> DataFrame:
    """(query_id, rank, id, score): nearest by cosine for a stated set of queries, ties to smaller ids.

    Queries are packed into blocks of about ``QUERY_BLOCK`` and vectors of the index into rows of at most
    ``INDEX_ROWS``; every row meets every block by the block's number, and a task keeps the best of what it has
    seen of a block, so that what is shuffled is k rows for each query, block and task, not the pairs.  Candidates
    come from a matrix product; scores are then sums over the vectors alone, equal for equal vectors.

    Vectors that are null or of length zero, or hold nulls, and those of another dimension than the query's, take no part.
    """
    whole = lambda v: v.isNotNull() & ~F.exists(v, lambda x: x.isNull()) & (norm(v) > 0)
    q = queries.filter(whole(F.col(vector))).select(F.col(id_).alias("query_id"), F.col(vector).cast("array<double>").alias("_q"), F.size(vector).alias("_dim"))
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    packed = q.groupBy("_dim", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("_block")).agg(F.sort_array(F.collect_list(F.struct("query_id", "_q"))).alias("_queries"))
    d = index.filter(whole(F.col(vector))).select(F.col(id_).alias("_id"), F.col(vector).cast("array<double>").alias("_v"), F.size(vector).alias("_dim"))
    id_kind, query_kind = (df.schema[c].dataType.simpleString() for df, c in ((d, "_id"), (q, "query_id")))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for lo in range(0, len(at), INDEX_ROWS):
                    part = b.take(pa.array(at[lo : lo + INDEX_ROWS]))
                    ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), ids, pa.array([part.column(1).flatten().to_numpy().tobytes()], pa.binary())], ["_dim", "_ids", "_vectors"])

    rows = d.mapInArrow(rows_of, f"_dim int, _ids array<{id_kind}>, _vectors binary").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for b in batches:
            for dim, block, asked, ids, raw in zip(*(b.column(c).to_pylist() for c in ("_dim", "_block", "_queries", "_ids", "_vectors"))):
                names, q = [x["query_id"] for x in asked], np.array([x["_q"] for x in asked])
                v = np.frombuffer(raw).reshape(-1, dim)
                lengths = np.sqrt((v * v).sum(1))
                score = (q @ v.T) / (np.sqrt((q * q).sum(1))[:, None] * lengths)
                least = np.partition(score, -min(k, len(v)), axis=1)[:, -min(k, len(v))] - 1e-9
                for j, name in enumerate(names):
                    at = np.flatnonzero(score[j] >= least[j])
                    exact = (v[at] * q[j]).sum(1) / (np.sqrt((q[j] * q[j]).sum()) * lengths[at])
                    found = seen.get((block, dim, name), []) + [(-float(s), ids[x]) for s, x in zip(exact, at)]
                    seen[block, dim, name] = sorted(found)[:k]
                if len(seen) > 4 * QUERY_BLOCK:
                    yield told(seen)
                    seen = {}
        if seen:
            yield told(seen)

    def told(seen: dict) -> pa.RecordBatch:
        flat = [(name, i, -s) for (_, _, name), found in seen.items() for s, i in found]
        return pa.RecordBatch.from_arrays([pa.array([x[n] for x in flat], kind) for n, kind in enumerate(kinds)], ["query_id", "_id", "score"])

    kinds = [to_arrow_type(q.schema["query_id"].dataType), to_arrow_type(d.schema["_id"].dataType), pa.float64()]
    met = rows.join(packed, ["_dim", "_block"]).select("_dim", "_block", "_queries", "_ids", "_vectors")
    found = met.mapInArrow(best, f"query_id {query_kind}, _id {id_kind}, score double")
    return top_k(found, "query_id", "score", "_id", k).select("query_id", "rank", F.col("_id").alias(id_), "score")


def bm25_top_k(docs: DataFrame, queries: DataFrame, id_: str, text: str, query_id: str, query_text: str, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """BM25 scores of the documents that share a term with a query.

    Queries come in blocks of ``QUERY_BLOCK``.  The texts are cut into words once for a block, and a row for each document
    holds the counts of the block's terms in it; it is never moved by term, as a term may be in all documents.  Tasks score
    the rows where they lie and keep the best of each query, so that k rows for each query and task are shuffled.
    """
    found = [_of_block(docs, asked, id_, text, k, k1, b, queries.schema[query_id].dataType) for asked in asked_blocks(queries, query_id, query_text)]
    if not found:
        return docs.limit(0).join(queries.limit(0)).select(F.col(query_id).alias("query_id"), F.lit(0).cast("long").alias("rank"), F.col(id_), F.lit(0.0).alias("score"))
    return reduce(DataFrame.unionByName, found)


def _of_block(docs: DataFrame, asked: Asked, id_: str, text: str, k: int, k1: float, b: float, query_type: T.DataType) -> DataFrame:
    path, vocabulary = folder(docs.sparkSession), pa.array(asked.terms, pa.string())
    id_kind, arrow_id = docs.schema[id_].dataType.simpleString(), arrow_kind(docs, id_)
    columns = ["id", "words", "terms", "counts", "lengths"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                lists = batch.column(1).slice(lo, 1024)
                row, length, term, tf, _ = counted(lists, vocabulary)
                ends = pa.array(np.searchsorted(row, np.arange(len(lists) + 1)), pa.int32())
                of_row = lambda x: pa.ListArray.from_arrays(ends, pa.array(x, pa.int32()))  # noqa: B023, E731
                texts = lists.flatten()
                starts = pa.array(np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(False))]), pa.int32())
                words = pa.ListArray.from_arrays(starts, texts.value_lengths())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 1024), words, of_row(term), of_row(tf), of_row(length)], columns)

    posts = written(whole_words(docs, id_, text).mapInArrow(count, f"id {id_kind}, words array<int>, terms array<int>, counts array<int>, lengths array<int>"), path, "postings")
    sizes = posts.agg(F.sum(F.size("words")), F.sum(F.aggregate("words", F.lit(0).cast("long"), lambda s, x: s + x))).first()
    df = {r[0]: r[1] for r in posts.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
    weight = weigher(df, len(asked.terms), sizes[0] or 0, sizes[1] or 0, k1, b)
    names, k = pa.array(asked.names, to_arrow_type(query_type)), max(1, k)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Best(asked, arrow_id, k)
        for batch in batches:
            for lo in range(0, batch.num_rows, asked.step()):
                part = batch.slice(lo, asked.step())
                term, tf, dl = (part.column(c).flatten().to_numpy(False).astype(np.int64) for c in (1, 2, 3))
                row = np.repeat(np.arange(part.num_rows), part.column(1).value_lengths().to_numpy(False))
                kept.take(asked.sums(row, term, weight(term, tf, dl), part.num_rows), part.column(0))
        yield from kept.rows(names)

    found = posts.select("id", "terms", "counts", "lengths").mapInArrow(best, f"query_id {query_type.simpleString()}, id {id_kind}, score double")
    # Written, so that what it meets next is planned by its size.
    return written(top_k(found, "query_id", "score", "id", k).select("query_id", "rank", F.col("id").alias(id_), "score"), path, "best")


def hybrid_top_k(first: DataFrame, second: DataFrame, id_: str, k: int = 10) -> DataFrame:
    """Results of the first search in its order, then unseen ones of the second, cut to k."""
    both = first.select("query_id", id_, F.lit(0).alias("source"), "rank").unionByName(second.select("query_id", id_, F.lit(1).alias("source"), "rank"))
    seen = both.groupBy("query_id", id_).agg(F.min(F.struct("source", "rank")).alias("_at"))
    w = Window.partitionBy("query_id").orderBy("_at", id_)
    return seen.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select("query_id", "rank", id_, F.col("_at.source").alias("source"))


def multi_query_union(results: DataFrame, group: str, query_no: str, id_: str, k: int = 10) -> DataFrame:
    """Results of a group's queries in order of query and rank, each once, the first k."""
    seen = results.groupBy(group, id_).agg(F.min(F.struct(query_no, "rank")).alias("_at"))
    w = Window.partitionBy(group).orderBy("_at", id_)
    return seen.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).drop("_at")


def context(results: DataFrame, group: str, order: str, text: str, each: int = 2_000, total: int = 45_000) -> DataFrame:
    """Texts of each group in order, each cut to ``each`` characters, the whole to ``total``."""
    item = F.struct(F.col(order).alias("o"), F.substring(text_or_empty(text), 1, each).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "\n\n")
    return results.groupBy(group).agg(F.substring(joined, 1, total).alias("context"))


def audited(value: Column, conf: Column, why: Column, score: Column, sources: Column) -> Column:
    """Cell of a result: missing markers as ``[missing]``, 0, with its telemetry of at most three sources."""
    none = cell_missing(F.lower(value))
    telemetry = F.format_string("Rationale: %s\nTop Score: %.2f\nSources: [%s]", text_or_empty(why), F.coalesce(score, F.lit(0.0)), F.array_join(F.transform(F.slice(sources, 1, 3), lambda s: F.concat(F.lit("'"), s, F.lit("'"))), ", "))
    return F.struct(F.when(none, "[missing]").otherwise(value).alias("value"), F.when(none, 0.0).otherwise(conf).alias("confidence"), telemetry.alias("telemetry_context"))


def preflight_urls(text: Column | str, n: int = 5) -> Column:
    """First ``n`` distinct links to repositories or PDF files."""
    return F.slice(F.filter(urls_of(text), lambda u: u.rlike(r"(?i)github\.com|gitlab\.com|bitbucket\.org|\.pdf")), 1, n)


def grounding_text(name: Column, description: Column, urls: Column, n: int = 5, limit: int = 1_000_000) -> Column:
    return F.substring(F.concat_ws("\n", F.concat(F.lit("Project: "), text_or_empty(name)), F.concat(F.lit("Description: "), text_or_empty(description)), F.concat(F.lit("URLs: "), F.array_join(F.slice(urls, 1, n), ", "))), 1, limit)
