"""BM25 of batches in tasks against plain scores."""

import random

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import retrieval, term_scores
from quarrystone.operators.retrieval import bm25_top_k
from tests.test_search_index import close, plain


@pytest.mark.parametrize("block, cells", [(2048, 1 << 18), (3, 40)])
def test_blocks_equal_plain_scores(spark, monkeypatch, block, cells):
    monkeypatch.setattr(term_scores, "QUERY_BLOCK", block)
    monkeypatch.setattr(term_scores, "CELLS", cells)
    r = random.Random(5)
    vocabulary = [f"t{k}" for k in range(30)]
    docs = [(i, None if i % 31 == 0 else "Same text t1 t2!" if i % 5 == 0 else " ".join(r.choices(vocabulary, weights=range(1, 31), k=r.randint(0, 60)))) for i in range(200)]
    queries = [(q, " ".join(r.choices([*vocabulary, "none", "same"], k=r.randint(1, 5)))) for q in range(20)] + [(99, "")]
    got = bm25_top_k(spark.createDataFrame(docs, "i long, t string").repartition(3), spark.createDataFrame(queries, "q long, text string"), "i", "t", "q", "text", 6)
    close([tuple(x) for x in got.select("query_id", "rank", "i", "score").collect()], plain(docs, queries, 6))
    none = spark.createDataFrame([], "q long, text string")
    assert bm25_top_k(spark.createDataFrame(docs, "i long, t string"), none, "i", "t", "q", "text").columns == ["query_id", "rank", "i", "score"]
    assert bm25_top_k(spark.createDataFrame([], "i long, t string"), spark.createDataFrame(queries, "q long, text string"), "i", "t", "q", "text").count() == 0


def test_ids_that_repeat_are_one_document(spark):
    """As SQL groups: counts of one id and length come together, other lengths are added."""
    docs = [("a", "x y"), ("a", "x z"), ("a", "x"), ("b", "x x y"), (None, "y"), (None, "y")]
    got = bm25_top_k(spark.createDataFrame(docs, "i string, t string"), spark.createDataFrame([(1, "x"), (1, "y")], "q long, text string"), "i", "t", "q", "text")
    import duckdb

    from quarrystone.plans.text_queries import _BM25_BASE

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.execute("CREATE TABLE benchmark AS SELECT 1 AS item_id, unnest(['x', 'y']) AS text")
    want = con.execute(f"WITH {_BM25_BASE} SELECT query_id, doc_id, score FROM r").fetchall()
    assert {(r["query_id"], r["i"]): r["score"] for r in got.collect()} == pytest.approx({(q, i): s for q, i, s in want})


def test_no_task_gets_all_documents_of_a_term(spark, monkeypatch):
    """A word of all documents goes to no single task: what is ranked behind the tasks is k rows of each."""
    seen = []
    ranked = retrieval.top_k
    monkeypatch.setattr(retrieval, "top_k", lambda scored, *a: (seen.append(scored.count()), ranked(scored, *a))[1])
    docs = spark.range(0, 4000, 1, 4).select("id", F.concat(F.lit("the "), F.col("id").cast("string")).alias("t"))
    got = bm25_top_k(docs, spark.createDataFrame([(1, "the"), (2, "the 7")], "q long, text string"), "id", "t", "q", "text", 5)
    assert [r["id"] for r in got.filter("query_id = 1").orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    assert sum(seen) <= 4 * 2 * 5 * 2
