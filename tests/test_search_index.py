"""The text index against plain BM25, over batches and writers."""

import math
import random
import re
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import search_index
from quarrystone.operators.search_index import SearchIndex
from quarrystone.sources.store import Store


def plain(docs, queries, k, k1=1.5, b=0.75):
    words = {i: [w for w in re.split("[^a-z0-9]+", (t or "").lower()) if w] for i, t in docs}
    n, avgdl = len(words), sum(map(len, words.values())) / len(words)
    tf = {i: Counter(w) for i, w in words.items()}
    df = Counter(t for c in tf.values() for t in c)
    out = set()
    for q, text in queries:
        asked = {w for w in re.split("[^a-z0-9]+", text.lower()) if w}
        scores = {i: round(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * len(words[i]) / avgdl)) for t in asked if c[t]), 6) for i, c in tf.items() if asked & c.keys()}
        for rank, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]):
            out.add((q, rank + 1, i, s))
    return out


def close(got, want):
    assert {x[:3] for x in got} == {x[:3] for x in want}
    scores = {x[:3]: x[3] for x in want}
    assert all(abs(s - scores[q, r, i]) < 2e-6 for q, r, i, s in got)


@pytest.mark.parametrize("bucket, first", [(256, 4), (7, 1), (1, 2)])
def test_batches_and_blocks_equal_plain_scores(spark, tmp_path, monkeypatch, bucket, first):
    monkeypatch.setattr(search_index, "BUCKET", bucket)
    monkeypatch.setattr(search_index, "FIRST", first)
    r = random.Random(9)
    vocabulary = [f"t{k}" for k in range(40)]
    docs = [(i, None if i % 31 == 0 else " ".join(r.choices(vocabulary, weights=range(1, 41), k=r.randint(0, 60)))) for i in range(200)]
    queries = [(q, " ".join(r.choices([*vocabulary, "none"], k=r.randint(1, 5)))) for q in range(20)] + [(99, "")]
    index = SearchIndex(Store(spark, str(tmp_path)))
    asked = spark.createDataFrame(queries, "q long, text string")
    with pytest.raises(LookupError):
        index.search(asked, "q", "text")
    for lo in (0, 50, 120):
        hi = {0: 50, 50: 120, 120: 200}[lo]
        index.add(spark.createDataFrame(docs[lo:hi], "i long, t string"), "i", "t")
        close([tuple(x) for x in index.search(asked, "q", "text", 6).collect()], plain(docs[:hi], queries, 6))


def test_concurrent_batches_are_all_counted(spark, tmp_path):
    docs = [(i, f"a w{i}") for i in range(9)]
    parts = [spark.createDataFrame(docs[k : k + 3], "i long, t string") for k in (0, 3, 6)]
    threads = [threading.Thread(target=lambda p=p: SearchIndex(Store(spark, str(tmp_path))).add(p, "i", "t")) for p in parts]
    [x.start() for x in threads]
    [x.join() for x in threads]
    index = SearchIndex(Store(spark, str(tmp_path)))
    assert index.store.latest("postings")["note"] == {"n": 9, "words": 18}
    asked = spark.createDataFrame([(1, "a w4")], "q long, text string")
    close([tuple(x) for x in index.search(asked, "q", "text", 4).collect()], plain(docs, [(1, "a w4")], 4))


def test_an_added_batch_leaves_former_files_alone(spark, tmp_path):
    index = SearchIndex(Store(spark, str(tmp_path)))
    index.add(spark.createDataFrame([(1, "a b")], "i long, t string"), "i", "t")
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "postings").rglob("*.parquet")}
    index.add(spark.createDataFrame([(2, "a c")], "i long, t string"), "i", "t")
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "postings").rglob("*.parquet")}
    assert before.items() <= after.items() and len(after) > len(before)


def test_neither_postings_nor_pairs_are_shuffled_by_term(spark, tmp_path, monkeypatch):
    """A batch is made where it is read; what is ranked behind a search's tasks is k rows of each."""
    docs = spark.range(0, 3000, 1, 3).select("id", F.concat(F.lit("the "), F.col("id").cast("string")).alias("t"))
    assert "Exchange" not in search_index.postings(docs, "id", "t", "b")._jdf.queryExecution().executedPlan().toString()
    index, seen, ranked = SearchIndex(Store(spark, str(tmp_path))), [], search_index.top_k
    index.add(docs, "id", "t")
    monkeypatch.setattr(search_index, "top_k", lambda scored, *a: (seen.append(scored.count()), ranked(scored, *a))[1])
    found = index.search(spark.createDataFrame([(1, "the"), (2, "the 7")], "q long, text string"), "q", "text", 5)
    assert [r["id"] for r in found.filter("query_id = 1").orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    assert found.filter("query_id = 2").orderBy("rank").first()["id"] == 7 and sum(seen) <= 4 * 2 * 5
