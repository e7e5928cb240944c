"""Numbers of links of the similarity join."""

import random

import pytest

from quarrystone.llm import ngram_join, shingles


@pytest.mark.parametrize("block", [1024, 3])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    r = random.Random(5)
    texts = [None, "", "x y z u v", "x y z u v", "Same few"]
    for _ in range(8):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.choice([20, 60, 150]))]
        for _ in range(r.randrange(3, 7)):
            near = list(words)
            near[r.randrange(len(near))] = "other"
            texts += [" ".join(near)] * r.choice([1, 1, 3])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    sets = [shingles.shingle_set(t) for t in texts]
    want = {i: sum(i != j and len(a) > 0 and len(b) > 0 and shingles.similar(a, b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}
    assert {x["doc_id"]: x["n_links"] for x in ngram_join.similarity_join(docs).collect()} == want
    assert max(want.values()) > 3
