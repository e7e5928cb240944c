"""Very long texts through every operator, and conversations that repeat."""

import numpy as np
import pytest

from quarrystone.llm import bpe_tree, chat, langid, licenses, ngram_join, packing, quality_classifier, quality_rules, token_counts, wordbpe

LONG = {
    "words": " ".join(f"word{k % 5000} and" for k in range(120_000)),
    "one word": "abcdefghij" * 100_000,
    "one line": "License-Expression: MIT or " * 20_000,
    "lines": "short line\n" * 60_000,
    "spaces": " " * 500_000,
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "en") for k, t in enumerate(LONG.values())], "doc_id long, text string, lang string").repartition(2).cache()


def test_long_texts(spark, docs):
    e = wordbpe.encoder(wordbpe.default_path())
    texts = list(LONG.values())
    ids = {r["doc_id"]: bytes(r["ids"]) for r in bpe_tree.encode_documents(docs).collect()}
    assert all(ids[k] == e.whole(t) for k, t in enumerate(texts))
    sizes = {}
    for r in packing.pack_documents(docs).collect():
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert sizes == {k: len(x) // 4 + 1 for k, x in ids.items()}
    joined = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similarity_join(docs).collect()}
    assert joined == {0: (10_000, 0), 1: (1, 1), 2: (3, 2), 3: (2, 3), 4: (0, 4)}
    rules = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert rules[0]["n_words"] == 240_000 and rules[1]["n_words"] == 1 and rules[3]["n_dup_lines"] == 59_999 and rules[4]["n_words"] == 0
    found = {r["doc_id"]: r for r in licenses.license_scan(docs).collect()}
    assert len(found[2]["expressions"]) == 20_000 and found[1]["n_words"] == 1
    counts = {}
    for r in token_counts.token_counts(docs).collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + r["n_tokens"]
    library = token_counts.Spans(token_counts.default_path()).library
    assert counts == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}
    model = langid.learn(spark.createDataFrame([("the and line word", "en"), ("der und zeile", "de")], "text string, lang string"))
    assert {r["doc_id"]: r["lang_pred"] for r in langid.language_spans(docs, model).collect()}[0] == "en"
    weights = np.zeros(quality_classifier.BUCKETS + 1, np.float32)
    assert {r["score"] for r in quality_classifier.quality_scores(docs, weights).collect()} == {0.5}


def test_conversations_long_and_repeated(spark):
    turns = [(1, k, "user" if k % 2 else "assistant", f"turn {k} <\\ " * 3) for k in range(600)]
    rows = turns + turns + [(2, *r[1:]) for r in turns for _ in range(2)] + [(3, 0, "assistant", LONG["words"])]
    nodes, convs = chat.prefix_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {r["conv_id"]: r for r in chat.read_back(nodes, convs).collect()}
    want = [(r[2], r[3]) for r in turns for _ in range(2)]
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == want == [(t["role"], t["text"]) for t in back[2]["turns"]]
    assert back[3]["loss_text"] == LONG["words"] and nodes.count() == 1201
