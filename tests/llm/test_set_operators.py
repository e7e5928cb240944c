"""Similarity join, nearest neighbours, chat trees and the pipeline: brute force and edge cases."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from quarrystone.llm import chat, entry, hilbert_ann, ngram_join, packing, shingles
from quarrystone.llm.bytebpe import default_path, encoder
from quarrystone.llm.components import components
from quarrystone.llm.common import shared_dir


def test_signatures_of_similar_sets_meet():
    r = np.random.default_rng(1)
    seen = 0
    for _ in range(4000):
        n = int(r.choice([1, 2, 3, 4, 5, 6, 8, 9, 15, 16, 17, 31, 33, 64, 100, 257, 500]))
        base = np.unique(r.integers(0, 2**63, n * 2, dtype=np.uint64))
        a = base[:n]
        b = np.sort(np.concatenate([a[r.permutation(n)[: n - int(r.integers(0, n // 5 + 1))]], base[n : n + int(r.integers(0, n // 5 + 1))]]))
        if len(b) and shingles.similar(a, b):
            seen += 1
            (x, nx), (y, ny) = shingles.signatures(a), shingles.signatures(b)
            shared = np.intersect1d(x, y)
            tags = {int(s & np.uint64(255)) >> 1 for s in shared}
            need = dict(nx), dict(ny)
            # In some tag, as many as both demand at the first level.
            assert any(np.sum((shared & np.uint64(255)) >> np.uint64(1) == t) >= max(1, min(need[0].get(t, 10**9), need[1].get(t, 10**9))) for t in tags)
    assert seen > 500


def _family(r, size):
    base = [f"w{r.randrange(10**6)}" for _ in range(size)]
    out = [base]
    for _ in range(r.randint(0, 6)):
        other = list(r.choice(out))
        for _ in range(r.randint(0, max(1, size // 25))):
            other[r.randrange(len(other))] = f"v{r.randrange(10**6)}"
        out.append(other)
    return [" ".join(x) for x in out]


def _brute(texts):
    sets = {k: shingles.shingle_set(t) for k, t in texts}
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if len(sets[a]) and len(sets[b]) and shingles.similar(sets[a], sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in keys}


@pytest.mark.parametrize("block", [1024, 3])
def test_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    r = random.Random(2)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [t for _ in range(25) for t in _family(r, r.choice([3, 5, 8, 20, 60, 150]))]
    texts += [passage + " " + " ".join(f"q{r.randrange(10**6)}" for _ in range(60)) for _ in range(15)]
    texts += [texts[0].upper(), texts[0], None, "", "  ", "Same few", "same  few", "x y z u v", "x y z u v", "x y z u v w"]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    docs = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, component_id int").repartition(5)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.similarity_join(docs).collect()}
    assert got == _brute(rows)


def test_join_edges(spark, odd_docs, no_docs):
    rows = ngram_join.similarity_join(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all((r["component_id"] is None) == (r["doc_id"] is None) for r in rows)
    assert ngram_join.similarity_join(no_docs).count() == 0
    kept = ngram_join.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and kept.filter("doc_id = 3").count() == 1 and kept.filter("doc_id is null").count() == 1


def test_join_one_id_with_several_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(20)), " ".join(f"b{k}" for k in range(20))
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (9, b)], "doc_id long, text string")
    assert {r["component_id"] for r in ngram_join.similarity_join(docs).collect()} == {1}


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(edges, "a long, b long"), shared_dir(spark), "t").collect()}
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_hilbert_neighbours_are_adjacent():
    side = np.arange(16)
    grid = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    key = hilbert_ann.hilbert(grid, 4)
    assert sorted(key.tolist()) == list(range(16**3))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def _nearest(v, queries, k):
    out = {}
    for q in queries:
        d = sorted((float(np.sqrt(((v[q] - v[i]) ** 2).sum())), i) for i in v if i != q)
        out[q] = [(i, s) for s, i in d[:k]]
    return out


def test_small_tables_are_exact(spark):
    r = np.random.default_rng(4)
    v = {k: np.float32(r.normal(size=8)).astype(np.float64) for k in range(60)}
    for k in range(60, 90):
        v[k] = v[7]
    rows = [(k, [float(x) for x in v[k]], 1) for k in v] + [(200, None, 1), (201, [0.0] * 8, 1), (202, [float("nan")] * 8, 1), (203, [1.0, None] * 4, 1), (204, [1.0] * 3, 1), (None, [1.0] * 8, 1), (5, [float(x) for x in v[5]], 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = {}
    for x in hilbert_ann.nearest(d, "vec_id % 10 = 0", 10).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    assert got == _nearest(v, [k for k in v if k % 10 == 0], 10)
    assert hilbert_ann.nearest(d.limit(0), "vec_id % 10 = 0").count() == 0
    assert hilbert_ann.nearest(d.filter("vec_id in (0, 1, 2)"), "vec_id = 0").count() == 2


def test_recall(spark):
    """Against brute force on the given table, which is too small for all windows."""
    sf, stated = "/root/testdata/sf0.1", 0.9
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    v = dict(zip(e.vec_id.tolist(), np.array(e.embedding.tolist(), np.float64)))
    want = _nearest(v, [k for k in v if k % 100 == 0][:60], 10)
    got = hilbert_ann.query(spark, sf).toPandas()
    got = got[got["query_id"].isin(want.keys())]
    hit = sum(len({i for i, _ in want[q]} & set(g.vec_id)) for q, g in got.groupby("query_id"))
    assert hit >= stated * 10 * len(want)
    exact = {(q, i): s for q in want for i, s in want[q]}
    assert all(abs(exact[r.query_id, r.vec_id] - r.score) < 1e-12 for r in got.itertuples() if (r.query_id, r.vec_id) in exact)


def test_recall_on_a_table_of_its_own(spark, tmp_path):
    """50,000 vectors, with copies, of no low-dimensional shape: the tables of sf0.1 are too small for all windows."""
    g = np.random.default_rng(12)
    x = g.standard_normal((50_000, 32)).astype(np.float32)
    x[1000:1500] = x[:500]
    x[2000:3000] += 0.1 * x[3000:4000]
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), str(tmp_path / "embeddings.parquet"))
    asked = np.arange(0, len(x), 100)[:60]
    v = x.astype(np.float64)
    got = hilbert_ann.query(spark, str(tmp_path)).toPandas()
    assert len(got) == 10 * 500
    hit = 0
    for q in asked.tolist():
        score = np.sqrt(((v - v[q]) ** 2).sum(1))
        score[q] = np.inf
        near = got[got["query_id"] == q].sort_values("rank")
        assert np.allclose(near["score"], score[near["vec_id"]], rtol=0, atol=1e-9)
        hit += len(set(np.argsort(score, kind="stable")[:10].tolist()) & set(near["vec_id"]))
    assert hit >= 0.9 * 10 * len(asked)


def test_template_round_trip():
    r = random.Random(5)
    for _ in range(500):
        turns = [("".join(r.choice("ab\\<\n>/") for _ in range(r.randint(0, 6))), "".join(r.choice(["<", "\\", "</turn>\n", "<turn> user\n", "x", "\n", "n"]) for _ in range(r.randint(0, 8)))) for _ in range(r.randint(1, 4))]
        made = "".join(chat.format_turn(*t) for t in turns)
        assert [(a, b) for a, b, _ in chat.read_turns(made)] == turns


@pytest.fixture
def conversations(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "yes"), (2, 0, "system", "s"), (2, 1, "user", "hi"), (2, 2, "assistant", "no"), (2, 3, "user", None),
        (3, 0, "user", "hi"), (4, 1, "assistant", "b"), (4, 1, "assistant", "a"), (4, None, None, "first"), (None, 0, "user", "<turn> \\"), (5, 0, "system", "s"), (5, 1, "user", "hi"), (5, 2, "assistant", "yes"),
    ]
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, node string")


def test_tree_reads_back(conversations):
    nodes, convs = chat.prefix_tree(conversations)
    back = {r["conv_id"]: r for r in chat.read_back(nodes, convs).collect()}
    assert [(t["role"], t["text"]) for t in back[4]["turns"]] == [("", "first"), ("assistant", "a"), ("assistant", "b")]
    assert back[2]["loss_text"] == "no" and back[4]["loss_text"] == "ab" and [t["text"] for t in back[None]["turns"]] == ["<turn> \\"]
    assert nodes.count() == 10


def test_tree_layout(conversations):
    nodes, _ = chat.prefix_tree(conversations)
    rows = {bytes(r["node"]): r for r in nodes.collect()}
    ids = lambda r: r["size"]
    assert all(len(r["ids"]) == r["size"] * encoder(default_path()).kind.itemsize for r in rows.values())
    order = sorted(rows.values(), key=lambda r: r["offset"])
    at = 0
    for r in order:
        assert r["offset"] == at
        at += ids(r)
    for r in order:
        up, parent = [], r["parent"]
        while parent is not None:
            p = rows[bytes(parent)]
            up.append(p)
            parent = p["parent"]
        assert r["position"] == sum(map(ids, up))
        covered = {x for i in r["intervals"] for x in range(i["start"], i["end"])}
        assert covered == {x for p in up for x in range(p["offset"], p["offset"] + ids(p))}
    # Depth first: a node's descendants follow it without a gap.
    for r in order:
        inside = [x for x in order if bytes(r["node"]) in _path(rows, x)]
        assert inside[-1]["offset"] + ids(inside[-1]) - r["offset"] == sum(map(ids, inside))


def _path(rows, r):
    out = {bytes(r["node"])}
    while r["parent"] is not None:
        r = rows[bytes(r["parent"])]
        out.add(bytes(r["node"]))
    return out


def test_empty_conversations(conversations):
    nodes, convs = chat.prefix_tree(conversations.limit(0))
    assert nodes.count() == 0 and chat.read_back(nodes, convs).count() == 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracles(spark, name, sf):
    from tests.compare import same

    same(spark, sf, entry.queries()[name], entry.oracle_sql()[name])


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns
        assert kept.join(docs, docs.columns, "left_anti").count() == 0
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    ids = {r["doc_id"] for r in docs.collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == ids
    sets = _brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert all(k == c for k, (_, c) in sets.items())
    assert packing.pack_documents(docs).select("doc_id").distinct().count() == len(ids)
