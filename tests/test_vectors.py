"""Vector search in blocks against all pairs."""

import numpy as np

from quarrystone.operators import retrieval


def test_blocks_equal_all_pairs(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(k, [float(x) for x in r.integers(-3, 4, 4)]) for k in range(200)]
    rows += [(200, None), (201, [0.0] * 4), (202, [1.0, None, 0.0, 0.0]), (203, [1.0, 2.0]), (204, [2.0, 4.0]), (205, [1e-3, 2e-3])]
    d = spark.createDataFrame(rows, "id long, v array<float>").repartition(3)
    ok = {k: np.array(v, np.float32).astype(float) for k, v in rows if v and None not in v and any(v)}
    want = {}
    for k, v in ok.items():
        found = sorted((-round(float(v @ w / np.sqrt((v @ v) * (w @ w))), 9), j) for j, w in ok.items() if len(w) == len(v))[:7]
        want[k] = [(n + 1, -s) for n, (s, _) in enumerate(found)]
    for block, packed in ((2048, 4096), (20, 16)):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        monkeypatch.setattr(retrieval, "INDEX_ROWS", packed)
        got = {}
        for x in retrieval.vector_top_k(d, d, "id", "v", 7).orderBy("query_id", "rank").collect():
            assert abs(x["score"] - ok[x["id"]] @ ok[x["query_id"]] / np.sqrt((ok[x["id"]] @ ok[x["id"]]) * (ok[x["query_id"]] @ ok[x["query_id"]]))) < 1e-12
            got.setdefault(x["query_id"], []).append((x["rank"], round(x["score"], 9)))
        assert got == want
    assert retrieval.vector_top_k(d, d.limit(0), "id", "v").count() == 0
