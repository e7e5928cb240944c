"""The Merkle manifest against SQL, a plain version and its own rounds."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quarrystone.llm import merkle
from tests.compare import same


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(rows, now, run=16):
    """rows: (doc_id, source, lang, n_chars, text); now: position to present text."""

    def leaf(r):
        return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in r])

    def proof(nodes, k):
        out = []
        while len(nodes) > 1:
            a = k - k % run
            out.append((nodes[a:k], nodes[k + 1 : a + run]))
            nodes, k = [H(*nodes[i : i + run]) for i in range(0, len(nodes), run)], k // run
        return out, nodes[0]

    key = lambda x, kind: (x is not None, x if x is not None else kind)
    order = sorted(range(len(rows)), key=lambda k: (key(rows[k][1] and rows[k][1].encode(), b""), key(rows[k][0], 0), leaf(rows[k])))
    groups = {}
    for k in order:
        groups.setdefault(rows[k][1], []).append(k)
    subs = [proof([leaf(rows[k]) for k in g], 0)[1] for g in groups.values()]
    root, out = proof(subs, 0)[1], []
    for place, (source, g) in enumerate(groups.items()):
        leaves = [leaf(rows[k]) for k in g]
        for i, k in enumerate(g):
            path = proof(leaves, i)[0] + proof(subs, place)[0]
            node = leaf((*rows[k][:4], now[k])) if k in now else leaves[i]
            for a, b in path:
                node = H(*a, node, *b)
            out.append((rows[k][0], leaves[i], subs[place], root, H(*[x for a, b in path for x in a + b]), node, node == root))
    return sorted(out, key=str)


ROWS = [(k if k % 7 else None, f"s{k % 5}" if k % 11 else None, "en", k, f"Text É {k}") for k in range(300)]
ROWS += [(1, "lone", None, None, "T"), (2, "x", None, 3, None), (2, "x", None, 3, None), (2, "x", None, 3, "")]


@pytest.mark.parametrize("run, levels, top", [(16, 3, 1 << 17), (16, 1, 3), (3, 1, 1), (3, 2, 9)])
def test_equals_a_plain_version(spark, run, levels, top):
    docs = spark.createDataFrame(ROWS, "doc_id long, source string, lang string, n_chars long, text string").withColumn("leaf", F.lit(1)).withColumn("pos", F.lit("x"))
    now = {k: r[4].lower() for k, r in enumerate(ROWS) if r[4] and r[0] and r[0] % 3 == 0}
    got = merkle.manifest(docs, {"text": F.when(F.col("doc_id") % 3 == 0, F.lower("text"))}, run=run, levels=levels, top=top)
    assert sorted(map(tuple, got.collect()), key=str) == plain(ROWS, now, run)


def test_query_equals_sql(spark, sf):
    same(spark, sf, merkle.query, merkle.ORACLE_SQL)


def test_tampered_rows_alone_fail(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    low = str.maketrans(merkle.UPPER, merkle.LOWER)
    for r in merkle.query(spark, sf).collect():
        text = docs[r["doc_id"]]
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0 or text.translate(low) == text)


def test_odd_tables(spark, odd_docs, no_docs):
    fields = ("doc_id", "text", "score")
    got = merkle.manifest(odd_docs, group_col="lang", fields=fields).collect()
    assert len(got) == odd_docs.count() and all(r["verified"] for r in got)
    assert merkle.manifest(no_docs, group_col="lang", fields=fields).collect() == []
    one = merkle.manifest(odd_docs.limit(1), group_col="lang", fields=fields).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == H()
