"""The source divergence audit against SQL and a plain version."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from quarrystone.llm import divergence as m
from tests.compare import same

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10, ranks=10):
    """rows: (text, lang, source)."""
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in ((a or "", b or "", c or "") for a, b, c in rows):
        words = TERM.findall(text.translate(LOW))
        groups.add((lang, source))
        n[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        terms = sorted((t for t, k in docs[lang].items() if k >= least), key=str.encode)
        own = [s for x, s in groups if x == lang]

        def share(counts):
            whole = sum(counts[t] for t in terms)
            return {t: 1 + 1_000_000_000 * (counts[t] + 2) // (whole + 2 * len(terms)) for t in terms}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: share(n[lang, s]) for s in own}
        q = share(sum((n[lang, s] for s in own), Counter()))
        for s in own:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in terms), o) for o in own if o != s]
            found = [(f(p[s][t], q[t]), t) for t in terms if n[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", found, ranks)):
                for k, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out.add((lang, s, part, item, value, k + 1))
    return out


def random_rows(seed, n=400):
    r = random.Random(seed)
    words = ["aa", "AB", "abc", "É", "éa", "中文", "中", "x-y", "😀", "ſ", "İ", "q", "z\x1cz", "ab1cd"] + [f"{a}{b}" for a in "abc" for b in "def"]
    text = lambda: " ".join(r.choices(words, k=r.randrange(12)))
    return [(None if r.random() < 0.05 else text(), r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "É", None, "s10"])) for _ in range(n)]


def test_equals_a_plain_version(spark, monkeypatch):
    for seed, least, leaves in ((1, 10, 1 << 17), (2, 3, 8)):
        # Few leaves make tasks empty their tries again and again.
        monkeypatch.setattr(m, "LEAVES", leaves)
        rows = random_rows(seed)
        docs = spark.createDataFrame([(*x, 1) for x in rows], "text string, lang string, source string, a int").repartition(5)
        got = [tuple(r) for r in m.divergence(docs, least=least).select("lang", "source", "part", "item", "value", "rank").collect()]
        assert len(got) == len(set(got)) and set(got) == plain(rows, least)


def test_trie_merges_and_walks_in_byte_order():
    r, trie, want = random.Random(3), m.RadixTrie(), defaultdict(lambda: [0, Counter()])
    for _ in range(3000):
        term = "".join(r.choices("abé中😀", k=r.randrange(1, 6))).encode()
        slot = r.randrange(4)
        trie.add(term, 1, np.array([(slot, 2)], m.COUNTER).tobytes())
        want[term][0] += 1
        want[term][1][slot] += 2
    got = [(t, d, dict(np.frombuffer(c, m.COUNTER).tolist())) for t, d, c in trie.walk()]
    assert got == [(t, d, dict(c)) for t, (d, c) in sorted(want.items())] and trie.leaves == len(want)


def test_shares_are_exact_beyond_64_bits():
    for n, of in ((10**12, 10**13 + 7), (10**13, 10**13), (2, 9 * 10**15), (123456789012345, 987654321098765)):
        assert m.shares(np.array([n]), np.array([of]))[0] == 1 + 10**9 * n // of


def test_query_equals_sql(spark, sf):
    same(spark, sf, m.query, m.ORACLE_SQL)


def test_odd_tables(spark, odd_docs, no_docs):
    docs = odd_docs.withColumnRenamed("doc_id", "source")
    rows = [(r["text"], r["lang"], None if r["source"] is None else str(r["source"])) for r in docs.collect()]
    assert {tuple(r) for r in m.divergence(docs, least=1).collect()} == plain(rows, 1)
    assert m.divergence(no_docs.withColumnRenamed("doc_id", "source")).collect() == []


def test_a_very_long_text_and_term(spark):
    rows = [("ab " * 400_000 + "x" * 300_000, "en", "a"), ("b " * 10, "en", "b"), ("x" * 300_000, "en", "b")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert {tuple(r) for r in m.divergence(docs, least=1).collect()} == plain(rows, 1)
