"""Licences, rules, tokens, languages, quality and packing: brute force, round trips and edge cases."""

import random
import re
import time
import zlib

import numpy as np
import pytest

from quarrystone.llm import bpe_tree, langid, licenses, packing, quality_classifier, quality_rules, token_counts, wordbpe
from tests.llm.conftest import ODD

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_counts_match_brute_force(spark):
    r = random.Random(1)
    texts = ["".join(r.choice(["a ", "b ", "c\n", "# ", "a b c d e ", "é| ", " ", "!"]) for _ in range(r.randint(0, 60))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in quality_rules.features(docs).collect()}
    for k, t in enumerate(texts):
        w = WORDS.findall(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        covered = {i + o for i, g in enumerate(grams) if grams.count(g) > 1 for o in range(5)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        assert (got[k]["n_words"], got[k]["word_chars"], got[k]["n_repeat_words"], got[k]["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert got[k]["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t))


def test_quality_rules_edges(odd_docs, no_docs):
    rows = quality_rules.quality_rules(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["kept"] is not None for r in rows)
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] < 10)
    assert quality_rules.quality_rules(no_docs).count() == 0


def test_quality_rules_learn_junk(spark):
    good = [" ".join(f"word{k}{i}" for i in range(60)) + "\nnext line here" for k in range(90)]
    bad = [" ".join(f"w{k}{i} |" for i in range(60)) for k in range(10)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs).collect()}
    assert all(kept[k] for k in range(90)) and not any(kept[k] for k in range(90, 100))


def test_license_phrases_match_brute_force(spark):
    r = random.Random(2)
    vocabulary = ["gnu", "General", "PUBLIC", "license", "Apache", "cc", "by", "MIT", "x", "é", "cc-by", "\n", "licenseé"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 40))) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in licenses.license_scan(docs, notices=()).collect()}
    for k, t in enumerate(texts):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        want = sorted((i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
        assert got[k]["n_words"] == len(w) and [(p["start"], p["label"]) for p in got[k]["places"]] == want


@pytest.mark.parametrize(
    "text, rpn, choices",
    [
        ("MIT", "MIT", "mit"),
        ("MIT OR Apache-2.0 AND GPL-2.0", "MIT Apache-2.0 GPL-2.0 and or", "mit or apache and gpl"),
        ("MIT AND Apache-2.0 OR GPL-2.0", "MIT Apache-2.0 and GPL-2.0 or", "gpl or apache and mit"),
        ("(MIT or BSD-3-Clause) and GPL-2.0-only WITH Classpath-exception-2.0", "MIT BSD-3-Clause or GPL-2.0-only Classpath-exception-2.0 with and", "gpl with classpath-exception-2.0 and (bsd or mit)"),
        ("MIT or (MIT and ISC)", "MIT MIT ISC and or", "mit"),
        ("MIT and (ISC or MIT)", "MIT ISC MIT or and", "mit"),
        ("(MIT or ISC) or (BSD or (MIT or ISC))", "MIT ISC or BSD MIT ISC or or or", "bsd or isc or mit"),
        ("MIT some prose behind it", "MIT", "mit"),
        ("MIT AND", "MIT", "mit"),
        ("MIT AND (GPL-2.0", "MIT", "mit"),
        ("MIT with nothing", "MIT", "mit"),
        ("MIT or so they say", "MIT", "mit"),
        ("GPL-2.0 WITH x-exception WITH y-exception", "GPL-2.0 x-exception with", "gpl with x-exception"),
        ("(MIT or ISC) with x-exception", "MIT ISC or", "isc or mit"),
        ("GPL-2.0-only AND Zork", "GPL-2.0-only Zork and", "gpl and zork"),
        ("MIT OR Zork", "MIT Zork or", "mit or zork"),
        ("Zork OR MIT", "Zork MIT or", "mit or zork"),
        ("(Zork AND MIT)", "Zork MIT and", "mit and zork"),
        ("LicenseRef-X AND GPL-3.0-only", "LicenseRef-X GPL-3.0-only and", "gpl and licenseref-x"),
        ("DocumentRef-d:LicenseRef-x and more", "DocumentRef-d:LicenseRef-x", "documentref-d:licenseref-x"),
        ("MIT. See the file", "MIT", "mit"),
        ("Zork-1.0 */", "Zork-1.0", "zork-1.0"),
        ("Zork-1.0 is here", "", None),
        ("see the file below", "", None),
        ("mitre-thing", "", None),
        ("((MIT)", "", None),
        ("AND MIT", "", None),
        ("\nMIT", "", None),
        ("", "", None),
    ],
)
def test_license_expressions(text, rpn, choices):
    got, end = licenses.parse(text)
    assert " ".join(got) == rpn and (not got or text[:end].split()[-1].strip("()") == text[:end].strip(" ()").split()[-1])
    if got:
        assert licenses.evaluate(got)[0] == choices


#: Identifiers of the brute-force test with their labels, by hand.
KNOWN = {"mit": "mit", "bsd": "bsd", "gpl-2.0+": "gpl", "apache-2.0": "apache", "isc": "isc"}
OPAQUE = {"Zork": "zork", "X1": "x1"}


def _descent(tokens):
    """The longest start of the tokens that is an expression, by descent, as nested tuples, with its length; None without any."""

    def atom(k):
        if k < len(tokens) and tokens[k] == "(":
            found = either(k + 1)
            return (found[0], found[1] + 1) if found and found[1] < len(tokens) and tokens[found[1]] == ")" else None
        label = (KNOWN.get(tokens[k].lower()) or OPAQUE.get(tokens[k])) if k < len(tokens) else None
        if not label:
            return None
        if k + 2 < len(tokens) and tokens[k + 1].lower() == "with" and (tokens[k + 2] in ("x-exception", *OPAQUE) or tokens[k + 2].lower() in KNOWN):
            return f"{label} with {tokens[k + 2].lower()}", k + 3
        return label, k + 1

    def series(k, word, part):
        found = part(k)
        while found and found[1] < len(tokens) and tokens[found[1]].lower() == word:
            more = part(found[1] + 1)
            if not more:
                break
            found = (word, found[0], more[0]), more[1]
        return found

    both = lambda k: series(k, "and", atom)
    either = lambda k: series(k, "or", both)
    return either(0)


def _atoms(tree):
    return {tree} if isinstance(tree, str) else _atoms(tree[1]) | _atoms(tree[2])


def _holds(tree, true):
    if isinstance(tree, str):
        return tree in true
    return (all if tree[0] == "and" else any)(_holds(x, true) for x in tree[1:])


def _same_choices(shown, tree):
    """Whether the shown expression holds for the same sets of licences, tried one by one."""
    atoms = sorted(_atoms(tree))
    code = shown
    for k, x in sorted(enumerate(atoms), key=lambda x: -len(x[1])):
        code = re.sub(rf"(?<![\w.+-]){re.escape(x)}(?![\w.+-]| with)", f"_{k}_", code)
    for bits in range(1 << len(atoms)):
        true = {x for k, x in enumerate(atoms) if bits >> k & 1}
        if eval(code, {f"_{k}_": x in true for k, x in enumerate(atoms)}) != _holds(tree, true):
            return False
    return True


def _told(line):
    """The expression behind a tag on its line, by descent."""
    tokens = re.findall(r"[()]|[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?|\S", line)
    found = _descent(tokens)
    if not found:
        return None
    listed = any(t.lower() in KNOWN for k, t in enumerate(tokens[: found[1]]) if not k or tokens[k - 1].lower() != "with")
    return found[0] if listed or not "".join(tokens[found[1] :]).strip(".;,") else None


def test_license_query_matches_brute_force(spark, tmp_path):
    r = random.Random(12)
    vocabulary = ["GNU", "general", "public", "License", "mit", "cc", "by", "bsd 3 clause", "é", ";", "\n", "SPDX-License-Identifier:", "x License-Expression:", "MIT", "GPL-2.0+", "Apache-2.0", "ISC.", "Zork", "X1", "OR", "and", "(", ")", "WITH", "x-exception", "prose"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))) for _ in range(300)]
    texts += ["License-Expression: " + " ".join(r.choices(["MIT", "GPL-2.0+", "ISC", "Zork", "OR", "OR", "and", "and", "(", ")", "WITH x-exception"], k=r.randint(1, 12))) for _ in range(300)] + [None, ""]
    # License, GNU and others with capitals would be identifiers of their own behind a tag.
    texts = [t and re.sub("GNU|License(?!-)", lambda m: m[0].lower(), t) for t in texts]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    phrases = [(p.split(), n, True, licenses.BASE_WEIGHT) for p, n in licenses.BASE] + [(p.split(), n, False, w) for p, n, w in licenses.NOTICES]
    some = 0
    for row in licenses.query(spark, str(tmp_path)).collect():
        t = texts[row["doc_id"]] or ""
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        found = [(i, n, base, weight) for p, n, base, weight in phrases for i in range(len(w)) if w[i : i + len(p)] == p]
        lines = [t[m.end() :].split("\n")[0] for m in re.finditer("(?i)spdx-license-identifier:|license-expression:", t)]
        told = [c for c in map(_told, lines) if c]
        starts = [i for i, _, base, _ in found if base]
        score = 1 - np.prod([1 - weight for *_, weight in found] + [1 - licenses.TAG_WEIGHT] * len(told))
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"]) == (len(w), len(starts), min(starts, default=None), max(starts, default=None))
        assert row["base_labels"] == ",".join(sorted({n for _, n, base, _ in found if base}))
        shown = row["choices"].split("; ") if row["choices"] else []
        assert row["score"] == pytest.approx(score) and len(shown) == len(told) and all(map(_same_choices, shown, told)), t
        labels = {n for _, n, _, _ in found} | {x.split(" with ")[0] for c in shown for x in re.split(r" and | or |[()]", c) if x}
        assert row["labels"] == ",".join(sorted(labels))
        some += len(told)
    assert some > 200


def test_license_choices_are_not_multiplied_out():
    pairs = " AND ".join(f"(GPL-2.0 WITH a{k}-exception OR GPL-2.0 WITH b{k}-exception)" for k in range(20))
    start = time.perf_counter()
    (_, _, _, choices, labels), = licenses.scan(f"License-Expression: {pairs}")[2]
    assert time.perf_counter() - start < 0.1 and labels == ["gpl"] and choices.count(" or ") == 20
    for text in ("MIT or " * 100_000 + "ISC", "".join(f"X{k} and (Y{k} or (" for k in range(20_000)) + "MIT" + "))" * 20_000, " or ".join(f"MIT and Y{k}" for k in range(20_000))):
        start = time.perf_counter()
        assert len(licenses.scan(f"License-Expression: {text}")[2]) == 1 and time.perf_counter() - start < 10


def test_license_scan_is_linear():
    out = licenses.scan("License-Expression: MIT or (Apache-2.0 " * 800)
    assert len(out[2]) == 800 and sum(len(x[1]) for x in out[2]) < 20_000
    assert len(licenses.scan("mit license " * 200_000)[1]) == 200_000 and not licenses.scan("License-Expression: " + "(" * 500_000)[2]


def test_license_edges(odd_docs, no_docs):
    rows = licenses.license_scan(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["score"] == 0 and not r["places"] for r in rows)
    assert licenses.license_scan(no_docs).count() == 0
    n, places, expressions, score = licenses.scan("é SPDX-License-Identifier: MIT\nx")
    assert expressions == [(2, "MIT", "MIT", "mit", ["mit"])] and score == 1.0


@pytest.fixture(scope="module")
def encoder():
    return wordbpe.encoder(wordbpe.default_path())


def _texts(n, seed):
    r = random.Random(seed)
    parts = list("abcABC  \n'sst.!1é²½ß") + ["<|endoftext|>", "<|", "é", "'ll", "'Re", "中", "İ", "Σ", "\x85", "zzzzzzzzzzzzzzz", "   ", "12"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 120))) for _ in range(n)]


def test_word_encoder_equals_library(encoder):
    texts = _texts(1500, 3)
    for t, ids in zip(texts, encoder.encode_many(texts)):
        want = np.array(encoder.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert ids == want and encoder.marked(t)[0].tobytes() == want, t
        assert encoder.decode(ids) == encoder.library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_tree_equals_whole(encoder, monkeypatch):
    r = random.Random(4)
    for t in _texts(600, 5):
        monkeypatch.setattr(bpe_tree, "REACH", r.choice([33, 64, 256]))
        t = r.choice([t, t * 5, t.replace(" ", ""), "x" * 400 + t, t + "'ll" * 90, t + "!'s" * 120, "<|endoftext|>" * 30 + t])
        assert bpe_tree.tree_encode(encoder, t, r.choice([16, 50, 128])) == encoder.whole(t), t


@pytest.mark.parametrize("alphabet", ["ab", "aab", "etaoinshrdlu", "e\u0301\u0323o", "中文字日本", "\u1100\u1161\u11a8\uac00", "a\u0345\u0301\u0308\u0316"])
def test_tree_within_one_word(encoder, monkeypatch, alphabet):
    r = random.Random(len(alphabet))
    for leaf in (97, 700, 1500):
        monkeypatch.setattr(bpe_tree, "REACH", r.choice([33, 64]))
        t = "".join(r.choice(alphabet) for _ in range(5000))
        assert bpe_tree.tree_encode(encoder, t, leaf) == encoder.whole(t)


def test_tree_windows_of_a_long_word_stay_small(encoder, monkeypatch):
    r, sizes = random.Random(6), []
    text = "".join(r.choices("etaoinshrdlcumw", k=1_000_000))
    piece = bpe_tree.encode_piece
    monkeypatch.setattr(bpe_tree, "encode_piece", lambda e, t, start=0: sizes.append(len(t)) or piece(e, t, start))
    pieces = [piece(encoder, text[a:b], a) for a, b in bpe_tree.leaves(text)]
    assert bpe_tree.join_all(encoder, text, pieces).ids.tobytes() == encoder.whole(text)
    assert len(sizes) >= len(pieces) - 1 and max(sizes) <= 4096


def test_tree_in_spark(spark, encoder, odd_docs, no_docs):
    texts = [t * 8 for t in _texts(20, 6)] + ODD
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)] + [(0, texts[0], 1)], "doc_id long, text string, ids int")
    rows = bpe_tree.encode_documents(docs, decode=True, leaf=100).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = encoder.whole(texts[r["doc_id"]] or "")
        assert bytes(r["ids"]) == want and r["decoded"] == encoder.decode(want)
    assert bpe_tree.encode_documents(odd_docs).count() == odd_docs.count() and bpe_tree.encode_documents(no_docs).count() == 0


def test_packing_plan_is_cheapest():
    def cost(cuts, ends, stops, size):
        total, start = 0.0, 0
        for c in cuts:
            n = c - start
            if n > size:
                return float("inf")
            total += packing.SEQUENCE_COST + (0 if n & (n - 1) == 0 and n >= packing.SHORT or n == size else size - n)
            total += 0 if c in ends else packing.SENTENCE_CUT if c in stops else packing.HARD_CUT
            start = c
        return total

    r = np.random.default_rng(7)
    for _ in range(40):
        size = 2048
        points = np.unique(r.integers(1, 5000, 9))
        ends = np.unique(np.append(r.choice(points, 3), 5000))
        stops = np.setdiff1d(points, ends)
        got = packing.plan(ends, stops, size)
        every = sorted({*ends.tolist(), *stops.tolist()})
        full = sorted({*every, *(a + size for a, b in zip([0, *every], every) if b - a > size for _ in (0,)), *(a + 2 * size for a, b in zip([0, *every], every) if b - a > 2 * size)})
        best = float("inf")
        inner = [c for c in full if c != 5000]
        for mask in range(1 << len(inner)):
            cuts = [c for k, c in enumerate(inner) if mask >> k & 1] + [5000]
            best = min(best, cost(cuts, set(ends.tolist()), set(stops.tolist()), size))
        assert abs(cost(got, set(ends.tolist()), set(stops.tolist()), size) - best) < 1e-6


@pytest.mark.parametrize("block", [1, 300, 1 << 19])
def test_packing_holds_every_token_once(spark, encoder, block):
    texts = _texts(30, 8) + ODD + ["word. " * 9000]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, offset string")
    rows = packing.pack_documents(docs, size=1024, block=block).collect()
    at, fill = {}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        ids = encoder.whole(texts[r["doc_id"]] or "") + np.array([2], "<u4").tobytes()
        assert r["start"] == at.get(r["doc_id"], 0) and r["doc_tokens"] == len(ids) // 4
        assert bytes(r["ids"]) == ids[4 * r["start"] : 4 * (r["start"] + r["length"])]
        at[r["doc_id"]] = r["start"] + r["length"]
    assert at == {k: len(encoder.whole(t or "")) // 4 + 1 for k, t in enumerate(texts)}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 1024


def test_packing_edges(odd_docs, no_docs):
    assert {r["doc_id"] for r in packing.pack_documents(odd_docs).collect()} == {*range(len(ODD)), None}
    assert packing.pack_documents(no_docs).count() == 0


def test_token_attribution_rules():
    starts, ends = np.array([0, 2, 5, 9]), np.array([2, 5, 9, 10])
    sections = [(0, 3), (3, 4), (6, 9)]
    assert token_counts.attribute(starts, ends, sections, "first").tolist() == [0, 0, 2, -1]
    assert token_counts.attribute(starts, ends, sections, "last").tolist() == [0, 1, 2, -1]
    assert token_counts.attribute(starts, ends, [(0, 3), (3, 8)], "most").tolist() == [0, 1, 1, -1]


def test_token_counts_match_brute_force(spark, odd_docs, no_docs):
    texts = _texts(40, 9) + ODD
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {}
    for r in token_counts.token_counts(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    library = token_counts.Spans(token_counts.default_path()).library
    for k, t in enumerate(texts):
        t = t or ""
        offsets = library.encode(t, add_special_tokens=False).offsets
        want = [sum(s <= a < e for a, _ in offsets) for s, e in token_counts.paragraphs(t)]
        rows = sorted(got[k], key=lambda r: r["section"])
        assert [r["n_tokens"] for r in rows] == want and sum(want) == len(offsets)
    assert token_counts.token_counts(odd_docs).filter("doc_id is null").count() == 1 and token_counts.token_counts(no_docs).count() == 0


def test_token_counts_of_given_sections(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "none here"), (3, None)], "doc_id long, text string")
    sections = spark.createDataFrame([(1, 7, 0, 5), (1, 8, 6, 8), (9, 1, 0, 2), (1, 9, 6, 8), (1, 10, 3, None), (1, 11, 5, 2)], "doc_id long, section long, start long, end long")
    rows = {}
    for r in token_counts.token_counts(docs, sections).collect():
        rows.setdefault(r["doc_id"], {})[r["section"]] = r["n_tokens"]
    library = token_counts.Spans(token_counts.default_path()).library
    assert rows[1][7] >= 1 and rows[1][8] >= 1 and rows[1][9] == 0 and set(rows[1]) == {7, 8, 9, token_counts.OUTSIDE}
    assert sum(rows[1].values()) == len(library.encode("alpha beta gamma").ids) and rows[2] == {token_counts.OUTSIDE: len(library.encode("none here").ids)} and rows[3] == {token_counts.OUTSIDE: 0}
    with pytest.raises(ValueError):
        token_counts.token_counts(docs, rule="middle")


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_of_overlapping_sections_add_up(spark, rule):
    r = random.Random(13)
    texts = _texts(30, 14)
    given = [(k, n, a, a + r.randint(0, 30)) for k, t in enumerate(texts) for n in range(r.randint(0, 6)) for a in [r.randint(0, max(len(t), 1))]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for x in token_counts.token_counts(docs, spark.createDataFrame(given, "doc_id long, section long, start long, end long"), rule).collect():
        got.setdefault(x["doc_id"], {})[x["section"]] = x["n_tokens"]
    library = token_counts.Spans(token_counts.default_path()).library
    for k, t in enumerate(texts):
        of = {}
        for start, end, n in sorted((a, b, n) for d, n, a, b in given if d == k):
            for c in range(start, end):
                of.setdefault(c, n)
        want = {n: 0 for d, n, _, _ in given if d == k}
        for a, b in library.encode(t, add_special_tokens=False).offsets:
            inside = [of[c] for c in range(a, b) if c in of]
            name = token_counts.OUTSIDE if not inside else inside[0] if rule == "first" else inside[-1] if rule == "last" else max(dict.fromkeys(inside), key=inside.count)
            want[name] = want.get(name, 0) + 1
        assert got[k] == (want or {token_counts.OUTSIDE: 0}), t


def test_viterbi_equals_brute_force():
    import itertools

    r = np.random.default_rng(10)
    for _ in range(60):
        s = r.normal(size=(6, 3)) * 4
        best = max(sum(s[t, p] for t, p in enumerate(path)) - 5 * sum(a != b for a, b in zip(path, path[1:])) for path in itertools.product(range(3), repeat=6))
        path = langid.viterbi(s, 5.0).tolist()
        assert abs(sum(s[t, p] for t, p in enumerate(path)) - 5 * sum(a != b for a, b in zip(path, path[1:])) - best) < 1e-9


def test_one_label_for_all_words_is_as_good_as_the_search():
    r = np.random.default_rng(15)
    model = langid.Model({"a": np.ones(langid.BUCKETS + len(langid.NAMES)), "b": np.ones(langid.BUCKETS + len(langid.NAMES)), "c": np.ones(langid.BUCKETS + len(langid.NAMES))})
    gain = lambda s, path: sum(s[t, p] for t, p in enumerate(path)) - langid.SWITCH * sum(a != b for a, b in zip(path, path[1:]))
    short = 0
    for _ in range(400):
        s = np.minimum(0, r.normal(size=(int(r.integers(1, 40)), 3)) * r.choice([0.5, 2.0, 4.0]) - 1 + (r.random(3) - 0.5) * 2)
        got = model.label(s)
        if isinstance(got, int):
            short += 1
            assert abs(gain(s, [got] * len(s)) - gain(s, langid.viterbi(s, langid.SWITCH).tolist())) < 1e-6
    assert 20 < short < 400


def test_word_scores_equal_plain_ones():
    train = {"de": ["der", "hund", "straße"], "en": ["the", "dog", "the"], "ru": ["собака"]}
    sums = {}
    for lang, words in train.items():
        sums[lang] = np.zeros(langid.BUCKETS + len(langid.NAMES))
        for w in words:
            np.add.at(sums[lang], langid.grams([w])[0], 1)
            sums[lang][langid.BUCKETS + langid.scripts([w])[0]] += 1
    model = langid.Model(sums)
    for word in ("the", "hunde", "собака", "中文", "ö"):
        at, of = langid.grams([word])
        assert len(at) == len(word) + 2 + len(word) + 1 + len(word) and set(of) == {0}
        logs = {n: sum(np.log((sums[n][k] + 0.05) / (sums[n][: langid.BUCKETS] + 0.05).sum()) for k in at) for n in train}
        name = langid.scripts([word])[0]
        use = [n for n in train if sums[n][langid.BUCKETS + name] / sums[n][langid.BUCKETS :].sum() >= langid.SCRIPT_SHARE] or list(train)
        top = max(logs[n] for n in use)
        want = [max(logs[n] - top, -langid.CLIP) if n in use else langid.REMOVED for n in sorted(train)]
        assert model.score([word])[0].tolist() == pytest.approx(want, abs=1e-3)


def test_language_of_held_out_documents(spark, sf):
    rows = langid.query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def test_language_spans_and_scripts(spark, odd_docs, no_docs):
    train = spark.createDataFrame([("the cat and the dog were here with that", "en"), ("der hund und die katze sind nicht hier", "de"), ("собака и кошка здесь", "ru"), (None, "fr"), ("x", None)], "text string, lang string")
    model = langid.learn(train)
    assert model.langs == ["de", "en", "ru"]
    (lang, score, spans), *_ = langid.identify(model, ["the cat and the dog were here собака и кошка здесь собака и кошка"])
    assert {x[2] for x in spans} == {"en", "ru"}
    assert [x[0] for x in langid.identify(model, ["½ ² 12", "½ the"])] == ["und", "en"]
    rows = langid.language_spans(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and {r["lang_pred"] for r in rows if r["doc_id"] in (0, 1, 2, 7)} == {"und"}
    assert langid.language_spans(no_docs, model).count() == 0
    empty = langid.learn(train.limit(0))
    assert {r["lang_pred"] for r in langid.language_spans(odd_docs, empty).collect()} == {"und"}
    assert langid.in_known_language(odd_docs, model).columns == odd_docs.columns


def test_quality_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_classifier.query(spark, sf).join(labels, "doc_id").collect()
    held = [(r["score"], r["quality"]) for r in rows if r["held_out"]]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert sum(a > b for a in good for b in bad) >= 0.95 * len(good) * len(bad)
    assert docs.count() == quality_classifier.query(spark, sf).count()


def _plain_features(text):
    word = lambda x: zlib.crc32(x.encode()) * 0x9E3779B97F4A7C15 % 2**64
    mult, words = 0xC2B2AE3D27D4EB4F, [word(x) for x in re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", text)]
    out = {}
    for n in (1, 2, 4):
        grams = []
        for k in range(len(words) - n + 1):
            g = words[k]
            for m in range(1, n):
                g = (g * mult % 2**64) ^ ((words[k + m] + m + 1) % 2**64)
            grams.append(g)
        for g in set(grams) if n < 4 else ():
            at = (g * mult % 2**64) >> 46
            out[at] = out.get(at, 0) + (grams.count(g) / len(grams)) ** 0.5
        for k in range(8) if n > 1 and grams else ():
            share = sum(min(grams.count(g).bit_length() - 1, 7) == k for g in grams) / len(grams)
            at = zlib.crc32(b"times %d %d" % (n, k)) % quality_classifier.BUCKETS
            if share:
                out[at] = out.get(at, 0) + share
    return out


def test_quality_classifier_equals_plain_one(spark):
    r, c = random.Random(16), quality_classifier
    texts = [" ".join(r.choice(["buy", "now", "!!", "a", "fine", "text", "7", "_"] if k % 3 else ["long", "and", "fine", "text", "é", "of", "words"]) for _ in range(r.randint(0, 40))) for k in range(60)]
    for t in texts:
        at, x = c.features(t)
        want = _plain_features(t)
        assert at.tolist() == sorted(want) and x.tolist() == pytest.approx([want[k] for k in sorted(want)], rel=2e-3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)], "doc_id long, quality int")
    weights = c.fit(docs, labels)
    order = [x["doc_id"] for x in labels.selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h").collect()]
    z, n, w = {}, {}, lambda k: 0.0 if abs(z.get(k, 0)) <= c.L1 else -(z[k] - (c.L1 if z[k] > 0 else -c.L1)) / ((c.BETA + n[k] ** 0.5) / c.ALPHA + c.L2)
    for _ in range(c.EPOCHS):
        for k in order:
            x = dict(zip(*(v.tolist() for v in c.features(texts[k])))) | {c.BUCKETS: 1.0}
            held = {j: w(j) for j in x}
            p = 1 / (1 + np.exp(-sum(held[j] * v for j, v in x.items())))
            for j, v in x.items():
                g = (p - (k % 3 == 0)) * v
                z[j] = z.get(j, 0) + g - ((n.get(j, 0) + g * g) ** 0.5 - n.get(j, 0) ** 0.5) / c.ALPHA * held[j]
                n[j] = n.get(j, 0) + g * g
    assert {k: weights[k] for k in z} == pytest.approx({k: w(k) for k in z}, abs=1e-4) and np.count_nonzero(weights) <= len(z)
    for x in c.quality_scores(docs, weights).collect():
        at = c.features(texts[x["doc_id"]])
        assert x["score"] == pytest.approx(1 / (1 + np.exp(-sum(w(k) * v for k, v in zip(*(v.tolist() for v in at))) - w(c.BUCKETS))), abs=1e-4)
    few = c.fit(docs, labels, values=sum(len(c.features(texts[k])[0]) for k in order[:5]))
    assert np.allclose(few, c.train([(int(k % 3 == 0), *c.features(texts[k])) for k in order[:5]]), atol=1e-5)


def test_quality_classifier_edges(spark, odd_docs, no_docs):
    none = quality_classifier.fit(odd_docs, spark.createDataFrame([(99, 1), (3, None)], "doc_id long, quality int"))
    assert {r["score"] for r in quality_classifier.quality_scores(odd_docs, none).collect()} == {0.5}
    some = quality_classifier.fit(odd_docs, spark.createDataFrame([(3, 1), (3, 0), (6, 0), (9, 1)], "doc_id long, quality int"), rows=3)
    rows = quality_classifier.quality_scores(odd_docs, some).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_classifier.quality_scores(no_docs, some).count() == 0
    assert quality_classifier.of_quality(odd_docs, none).count() == odd_docs.count()
