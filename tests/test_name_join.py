"""Joins of names by similarity against all pairs of difflib."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import name_join
from quarrystone.operators.work import folder


def table(spark, names):
    d = name_join.numbered(spark.createDataFrame([(x,) for x in names], "name string"), folder(spark))
    return d, {r["nid"]: r["name"] for r in d.collect()}


def mixed(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcde 中\U0001f600") for _ in range(r.randint(1, 30))) for _ in range(40)]
    edited = []
    for x in base:
        for _ in range(3):
            y = list(x)
            for _ in range(r.randint(1, 3)):
                at = r.randrange(len(y) + 1)
                if r.random() < 0.5 and y:
                    y[at : at + 1] = []
                else:
                    y.insert(at, r.choice("abcdez"))
            edited.append("".join(y))
    moved = [x[len(x) // 2 :] + x[: len(x) // 2] for x in base[:10]]
    long = ["word " * 60, "word " * 59 + "ward ", "ab" * 120, "ab" * 118]
    return [*base, *edited, *moved, *long, "ab", "axb", "abc", "a", "b"]


def ratios(found):
    for x in found:
        for y in found:
            if x < y:
                a, b = found[x], found[y]
                yield (x, y), max(difflib.SequenceMatcher(None, a, b).ratio(), difflib.SequenceMatcher(None, b, a).ratio())


@pytest.mark.parametrize("cell", [2_000, 6])
@pytest.mark.parametrize("least", [0.81, 0.9])
def test_similar_equals_all_pairs(spark, monkeypatch, cell, least):
    monkeypatch.setattr(name_join, "CELL", cell)
    names, found = table(spark, mixed(7))
    want = {pair for pair, ratio in ratios(found) if ratio >= least}
    got = [(r["x"], r["y"]) for r in name_join.similar(names, least).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60


def test_asked_names_meet_all_others(spark):
    names, found = table(spark, mixed(8))
    asked = names.filter(F.col("nid") % 3 == 0)
    mine = {r["nid"] for r in asked.collect()}
    got = [(r["x"], r["y"]) for r in name_join.candidates(names, 0.85, asked).collect()]
    want = {p for (x, y), ratio in ratios(found) if ratio >= 0.85 for p in ((x, y), (y, x)) if p[0] in mine}
    assert want and want <= set(got) and len(got) == len(set(got)) and all(x in mine and x != y for x, y in got)


@pytest.mark.parametrize("cell", [2_000, 3])
def test_contained_equals_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(name_join, "CELL", cell)
    names, found = table(spark, [*mixed(9), *(x[3:9] for x in mixed(9)), "ab" * 50, "abab", "aaaa", "aaaaa", "aaa"])
    want = {(x, y) for x in found for y in found if x != y and len(found[x]) >= 4 and found[x] in found[y]}
    got = [(r["x"], r["y"]) for r in name_join.contained(names).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_null_repeated_and_no_names(spark):
    names, found = table(spark, [None, "", "", "same name here", "same name here", "same name hero", None])
    assert sorted(found.values()) == ["", "same name here", "same name hero"]
    assert name_join.similar(names, 0.9).count() == 1 and name_join.contained(names).count() == 0
    none, _ = table(spark, [])
    assert name_join.similar(none, 0.9).count() == 0 and name_join.contained(none).count() == 0 and name_join.candidates(none, 0.9, none).count() == 0


def test_a_ratio_too_low_is_an_error(spark):
    names, _ = table(spark, ["x"])
    with pytest.raises(ValueError):
        name_join.candidates(names, 0.8)


def test_runs_sent_never_lose_a_pair():
    """The count of shared runs is no more than what any two names of a ratio share, over all small lengths."""
    for least in (0.81, 0.82, 0.9, 0.95):
        for m in range(1, 60):
            for n in range(m, 60):
                q, c = name_join.shared_runs(least, m + n)
                if name_join.shared_length(least, m + n) <= m and m + n > 2:
                    assert c >= 1 and name_join.first_runs(least, m)[q] >= m - q + 2 - c and name_join.first_runs(least, n)[q] >= n - q + 2 - c
