"""Interval joins and observed phases, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import intervals
from quarrystone.operators.intervals import interval_join, interval_stats
from quarrystone.operators.phases import Phases


def test_equals_all_pairs(spark):
    r = random.Random(3)
    points = [(k, r.choice("ab"), None if k % 29 == 0 else r.choice([r.uniform(-500, 5000), 60.0 * r.randint(0, 60), 0.0])) for k in range(300)]
    spans = []
    for k in range(200):
        a = r.choice([60.0 * r.randint(0, 60), r.uniform(-400, 4000)])
        spans.append((k, r.choice("abc"), a, a + r.choice([0.0, 60.0, 960.0, r.uniform(0, 5000), r.uniform(0, 50), -1.0])))
    spans += [(900, "a", None, 3.0), (901, "b", -1e7, 1e7)]
    p = spark.createDataFrame(points, "p long, key string, at double").repartition(3)
    s = spark.createDataFrame(spans, "s long, key string, lo double, hi double")
    want = {(i, j) for i, k, t in points for j, k2, a, b in spans if k == k2 and t is not None and a is not None and a <= t <= b}
    got = [(x["p"], x["s"]) for x in interval_join(p, s, "at", "lo", "hi", ["key"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    free = {(x["p"], x["s"]) for x in interval_join(p, s.drop("key"), "at", "lo", "hi", width=7.0).collect()}
    assert free == {(i, j) for i, _, t in points for j, _, a, b in spans if t is not None and a is not None and a <= t <= b}
    assert interval_join(p, s.limit(0), "at", "lo", "hi", ["key"]).count() == 0


def test_long_intervals_touch_two_bins(spark):
    p = spark.createDataFrame([(float(k),) for k in range(100)], "at double")
    s = spark.createDataFrame([(1, -1e9, 1e9), (2, 5.0, 5.0)], "s long, lo double, hi double")
    d = interval_join(p, s, "at", "lo", "hi")
    assert d.count() == 101
    assert "NestedLoop" not in d._jdf.queryExecution().toString() and "Cartesian" not in d._jdf.queryExecution().toString()


@pytest.mark.parametrize("bits", [1, 2, 6])
def test_stats_equal_those_of_all_pairs(spark, monkeypatch, bits):
    monkeypatch.setattr(intervals, "NODE_BITS", bits)
    r = random.Random(4)
    points = [(r.choice(["a", "b", None]), None if k % 29 == 0 else r.choice([r.uniform(-50, 500), 6.0 * r.randint(0, 60), 0.0, -0.0]), None if k % 7 == 0 else r.uniform(-1, 1)) for k in range(300)]
    spans = []
    for k in range(150):
        a = r.choice([6.0 * r.randint(0, 60), r.uniform(-40, 400), 0.0])
        spans.append((k % 120, r.choice(["a", "b", "c", None]), a, a + r.choice([0.0, 6.0, 96.0, r.uniform(0, 500), -1.0])))
    spans += [(900, "a", None, 3.0), (901, "b", -1e7, 1e7), (901, "b", -1e7, 1e7), (902, "a", 1e6, 1e7)]
    p = spark.createDataFrame(points, "key string, at double, v double").repartition(3)
    s = spark.createDataFrame(spans, "s long, key string, lo double, hi double")
    want = {}
    for i, k, a, b in spans:
        for k2, t, v in points:
            if k is not None and k == k2 and t is not None and a is not None and a <= t <= b:
                want.setdefault(i, []).append(v)
    told = {i: (len(v), max((x for x in v if x is not None), default=None), min((x for x in v if x is not None), default=None)) for i, v in want.items()}
    assert {x["s"]: (x["n"], x["most"], x["least"]) for x in interval_stats(p, s, "at", "lo", "hi", "v", ["s"], ["key"]).collect()} == told
    assert interval_stats(p, s.limit(0), "at", "lo", "hi", "v", ["s"], ["key"]).count() == 0
    assert interval_stats(p.limit(0), s, "at", "lo", "hi", "v", ["s"], ["key"]).count() == 0


def test_stats_of_many_points_in_many_intervals(spark):
    """Ten billion pairs: 100,000 points at one time, in each of 100,000 intervals."""
    d = spark.range(100_000)
    got = interval_stats(d.select(F.lit(5.0).alias("at"), F.col("id").alias("v")), d.select("id", F.lit(1.0).alias("lo"), F.lit(9.0).alias("hi")), "at", "lo", "hi", "v", ["id"])
    assert [tuple(x) for x in got.groupBy("n", "most", "least").count().collect()] == [(100_000, 99_999, 0, 100_000)]


def test_phases_report_what_each_job_saw(spark):
    d = spark.range(1000).withColumn("v", F.col("id") % 7)
    seen = Phases({"sum": F.sum("v")})
    out = seen.chain(d, [("all", lambda x: x), ("some", lambda x: x.filter("v > 2")), ("none", lambda x: x.filter("v > 9"))])
    got = [r.asDict() for r in seen.report(spark).orderBy("place").collect()]
    assert [(r["phase"], r["rows"]) for r in got] == [("all", 1000), ("some", d.filter("v > 2").count()), ("none", 0)] and out.count() == 0
    assert [r["metrics"]["sum"] for r in got] == [d.agg(F.sum("v")).first()[0], d.filter("v > 2").agg(F.sum("v")).first()[0], None]
    assert all(r["seconds"] > 0 for r in got)
