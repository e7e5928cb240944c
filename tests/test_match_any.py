"""First rows by any of several names."""

from pyspark.sql import functions as F

from quarrystone.operators.knowledge_base import match_any


def test_first_row_of_each_name(spark):
    rows = spark.createDataFrame([(3, "a", "b"), (1, "b", "b"), (2, None, "a"), (None, "c", "d"), (5, "e", None)], "k long, x string, y string")
    names = spark.createDataFrame([("a",), ("b",), ("a",), ("c",), (None,), ("z",)], "name string")
    got = {(r["name"], r["k"], r["x"], r["y"]) for r in match_any(rows, names, ["x", "y"], "name", "k").collect()}
    assert got == {("a", 2, None, "a"), ("b", 1, "b", "b"), ("c", None, None, None)}


def test_rows_of_a_name_are_not_sorted_in_one_task(spark):
    """The smallest order of each key is found by hashing, before whole rows are touched."""
    rows = spark.range(1000).select("id", F.lit("same").alias("x"))
    d = match_any(rows, spark.createDataFrame([("same",)], "name string"), ["x"], "name", "id")
    assert [tuple(r) for r in d.collect()] == [("same", 0, "same")]
    assert "partial_min(_order" in d._jdf.queryExecution().executedPlan().toString()
