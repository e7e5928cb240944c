"""Connected components of an edge table, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is its component's smallest node.

    Each step hooks every label that has a smaller neighbour to its smallest one, shortens the
    hooks to their roots by pointer jumping, and contracts the edges.  Each step at least halves
    the labels that still have edges; every table is written to the shared folder.
    """
    spark = edges.sparkSession
    pairs = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(), folder, f"{name}-pairs")
    labels = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct().withColumn("label", F.col("node"))
    step = 0
    while not pairs.isEmpty():
        hooks = materialize(pairs.groupBy("x").agg(F.min("y").alias("y")), folder, f"{name}-hooks-{step}-0")
        jump = 0
        while True:
            up = hooks.select(F.col("x").alias("_x"), F.col("y").alias("_y"))
            if hooks.join(up, F.col("y") == F.col("_x"), "left_semi").isEmpty():
                break
            jump += 1
            hooks = materialize(hooks.join(up, F.col("y") == F.col("_x"), "left").select("x", F.coalesce("_y", "y").alias("y")), folder, f"{name}-hooks-{step}-{jump}")
        to = hooks.select(F.col("x").alias("_x"), F.col("y").alias("_y"))
        labels = materialize(labels.join(to, F.col("label") == F.col("_x"), "left").select("node", F.coalesce("_y", "label").alias("label")), folder, f"{name}-labels-{step}")
        moved = pairs.join(to, F.col("x") == F.col("_x"), "left").select(F.coalesce("_y", "x").alias("x"), "y")
        moved = moved.join(to, F.col("y") == F.col("_x"), "left").select("x", F.coalesce("_y", "y").alias("y"))
        moved = moved.filter("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
        pairs = materialize(moved, folder, f"{name}-pairs-{step}")
        discard(spark, f"{folder}/{name}-pairs" if not step else f"{folder}/{name}-pairs-{step - 1}", *([f"{folder}/{name}-labels-{step - 1}"] if step else []))
        step += 1
    return labels
