"""Points in intervals, as samples in the jobs that ran when they were taken."""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import folder, written

#: Bins of a level hold this many of the level below.
STEP = 16
#: Nodes hold two to this many of the level below; as many copies of the upper ones are made.
NODE_BITS = 6


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, keys: Sequence[str] = (), width: float = 60.0) -> DataFrame:
    """Rows of ``points`` with the rows of ``intervals`` that hold them (both ends included) and agree in ``keys``.

    Time is cut into bins at several levels, each ``STEP`` times as wide as the one below, from ``width`` on.  An
    interval goes to the lowest level where it is no longer than a bin, so it touches two bins at most however long it
    is; a point goes to its bin at each level.  They meet by level, bin and keys, and the exact test
    follows, so no join is without an equality, and work grows with what meets.  The number of levels follows
    from the longest interval.  Bounds and points are numbers, in one unit with ``width``; nulls, and intervals that end before
    they start, hold nothing.
    """
    spans = intervals.filter(F.col(start) <= F.col(end))
    longest = spans.agg(F.max(F.col(end) - F.col(start)).alias("n")).first()["n"] or 0
    levels = 1
    while width * STEP ** (levels - 1) < longest:
        levels += 1
    # The bins' widths are few numbers, one for each level.
    widths = [width * STEP**k for k in range(levels)]
    bin_of = lambda x, w: F.floor(x.cast("double") / w).cast("long")
    size: Column = F.lit(None).cast("int")
    for k in reversed(range(levels)):
        size = F.when(F.col(end) - F.col(start) <= widths[k], F.lit(k)).otherwise(size)
    wide = F.element_at(F.array(*[F.lit(float(w)) for w in widths]), F.col("_level") + 1)
    cut = spans.withColumn("_level", size).withColumn("_bin", F.explode(F.array_distinct(F.array(bin_of(F.col(start), wide), bin_of(F.col(end), wide)))))
    names = {c: f"_k{k}" for k, c in enumerate(keys)}
    cut = cut.withColumnsRenamed(names)
    near = points.withColumn("_at_bin", F.explode(F.array(*[F.struct(F.lit(k).alias("l"), bin_of(F.col(at), w).alias("b")) for k, w in enumerate(widths)])))
    on = (F.col("_at_bin.l") == F.col("_level")) & (F.col("_at_bin.b") == F.col("_bin"))
    for c, other in names.items():
        on &= F.col(c) == F.col(other)
    met = near.join(cut, on & F.col(at).between(F.col(start), F.col(end)))
    return met.select(*points.columns, *[c for c in intervals.columns if c not in keys])


def interval_stats(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, value: str, by: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(*by, n, most, least): number and range of ``value`` of the points in the intervals of each ``by``; none without a point.

    The points that an interval holds (both ends included, agreeing in ``keys``) are a run of the points' order by
    keys and time.  Points and both ends of the intervals are sorted into ranges together, and the numbers of
    points before them give each interval its first and last place.  Nodes hold the values of 64 places, nodes of the next level
    the ranges of 64 nodes; an interval takes a piece of two nodes of each level at most, however many points it holds, so work
    grows with points and intervals and not with their pairs.  Upper nodes, which many intervals touch, are copied
    and met by a hash.  Bounds and points are numbers of one type; nulls, and intervals that end before they start, hold nothing.
    """
    spark, bits = points.sparkSession, NODE_BITS
    path = folder(spark)
    same = [F.col(k).isNotNull() for k in keys]
    span = F.struct(*[F.col(c) for c in by], *[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.col(start).alias("_start"), F.col(end).alias("_end"))
    spans = intervals.filter(reduce(lambda a, b: a & b, same, F.col(start) <= F.col(end))).groupBy(span.alias("_span")).agg(F.count(F.lit(1)).alias("_times"))
    # At one time, starts come before points and ends behind them.
    places = [f"_k{n}" for n in range(len(keys))] + ["_at", "_kind"]
    ends = spans.select("_span", "_times", *[F.col(f"_span._k{n}").alias(f"_k{n}") for n in range(len(keys))], F.explode(F.array(F.struct(F.col("_span._start").alias("_at"), F.lit(0).alias("_kind")), F.struct(F.col("_span._end").alias("_at"), F.lit(2).alias("_kind")))).alias("_x")).select("_span", "_times", *places[:-2], "_x.*")
    seen = points.filter(reduce(lambda a, b: a & b, same, F.col(at).isNotNull())).select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.col(value).alias("_value"))
    # Written once, as ranges may fall otherwise when they are made again.
    ranged = seen.unionByName(ends, allowMissingColumns=True).repartitionByRange(*places).sortWithinPartitions(*places)
    ranged = written(ranged.select("_kind", "_value", "_span", "_times").withColumn("_part", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id()), path, "ranged")
    is_point = (F.col("_kind") == 1).cast("long")
    sizes = ranged.groupBy("_part").agg(F.sum(is_point).alias("_size"))
    # A row for each range.
    before = written(sizes.select("_part", "_size", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before")), path, "sizes")
    total = before.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    within = F.sum(is_point).over(Window.partitionBy("_part").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("_within", within).join(before, "_part").select("_kind", "_value", "_span", "_times", (F.col("_before") + F.col("_within")).alias("_place"))

    # Children by their number in the level below; a level's nodes are few against those of the one below.
    children = placed.filter("_kind = 1").select((F.col("_place") - 1).alias("_child"), F.col("_value").alias("_least"), F.col("_value").alias("_most"))
    nodes, level = [], 0
    while level == 0 or total >> bits * level:
        held = F.sort_array(F.collect_list(F.struct((F.col("_child") % (1 << bits)).alias("c"), F.col("_least").alias("least"), F.col("_most").alias("most"))))
        made = children.groupBy(F.shiftright("_child", bits).alias("_node")).agg(held.alias("_held"))
        made = written(made.select("_node", F.col("_held.least").alias("_leasts"), F.col("_held.most").alias("_mosts")), path, f"level-{level}")
        copies = 0 if level == 0 else (1 << bits) - 1
        nodes.append(made.withColumn("_level", F.lit(level)).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies)))))
        children = made.select(F.col("_node").alias("_child"), F.array_min("_leasts").alias("_least"), F.array_max("_mosts").alias("_most"))
        level += 1

    def pieces(k: int) -> Column:
        """Children of level k, from and to, that no node of the next level takes whole."""
        up = lambda x, n: F.shiftright(x + F.lit((1 << bits * n) - 1), bits * n)
        a, b, a2, b2 = up(F.col("_lo"), k), F.shiftright("_hi", bits * k), up(F.col("_lo"), k + 1), F.shiftright("_hi", bits * (k + 1))
        piece = lambda lo, hi: F.struct(F.lit(k).alias("_level"), lo.alias("_from"), hi.alias("_to"))
        split = F.array(piece(a, F.shiftleft(a2, bits)), piece(F.shiftleft(b2, bits), b))
        return F.when(a >= b, F.array().cast("array<struct<_level:int,_from:bigint,_to:bigint>>")).when(a2 > b2, F.array(piece(a, b))).otherwise(split)

    runs = placed.filter("_kind <> 1").groupBy("_span", "_times").agg(F.min("_place").alias("_lo"), F.max("_place").alias("_hi"))
    met = runs.select("_span", "_times", F.inline(F.concat(*[pieces(k) for k in range(level)]))).filter("_from < _to")
    met = met.withColumn("_node", F.shiftright("_from", bits)).withColumn("_copy", F.when(F.col("_level") == 0, 0).otherwise(F.pmod(F.xxhash64("_span"), F.lit(1 << bits)).cast("int")))
    met = met.join(reduce(DataFrame.unionByName, nodes), ["_level", "_node", "_copy"])
    part = lambda c: F.slice(c, (F.col("_from") % (1 << bits) + 1).cast("int"), (F.col("_to") - F.col("_from")).cast("int"))
    held = F.col("_times") * (F.col("_to") - F.col("_from")) * F.element_at(F.array(*[F.lit(1 << bits * k).cast("long") for k in range(level)]), F.col("_level") + 1)
    found = met.select(*[F.col(f"_span.{c}").alias(c) for c in by], held.alias("_n"), F.array_max(part("_mosts")).alias("_most"), F.array_min(part("_leasts")).alias("_least"))
    return found.groupBy(*by).agg(F.sum("_n").alias("n"), F.max("_most").alias("most"), F.min("_least").alias("least"))
