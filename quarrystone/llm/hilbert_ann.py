"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to ``DIMS`` dimensions by ``CURVES`` random orthogonal maps, each with a shift
of its own, and numbered along a Hilbert curve.  Quantiles of the numbers cut every curve into
windows of about equally many vectors; Spark range-partitions the vectors by curve and window, so a
task holds stretches of a curve and takes them window by window.  A query is sent to its own window
and to the neighbouring ones on every curve, the candidates of all curves merge, and the nearest by
exact Euclidean distance in double precision are kept.  The index holds every vector: ``CURVES`` copies
of each are shuffled, in the precision given.

Equal vectors are one point of the index; of their ids the ``k + 1`` smallest can be among anyone's
``k`` nearest, and only those are kept (a limit that is exact, applied before any shuffle).

A window is a share of all vectors (``SHARE``), not a number: in data without a low-dimensional
shape, near neighbours are no nearer on a curve than their share, so a fixed number would lose
recall as the table grows.  A window has ``WINDOW_LEAST`` rows at least; shares of more than
``WINDOW_ROWS`` rows are cut into several windows and the query goes to all of them, so that a task's
memory stays bounded.

Defined results: vectors that are null, empty, all zero, or hold a null or non-finite component take
no part, nor do rows without an id or vectors of another length than the most frequent one; with
fewer than ``k`` candidates all found are returned; repeated rows are one row; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, shared_dir, table

CURVES, DIMS, BITS, SEED = 10, 8, 7, 20
#: Windows of a curve each hold this share of the vectors; a query also searches one on either side.
SHARE = 1 / 25
#: Rows of a window, at least and at most, on average.
WINDOW_LEAST, WINDOW_ROWS = 160, 50_000


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Numbers along the Hilbert curve of rows of grid coordinates below ``2**bits``.

    Works from the highest bit down: the reflections and exchanges of each orthant are undone,
    then the bits are read as a Gray code, dimension by dimension.
    """
    x = x.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        bit, below = 1 << b, (1 << b) - 1
        for d in range(dims):
            upper = (x[d] & bit) > 0
            swap = np.where(upper, 0, (x[0] ^ x[d]) & below)
            x[0] ^= np.where(upper, below, 0) ^ swap
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


class Curves:
    """Projections and shifts of all curves for vectors of one length and scale."""

    def __init__(self, length: int, scale: float, curves: int = CURVES, dims: int = DIMS, bits: int = BITS):
        r = np.random.default_rng(SEED)
        self.dims, self.bits, self.scale = min(dims, length), bits, scale or 1.0
        self.maps = [np.linalg.qr(r.normal(size=(length, self.dims)))[0] for _ in range(curves)]
        self.shifts = [r.uniform(0.35, 0.65, self.dims) for _ in range(curves)]

    def keys(self, x: np.ndarray) -> np.ndarray:
        """A column of curve numbers for each curve."""
        top = (1 << self.bits) - 1
        # Coordinates are spread over about three standard deviations to either side.
        return np.stack([hilbert(np.clip((x @ m / (6 * self.scale) + s) * (top + 1), 0, top), self.bits) for m, s in zip(self.maps, self.shifts)], 1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): finite, not all zero, minus zero as zero; floats stay floats, other numbers become doubles."""
    kind = "float" if vectors.select(vector_col).schema[0].dataType.simpleString() == "array<float>" else "double"
    v = F.transform(F.col(vector_col), lambda x: x.cast(kind) + F.lit(0.0).cast(kind))
    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return d.filter(~F.coalesce(bad, F.lit(True))).filter(F.exists("v", lambda x: x != 0.0))


def nearest(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", share: float = SHARE, curves: int = CURVES) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest found of every row that ``is_query`` holds for.

    ``is_query`` is a condition on ``vec_id``.
    """
    spark = vectors.sparkSession
    folder = shared_dir(spark)
    base = usable(vectors, id_col, vector_col)
    row = base.groupBy(F.size("v").alias("length")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("sq")).orderBy(F.desc("n"), "length").first()
    if row is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    length, n = row["length"], row["n"]
    shape = Curves(length, float(np.sqrt(row["sq"] / length)), curves)
    base = base.filter(F.size("v") == length)
    kind = np.dtype("<f4" if base.schema["v"].dataType.simpleString() == "array<float>" else "<f8")
    # The limit runs before the shuffle too, so a vector that many rows share stays small.
    first = base.distinct().withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("_r") <= k + 1)
    points = first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = base.filter(is_query).select("vec_id", F.col("v").alias("_v")).distinct()
    points = materialize(points.join(asked.select("_v").distinct(), F.col("v") == F.col("_v"), "left").select(F.col("ids")[0].alias("point"), "v", "ids", F.col("_v").isNotNull().alias("asks")), folder, "points")

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = shape.keys(matrix(b.column(0), length))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(curves, dtype=np.int32), len(keys))), pa.array(keys.reshape(-1))], ["curve", "key"])

    # Windows by quantiles, cut further where they would hold too many rows; reach in windows.
    cuts = max(min(round(1 / share), n // WINDOW_LEAST + 1), n // WINDOW_ROWS + 1)
    reach = max(1, round(share * cuts))
    at = F.percentile_approx("key", [i / cuts for i in range(1, cuts)], max(10_000, 20 * cuts))
    found = map_arrow(points.select("v"), numbers, "curve int, key long", 1024).groupBy("curve").agg(at.alias("at")).collect()
    bounds = {r["curve"]: np.array(r["at"] or [], np.int64) for r in found}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["curve", "window", "point", "x", "ids", "asks"]
        for b in batches:
            x = matrix(b.column(1), length)
            keys = shape.keys(x)
            n, raw = len(x), x.astype(kind).tobytes()
            vector = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * length * kind.itemsize).astype(np.int32).tobytes()), pa.py_buffer(raw)])
            asks = np.flatnonzero(b.column(3).to_numpy(zero_copy_only=False))
            for c in range(curves):
                window = np.searchsorted(bounds[c], keys[:, c], "right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c, np.int32)), pa.array(window), b.column(0), vector, b.column(2), pa.array(np.zeros(n, bool))], names)
                for k in range(-reach, reach + 1):
                    at = asks[(window[asks] + k >= 0) & (window[asks] + k < cuts)]
                    if len(at):
                        rows = pa.array(at)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, np.int32)), pa.array(window[at] + np.int32(k)), b.column(0).take(rows), vector.take(rows), pa.nulls(len(at), b.column(2).type), pa.array(np.ones(len(at), bool))], names)

    def rerank(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        asks = rows.column("asks").to_numpy(zero_copy_only=False)
        data, queries = rows.filter(pa.array(~asks)), rows.filter(pa.array(asks))
        x = np.frombuffer(b"".join(data.column("x").to_pylist()), kind).reshape(-1, length).astype(np.float64)
        ids = data.column("ids").combine_chunks()
        first, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
        out_q, out_i, out_s = [], [], []
        raw, point = queries.column("x").to_pylist(), queries.column("point").to_pylist()
        norm = (x * x).sum(1)
        for a in range(0, len(raw) if len(x) else 0, 256):
            q = np.frombuffer(b"".join(raw[a : a + 256]), kind).reshape(-1, length).astype(np.float64)
            rough = norm - 2 * (q @ x.T)
            for j in range(len(q)):
                # All rows within rounding of the (k + 1)th nearest are measured exactly.
                if len(x) > k + 1:
                    bound = np.partition(rough[j], k)[k]
                    at = np.flatnonzero(rough[j] <= bound + 1e-9 * (1 + abs(bound) + float(q[j] @ q[j])))
                else:
                    at = np.arange(len(x))
                exact = np.sqrt(((q[j] - x[at]) ** 2).sum(1))
                pairs = sorted((s, i) for s, r in zip(exact.tolist(), at.tolist()) for i in flat[first[r] : first[r + 1]].tolist())[: k + 1]
                out_q += [point[a + j]] * len(pairs)
                out_s += [s for s, _ in pairs]
                out_i += [i for _, i in pairs]
        return pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_i, pa.int64()), pa.array(out_s, pa.float64())], ["point", "vec_id", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            place = b.column(0).to_numpy().astype(np.int64) << 32 | b.column(1).to_numpy()
            cut = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(place)]
            for start, stop in zip(cut[:-1], cut[1:]):
                if held and place[start] != now:
                    yield rerank(held)
                    held = []
                now = place[start]
                held.append(b.slice(start, stop - start))
        if held:
            yield rerank(held)

    dealt = map_arrow(points, deal, "curve int, window int, point long, x binary, ids array<long>, asks boolean", 1024)
    near = map_arrow(dealt.repartitionByRange("curve", "window").sortWithinPartitions("curve", "window"), search, "point long, vec_id long, score double", 4096)
    best = near.groupBy("point", "vec_id").agg(F.min("score").alias("score"))
    best = best.withColumn("_r", F.row_number().over(Window.partitionBy("point").orderBy("score", "vec_id"))).filter(F.col("_r") <= k + 1)
    of = points.filter("asks").select("point", F.col("v").alias("_p")).join(asked.withColumnRenamed("vec_id", "query_id"), F.col("_p") == F.col("_v")).select("query_id", F.col("point").alias("_point"))
    # An asked vector has k + 1 rows at most, whatever the number of its queries.
    lists = best.groupBy("point").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
    others = lambda q: F.slice(F.filter("found", lambda x: x["vec_id"] != q), 1, k)
    out = of.join(lists, F.col("_point") == F.col("point")).select("query_id", F.posexplode(others(F.col("query_id"))).alias("_at", "x"))
    return out.select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def matrix(column: pa.Array, length: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, length)


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
