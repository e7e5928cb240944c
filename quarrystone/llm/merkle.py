"""Merkle manifest of a dataset: a proof for every row, by a broadcast upper tree.

Leaves are digests of rows.  Each group (source) has a tree over its leaves in the order of their ids,
``RUN`` children to a node, and the groups' roots, in the order of the groups, have a tree of their own.

1. Rows become digests where they lie (SHA-256 on the JVM); from here on only ids and digests move.
2. Digests are range-partitioned by group and id and numbered by sums over the sorted ranges, so a
   group of any size is spread over tasks.
3. Blocks of ``RUN ** BLOCK_LEVELS`` neighbouring leaves are reduced whole, a record for each block.
4. The blocks' roots are the small upper tree.  The driver builds it while it has at most ``TOP`` nodes
   (32 bytes each); above that, further rounds of blocks come first, in Spark, over each group's nodes
   and then over the groups' roots, so that the driver's part is bounded at every size.
5. The upper tree is broadcast, as the suffix paths that its nodes share; executors finish every row's
   proof from its block and its suffix, and fold the row's digest, as it now is, back to a root.

Defined results: an empty table gives an empty result; a group of one row has its leaf for a root; a
null group is a group and comes first; null ids come first in their group; rows that repeat an id are
ordered by their leaves; repeated rows are leaves each and have their own proofs.  Rows equal in all
columns lie in one range, about 100 bytes each.  Texts of any length are read whole; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, shared_dir, table

RUN = 16
BLOCK_LEVELS = 3
#: Most nodes that the driver builds a tree of and broadcasts: 4 MB of digests, and the groups' names.
TOP = 1 << 17
#: Columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(hexes: bytes) -> bytes:
    return hashlib.sha256(hexes).hexdigest().encode()


def height(n: int, run: int = RUN) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // run), levels + 1
    return levels


def climb(nodes: bytes, levels: int, run: int = RUN) -> list[bytes]:
    """``nodes`` (hex digests, 64 bytes each) and the levels above, each one byte string."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append(b"".join(digest(below[k : k + 64 * run]) for k in range(0, len(below), 64 * run)))
    return out


def siblings(levels: list[bytes], at: int, run: int = RUN) -> list[tuple[bytes, bytes]]:
    """For node ``at`` of the lowest level, what stands left and right of its ancestors in their runs, up to below the last level."""
    out = []
    for row in levels[:-1]:
        first = at - at % run
        out.append((row[64 * first : 64 * at], row[64 * (at + 1) : 64 * (first + run)]))
        at //= run
    return out


def fold(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        node = digest(left + node + right)
    return node


def pack_path(path: list[tuple[bytes, bytes]]) -> bytes:
    return b"".join(bytes([len(a) // 64, len(b) // 64]) + bytes.fromhex((a + b).decode()) for a, b in path)


def unpack_path(raw: bytes) -> list[tuple[bytes, bytes]]:
    out, k = [], 0
    while k < len(raw):
        left, both = 64 * raw[k], 32 * (raw[k] + raw[k + 1])
        hexes = raw[k + 2 : k + 2 + both].hex().encode()
        out.append((hexes[:left], hexes[left:]))
        k += 2 + both
    return out


class UpperTree:
    """The nodes left for the driver: each group's, and the tree over the groups' roots."""

    def __init__(self, nodes: list[tuple], run: int = RUN):
        """``nodes``: (group, 32-byte digest), groups in order, nodes of a group in order."""
        self.run, self.groups, rows = run, {}, {}
        for group, node in nodes:
            rows.setdefault(group, []).append(bytes(node))
        roots = []
        for k, (group, found) in enumerate(rows.items()):
            levels = climb(b"".join(found).hex().encode(), height(len(found), run), run)
            self.groups[group] = (k, levels)
            roots.append(levels[-1])
        self.levels = climb(b"".join(roots), height(len(roots), run), run)
        self.root = self.levels[-1]

    def suffix(self, group, at: int) -> list[tuple[bytes, bytes]]:
        k, levels = self.groups[group]
        return siblings(levels, at, self.run) + siblings(self.levels, k, self.run)


def field(c: Column) -> Column:
    c = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def leaf(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256))


def numbered(rows: DataFrame, folder: str, name: str, order: list[str], by: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0 in each group of ``by``, in ``order``) and ``n`` (rows of the group)."""
    order = [*by, *order]
    at = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), folder, name)
    at = at.withColumn("_part", F.shiftright("_at", 33))
    firsts = at.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    ranges = firsts.select(
        *[F.col(c).alias(f"_{c}") for c in by],
        F.col("_part").alias("_p"),
        (F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n") - F.col("_first")).alias("_shift"),
        F.sum("_n").over(Window.partitionBy(*by)).alias("n"),
    )
    same = F.col("_part") == F.col("_p")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return at.join(ranges, same).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "n")


def blocks(rows: DataFrame, run: int, levels: int) -> DataFrame:
    """(grp, block, n, ids, leaves, changed_at, changed, node): a record for each block of the numbered rows (grp, pos, n, id, leaf, changed)."""
    size = run**levels
    kind = rows.schema["id"].dataType.simpleString()

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def record() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            leaves = b"".join(t["leaf"].to_pylist())
            n, changed = t["n"][0].as_py(), t["changed"].to_pylist()
            at = [k for k, x in enumerate(changed) if x is not None]
            node = climb(leaves.hex().encode(), min(levels, height(n, run)), run)[-1]
            ids = t["id"].combine_chunks()
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids)
            return pa.RecordBatch.from_arrays(
                [t["grp"].combine_chunks().slice(0, 1), pa.array([t["pos"][0].as_py() // size], pa.int64()), pa.array([n], pa.int64()), ids]
                + [pa.array([leaves], pa.binary()), pa.array([at], pa.list_(pa.int32())), pa.array([b"".join(changed[k] for k in at)], pa.binary()), pa.array([bytes.fromhex(node.decode())], pa.binary())],
                ["grp", "block", "n", "ids", "leaves", "changed_at", "changed", "node"],
            )

        for b in batches:
            # Blocks come whole and in order, so one begins where a position is a multiple of its size.
            starts = np.flatnonzero(b.column("pos").to_numpy() % size == 0)
            for lo, hi in pairwise([0, *starts.tolist(), b.num_rows]):
                if held and lo in starts:
                    yield record()
                if hi > lo:
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield record()

    rows = rows.select("grp", "pos", "n", "id", "leaf", "changed").withColumn("_block", F.floor(F.col("pos") / size))
    rows = rows.repartition("grp", "_block").sortWithinPartitions("grp", "_block", "pos").drop("_block")
    return rows.mapInArrow(f, f"grp string, block bigint, n bigint, ids array<{kind}>, leaves binary, changed_at array<int>, changed binary, node binary")


def with_paths(records: DataFrame, paths: DataFrame | None) -> DataFrame:
    """Records with the paths of their nodes; without a table of paths the upper tree has them."""
    if paths is None:
        return records.withColumn("path", F.lit(None).cast("binary"))
    p = paths.select(F.col("grp").alias("_g"), F.col("pos").alias("_pos"), "path")
    return records.join(p, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_pos"))).drop("_g", "_pos")


def manifest(docs: DataFrame, now: dict[str, Column] | None = None, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, run: int = RUN, levels: int = BLOCK_LEVELS, top: int = TOP) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``now`` gives columns as they are at the time of the check (null: as before); leaf, subroot, root and
    proof are of ``docs``, the folded root is that of the present row with the original siblings.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    now = now or {}
    before, after = leaf([F.col(c) for c in fields]), leaf([F.coalesce(now[c], F.col(c)) if c in now else F.col(c) for c in fields])
    # Only rows with a changed column have a second digest.
    touched = F.lit(False)
    for c in now.values():
        touched |= c.isNotNull()
    leaves = docs.select(F.col(group_col).cast("string").alias("grp"), F.col(id_col).alias("id"), before.alias("leaf"), F.when(touched, after).alias("changed"))
    leaves = materialize(leaves, folder, "leaves")
    rounds = [materialize(blocks(numbered(leaves, folder, "numbered", ["id", "leaf"], ["grp"]), run, levels), folder, "blocks-0")]
    discard(spark, f"{folder}/leaves", f"{folder}/numbered")

    def nodes() -> DataFrame:
        return rounds[-1].select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / run**levels).alias("n"), F.col("node").alias("leaf"), *[F.lit(None).cast(x).alias(c) for c, x in (("id", "long"), ("changed", "binary"))])

    names, left = None, nodes()
    while left.limit(top + 1).count() > top:
        if names is None and left.filter("n > 1").isEmpty():
            # Every group is its root: from here on there is one tree, over the groups in their order.
            names = materialize(numbered(left.select("grp", "leaf").withColumn("_one", F.lit(1)), folder, "names", ["grp"], ["_one"]), folder, "ranks")
            left, upper = names.select(F.lit(None).cast("string").alias("grp"), "pos", "n", "leaf", *[F.lit(None).cast(x).alias(c) for c, x in (("id", "long"), ("changed", "binary"))]), len(rounds)
            rounds.append(None)
        else:
            rounds.append(materialize(blocks(left, run, levels), folder, f"blocks-{len(rounds)}"))
            left = nodes()
    got = [(r["grp"], r["leaf"]) for r in left.orderBy("grp", "pos").select("grp", "leaf").collect()]
    if not got:
        tree = None
    else:
        tree = UpperTree(got, run)
    held, root = spark.sparkContext.broadcast(tree), tree.root.decode() if tree else None

    def path_of(group, block: int, path: bytes | None) -> list[tuple[bytes, bytes]]:
        return unpack_path(path) if path is not None else held.value.suffix(group, block)

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Paths of the children of blocks."""
        size = run**levels
        for b in batches:
            for r in b.to_pylist():
                rows = climb(r["leaves"].hex().encode(), min(levels, height(r["n"], run)), run)
                above, count = path_of(r["grp"], r["block"], r["path"]), len(r["leaves"]) // 32
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["grp"]] * count, pa.string()), pa.array([r["block"] * size + k for k in range(count)], pa.int64()), pa.array([pack_path(siblings(rows, k, run) + above) for k in range(count)], pa.binary())],
                    ["grp", "pos", "path"],
                )

    paths, past = None, len(rounds)
    for k in reversed(range(1, len(rounds))):
        if rounds[k] is None:
            # From the one tree back to the groups: a path by the group's place.
            if paths is None:
                places = names.select("grp", "pos")
                paths = places.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([b.column(0), pa.array([0] * b.num_rows, pa.int64()), pa.array([pack_path(held.value.suffix(None, p)) for p in b.column(1).to_pylist()], pa.binary())], ["grp", "pos", "path"]) for b in batches), "grp string, pos bigint, path binary")
            else:
                paths = names.select("grp", F.col("pos").alias("_rank")).join(paths.select(F.col("pos").alias("_p"), "path"), F.col("_rank") == F.col("_p")).select("grp", F.lit(0).cast("long").alias("pos"), "path")
        else:
            paths = with_paths(rounds[k].select("grp", "block", "n", "leaves"), paths).mapInArrow(down, "grp string, pos bigint, path binary")
        paths = materialize(paths, folder, f"paths-{k}")

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1)
                group, block, n, raw, at, changed, path = (r.column(c)[0].as_py() for c in ("grp", "block", "n", "leaves", "changed_at", "changed", "path"))
                rows = climb(raw.hex().encode(), min(levels, height(n, run)), run)
                above = path_of(group, block, path)
                subroot = fold(rows[-1], above[: height(n, run) - len(rows) + 1]).decode()
                tail = b"".join(a + c for a, c in above)
                present = {x: changed[32 * j : 32 * j + 32].hex().encode() for j, x in enumerate(at)}
                count, proofs, folded = len(raw) // 32, [], []
                for x in range(count):
                    own = siblings(rows, x, run)
                    proofs.append(digest(b"".join(a + c for a, c in own) + tail).decode())
                    folded.append(fold(fold(present.get(x) or rows[0][64 * x : 64 * x + 64], own), above).decode())
                hexes = rows[0].decode()
                yield pa.RecordBatch.from_arrays(
                    [r.column("ids").flatten(), *(pa.array(c, pa.string()) for c in ([hexes[64 * x : 64 * x + 64] for x in range(count)], [subroot] * count, [root] * count, proofs, folded))],
                    [id_col, "leaf", "subroot", "root", "proof_sha256", "folded_root"],
                )

    done = with_paths(rounds[0].drop("node"), paths).mapInArrow(finish, f"`{id_col}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark, sf_dir: str) -> DataFrame:
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(table(spark, sf_dir, "documents"), {"text": F.when(touched, F.translate("text", UPPER, LOWER))})


ORACLE_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), d AS (
  SELECT *, doc_id::VARCHAR AS id, translate(text, '{UPPER}', '{LOWER}') AS low FROM documents
), c AS (
  SELECT d.*, coalesce(xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(id) + 1), lambda k: ascii(id[k])::BIGINT), lambda a, x: xor(a >> 8, crc.t[(xor(a, x) & 255) + 1])), 4294967295) % 5 = 0, false) AS touched
  FROM d, crc
), e AS (
  SELECT doc_id, source, touched,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(id) || ':' || id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
    || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR END AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS t, CASE WHEN text IS NULL THEN '-' ELSE strlen(low) || ':' || low END AS l
  FROM c
), leaves AS (
  SELECT doc_id, source, leaf, present, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM (SELECT doc_id, source, sha256(head || t) AS leaf, CASE WHEN touched THEN sha256(head || l) ELSE sha256(head || t) END AS present FROM e)
), trees AS (
  SELECT source, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM leaves GROUP BY source
  UNION ALL
  SELECT source, level + 1, list_transform(range(0, len(nodes), {RUN}), lambda k: sha256(array_to_string(nodes[k + 1:k + {RUN}], ''))) FROM trees WHERE len(nodes) > 1
), subs AS (
  SELECT source, level AS h, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM trees WHERE len(nodes) = 1
), uppers AS (
  SELECT 0 AS level, (SELECT list(subroot ORDER BY place) FROM subs) AS nodes
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(nodes), {RUN}), lambda k: sha256(array_to_string(nodes[k + 1:k + {RUN}], ''))) FROM uppers WHERE len(nodes) > 1
), steps AS (
  SELECT l.source, l.pos, t.level, (l.pos // ({RUN} ** t.level)::BIGINT) AS i, t.nodes
  FROM leaves l JOIN trees t ON l.source IS NOT DISTINCT FROM t.source WHERE len(t.nodes) > 1
  UNION ALL
  SELECT l.source, l.pos, s.h + u.level, (s.place // ({RUN} ** u.level)::BIGINT), u.nodes
  FROM leaves l JOIN subs s ON l.source IS NOT DISTINCT FROM s.source, uppers u WHERE len(u.nodes) > 1
), sides AS (
  SELECT source, pos, level, array_to_string(nodes[i - i % {RUN} + 1:i], '') AS a, array_to_string(nodes[i + 2:i - i % {RUN} + {RUN}], '') AS b FROM steps
), paths AS (
  SELECT source, pos, list(a ORDER BY level) AS a, list(b ORDER BY level) AS b, sha256(string_agg(a || b, '' ORDER BY level)) AS proof FROM sides GROUP BY source, pos
), folds AS (
  SELECT l.doc_id, l.source, l.pos, l.leaf, l.present AS node, 1 AS k, p.a, p.b, coalesce(p.proof, sha256('')) AS proof FROM leaves l LEFT JOIN paths p ON l.source IS NOT DISTINCT FROM p.source AND l.pos = p.pos
  UNION ALL
  SELECT doc_id, source, pos, leaf, sha256(a[k] || node || b[k]), k + 1, a, b, proof FROM folds WHERE k <= len(a)
)
SELECT f.doc_id, f.leaf, s.subroot, r.root, f.proof AS proof_sha256, f.node AS folded_root, f.node = r.root AS verified
FROM folds f JOIN subs s ON f.source IS NOT DISTINCT FROM s.source, (SELECT nodes[1] AS root FROM uppers WHERE len(nodes) = 1) r
WHERE f.k > coalesce(len(f.a), 0)
"""
