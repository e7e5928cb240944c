"""N-gram Jaccard join by PartEnum signatures.

Documents are sets of distinct word shingles (``shingles``); two are linked when 100 times the
size of the intersection reaches 80 times that of the union.  The steps:

1. Sets, sizes and 128-bit fingerprints per document; equal sets form a class, whose smallest id
   stands for it.  Of equal sets in one task only the first goes on.
2. Signatures of the sets: enumerated subsets of partitions of the shingles' domain, by size band.
   A task takes blocks of ``HELD`` signatures, sorted, and sends each distinct one of a block once, with
   its first document and how many there are, packed, in a row for each of ``parts`` ranges.
   A signature of a passage that all documents share is so many rows as there are blocks.
3. Ranges answer the blocks which signatures several documents hold: how many, and the first of all.
   Each range is one task's, dealt by number.
4. Blocks, which know all signatures of their documents, leave out the most frequent: a similar pair
   shares not one signature but ``need`` of a tag, so each document leaves out ``need - 1``; signatures of
   passages that many documents share go first.  The others are edges to the first holder.
5. Families: components of those edges.  A family's documents are dealt to blocks of about ``BLOCK``, and
   each pair of blocks meets in one task, which tests sizes and counts by bins for all its pairs, and
   the sets of those that pass.  Each pair that could be similar is thus tested: components and numbers
   of links are exact.  A task returns a forest of its links and the sum of each document's, copies
   counted, not the links.

Sets of candidates are made again from the texts; a bitmap of fixed size (``BITMAP`` bits) names
them, so that other texts are skipped.

Defined results: a null or empty text has no shingles and its own id as component; rows with a null
id get a null component and take part in no link; rows with one id are one node; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, discard, map_arrow, materialize, shared_dir, table
from .components import components
from .shingles import DENOMINATOR, HASHES, NUMERATOR, fingerprint, shingle_set, signatures, similar

#: Signatures of a range, on average; the number of ranges follows from the corpus.
RANGE = 1 << 20
#: Signatures of a block: what a task holds before it sends to each range.
HELD = 1 << 20
#: Documents of a block of a family, on average.
BLOCK = 1024
#: Bins whose counts bound how much two sets differ.
BINS = 256
#: Bits of the bitmap that names candidates (2 MB).
BITMAP = 1 << 24


def pack(x: np.ndarray) -> bytes:
    """Bytes of 64-bit numbers plane by plane, which compresses well for small differences."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).reshape(-1).view("<u8")


def describe(docs: DataFrame) -> DataFrame:
    """Size and fingerprint of every document's set, and how many of its elements fall in each of ``BINS``."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(HASHES)
        for b in batches:
            sets = [shingle_set(t) for t in b.column(1).to_pylist()]
            prints = np.frombuffer(b"".join(fingerprint(s) for s in sets), "<i8").reshape(-1, 2)
            counts = [np.minimum(np.bincount((s >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(counts, pa.binary())], ["doc_id", "n_shingles", "p1", "p2", "bins"])

    return map_arrow(docs, f, "doc_id long, n_shingles long, p1 long, p2 long, bins binary", 512)


def dealt(parts: int) -> np.ndarray:
    """For each of ``parts`` tasks an integer that hash partitioning by an int column sends to it.

    Spark's hash of an int is Murmur3 with seed 42.
    """
    with np.errstate(over="ignore"):
        keys = np.arange(parts * 32, dtype=np.uint32)
        turn = lambda x, n: (x << np.uint32(n)) | (x >> np.uint32(32 - n))
        h = turn(keys * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593) ^ np.uint32(42)
        h = turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
    task, first = np.unique(h.view(np.int32).astype(np.int64) % parts, return_index=True)
    out = np.arange(parts, dtype=np.int32)
    out[task] = keys[first]
    return out


def blocks(docs: DataFrame, parts: int) -> DataFrame:
    """Packed rows of blocks.

    A row for a range has the block's distinct signatures there, their first documents and how many
    each has.  Rows without signatures are the block's own: ``nodes`` has (signature, document) of
    those that several of its documents hold, ``needs`` has (document, tag, need).
    """
    keys = dealt(parts)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        found: list[np.ndarray] = []
        owners: list[int] = []
        needs: list[tuple[int, int, int]] = []
        held, block = 0, TaskContext.get().partitionId() << 32
        claim(HASHES)

        def flush() -> pa.RecordBatch:
            sigs = np.concatenate(found)
            nodes = np.repeat(np.array(owners, np.int64), [len(x) for x in found])
            order = np.lexsort((nodes, sigs))
            sigs, nodes = sigs[order], nodes[order]
            first = _starts(sigs)
            size = np.diff(np.append(first, len(sigs)))
            many = np.repeat(size > 1, size)
            own = (pack(sigs[many]), pack(nodes[many].view(np.uint64)), np.array(needs, np.int64).reshape(-1, 3).tobytes())
            sigs, nodes = sigs[first], nodes[first].view(np.uint64)
            part = ((sigs >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            cuts = np.concatenate([_starts(part), [len(part)]])
            rows = [(int(keys[int(part[a])]), block, pack(np.diff(sigs[a:b], prepend=np.uint64(0))), pack(nodes[a:b]), pack(size[a:b].astype(np.uint64)), None) for a, b in zip(cuts[:-1], cuts[1:])]
            rows.append((int(keys[block % parts]), block, None, own[0], own[1], own[2]))
            found.clear()
            owners.clear()
            needs.clear()
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["part", "block", "sigs", "nodes", "sizes", "needs"])

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = shingle_set(text)
                if not len(s) or (p := fingerprint(s)) in seen:
                    continue
                seen.add(p)
                sigs, need = signatures(s)
                found.append(sigs)
                owners.append(key)
                needs += [(key, tag, n) for tag, n in need]
                held += len(sigs)
                if held >= HELD:
                    yield flush()
                    held, block = 0, block + 1
        if found:
            yield flush()

    return map_arrow(docs, f, "part int, block long, sigs binary, nodes binary, sizes binary, needs binary")


def _starts(x: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def shared(sent: DataFrame, parts: int) -> DataFrame:
    """What ranges answer: of each block's signatures those that several documents hold, with the
    block's first document and size, how many hold it in all, and the first document of all."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["block", "sigs", "nodes", "sizes", "needs", "totals", "firsts"], [pa.int64()] + [pa.binary()] * 6
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        number, parted = [], [[], [], []]
        for b in batches:
            for block, sigs, nodes, sizes, needs in zip(*(b.column(k).to_pylist() for k in range(1, 6))):
                if sigs is None:
                    yield batch([(block, None, nodes, sizes, needs, None, None)])
                    continue
                number.append(block)
                for held, x in zip(parted, (np.cumsum(unpack(sigs)), unpack(nodes), unpack(sizes))):
                    held.append(x)
        if not number:
            return
        of = np.repeat(np.arange(len(number)), [len(x) for x in parted[0]])
        sig, node, size = (np.concatenate(x) for x in parted)
        parted.clear()
        order = np.lexsort((node.view(np.int64), sig))
        sig, node, size, of = sig[order], node[order], size[order], of[order]
        first = _starts(sig)
        count = np.diff(np.append(first, len(sig)))
        total = np.repeat(np.add.reduceat(size, first), count)
        root = np.repeat(node[first], count)
        many = np.flatnonzero(total > 1)
        many = many[np.argsort(of[many], kind="stable")]
        sig, node, size, total, root, of = (x[many] for x in (sig, node, size, total, root, of))
        cuts = np.concatenate([_starts(of), [len(of)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch([(number[of[a]], pack(np.diff(sig[a:b], prepend=np.uint64(0))), pack(node[a:b]), pack(size[a:b]), None, pack(total[a:b]), pack(root[a:b]))])

    return sent.repartition(parts, "part").mapInArrow(f, "block long, sigs binary, nodes binary, sizes binary, needs binary, totals binary, firsts binary")


def edges(answers: DataFrame, parts: int) -> DataFrame:
    """(a, b): the documents of each block with the first holders of the signatures that they keep."""

    def settle(rows: list[tuple]) -> np.ndarray:
        own = next(r for r in rows if r[1] is None)
        rows = [r for r in rows if r[1] is not None]
        if not rows:
            return np.zeros((0, 2), np.int64)
        needs = np.frombuffer(own[4], np.int64).reshape(-1, 3)
        sig, node, size, total, root = (np.concatenate([g(r) for r in rows]) for g in (lambda r: np.cumsum(unpack(r[1])), lambda r: unpack(r[2]), lambda r: unpack(r[3]), lambda r: unpack(r[5]), lambda r: unpack(r[6])))
        # Signatures that several documents of the block hold stand for all of those.
        group, members = unpack(own[2]), unpack(own[3])
        order = np.argsort(sig)
        at = order[np.searchsorted(sig, group, sorter=order)] if len(group) else np.zeros(0, np.int64)
        one = size == 1
        sig, node, total, root = (np.concatenate([x[one], y]) for x, y in ((sig, group), (node, members), (total, total[at]), (root, root[at])))
        sig, node, total, root = sig.view(np.int64), node.view(np.int64), total.view(np.int64), root.view(np.int64)
        tag = (sig & 255) >> 1
        # By document and tag, the most frequent first; one order of signatures for all documents.
        order = np.lexsort((sig, -total, tag, node))
        node, tag, root = node[order], tag[order], root[order]
        ids = np.unique(needs[:, 0])
        key = np.searchsorted(ids, node) * 256 + tag
        first = _starts(key)
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        # An id that has several texts keeps what the one with the least need keeps.
        known = np.searchsorted(ids, needs[:, 0]) * 256 + needs[:, 1]
        by = np.lexsort((needs[:, 2], known))
        least = by[_starts(known[by])]
        keep = rank >= needs[least, 2][np.searchsorted(known[least], key)] - 1
        keep &= node != root
        return np.unique(np.stack([node[keep], root[keep]], 1), axis=0)

    def batch(found: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if held and r[0] != held[0][0]:
                    yield batch(settle(held))
                    held = []
                held.append(r)
        if held:
            yield batch(settle(held))

    return map_arrow(answers.repartition(parts, "block").sortWithinPartitions("block"), f, "a long, b long")


def bitmap(nodes: DataFrame) -> np.ndarray:
    """``BITMAP`` bits, as 64-bit words; at most BITMAP / 64 rows reach the driver."""
    at = F.col("node").bitwiseXOR(F.shiftright("node", 24)).bitwiseAND(F.lit(BITMAP - 1))
    rows = nodes.withColumn("_at", at).select(F.shiftright("_at", 6).alias("w"), F.expr("shiftleft(1L, cast(_at & 63 as int))").alias("m"))
    got = rows.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    words = np.zeros(BITMAP // 64, np.int64)
    words[got.column("w").to_numpy()] = got.column("m").to_numpy()
    return words


def sets_of(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """(node, s, p1, p2): sets and fingerprints of the documents that the bitmap names."""
    held = docs.sparkSession.sparkContext.broadcast(words)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(HASHES)
        bits = held.value
        for b in batches:
            node = b.column(0).to_numpy()
            at = (node ^ (node >> 24)) & (BITMAP - 1)
            b = b.filter(pa.array((bits[at >> 6] >> (at & 63)) & 1 == 1))
            if b.num_rows:
                sets = [shingle_set(t) for t in b.column(1).to_pylist()]
                prints = np.frombuffer(b"".join(fingerprint(s) for s in sets), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(prints[:, 0]), pa.array(prints[:, 1])], ["node", "s", "p1", "p2"])

    return map_arrow(docs, f, "node long, s binary, p1 long, p2 long", 512)


def block_pairs(members: DataFrame, count: bool = True) -> DataFrame:
    """Verified links of families: ``members`` has family, node, n, bins, s, p1, p2 and copies.

    Rows with b are a forest (a, b) of the links.  The others have in ``links`` how many documents of
    other sets in a pair of blocks are similar to the set (p1, p2) of a; without ``count`` there are
    none, and pairs that are joined already are not verified.  Each pair of a family's blocks is one
    group of rows; groups stream through the task one by one.
    """
    size = members.groupBy("family").agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") > BLOCK)
    d = members.join(size, "family", "left").withColumn("_k", F.ceil(F.coalesce("_m", F.lit(1)) / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("_k")).cast("int")
    d = d.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    d = d.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "bins", "s", "p1", "p2", "copies")

    def links(rows: list[tuple]) -> list[tuple]:
        i, j = rows[0][1], rows[0][2]
        left = [r for r in rows if r[3] == i]
        right = left if i == j else [r for r in rows if r[3] == j]
        if not left or not right:
            return []
        sets = [np.frombuffer(r[7], np.uint64) for r in right]
        bins = np.frombuffer(b"".join(r[6] for r in right), np.uint8).reshape(-1, BINS).astype(np.int16)
        n = np.array([r[5] for r in right])
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.get(x, x) != x:
                x = up[x]
            return x

        out: list[tuple] = []
        found: dict[tuple[int, int, int], int] = {}
        for k, r in enumerate(left):
            x, mine = np.frombuffer(r[6], np.uint8).astype(np.int16), np.frombuffer(r[7], np.uint64)
            first = k + 1 if left is right else 0
            # Similar sets of m and n elements differ in (m + n) / 9 at most, and in no fewer than their bins do.
            differ = np.abs(bins[first:] - x).sum(1, dtype=np.int64)
            ok = (differ * (NUMERATOR + DENOMINATOR) <= (r[5] + n[first:]) * (DENOMINATOR - NUMERATOR)) & (DENOMINATOR * np.minimum(r[5], n[first:]) >= NUMERATOR * np.maximum(r[5], n[first:]))
            for m in (np.flatnonzero(ok) + first).tolist():
                o = right[m]
                if not count and root(r[4]) == root(o[4]) or not similar(mine, sets[m]):
                    continue
                for one, other in ((r, o), (o, r)) if count else ():
                    key = (one[4], one[8], one[9])
                    found[key] = found.get(key, 0) + other[10]
                if (ra := root(r[4])) != (rb := root(o[4])):
                    up[max(ra, rb)] = min(ra, rb)
                    out.append((r[4], o[4], None, None, None))
        return out + [(a, None, p1, p2, n) for (a, p1, p2), n in found.items()]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(5)], ["a", "b", "p1", "p2", "links"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if held and r[:3] != held[0][:3]:
                    out += links(held)
                    held = []
                held.append(r)
            yield batch(out)
        yield batch(links(held) if held else [])

    return map_arrow(d.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "node"), f, "a long, b long, p1 long, p2 long, links long", 1024)


def similarity_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_range: int = RANGE, count: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id and, with ``count``, n_links of every row.

    ``n_links`` is the number of other rows with an id and a similar text, copies of its own included.

    ``per_range`` is what one task takes of the signatures; a task needs about 100 bytes for each,
    so executors with more memory can have fewer, larger ranges.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = d.filter("doc_id is not null")
    described = materialize(describe(d), folder, "described")
    classes = described.filter("doc_id is not null and n_shingles > 0").groupBy("p1", "p2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("bins").alias("bins"))
    classes = materialize(classes, folder, "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // per_range + 1)
    # Document to class, for the documents that may stand in a run.
    member = described.filter("doc_id is not null and n_shingles > 0").select("doc_id", "p1", "p2").join(classes.select("p1", "p2", "rep"), ["p1", "p2"]).select(F.col("doc_id").alias("node"), "rep")
    member = materialize(member, folder, "member")

    rep = member.distinct()
    near = edges(shared(blocks(known, parts), parts), parts).distinct()
    for k in ("a", "b"):
        near = near.join(rep.select(F.col("node").alias(k), F.col("rep").alias(f"r{k}")), k)
    families = components(near.select(F.col("ra").alias("a"), F.col("rb").alias("b")), folder, "families")

    words = bitmap(families.select("node"))
    sets = sets_of(known, words)
    # An id that repeats may stand for several classes: fingerprints tell their sets apart.
    sizes = classes.select(F.col("rep").alias("node"), "n", "bins", "p1", "p2", "copies")
    full = families.select("node", F.col("label").alias("family")).join(sets, "node").join(sizes, ["node", "p1", "p2"])
    verified = block_pairs(full.dropDuplicates(["node", "p1", "p2"]).select("family", "node", "n", "bins", "s", "p1", "p2", "copies"), count)
    if count:
        verified = materialize(verified, folder, "links")
    links = verified.filter("b is not null").select("a", "b")
    linked = verified.filter("b is null").groupBy(F.col("p1").alias("_l1"), F.col("p2").alias("_l2")).agg(F.sum("links").alias("links"))
    same_id = member.groupBy("node").agg(F.min("rep").alias("b"), F.max("rep").alias("a")).filter("a <> b").select("node")
    same_id = rep.join(same_id, "node").withColumn("b", F.min("rep").over(Window.partitionBy("node"))).select(F.col("rep").alias("a"), "b")
    links = links.unionByName(same_id)
    labels = components(links, folder, "labels")
    discard(spark, f"{folder}/member", f"{folder}/families-*")

    class_of = classes.select(F.col("p1").alias("_p1"), F.col("p2").alias("_p2"), "rep", "copies").join(labels, F.col("rep") == F.col("node"), "left")
    if count:
        class_of = class_of.join(linked, (F.col("_p1") == F.col("_l1")) & (F.col("_p2") == F.col("_l2")), "left")
    out = described.join(class_of, (F.col("p1") == F.col("_p1")) & (F.col("p2") == F.col("_p2")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep", "doc_id")).alias("component_id")
    n_links = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).otherwise(0).alias("n_links")
    return out.select("doc_id", "n_shingles", component, *([n_links] if count else []))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without near duplicates: of each component the row with the smallest id stays.

    Of rows that repeat that id the one with the smallest text stays (null last); rows with a null id
    all stay; any other columns stay as they are, whatever their names.
    """
    mark, key = (f"_{uuid.uuid4().hex}" for _ in range(2))
    found = similarity_join(docs, id_col, text_col, count=False)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(key)).distinct()
    several = docs.groupBy(F.col(id_col).cast("long").alias(key)).agg(F.count(F.lit(1)).alias(mark)).filter((F.col(mark) > 1) & F.col(key).isNotNull()).select(key)
    drop = lambda d, keys: d.join(keys, F.col(id_col) == F.col(key), "left_anti")
    if several.isEmpty():
        return drop(docs, gone)
    # Only rows whose id repeats are ranked; all others need no order.
    first = Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_last())
    again = drop(docs.join(several, F.col(id_col) == F.col(key), "left_semi"), gone).withColumn(mark, F.row_number().over(first)).filter(F.col(mark) == 1).drop(mark)
    return drop(docs, gone.union(several).distinct()).unionByName(again)


def query(spark, sf_dir: str) -> DataFrame:
    return similarity_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.c = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, coalesce(l.l, 0) AS n_links
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, count(*) AS l FROM e GROUP BY a) l ON l.a = d.doc_id JOIN (SELECT a, min(c) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""
