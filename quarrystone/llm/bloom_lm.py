"""Language-model scores by a log-frequency Bloom filter.

1. Tasks read their documents once and write blocks of about ``BLOCK_TOKENS`` tokens: the block's distinct
   tokens and, for every place, the number of its token.  All that follows works on blocks.
2. Counts of one and two tokens in the training documents are summed in each block, dealt to ranges of
   their 48-bit hashes and merged there as they come, so that a range holds its distinct n-grams alone.
3. Counts are quantised: level j holds the counts from ``threshold(j)`` on, each up to five by itself and
   above that in steps of a quarter.  An n-gram of level j is put into a Bloom filter once for
   each level up to j.  Each range fills its own part of the filter, as the hash's first bits choose the line.
   The filter has at most ``FILTER_BITS`` bits, which bounds what is collected and broadcast: its
   lowest level is the first one from which all entries of all n-grams, by the histogram of their levels, fit
   at ``ENTRY_BITS`` bits each; n-grams below that level count as unseen.  The rule is the same at every size.
4. The filter is broadcast.  A count is read by probing levels upwards until one is missing; each block asks
   for its tokens and pairs.  With c the count so read, N the training tokens, V the distinct ones
   and K = ``PRIOR``: p(w) = (c(w) + 1) / (N + V + 1), p(w after v) = (min(c(vw), c(v)) + K p(w)) / (c(v) + K).
   A false positive (some per cent of unseen n-grams) counts as one level too many.
5. Exact counts of single tokens, for the base columns, are sums over the blocks that hold a token: each block sends each of
   its tokens once, whatever the number of documents, and gets the sum back.

A text is its tokens and one end token, which also stands before the first.

Defined results: null and empty texts have the end token alone; a null id is not held out; repeated rows
count and are scored as often as they occur; without training documents N and V are 0 and all counts
unseen; an empty table gives an empty result; texts and tokens may be of any length, as a block is not
cut within a text; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import coded_words, discard, map_arrow, materialize, shared_dir, table

BLOCK_TOKENS = 1 << 20
FILTER_BITS, ENTRY_BITS = 1 << 29, 8
#: Bits set by an entry, all in one word of 64 bits; words of a line of 512 bits.
SET_BITS, LINE_BITS = 4, 512
PRIOR = 300.0
#: Bits of an n-gram's hash, and those of them that a range's rows carry; ranges by the bits before, 2^8 to 2^16.
HASH_BITS, ROW_BITS = 48, 40
#: Entries that wait in a range until they are merged.
WAITING = 1 << 21
#: Places of a block that are scored at once.
AT_ONCE = 1 << 17
END = b" "
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def thresholds() -> np.ndarray:
    """Least counts of the levels from 1 on."""
    out = [1]
    while out[-1] < 1 << 60:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return np.array(out, np.int64)


LEVELS = thresholds()
#: The count that a level stands for: the middle of its counts; level 0 is unseen.
MIDDLE = np.concatenate([[0.0], (LEVELS + np.append(LEVELS[1:], 2 * LEVELS[-1]) - 1) / 2])


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, counts, "right")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    x = (x ^ (x >> np.uint64(29))) * MIX2
    return x ^ (x >> np.uint64(32))


def token_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def ones(h: np.ndarray) -> np.ndarray:
    """Hashes of single tokens, as n-grams."""
    return mixed(h) >> np.uint64(64 - HASH_BITS)


def twos(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * MIX2 + second + np.uint64(1)) >> np.uint64(64 - HASH_BITS)


def places(grams: np.ndarray, at: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Word of the filter and bits in it, of n-grams at a level."""
    lines = bits // LINE_BITS
    x = mixed(grams + np.uint64(at * int(MIX) % 2**64))
    word = (grams >> np.uint64(HASH_BITS - (lines.bit_length() - 1))) * np.uint64(LINE_BITS // 64) + (x & np.uint64(LINE_BITS // 64 - 1))
    mask = np.zeros(len(grams), np.uint64)
    for k in range(SET_BITS):
        mask |= np.uint64(1) << (x >> np.uint64(8 + 6 * k) & np.uint64(63))
    return word.astype(np.int64), mask


def read_levels(words: np.ndarray, least: int, grams: np.ndarray) -> np.ndarray:
    """Levels of n-grams by repeated probes, upwards from the filter's lowest level; 0: not held."""
    out, left, at = np.zeros(len(grams), np.int64), np.arange(len(grams)), least
    while len(left) and at <= len(LEVELS):
        word, mask = places(grams[left], at, 64 * len(words))
        left = left[words[word] & mask == mask]
        out[left] = at
        at += 1
    return out


def zipped(x: np.ndarray) -> bytes:
    """Numbers below 2^31 by planes of their bytes, compressed."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def unzipped(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int32)
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def counted(x: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and how often each occurs, or the sums of ``n``."""
    if n is None:
        return np.unique(x, return_counts=True)
    order = np.argsort(x, kind="stable")
    x, n = x[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[first], np.add.reduceat(n, first) if len(x) else n


def in_blocks(docs: DataFrame, block_tokens: int) -> DataFrame:
    """Blocks of the documents (id, held_out, text as binary)."""
    kind = docs.schema["id"].dataType.simpleString()

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {END: 0}
        ids, held, sizes, at, count = [], [], [], [], 0
        part, done = TaskContext.get().partitionId() << 32, 0

        def block() -> pa.RecordBatch:
            lens, numbers, out = np.concatenate(sizes), np.concatenate(at), np.concatenate(held)
            # Frequent tokens get small numbers, which take less room.
            order = np.argsort(-np.bincount(numbers, minlength=len(number)), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            numbers = place[numbers]
            tokens = list(number)
            training = np.bincount(numbers[np.repeat(~out, lens)], minlength=len(order))
            all_ids = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part + done], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(all_ids)], pa.int32()), all_ids),
                    *(pa.array([x], pa.binary()) for x in (np.packbits(out).tobytes(), lens.astype("<i8").tobytes(), zipped(numbers), pa.compress(b"\n".join(tokens[k] for k in order), codec="zstd", asbytes=True))),
                    pa.array([sum(map(len, tokens)) + len(tokens) - 1], pa.int64()),
                    pa.array([training.astype("<i8").tobytes()], pa.binary()),
                    pa.array([len(numbers)], pa.int64()),
                    pa.array([int(lens[~out].sum())], pa.int64()),
                ],
                ["block", "ids", "held", "lens", "places", "tokens", "tokens_size", "training", "n", "n_training"],
            )

        for b in batches:
            texts = [b"" if x is None else x.lower() for x in b.column(2).to_pylist()]
            words, text, of = coded_words(texts)
            numbers = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
            lens = np.bincount(text, minlength=len(texts)) + 1
            whole = np.zeros(int(lens.sum()), np.int64)
            ends = np.zeros(len(whole), bool)
            ends[np.cumsum(lens) - 1] = True
            whole[~ends] = numbers[of]
            ids.append(b.column(0))
            held.append(b.column(1).to_numpy(zero_copy_only=False))
            sizes.append(lens)
            at.append(whole.astype(np.int32))
            count += len(whole)
            if count >= block_tokens:
                yield block()
                number, count, done = {END: 0}, 0, done + 1
                ids, held, sizes, at = [], [], [], []
        if ids:
            yield block()

    return map_arrow(docs, f, f"block long, ids array<{kind}>, held binary, lens binary, places binary, tokens binary, tokens_size long, training binary, n long, n_training long", 1024)


def tokens_of(row: dict) -> list[bytes]:
    return pa.decompress(row["tokens"], decompressed_size=row["tokens_size"], codec="zstd", asbytes=True).split(b"\n")


def pairs_of(row: dict, numbers: np.ndarray, lens: np.ndarray, end: int) -> np.ndarray:
    """Numbers of the tokens before the places: the end token before a text's first."""
    before = np.empty_like(numbers)
    before[1:] = numbers[:-1]
    starts = np.cumsum(lens) - lens
    before[starts] = end
    return before


def pair_counts(numbers: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return counted(before.astype(np.int64) << 32 | numbers)


def gram_counts(blocks: DataFrame, ranges: int) -> DataFrame:
    """(range, grams, counts): the training n-grams of each block, as rows for the ranges that have some."""
    shift = HASH_BITS - (ranges.bit_length() - 1)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                numbers, lens = unzipped(row["places"], row["n"]), np.frombuffer(row["lens"], "<i8")
                out = np.unpackbits(np.frombuffer(row["held"], np.uint8), count=len(lens)).astype(bool)
                tokens = tokens_of(row)
                before = pairs_of(row, numbers, lens, tokens.index(END))
                teach = np.repeat(~out, lens)
                pairs, n = pair_counts(numbers[teach], before[teach])
                h = token_hashes(tokens)
                single = np.frombuffer(row["training"], "<i8")
                grams = np.concatenate([ones(h)[single > 0], twos(h[pairs >> 32], h[pairs & 0xFFFFFFFF])])
                grams, n = counted(grams, np.concatenate([single[single > 0], n]))
                cuts = np.searchsorted(grams, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(shift))
                some = np.flatnonzero(np.diff(cuts))
                rows = np.ascontiguousarray(grams.view(np.uint8).reshape(-1, 8)[:, : ROW_BITS // 8])
                n = n.astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([rows[cuts[r] : cuts[r + 1]].tobytes() for r in some], pa.binary()), pa.array([n[cuts[r] : cuts[r + 1]].tobytes() for r in some], pa.binary())],
                    ["range", "grams", "counts"],
                )

    return map_arrow(blocks.select("block", "held", "lens", "places", "tokens", "tokens_size", "training", "n"), f, "range int, grams binary, counts binary", 1)


def gram_levels(counts: DataFrame) -> DataFrame:
    """(range, grams, levels): distinct n-grams of every range, ascending, with the levels of their counts."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, size = None, [], 0

        def merge() -> None:
            nonlocal waiting, size
            if len(waiting) > 1:
                waiting = [counted(*(np.concatenate(x) for x in zip(*waiting)))]
            size = 0

        def row() -> pa.RecordBatch:
            merge()
            grams, n = waiting[0]
            raw = np.ascontiguousarray(grams.view(np.uint8).reshape(-1, 8)[:, : ROW_BITS // 8])
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([raw.tobytes()], pa.binary()), pa.array([level(n).astype(np.uint8).tobytes()], pa.binary())], ["range", "grams", "levels"])

        for b in batches:
            for r, raw, n in zip(*(c.to_pylist() for c in b.columns)):
                if r != now:
                    if now is not None:
                        yield row()
                    now, waiting, size = r, [], 0
                waiting.append((whole(raw), np.frombuffer(n, "<u4").astype(np.int64)))
                size += len(n) // 4
                if size > WAITING:
                    merge()
        if now is not None:
            yield row()

    return map_arrow(counts.repartition("range").sortWithinPartitions("range"), f, "range int, grams binary, levels binary", 4096)


def whole(raw: bytes) -> np.ndarray:
    """The last 40 bits of n-grams, as numbers."""
    out = np.zeros((len(raw) * 8 // ROW_BITS, 8), np.uint8)
    out[:, : ROW_BITS // 8] = np.frombuffer(raw, np.uint8).reshape(-1, ROW_BITS // 8)
    return out.view("<u8").ravel()


class Filter:
    """Bits, lowest level, training tokens and distinct ones."""

    def __init__(self, words: np.ndarray, least: int, n: int, v: int, prior: float):
        self.words, self.least, self.n, self.v, self.prior = words, least, n, v, prior

    def counts(self, grams: np.ndarray) -> np.ndarray:
        return MIDDLE[read_levels(self.words, self.least, grams)]

    def scores(self, tokens: list[bytes], numbers: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 of the probability of every place."""
        h = token_hashes(tokens)
        c = self.counts(ones(h))
        p = self.prior * (c + 1) / (self.n + self.v + 1)
        out = np.empty(len(numbers))
        # Most pairs of a block occur once there, so places are asked for as they come.
        for k in range(0, len(numbers), AT_ONCE):
            v, w = before[k : k + AT_ONCE], numbers[k : k + AT_ONCE]
            joint = np.minimum(self.counts(twos(h[v], h[w])), c[v])
            out[k : k + AT_ONCE] = np.log10((joint + p[w]) / (c[v] + self.prior))
        return out


def fill(levels: DataFrame, ranges: int, filter_bits: int, entry_bits: int) -> tuple[np.ndarray, int]:
    """The filter's words and its lowest level."""

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(256, np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                n += np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n), pa.int64()), pa.array(n[n > 0], pa.int64())], ["level", "n"])

    n = np.zeros(256, np.int64)
    for r in levels.select("levels").mapInArrow(histogram, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        n[r["level"]] = r["n"]
    # N-grams that reach a level have an entry there; all entries from a level on.
    entries = np.cumsum(np.cumsum(n[::-1]))[::-1]
    least = next((k for k in range(1, 256) if entries[k] * entry_bits <= filter_bits), 255)
    bits = max(ranges * LINE_BITS, 1 << max(0, int(entries[least] * entry_bits - 1).bit_length()))
    per_range, shift = bits // ranges // 64, HASH_BITS - (ranges.bit_length() - 1)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, raw, up_to in zip(*(c.to_pylist() for c in b.columns)):
                words = np.zeros(per_range, np.uint64)
                up_to = np.frombuffer(up_to, np.uint8)
                grams = whole(raw) & np.uint64((1 << shift) - 1) | np.uint64(r << shift)
                for at in range(least, int(up_to.max(initial=0)) + 1):
                    grams, up_to = grams[up_to >= at], up_to[up_to >= at]
                    word, mask = places(grams, at, bits)
                    np.bitwise_or.at(words, word - r * per_range, mask)
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([words.tobytes()], pa.binary())], ["range", "words"])

    words = np.zeros(bits // 64, np.uint64)
    for r in map_arrow(levels, part, "range int, words binary", 64).toLocalIterator():
        words[r["range"] * per_range : (r["range"] + 1) * per_range] = np.frombuffer(bytes(r["words"]), np.uint64)
    return words, least


def exact_counts(blocks: DataFrame) -> DataFrame:
    """(block, at, c, first): for the tokens of each block their count in all training documents; one row of each token is its first."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                tokens, n = tokens_of(row), np.frombuffer(row["training"], "<i8")
                for k in range(0, len(tokens), 1 << 16):
                    part = tokens[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([row["block"]] * len(part), pa.int64()), pa.array(np.arange(k, k + len(part)), pa.int32()), pa.array(n[k : k + len(part)], pa.int64())], ["token", "block", "at", "n"])

    asked = map_arrow(blocks.select("block", "tokens", "tokens_size", "training"), f, "token binary, block long, at int, n long", 1)
    same = Window.partitionBy("token").orderBy("block")
    every = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return asked.select("block", "at", F.sum("n").over(every).alias("c"), (F.row_number().over(same) == 1).alias("first"))


def answered(counts: DataFrame) -> DataFrame:
    """(block, c): the counts of a block's tokens, packed."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            block, c = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if block[lo] != now and parts:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([b"".join(parts)], pa.binary())], ["block", "c"])
                    parts = []
                now = int(block[lo])
                parts.append(c[lo:hi].astype("<i8").tobytes())
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([b"".join(parts)], pa.binary())], ["block", "c"])

    return counts.select("block", "at", "c").repartition("block").sortWithinPartitions("block", "at").select("block", "c").mapInArrow(f, "block long, c binary")


def bloom_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, filter_bits: int = FILTER_BITS, entry_bits: int = ENTRY_BITS, prior: float = PRIOR) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document; those that are not held out teach."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").cast("binary").alias("text"))
    blocks = materialize(in_blocks(d, block_tokens), folder, "blocks")
    sums = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_training"), F.lit(0)).alias("t")).first()
    ranges = 1 << min(16, max(8, sums["n"].bit_length() - 20))
    levels = materialize(gram_levels(gram_counts(blocks, ranges)), folder, "levels")
    words, least = fill(levels, ranges, filter_bits, entry_bits)
    discard(spark, f"{folder}/levels")
    counts = materialize(exact_counts(blocks), folder, "counts")
    distinct = counts.filter("first AND c > 0").count()
    held = spark.sparkContext.broadcast(Filter(words, least, sums["t"], distinct, prior))
    answers = answered(counts)
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                ids = row.column("ids").flatten()
                c = np.frombuffer(row.column("c")[0].as_py(), "<i8")
                r = {x: row.column(x)[0].as_py() for x in ("held", "lens", "places", "tokens", "tokens_size", "n")}
                numbers, lens = unzipped(r["places"], r["n"]), np.frombuffer(r["lens"], "<i8")
                out = np.unpackbits(np.frombuffer(r["held"], np.uint8), count=len(lens)).astype(bool)
                tokens = tokens_of(r)
                before = pairs_of(r, numbers, lens, tokens.index(END))
                starts = np.cumsum(lens) - lens
                base = np.add.reduceat(np.log10(c + 1.0)[numbers], starts) - lens * np.log10(model.n + model.v + 1.0)
                score = np.add.reduceat(model.scores(tokens, numbers, before), starts)
                known = np.add.reduceat((c > 0)[numbers].astype(np.int64), starts)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(out), pa.array(lens, pa.int64()), pa.array(known, pa.int64()), pa.array([model.n] * len(lens), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())],
                    [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    ready = blocks.select("block", "ids", "held", "lens", "places", "tokens", "tokens_size", "n").join(answers, "block")
    return map_arrow(ready, f, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", 1)


def query(spark, sf_dir: str) -> DataFrame:
    return bloom_scores(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
