"""Order-preserving packing of token ids into sequences by dynamic programming.

Documents keep their order within a partition of the input.  Cuts may stand after a document
(free), after a sentence (``SENTENCE_CUT``) or, where a sentence exceeds a sequence, anywhere
(``HARD_CUT``).  A sequence of n tokens costs the padding up to ``SIZE``, none where n is one of
the powers of two from ``SHORT`` on, plus ``SEQUENCE_COST``.  The least total cost over all choices of cuts is found by

    f(j) = penalty(j) + min over i of f(i) + padding(pos(j) - pos(i)) + SEQUENCE_COST

whose window minimum of f(i) + pos(i) a monotone queue keeps, plus the few i that lie exactly a
power of two before j.  The programme runs over blocks of at least ``BLOCK`` tokens; a block's
unfinished last sequence is carried into the next block, so memory does not grow with the
partition.  No rows are shuffled; sequence ids hold the partition number in their high bits.

Defined results: a null or empty text is one piece with the end id alone; repeated rows are packed
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, strings
from .wordbpe import default_path, encoder

SIZE = 4096
#: Id after each document.
END_ID = 2
#: Shortest power of two that is left without padding on purpose.
SHORT = 512
SENTENCE_CUT, HARD_CUT, SEQUENCE_COST = 6.0, 96.0, 12.0
#: Tokens of a block of the dynamic programme.
BLOCK = 1 << 19


def ends_sentence(token: str) -> bool:
    """Whether a token is the end of a word of full stops, exclamation or question marks, quotes or brackets after them allowed."""
    body = token.removesuffix("</w>")
    return body != token and body[:1] in tuple(".!?") and not body.strip(".!?\"')")


def plan(ends: np.ndarray, stops: np.ndarray, size: int = SIZE, finish: bool = True) -> list[int]:
    """Cut positions (the last is the end, if ``finish``) of the cheapest packing.

    ``ends`` are positions after documents, ascending, the last one the total; ``stops`` positions
    after sentences.  Without ``finish`` the last sequence is left open: the cuts are those of the
    cheapest packing up to the best open place, so that what follows can still be filled.
    """
    total = int(ends[-1])
    stands = np.zeros(total + 1, bool)
    stands[0] = stands[ends] = stands[stops] = True
    pos = np.flatnonzero(stands)
    gaps = np.flatnonzero(np.diff(pos) > size)
    if gaps.size:
        extra = np.concatenate([np.arange(pos[g] + size, pos[g + 1], size) for g in gaps])
        pos = np.union1d(pos, extra)
    penalty = np.full(total + 1, HARD_CUT)
    penalty[stops] = SENTENCE_CUT
    penalty[ends] = 0.0
    penalty = penalty[pos]
    exact: dict[int, list[int]] = {}
    number = np.full(total + 1, -1)
    number[pos] = np.arange(pos.size)
    power = SHORT
    while power < size:
        at = number[np.maximum(pos - power, 0)]
        hit = np.flatnonzero((pos >= power) & (at >= 0))
        for j, i in zip(hit.tolist(), at[hit].tolist()):
            exact.setdefault(j, []).append(i)
        power *= 2
    p, pen = pos.tolist(), penalty.tolist()
    n = len(p)
    best, back = [0.0] * n, [0] * n
    # Candidates in reach, their f(i) + pos(i) ascending: keys, numbers and where the live ones begin.
    keys, numbers, head = [0.0], [0], 0
    for j in range(1, n):
        x = p[j]
        while p[numbers[head]] < x - size:
            head += 1
        i = numbers[head]
        cost = keys[head] + size - x
        if j in exact:
            for k in exact[j]:
                if best[k] < cost:
                    cost, i = best[k], k
        best[j] = cost = cost + pen[j] + SEQUENCE_COST
        back[j] = i
        key = cost + x
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            numbers.pop()
        keys.append(key)
        numbers.append(j)
    j = n - 1
    if not finish:
        # Open end: the cheapest place in reach of the end, as the tokens after it go on in the next block.
        first = next(k for k in range(n) if p[k] > total - size)
        j = min(range(first, n), key=lambda k: (best[k], -k))
    out = []
    while j > 0:
        out.append(p[j])
        j = back[j]
    return out[::-1]


def pack_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """One row per piece of a document in a sequence, with its ids (little-endian unsigned 32-bit)."""
    path = path or default_path()
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        is_stop = np.array([*map(ends_sentence, e.strings), False])
        number = TaskContext.get().partitionId() << 40
        key_type = pa.null()
        tail = np.array([end_id], "<u4").tobytes()
        # Of what is not yet packed: document's id, its ids from `start` on, start, its number of ids.
        open_docs: list[tuple] = []
        held = 0

        def flush(finish: bool) -> pa.RecordBatch:
            nonlocal open_docs, held, number
            lengths = np.array([len(x[1]) // 4 for x in open_docs])
            ends = np.cumsum(lengths)
            ids = np.frombuffer(b"".join(x[1] for x in open_docs), "<u4")
            stops = np.flatnonzero(is_stop[np.minimum(ids, is_stop.size - 1)]) + 1
            cuts = plan(ends, stops, size, finish)
            keys, starts, sizes, parts, totals, sequences, offsets = [], [], [], [], [], [], []
            k, begin, first = 0, 0, 0
            raw = ids.view(np.uint8).data
            bounds = ends.tolist()
            for cut in cuts:
                while begin < cut:
                    stop = min(cut, bounds[k])
                    key, _, start, total = open_docs[k]
                    keys.append(key)
                    starts.append(start + begin - (bounds[k - 1] if k else 0))
                    sizes.append(stop - begin)
                    parts.append(bytes(raw[4 * begin : 4 * stop]))
                    totals.append(total)
                    sequences.append(number)
                    offsets.append(begin - first)
                    begin = stop
                    if stop == bounds[k]:
                        k += 1
                number += 1
                first = cut
            rest = []
            for x in open_docs[k : k + 1]:
                done = begin - (bounds[k - 1] if k else 0)
                rest.append((x[0], x[1][4 * done :], x[2] + done, x[3]))
            open_docs = rest + open_docs[k + 1 :]
            held = int(ends[-1]) - begin
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), *(pa.array(c, pa.int64()) for c in (starts, sizes)), pa.array(parts, pa.binary()), *(pa.array(c, pa.int64()) for c in (totals, sequences, offsets))], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            key_type = b.schema.field(0).type
            texts = strings(b.column(1))
            for key, ids in zip(b.column(0).to_pylist(), e.encode_many(texts)):
                ids += tail
                open_docs.append((key, ids, 0, len(ids) // 4))
                held += len(ids) // 4
                if held >= block:
                    yield flush(False)
        if open_docs:
            yield flush(True)

    return map_arrow(d, f, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long", 256)


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
