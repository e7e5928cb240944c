"""BPE encoding and decoding by tree concatenation.

A text longer than ``LEAF`` characters is cut into leaves at fixed places, whatever stands there,
within words too; the leaves are encoded in parallel, in any task.  Neighbours are then joined
pairwise, as a tree: a window around each join is encoded anew and grows until both sides agree
exactly with it, on a token each: the same id that ends at the same character.  The joined ids are
the left side's up to its token, the window's between, and the right side's from its token on.

That gives the ids of the whole text, because a sequence of tokens is what BPE makes of a stretch if
and only if each two neighbours are what it makes of those two, and every pair of neighbours here
stands in one of the three encodings.  So much for one word of any length; where words begin and end
is known ``MARGIN`` characters behind a cut, as the pre-tokeniser reads left to right and looks no
further ahead than the longest special string, so tokens nearer to a window's or a side's start do
not count.  Windows begin and end where the normal form of either side does not touch the other.
A window that reaches both outer ends is the whole stretch, so the growth always ends.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows each
give their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, strings
from .wordbpe import WordEncoder, default_path, encoder

#: Characters of a leaf; longer texts are encoded in parallel.
LEAF = 65_536
#: First reach of a window on each side of a join, in characters.
REACH = 256
#: Characters behind a cut whose tokens do not count: more than any special string has.
MARGIN = 32


@dataclass
class Piece:
    """The encoding of the stretch [start, end) of a text.

    ``marks`` has for each token twice the character where it ends, plus one if no token after it has a
    part of that character.
    """

    start: int
    end: int
    ids: np.ndarray
    marks: np.ndarray


def encode_piece(e: WordEncoder, text: str, start: int = 0) -> Piece:
    ids, marks = e.marked(text)
    return Piece(start, start + len(text), ids, marks + 2 * start)


def apart(text: str, at: int) -> bool:
    """Whether the normal form of a text is that of its parts before and from ``at`` on."""
    if at <= 0 or at >= len(text) or text[at] < "\u0300":
        return True
    one, two = text[at - 1], text[at]
    form = lambda x: unicodedata.normalize("NFC", x)
    return not unicodedata.combining(two) and not unicodedata.combining(form(two)[0]) and form(one + two) == form(one) + form(two)


def common(one: Piece, other: Piece, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in both of the tokens that end at the same character in [low, high] and have the same id."""
    a0, a1 = np.searchsorted(one.marks, [2 * low, 2 * high + 2])
    b0, b1 = np.searchsorted(other.marks, [2 * low, 2 * high + 2])
    found, a, b = np.intersect1d(one.marks[a0:a1] * (one.marks[a0:a1] & 1), other.marks[b0:b1] * (other.marks[b0:b1] & 1), return_indices=True)
    a, b = a[found > 0] + a0, b[found > 0] + b0
    same = one.ids[a] == other.ids[b]
    return a[same], b[same]


def join(e: WordEncoder, text: str, left: Piece, right: Piece) -> Piece:
    """Encoding of the stretch of both pieces; ``text`` is the whole text."""
    cut, reach = left.end, REACH
    while True:
        a, b = max(left.start, cut - reach), min(right.end, cut + reach)
        while a > left.start and not apart(text, a):
            a -= 1
        while b < right.end and not apart(text, b):
            b += 1
        window = encode_piece(e, text[a:b], a)
        # Tokens of the left side to keep, and the window's place behind the same token; then the right side's.
        keep, first, stop, rest = 0, 0, len(window.ids), len(right.ids)
        agrees = True
        if a > left.start:
            x, w = common(left, window, a + MARGIN, cut)
            agrees = len(x) > 0
            keep, first = (x[-1] + 1, w[-1] + 1) if agrees else (0, 0)
        if agrees and b < right.end:
            w, y = common(window, right, cut + MARGIN, b)
            agrees = len(w) > 0
            stop, rest = (w[0] + 1, y[0] + 1) if agrees else (0, 0)
        if agrees:
            parts = lambda of: np.concatenate([of(left)[:keep], of(window)[first:stop], of(right)[rest:]])
            return Piece(left.start, right.end, parts(lambda p: p.ids), parts(lambda p: p.marks))
        reach *= 2


def join_all(e: WordEncoder, text: str, pieces: list[Piece]) -> Piece:
    """Joins neighbours until one piece is left."""
    while len(pieces) > 1:
        pieces = [join(e, text, *pieces[k : k + 2]) if k + 1 < len(pieces) else pieces[k] for k in range(0, len(pieces), 2)]
    return pieces[0]


def leaves(text: str, leaf: int = LEAF) -> list[tuple[int, int]]:
    """Stretches of about ``leaf`` characters; a cut moves on to where the normal form allows one."""
    out, start = [], 0
    while start < len(text):
        stop = min(start + leaf, len(text))
        while stop < len(text) and not apart(text, stop):
            stop += 1
        out.append((start, stop))
        start = stop
    return out


def tree_encode(e: WordEncoder, text: str, leaf: int = LEAF) -> bytes:
    """The same within one task."""
    if len(text) <= leaf:
        return e.encode(text)
    return join_all(e, text, [encode_piece(e, text[a:b], a) for a, b in leaves(text, leaf)]).ids.tobytes()


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", decode: bool = False, leaf: int = LEAF) -> DataFrame:
    """Ids of every whole text (little-endian unsigned 32-bit), and with ``decode`` the decoded text.

    Short texts are encoded where they were read.  Leaves of long ones are dealt out by row and
    number, encoded, and met again by row; that group holds one text.
    """
    path = path or default_path()
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = f"doc_id {kind}, ids binary" + ", decoded string" * decode

    def rows(key: pa.Array, ids: list[bytes], e: WordEncoder) -> pa.RecordBatch:
        columns = [key, pa.array(ids, pa.binary())] + [pa.array([e.decode(x) for x in ids], pa.string())] * decode
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "ids"] + ["decoded"] * decode)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            yield rows(b.column(0), e.encode_many(strings(b.column(1))), e)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for k, text in enumerate(strings(b.column(1))):
                at = leaves(text, leaf)
                for n in range(0, len(at), 64):
                    some = at[n : n + 64]
                    numbers = [pa.array([row] * len(some), pa.int64()), pa.array(range(n, n + len(some)), pa.int32())]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([k] * len(some))), *numbers, pa.array([text[x:y] for x, y in some], pa.string())], ["doc_id", "row", "n", "leaf"])
                row += 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            found = [e.marked(t) for t in strings(b.column(3))]
            ids, marks = (pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, ids, marks], [*b.schema.names, "ids", "marks"])

    def whole(key, table):
        e, pieces, at = encoder(path), [], 0
        found = sorted(table.select(["n", "leaf", "ids", "marks"]).to_pylist(), key=lambda r: r["n"])
        for r in found:
            pieces.append(Piece(at, at + len(r["leaf"]), np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["marks"], "<i8") + 2 * at))
            at += len(r["leaf"])
        joined = join_all(e, "".join(r["leaf"] for r in found), pieces)
        return pa.Table.from_batches([rows(table.column("doc_id").combine_chunks().slice(0, 1), [joined.ids.tobytes()], e)])

    small = map_arrow(d.filter(F.length("text") <= leaf), short, schema)
    dealt = map_arrow(d.filter(F.length("text") > leaf), cut, f"doc_id {kind}, row long, n int, leaf string", 16).repartition("row", "n")
    coded = map_arrow(dealt, encode, f"doc_id {kind}, row long, n int, leaf string, ids binary, marks binary", 64)
    return small.unionByName(coded.groupBy("row").applyInArrow(whole, schema))


def query(spark, sf_dir: str) -> DataFrame:
    found = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), decode=True)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
