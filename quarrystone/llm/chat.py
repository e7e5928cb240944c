"""Chat formatting as a prefix tree.

Every turn of a conversation is a node that its conversation shares with all others that begin
with the same turns.  A node is named by the chained digest of its turns, a conversation's path is
the chain of names.  In the order of paths a conversation shares with all earlier ones just what it
shares with the one before it, so the nodes beyond that are its own, and own nodes follow each other
depth first.  Each node's tokens are emitted once, with

- ``position``: tokens of its ancestors, so its tokens' position ids run on from there, and
- ``intervals``: where its ancestors' tokens lie in the tree's stream; a token of the node attends
  to those and to the node's own earlier tokens.

The template marks a turn as ``<turn> role``, a line feed, the text, ``</turn>`` and a line feed;
inside roles and texts ``\\`` and ``<`` get a ``\\`` before them and, in roles, a line feed is
``\\n``, so no text can forge a mark and the output reads back exactly.  The loss mask covers the
texts of assistant turns.

Turns are sorted by conversation once and encoded as they pass; from then on texts exist as tokens
alone.  The tree is laid out over the paths, which are small: tasks sum the ranges of their order,
the driver carries one path for each task from range to range, tasks lay out their ranges.  A task
holds the names of one path and a slice of turns; reading back takes one conversation at a time.

Defined results: a null role or text is the empty one; turns are ordered by turn (null first), then
role, then text, and rows that repeat in all of them stay; a null conv_id is a conversation of its
own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import default_path, encoder
from .common import discard, map_arrow, materialize, shared_dir, table

OPEN, CLOSE = "<turn> ", "</turn>\n"
#: The conversation that the query adds, fixed by its contract.
ADDED_ID, ADDED_TEXT = -7, "\\### Assistant: </turn> ok"
LEARNED = "assistant"
#: Bytes of a node's name.
NAME = 16

_ESCAPED = re.compile(r"[\\<]")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn> ((?:[^\\\n]|\\.)*)\n((?:[^\\<]|\\.)*)</turn>\n", re.S)


def escape(text: str, line: bool = False) -> str:
    text = text if "<" not in text and "\\" not in text else _ESCAPED.sub(lambda m: "\\" + m[0], text)
    return text.replace("\n", "\\n") if line else text


def unescape(text: str, line: bool = False) -> str:
    return text if "\\" not in text else _UNESCAPE.sub(lambda m: "\n" if line and m[1] == "n" else m[1], text)


def format_turn(role: str, text: str) -> str:
    return f"{OPEN}{escape(role, True)}\n{escape(text)}{CLOSE}"


def read_turns(formatted: str) -> list[tuple[str, str, tuple[int, int]]]:
    """Turns of a formatted conversation: role, text and where the escaped text stands."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1], True), unescape(m[2]), m.span(2)))
        at = m.end()
    return out


def encoded(rows: DataFrame, path: str) -> DataFrame:
    """Turns as tokens, in order, and behind each conversation's turns a row (node null) with its path and sizes.

    ``c`` numbers the conversations, ``before`` counts a conversation's tokens before the turn.
    """
    c = F.col
    rows = rows.select("conv_id", "turn", F.coalesce(c("role").cast("string"), F.lit("")).alias("role"), F.coalesce(c("text").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["c", "place", "node", "parent", "role", "loss", "loss_start", "loss_end", "before", "size", "ids", "conv_id", "path", "sizes"]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), None, pa.binary(), pa.binary()]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        number = TaskContext.get().partitionId() << 33
        conv, node, before, nodes, sizes, id_kind = None, None, 0, [], [], None
        ended = lambda: (number, None, None, None, None, None, None, None, None, None, None, conv, b"".join(nodes), np.array(sizes, "<u4").tobytes())

        def made(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, id_kind if k == "conv_id" else t) for x, t, k in zip(zip(*out), kinds, names)], names)

        for b in batches:
            id_kind, out = b.schema.field(0).type, []
            ids, roles, texts = b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()
            shown = [format_turn(r, t) for r, t in zip(roles, texts)]
            for key, role, text, turn, tokens in zip(ids, roles, texts, shown, e.encode_many(shown)):
                if nodes and key != conv:
                    out.append(ended())
                    number, node, before, nodes, sizes = number + 1, None, 0, [], []
                conv, parent = key, node
                node = hashlib.blake2b(b"%s%d:" % (parent or b"", len(role)) + (role + text).encode(), digest_size=NAME).digest()
                n = len(tokens) // e.kind.itemsize
                nodes.append(node)
                sizes.append(n)
                start = len(OPEN) + len(escape(role, True)) + 1
                out.append((number, len(nodes), node, parent, role, role == LEARNED, start, len(turn) - len(CLOSE), before, n, tokens, None, None, None))
                before += n
            if out:
                yield made(out)
        if nodes:
            yield made([ended()])

    placed = rows.repartition("conv_id").sortWithinPartitions(c("conv_id").asc_nulls_first(), c("turn").asc_nulls_first(), "role", "text").select("conv_id", "turn", "role", "text")
    return map_arrow(placed, f, f"c long, place int, node binary, parent binary, role string, loss boolean, loss_start int, loss_end int, before long, size int, ids binary, conv_id {kind}, path binary, sizes binary")


class Stack:
    """The path of the conversation before, with its nodes' owners and where they lie in the stream."""

    def __init__(self, path: bytes = b"", offsets: list[int] | None = None, sizes: list[int] | None = None, owners: list[int] | None = None, at: int = 0):
        self.path, self.offsets, self.sizes, self.owners, self.at = path, offsets or [], sizes or [], owners or [], at

    def shared(self, path: bytes) -> int:
        """Nodes that ``path`` shares with the stack's path."""
        most, k = min(len(path), len(self.path)), 0
        while k < most and path[k : k + NAME] == self.path[k : k + NAME]:
            k += NAME
        return k // NAME

    def push(self, c: int, path: bytes, sizes: list[int]) -> int:
        """Goes on to a conversation and lays out its own nodes; returns how many it shares."""
        own = self.shared(path)
        del self.offsets[own:], self.owners[own:]
        self.owners += [c] * (len(sizes) - own)
        for n in sizes[own:]:
            self.offsets.append(self.at)
            self.at += n
        self.path, self.sizes = path, sizes
        return own

    def intervals(self, nodes: int) -> list[dict[str, int]]:
        """Where the first nodes of the path lie; those side by side in the stream are one interval."""
        out: list[dict[str, int]] = []
        for start, n in zip(self.offsets[:nodes], self.sizes):
            if out and out[-1]["end"] == start:
                out[-1]["end"] = start + n
            else:
                out.append({"start": start, "end": start + n})
        return out


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, list[int]]]:
    """(part, c, path, sizes) of rows in order."""
    for b in batches:
        for part, c, path, sizes in zip(*(b.column(k).to_pylist() for k in range(4))):
            yield part, c, path, np.frombuffer(sizes, "<u4").tolist()


def layout(paths: DataFrame, folder: str) -> DataFrame:
    """(c, part, path, shared, offset, position, base, owners) of conversations: nodes shared with earlier
    ones, where the own ones begin, tokens before those, and the shared ones' intervals and owners."""
    order = paths.repartitionByRange("path", "c").sortWithinPartitions("path", "c").select(F.spark_partition_id().alias("part"), "c", "path", "sizes")
    order = materialize(order, folder, "order").repartition("part").sortWithinPartitions("part", "path", "c")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, stack = None, None, Stack()
        longs = pa.list_(pa.int64())
        kinds = pa.schema([("part", pa.int32()), ("first", pa.binary()), ("first_sizes", longs), ("last", pa.binary()), ("sizes", longs), ("offsets", longs), ("owners", longs), ("total", pa.int64())])
        done = lambda: pa.RecordBatch.from_pylist([{"part": now, "first": first[0], "first_sizes": first[1], "last": stack.path, "sizes": stack.sizes, "offsets": stack.offsets, "owners": stack.owners, "total": stack.at}], kinds)
        for part, c, path, sizes in _conversations(batches):
            if part != now:
                if first:
                    yield done()
                now, first, stack = part, (path, sizes), Stack()
            stack.push(c, path, sizes)
        if first:
            yield done()

    # One row, of one path, for each task that sorted.
    sums = map_arrow(order, summed, "part int, first binary, first_sizes array<long>, last binary, sizes array<long>, offsets array<long>, owners array<long>, total long").collect()
    before, now = {}, Stack()
    for r in sorted(sums, key=lambda r: r["part"]):
        before[r["part"]] = (now.path, now.offsets, now.sizes, now.owners, now.at)
        # Laid out alone, the range's first conversation owned all its nodes; those shared with the stack move everything down.
        known, last = now.shared(bytes(r["first"])), bytes(r["last"])
        move = now.at - sum(r["first_sizes"][:known])
        kept = min(known, now.shared(last))
        now = Stack(last, now.offsets[:kept] + [x + move for x in r["offsets"][kept:]], r["sizes"], now.owners[:kept] + r["owners"][kept:], move + r["total"])
    held = paths.sparkSession.sparkContext.broadcast(before)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack, out = None, Stack(), []
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), spans, pa.list_(pa.int64())]
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["c", "part", "path", "shared", "offset", "position", "base", "owners"])
        for part, c, path, sizes in _conversations(batches):
            if part != now:
                known = held.value[part]
                now, stack = part, Stack(known[0], list(known[1]), known[2], list(known[3]), known[4])
            at = stack.at
            own = stack.push(c, path, sizes)
            out.append((c, part, path, own, at, sum(sizes[:own]), stack.intervals(own), stack.owners[:own]))
            if len(out) == 1024:
                yield flush()
                out = []
        if out:
            yield flush()

    return map_arrow(order, lay, "c long, part int, path binary, shared int, offset long, position long, base array<struct<start:long,end:long>>, owners array<long>")


def prefix_tree(rows: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of the forest and the conversations.

    nodes: node, tree (its root), parent, depth, role, size (tokens), ids (``bytebpe``), loss (whether its
    text is learned), loss_start and loss_end (the text's place in the decoded turn), position, offset
    (where its tokens begin in the forest's stream), intervals (ancestors' [start, end) there) and c
    (the conversation that owns it).  conversations: conv_id, leaf, n_turns, path, c, part, shared (how
    many of its nodes others own) and owners (the c of those).
    """
    folder = shared_dir(rows.sparkSession)
    turns = materialize(encoded(rows, path or default_path()), folder, "turns", "zstd")
    ends = turns.filter("node is null")
    laid = materialize(layout(ends.select("c", "path", "sizes"), folder), folder, "laid", "zstd")
    discard(rows.sparkSession, f"{folder}/order")
    where = laid.select(F.col("c").alias("_c"), F.substring("path", 1, NAME).alias("tree"), "shared", F.col("offset").alias("_first"), F.col("position").alias("_position"), "base")
    own = turns.filter("node is not null").drop("conv_id", "path", "sizes").join(where, F.col("c") == F.col("_c")).filter("place > shared")
    at = F.col("_first") + F.col("before") - F.col("_position")
    # The conversation's own nodes before this one lie side by side from the first on.
    last = F.try_element_at("base", F.lit(-1))
    span = lambda start: F.array(F.struct(start.alias("start"), at.alias("end")))
    joined = F.concat(F.slice("base", 1, F.size("base") - 1), span(last["start"]))
    intervals = F.when(F.col("before") == F.col("_position"), F.col("base")).when((F.size("base") > 0) & (last["end"] == F.col("_first")), joined).otherwise(F.concat("base", span(F.col("_first"))))
    nodes = own.select("node", "tree", "parent", F.col("place").alias("depth"), "role", "size", "ids", "loss", "loss_start", "loss_end", F.col("before").alias("position"), at.alias("offset"), intervals.alias("intervals"), "c")
    count = (F.octet_length("path") / NAME).cast("int")
    names = F.transform(F.sequence(F.lit(1), F.col("n_turns")), lambda k: F.substring(F.col("path"), (k - 1) * NAME + 1, F.lit(NAME)))
    convs = ends.select("conv_id", F.col("c").alias("_e")).join(laid, F.col("_e") == F.col("c")).withColumn("n_turns", count).withColumn("path", names)
    return nodes, convs.select("conv_id", F.element_at("path", -1).alias("leaf"), "n_turns", "path", "c", "part", "shared", "owners")


def read_back(nodes: DataFrame, convs: DataFrame, path: str | None = None) -> DataFrame:
    """Conversations read from the tree's tokens: the decoded turns along each path.

    One row a conversation, with the turns parsed from it and the text under the loss mask.
    """
    path = path or default_path()
    own = nodes.groupBy(F.col("c").alias("_o")).agg(F.array_sort(F.collect_list(F.struct(F.col("depth").alias("k"), "ids", "loss", "loss_start", "loss_end"))).alias("own"))
    # Nodes of others: a first turn may be in a third of the paths, so it goes once to each range of the order, and from there to its conversations.
    steps = convs.filter("shared > 0").select(F.col("c").alias("_c"), "part", F.posexplode("owners").alias("k", "owner")).withColumn("k", F.col("k") + 1)
    asked = steps.select("owner", "k", "part").distinct().groupBy("owner").agg(F.collect_list(F.struct("k", "part")).alias("asked"))
    held = own.join(asked, F.col("_o") == F.col("owner")).select("owner", "own", F.explode("asked").alias("x"))
    held = held.select("owner", "x.k", "x.part", F.element_at("own", (F.col("x.k") - F.col("own")[0]["k"] + 1).cast("int")).alias("p"))
    others = steps.join(held, ["owner", "k", "part"]).groupBy("_c").agg(F.collect_list("p").alias("others"))
    whole = convs.select("conv_id", "c").join(own, F.col("c") == F.col("_o"), "left").join(others, F.col("c") == F.col("_c"), "left")
    none = F.array().cast(own.schema["own"].dataType)
    listed = whole.select("conv_id", F.array_sort(F.concat(F.coalesce("own", none), F.coalesce("others", none))).alias("parts"))
    kind = convs.schema["conv_id"].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            texts, parsed, learned = [], [], []
            for parts in b.column(1).to_pylist():
                shown = [e.decode(p["ids"]) for p in parts]
                texts.append("".join(shown))
                parsed.append([{"role": r, "text": t} for r, t, _ in read_turns(texts[-1])])
                learned.append("".join(unescape(x[p["loss_start"] : p["loss_end"]]) for x, p in zip(shown, parts) if p["loss"]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(parsed, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), pa.array(learned, pa.string())], ["conv_id", "formatted", "turns", "loss_text"])

    return map_arrow(listed, parse, f"conv_id {kind}, formatted string, turns array<struct<role:string,text:string>>, loss_text string", 256)


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    added = spark.createDataFrame([(ADDED_ID, 0, "user", ADDED_TEXT), (ADDED_ID, 1, "assistant", ADDED_TEXT)], rows.schema)
    nodes, convs = prefix_tree(rows.unionByName(added))
    back = read_back(nodes, convs)
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest(whole).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        digest(F.col("loss_text")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\<]', '', 'g')) AS text_size,
             length(role) + length(regexp_replace(role, '[^\\<\n]', '', 'g')) AS role_size FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(7 + role_size + 1 + text_size + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
