"""Audit of how sources differ in their words, by mergeable radix tries.

Every task counts the terms of its documents in radix tries over UTF-8 bytes, one for each language,
whose leaves hold a counter for each source and the number of documents.  Tries travel as their
leaves, in the order of their bytes; a range exchange over (language, term) brings the leaves of a prefix
range of all tries to one task, in order, where they are merged into one trie again.  Its traversal
streams the terms that are kept, in UTF-8 order; from them come the sums for all pairs of sources of a
language and, as ties go by UTF-8 order, the first candidates of each source.

A leaf is one row for each task that saw the term, however often it occurs, and tries are emptied when
they reach ``LEAVES`` leaves, so no term and no source gathers its rows anywhere.  Counts, sums and
divisions are of integers and exact.

The result has a row for each pair of sources of a language, so their number must be small: more than
``GROUPS`` pairs of language and source are an error.

Defined results: null texts, languages and sources count as empty ones; documents without terms and
languages without kept terms still give their pairs, with the value 0; repeated rows count as often as
they occur; an empty table gives an empty result; texts and terms may be of any length; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.operators.work import few

from .common import coded_words, map_arrow, materialize, shared_dir, table

#: Documents of a language that a kept term occurs in.
LEAST_DOCS = 10
#: Ranks of the terms told for a source.
RANKS = 10
#: Scale of the shares.
SCALE = 1_000_000_000
#: Most pairs of language and source.
GROUPS = 100_000
#: Leaves of a task's tries together, and pairs of term and source counted before they go to the tries.
LEAVES, COUNTED = 1 << 18, 1 << 22
#: Bytes as the terms see them: A-Z in lower case, other ASCII characters but letters as spaces.
SEEN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
COUNTER = np.dtype([("slot", "<u4"), ("n", "<u8")])


class RadixTrie:
    """Terms (bytes) to a number of documents and counters by slot; edges hold as many bytes as have one way on."""

    #: A node is [its edge's label, children by first byte, documents, packed counters, whether these may repeat a slot]; no leaf: documents is None.
    def __init__(self):
        self.top, self.leaves = [b"", {}, None, b"", False], 0

    def add(self, term: bytes, docs: int, counters: bytes, repeats: bool = False) -> None:
        node, k, n = self.top, 0, len(term)
        while k < n:
            kids, byte = node[1], term[k]
            if kids is None:
                kids = node[1] = {}
            child = kids.get(byte)
            if child is None:
                kids[byte] = [term[k:], None, docs, counters, repeats]
                self.leaves += 1
                return
            label = child[0]
            if not term.startswith(label, k):
                same = 1
                while same < len(label) and k + same < n and label[same] == term[k + same]:
                    same += 1
                upper = [label[:same], {label[same]: child}, None, b"", False]
                child[0] = label[same:]
                kids[byte] = child = upper
                label = upper[0]
            node = child
            k += len(label)
        if node[2] is None:
            node[2:] = docs, counters, repeats
            self.leaves += 1
        else:
            node[2:] = node[2] + docs, node[3] + counters, True

    def walk(self) -> Iterator[tuple[bytes, int, bytes]]:
        """Leaves in the order of their bytes, which for UTF-8 is that of the characters."""
        stack = [(b"", self.top)]
        while stack:
            before, (label, kids, docs, counters, repeats) = stack.pop()
            term = before + label
            if docs is not None:
                yield term, docs, merged(counters) if repeats else counters
            if kids:
                stack += [(term, kids[b]) for b in sorted(kids, reverse=True)]


def merged(counters: bytes) -> bytes:
    """Counters by slot, each slot once."""
    c = np.frombuffer(counters, COUNTER)
    if len(c) < 2 or (c["slot"][1:] > c["slot"][:-1]).all():
        return counters
    slots, at = np.unique(c["slot"], return_inverse=True)
    out = np.zeros(len(slots), COUNTER)
    out["slot"] = slots
    np.add.at(out["n"], at, c["n"])
    return out.tobytes()


class Counts:
    """Counts of a task on their way to the tries: numbers for terms and, by number and slot, occurrences."""

    def __init__(self, langs: np.ndarray):
        self.langs, self.tries, self.number, self.held = langs, {}, {}, []

    def add(self, slots: np.ndarray, texts: list[bytes]) -> None:
        terms, doc, at = coded_words([t.translate(SEEN) for t in texts])
        number = np.fromiter((self.number.setdefault(t, len(self.number)) for t in terms), np.int64, len(terms))
        at = number[at]
        found, n = np.unique(at << 20 | slots[doc], return_counts=True)
        # A document counts once for each of its terms.
        once = np.unique(doc * max(1, len(self.number)) + at)
        lang = self.langs[slots[once // max(1, len(self.number))]]
        docs, m = np.unique((once % max(1, len(self.number))) << 20 | lang, return_counts=True)
        self.held.append((found, n, docs, m))

    def size(self) -> int:
        return sum(len(x[0]) for x in self.held)

    def into_tries(self) -> None:
        if not self.held:
            return
        (found, n), (docs, m) = (summed([x[k] for x in self.held], [x[k + 1] for x in self.held]) for k in (0, 2))
        self.held = []
        terms, self.number = list(self.number), {}
        counters = np.zeros(len(found), COUNTER)
        counters["slot"], counters["n"] = found & 0xFFFFF, n
        # Counters go by term and language, as the documents do, which have each of these once.
        key = (found >> 20) << 20 | self.langs[found & 0xFFFFF]
        order = np.argsort(key, kind="stable")
        raw, key = counters[order].tobytes(), key[order]
        lo, hi = np.searchsorted(key, docs), np.searchsorted(key, docs, "right")
        for k, d, a, b in zip(docs.tolist(), m.tolist(), (12 * lo).tolist(), (12 * hi).tolist()):
            trie = self.tries.get(k & 0xFFFFF)
            if trie is None:
                trie = self.tries[k & 0xFFFFF] = RadixTrie()
            trie.add(terms[k >> 20], d, raw[a:b])

    def leaves(self) -> Iterator[pa.RecordBatch]:
        self.into_tries()
        yield from packed(self.tries)
        self.tries = {}


def summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(n), len(found)).astype(np.int64)


def packed(tries: dict[int, RadixTrie], rows: int = 8192, least: int = 0) -> Iterator[pa.RecordBatch]:
    """Leaves of tries by language and term, as rows; those with fewer documents go."""
    for lang in sorted(tries):
        out = []
        for leaf in tries[lang].walk():
            if leaf[1] >= least:
                out.append(leaf)
            if len(out) == rows:
                yield leaf_batch(lang, out)
                out = []
        if out:
            yield leaf_batch(lang, out)


def leaf_batch(lang: int, leaves: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch:
    terms, docs, counters = zip(*leaves)
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(leaves), pa.int32()), pa.array(terms, pa.binary()), pa.array(docs, pa.int64()), pa.array(counters, pa.binary())], ["lang", "term", "docs", "counters"])


LEAF = "lang int, term binary, docs long, counters binary"


def counted(docs: DataFrame, slot_of: dict[tuple[str, str], int], langs: np.ndarray) -> DataFrame:
    """Leaves of the tasks' tries; ``docs`` is (lang, source, text as binary)."""
    held = docs.sparkSession.sparkContext.broadcast(slot_of)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(langs)
        for b in batches:
            slots = np.array([held.value[x] for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], np.int64)
            counts.add(slots, b.column(2).to_pylist())
            if counts.size() > COUNTED or len(counts.number) > LEAVES:
                counts.into_tries()
                if sum(t.leaves for t in counts.tries.values()) > LEAVES:
                    yield from counts.leaves()
        yield from counts.leaves()

    return map_arrow(docs, f, LEAF, 4096)


def summed_leaves(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[int, bytes, int, bytes]]:
    """Sorted leaves, equal ones as one; those of fewer than ``least`` documents go.  The last of a batch waits for the next one."""
    rest = None
    for b in batches:
        if rest is not None:
            b = pa.concat_batches([rest, b])
        if not b.num_rows:
            continue
        new = pc.or_(pc.not_equal(b.column(0)[1:], b.column(0)[:-1]), pc.not_equal(b.column(1)[1:], b.column(1)[:-1]))
        starts = np.concatenate([[0], 1 + np.flatnonzero(new.to_numpy(zero_copy_only=False))])
        last = int(starts[-1])
        if last:
            yield from leaf_sums(b.slice(0, last), starts[:-1], least)
        # One row, so that a term of very many tasks gathers nothing.
        lang, term, docs, counters = next(leaf_sums(b.slice(last), np.zeros(1, np.int64), 0))
        rest = pa.RecordBatch.from_arrays([pa.array([x], kind.type) for x, kind in zip((lang, term, docs, merged(counters)), b.schema)], schema=b.schema)
    if rest is not None:
        yield from leaf_sums(rest, np.zeros(1, np.int64), least)


def leaf_sums(b: pa.RecordBatch, starts: np.ndarray, least: int) -> Iterator[tuple[int, bytes, int, bytes]]:
    docs = np.add.reduceat(b.column(2).to_numpy(), starts)
    ends = np.append(starts[1:], b.num_rows)
    counters = b.column(3)
    at = np.frombuffer(counters.buffers()[1], np.int32)[counters.offset : counters.offset + b.num_rows + 1]
    raw = counters.buffers()[2]
    for k in np.flatnonzero(docs >= least).tolist():
        lo, hi = int(starts[k]), int(ends[k])
        # Counters of rows that follow each other lie one after another.
        yield b.column(0)[lo].as_py(), b.column(1)[lo].as_py(), int(docs[k]), raw[at[lo] : at[hi]].to_pybytes()


def kept_terms(leaves: DataFrame, least: int) -> DataFrame:
    """Leaves of all tries merged by prefix range; those of at least ``least`` documents stay, in UTF-8 order within a range."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = {}
        for lang, term, docs, counters in summed_leaves(batches, least):
            if sum(t.leaves for t in tries.values()) >= LEAVES:
                yield from packed(tries, least=least)
                tries = {}
            tries.setdefault(lang, RadixTrie()).add(term, docs, counters, True)
        yield from packed(tries, least=least)

    return leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(f, LEAF)


def shares(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * n / of), exactly: three digits of a long division at a time, so that nothing leaves 64 bits."""
    q = np.zeros(np.broadcast_shapes(n.shape, of.shape), np.int64)
    rest = n
    for _ in range(3):
        rest = rest * 1000
        q = q * 1000 + rest // of
        rest = rest % of
    return 1 + q


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): differences between sources of a language, and each source's own terms."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(read(lang_col).alias("lang"), read(source_col).alias("source"), read(text_col).cast("binary").alias("text"))
    groups = sorted((tuple(r) for r in few(docs.select("lang", "source").distinct(), GROUPS)), key=lambda g: (g[0].encode(), g[1].encode()))
    names = sorted({g[0] for g in groups}, key=str.encode)
    place = {x: k for k, x in enumerate(names)}
    lang_of = np.array([place[g[0]] for g in groups] or [0], np.int64)
    kept = materialize(kept_terms(materialize(counted(docs, {g: k for k, g in enumerate(groups)}, lang_of), folder, "leaves"), least), folder, "kept")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Occurrences of kept terms by slot, and the number of kept terms by language, below zero."""
        n, v = np.zeros(len(groups), np.int64), np.zeros(len(names), np.int64)
        for b in batches:
            c = np.frombuffer(b"".join(b.column(3).to_pylist()), COUNTER)
            np.add.at(n, c["slot"], c["n"].astype(np.int64))
            v += np.bincount(b.column(0).to_numpy(), minlength=len(names))
        at = [*np.flatnonzero(n).tolist(), *(-1 - np.flatnonzero(v)).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([int(n[k]) if k >= 0 else int(v[-1 - k]) for k in at], pa.int64())], ["at", "n"])

    sums = {r["at"]: r["n"] for r in kept.mapInArrow(totals, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    n_of = np.array([sums.get(k, 0) for k in range(len(groups))], np.int64)
    v_of = np.array([sums.get(-1 - k, 0) for k in range(len(names))], np.int64)
    own = [np.flatnonzero(lang_of == k) for k in range(len(names))] if groups else []

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial sums (a, b, value) for the pairs of slots, and candidates (a, term, value)."""
        for b in batches:
            lang = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(lang)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                slots, v = own[lang[lo]], int(v_of[lang[lo]])
                step = max(1, (1 << 20) // len(slots))
                for at in range(lo, hi, step):
                    part = b.slice(at, min(step, hi - at))
                    # Ties go by UTF-8; a batch may hold the end of one range and the start of another.
                    part = part.take(pc.sort_indices(part.column(1)))
                    raw = part.column(3).to_pylist()
                    c = np.frombuffer(b"".join(raw), COUNTER)
                    row = np.repeat(np.arange(len(raw)), [len(x) // COUNTER.itemsize for x in raw])
                    count = np.zeros((len(raw), len(slots)), np.int64)
                    count[row, np.searchsorted(slots, c["slot"])] = c["n"]
                    p = shares(count + 2, (n_of[slots] + 2 * v)[None, :])
                    q = shares(count.sum(1) + 2, np.array([n_of[slots].sum() + 2 * v]))
                    a, other, value, term = [], [], [], []
                    for k in range(len(slots)):
                        a += [int(slots[k])] * (len(slots) - k - 1)
                        other += slots[k + 1 :].tolist()
                        value += gap(p[:, k + 1 :], p[:, k : k + 1]).sum(0).tolist()
                    term += [None] * len(a)
                    f = np.where((count > 0) & (p > q[:, None]), gap(p, q[:, None]), -1)
                    first = np.argsort(-f, axis=0, kind="stable")[:ranks]
                    for k in range(len(slots)):
                        at_ = [x for x in first[:, k].tolist() if f[x, k] >= 0]
                        a += [int(slots[k])] * len(at_)
                        other += [None] * len(at_)
                        value += f[at_, k].tolist()
                        term += [part.column(1)[x].as_py() for x in at_]
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(other, pa.int32()), pa.array(term, pa.binary()), pa.array(value, pa.int64())], ["a", "b", "term", "value"])

    found = materialize(kept.mapInArrow(scored, "a int, b int, term binary, value long"), folder, "scored")
    group = spark.createDataFrame([(k, *g) for k, g in enumerate(groups)], "a int, lang string, source string")
    sums = found.filter("b IS NOT NULL").groupBy("a", "b").agg(F.sum("value").alias("value"))
    # Each pair was summed once; a source's row names the other.
    sums = sums.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"), "value").select("x.*", "value")
    other = group.select(F.col("a").alias("b"), F.col("lang").alias("_lang"), F.col("source").alias("item"))
    pairs = group.join(other, (F.col("lang") == F.col("_lang")) & (F.col("a") != F.col("b"))).join(sums, ["a", "b"], "left")
    pairs = pairs.select("a", "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    terms = found.filter("b IS NULL").select("a", "term", "value", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("value"), "term")).alias("rank")).filter(F.col("rank") <= ranks)
    terms = terms.join(group, "a").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("value"), "item"))).drop("a")
    return ranked.unionByName(terms)


def query(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), t AS (
  SELECT doc, lang, source, unnest(terms) AS term FROM d
), g AS (
  SELECT DISTINCT lang, source FROM d
), kept AS (
  SELECT lang, term, count(*) OVER (PARTITION BY lang) AS v FROM (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= {LEAST_DOCS})
), n AS (
  SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term
), c AS (
  SELECT g.lang, g.source, k.term, k.v, coalesce(n.n, 0)::HUGEINT AS n FROM g JOIN kept k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
), p AS (
  SELECT lang, source, term, n, 1 + ({SCALE} * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM c
), q AS (
  SELECT lang, term, 1 + ({SCALE} * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM (SELECT lang, term, any_value(v) AS v, sum(n) AS n FROM c GROUP BY lang, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), all_pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= {RANKS}
"""
