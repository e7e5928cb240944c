"""Token counts by offset-mapped attribution.

Each whole document is encoded once; its tokens' character spans meet the spans of the document's
sections in one ordered sweep (an interval join within the document), and every token is given to
sections by a rule for those that cross a boundary:

- ``first``: the section of its first character (the default),
- ``last``: the section of its last character,
- ``most``: the section with most of its characters, the earlier one if equal.

Tokens that touch no section count as ``outside``, so a document's counts always add up to its
tokens.  Sections are given as a table of (doc_id, section, start, end) or by default they are the
document's paragraphs: stretches between line feeds, each with its own line feed, so that together
they cover the text.  Of given sections that overlap, in order of start, end and name, a character
belongs to the first that holds it.

Defined results: a null or empty text has one empty section 0 without tokens; a document without
given sections has the section ``OUTSIDE`` with all its tokens; equal rows are counted each; sections
of unknown documents, and those that end before they start or lack a number, are ignored; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import ByteEncoder, default_path, plain_words
from .common import claim, map_arrow, strings, table

RULES = ("first", "last", "most")
OUTSIDE = -1
#: Words kept by a worker; the table starts anew when full.
KEPT_WORDS = 300_000


class Spans:
    """Ends of the tokens of whole texts, in characters, by the library or from known words."""

    def __init__(self, path: str):
        self.library = ByteEncoder(path).library
        self.kept: dict[str, tuple[int, ...]] = {}

    def forget(self) -> None:
        self.kept.clear()

    def whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of tokens by the library's offset map."""
        spans = np.array(self.library.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
        return spans[:, 0], spans[:, 1]

    def many(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Starts and ends of the tokens of each text; a character of several tokens is in each of them."""
        claim(self)
        kept = self.kept
        split = [plain_words(t) for t in texts]
        new = {w for words in split if words for w in words if w not in kept}
        if len(kept) + len(new) > KEPT_WORDS:
            kept.clear()
            new = {w for words in split if words for w in words}
        if new:
            new = list(new)
            # A word alone is one word again, so its offsets are those it has in any text.
            for w, e in zip(new, self.library.encode_batch(new, add_special_tokens=False)):
                kept[w] = np.array(e.offsets, np.int32).tobytes()
        out = []
        for text, words in zip(texts, split):
            if words is None:
                out.append(self.whole(text))
                continue
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            found = list(map(kept.__getitem__, words))
            tokens = np.fromiter(map(len, found), np.int64, len(found)) // 8
            spans = np.frombuffer(b"".join(found), np.int32).reshape(-1, 2) + np.repeat(np.cumsum(sizes) - sizes, tokens)[:, None]
            out.append((spans[:, 0], spans[:, 1]))
        for w in [w for w in new if len(w) > 64]:
            kept.pop(w, None)
        return out


_SPANS: dict[str, Spans] = {}


def touched(starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last section that hold a character of each token, ``OUTSIDE`` where none does; sections ascend and are disjoint."""
    # First section that ends after the token starts, last one that starts before the token ends.
    first, last = np.searchsorted(high, starts, "right"), np.searchsorted(low, ends, "left") - 1
    none = first > last
    return np.where(none, OUTSIDE, first), np.where(none, OUTSIDE, last)


def choose(starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray, rule: str) -> np.ndarray:
    """Each token's section by the rule, from what ``touched`` says."""
    if rule != "most":
        return first if rule == "first" else last
    out = first.copy()
    for k in np.flatnonzero(first < last):
        held = np.minimum(high[first[k] : last[k] + 1], ends[k]) - np.maximum(low[first[k] : last[k] + 1], starts[k])
        out[k] += int(np.argmax(held))
    return out


def attribute(starts: np.ndarray, ends: np.ndarray, sections: list[tuple[int, int]], rule: str = "first") -> np.ndarray:
    """Index of each token's section, ``OUTSIDE`` where it touches none; sections ascend and are disjoint."""
    low, high = np.array(sections, np.int64).reshape(-1, 2).T
    return choose(starts, ends, low, high, *touched(starts, ends, low, high), rule)


def disjoint(sections: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What of each section (start, end, name), in order, no earlier one holds."""
    out, at = [], 0
    for start, end, _ in sections:
        out.append((max(start, at), max(end, at)))
        at = out[-1][1]
    return out


def paragraphs(text: str) -> list[tuple[int, int]]:
    ends = [m.end() for m in re.finditer("\n", text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return list(zip([0, *ends], ends))


def token_counts(docs: DataFrame, sections: DataFrame | None = None, rule: str = "first", path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per section: doc_id, section, start, end, n_tokens and n_crossing, the tokens that also touch another.

    With given sections there is a row ``OUTSIDE`` for tokens in none, if there are such tokens or the
    document has no section.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or default_path()
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    given = sections is not None
    if given:
        s = sections.select(F.col(id_col).alias("_id"), F.col("section").cast("long").alias("section"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).filter("start <= `end`").groupBy("_id").agg(F.array_sort(F.collect_set(F.struct("start", "end", "section"))).alias("sections"))
        d = d.join(s, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "sections")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = _SPANS.setdefault(path, Spans(path)) if path not in _SPANS else _SPANS[path]
        for b in batches:
            texts = strings(b.column(1))
            named = [[(x["start"], x["end"], x["section"]) for x in r] for r in (x or [] for x in b.column(2).to_pylist())] if given else [[(s, e, k) for k, (s, e) in enumerate(paragraphs(t))] for t in texts]
            at, columns = [], [[] for _ in range(5)]
            for k, ((starts, ends), own) in enumerate(zip(spans.many(texts), named)):
                low, high = np.array(disjoint(own) if given else [x[:2] for x in own], np.int64).reshape(-1, 2).T
                # Sections without a character touch no token.
                full = np.flatnonzero(low < high)
                low, high = low[full], high[full]
                first, last = touched(starts, ends, low, high)
                index, crossing = choose(starts, ends, low, high, first, last, rule), first != last
                index = np.append(full, OUTSIDE)[index]
                counts = np.bincount(index + 1, minlength=len(own) + 1).tolist()
                crosses = np.bincount(index[crossing] + 1, minlength=len(own) + 1).tolist()
                rows = [(name, s, e, counts[j + 1], crosses[j + 1]) for j, (s, e, name) in enumerate(own)]
                if counts[0] or not own:
                    rows.append((OUTSIDE, None, None, counts[0], crosses[0]))
                at += [k] * len(rows)
                for c, values in zip(columns, zip(*rows)):
                    c.extend(values)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return map_arrow(d, f, f"doc_id {kind}, section long, start long, `end` long, n_tokens long, n_crossing long", 512)


def query(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
