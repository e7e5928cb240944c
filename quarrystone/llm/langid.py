"""Language identification: script ranges narrow the candidates, then Viterbi over per-word scores
with a switching penalty labels the spans of a text.

The model is learned here from texts with a known language: counts of hashed character n-grams
(one to three characters of a word between edge marks) and of scripts, over all training rows.
Tasks pre-aggregate, so ``languages * BUCKETS`` counts at most come from each task and reach the
driver, whatever the input.  A word's score for a language is the log-likelihood of its n-grams
against the best candidate, not below ``-CLIP``; languages whose training words hardly use the
word's script are no candidates for it (``REMOVED``, a score that no path takes if another can),
unless no language uses it.  The best labelling pays ``SWITCH`` for every change of language.

Where, for the language of the largest sum, no stretch of words gains more than ``SWITCH`` by any
other choice, one label for all words is optimal, so the general search is not run.

Defined results: ``und`` with score 0 for a null text, one without a letter, or an empty model;
repeated rows each give their row; an empty table gives an empty result; training rows with a null
text or language teach nothing; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, keep_rows, map_arrow, strings, table

BUCKETS = 1 << 15
CLIP, SWITCH = 4.0, 9.0
#: Score of a word for a language that is no candidate: worse than two changes of language and any word's scores.
REMOVED = -1000.0
#: Least score of a text that a filter keeps; a text in several languages has a low one and is kept.
KEEP_AT = 0.2
#: A language is a candidate for a script that at least this share of its training words uses.
SCRIPT_SHARE = 0.005
#: Words kept with their scores by a worker; the table starts anew when full.
KEPT_WORDS = 300_000
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")

#: First code points of script ranges; each reaches to the next.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
)
_FIRST = np.array([a for a, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
_INDEX = np.array([NAMES.index(n) for _, n in SCRIPTS])


_GRAM, _HASH = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of lower-cased words, and for each the number of its word."""
    c = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    of = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
    found, owners = [c], [of]
    for n in (2, 3):
        g = found[-1][:-1] * _GRAM + c[n - 1 :] + np.uint64(n << 40)
        found.append(g)
        owners.append(np.where(of[: len(g)] == of[n - 1 :], of[: len(g)], -1))
    at = ((np.concatenate(found) * _HASH) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)
    owners = np.concatenate(owners)
    return at[owners >= 0], owners[owners >= 0]


def scripts(words: list[str]) -> np.ndarray:
    """Number of the script of each word's first letter."""
    return _INDEX[np.searchsorted(_FIRST, np.fromiter((ord(w[0]) for w in words), np.int64, len(words)), "right") - 1]


class Model:
    """Languages, log-probabilities of the buckets and allowed scripts."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        full = np.array([counts[n] for n in self.langs], np.float64).reshape(len(self.langs), BUCKETS + len(NAMES))
        seen, scripts_ = full[:, :BUCKETS] + 0.05, full[:, BUCKETS:]
        self.log = np.log(seen / seen.sum(1, keepdims=True)).astype(np.float32)
        used = scripts_ / np.maximum(scripts_.sum(1, keepdims=True), 1) >= SCRIPT_SHARE
        self.allowed = np.where(used.any(0), used, True)
        self.forget()

    def forget(self) -> None:
        self.kept: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.langs)), np.float32)

    def __getstate__(self):
        return {"langs": self.langs, "log": self.log, "allowed": self.allowed}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.forget()

    def score(self, words: list[str]) -> np.ndarray:
        """Scores of distinct words, a row each."""
        at, of = grams(words)
        s = np.stack([np.bincount(of, row[at], len(words)) for row in self.log], 1)
        ok = self.allowed[:, scripts(words)].T
        s -= np.where(ok, s, -np.inf).max(1, keepdims=True)
        return np.where(ok, np.maximum(s, -CLIP), REMOVED).astype(np.float32)

    def matrices(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Scores of the words of each text; words that are not kept yet are scored together."""
        claim(self)
        kept = self.kept
        found = [list(map(kept.get, words)) for words in texts]
        open_ = [k for k, x in enumerate(found) if None in x]
        if open_:
            new = list({w for k in open_ for w, x in zip(texts[k], found[k]) if x is None})
            if len(kept) + len(new) > KEPT_WORDS:
                kept.clear()
                new, open_ = list(set().union(*texts)), range(len(texts))
            first = len(kept)
            while first + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[first : first + len(new)] = self.score(new)
            kept.update(zip(new, range(first, first + len(new))))
            for k in open_:
                found[k] = list(map(kept.__getitem__, texts[k]))
        return [self.rows[x] for x in found]

    def label(self, scores: np.ndarray) -> np.ndarray | int:
        """Number of the language of every word, or of all words."""
        if not len(scores):
            return 0
        best = int(scores.sum(0, dtype=np.float64).argmax())
        gain = np.cumsum(np.delete(scores, best, 1).max(1) - scores[:, best] if scores.shape[1] > 1 else np.zeros(len(scores)), dtype=np.float64)
        low = np.minimum.accumulate(np.concatenate([[0.0], gain[:-1]]))
        return best if (gain - low).max() <= SWITCH else viterbi(scores, SWITCH)


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """Labels with the largest sum of scores less ``switch`` for each change; ties stay, then the first language."""
    n, k = scores.shape
    value, back = scores[0].astype(np.float64).tolist(), np.zeros((n, k), np.int32)
    rows = scores.tolist()
    for t in range(1, n):
        top = max(value)
        at = value.index(top)
        step, row = back[t], rows[t]
        new = []
        for j in range(k):
            if value[j] >= top - switch:
                step[j] = j
                new.append(value[j] + row[j])
            else:
                step[j] = at
                new.append(top - switch + row[j])
        value = new
    out = np.zeros(n, np.int32)
    out[-1] = value.index(max(value))
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts (lang, bucket, n) over all rows, scripts in the buckets from ``BUCKETS`` on."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        sums: dict[str, np.ndarray] = {}

        def add() -> None:
            for lang, found in words.items():
                s = sums.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
                if found:
                    n, of = np.fromiter(found.values(), np.float64, len(found)), list(found)
                    at, owner = grams(of)
                    s[:BUCKETS] += np.bincount(at, n[owner], BUCKETS).astype(np.int64)
                    s[BUCKETS:] += np.bincount(scripts(of), n, len(NAMES)).astype(np.int64)
            words.clear()

        for b in batches:
            for text, lang in zip(strings(b.column(0)), b.column(1).to_pylist()):
                words.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
            if sum(map(len, words.values())) > KEPT_WORDS:
                add()
        add()
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * at.size, pa.string()), pa.array(at, pa.int32()), pa.array(s[at])], ["lang", "bucket", "n"])

    known = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    return map_arrow(known, f, "lang string, bucket int, n long", 512).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Model from all rows of ``docs``; ``languages * BUCKETS`` counts at most reach the driver."""
    found = counts(docs, text_col, lang_col).toArrow()
    langs = found.column("lang").to_pylist()
    sums = {n: np.zeros(BUCKETS + len(NAMES)) for n in set(langs)}
    for lang, b, n in zip(langs, found.column("bucket").to_pylist(), found.column("n").to_pylist()):
        sums[lang][b] = n
    return Model(sums)


def lower(text: str) -> str:
    """Lower case of the same length, so that places are those of the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def identify(model: Model, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """Language, score and spans (start, end, language) of each text.

    The score is the share of letters in the language's spans, times how surely it beats the next.
    """
    lows = [lower(t) for t in texts]
    words = [WORD.findall(t) for t in lows]
    # Signs such as fractions count as word characters, but a text of those alone has no letter.
    words = [w if any(c.isalpha() for x in w for c in x) else [] for w in words]
    if not model.langs:
        return [(UNKNOWN, 0.0, [])] * len(texts)
    return [settle(model, *x) for x in zip(texts, lows, words, model.matrices(words))]


def settle(model: Model, text: str, low: str, words: list[str], scores: np.ndarray) -> tuple[str, float, list[tuple[int, int, str]]]:
    if not words:
        return UNKNOWN, 0.0, []
    labels = model.label(scores)
    sums = scores.sum(0, dtype=np.float64)
    if isinstance(labels, int):
        best, share = labels, 1.0
        spans = [(0, len(text), model.langs[best])]
    else:
        letters = np.bincount(labels, [len(w) for w in words], len(model.langs))
        best = int(letters.argmax())
        share = float(letters[best] / letters.sum())
        spans = []
        for k, m in zip(labels.tolist(), WORD.finditer(low)):  # the same words
            if spans and spans[-1][2] == model.langs[k]:
                spans[-1] = (spans[-1][0], m.end(), model.langs[k])
            else:
                spans.append((m.start(), m.end(), model.langs[k]))
        sums = scores[labels == best].sum(0, dtype=np.float64)
    rest = np.delete(sums, best)
    sure = 1 / (1 + np.exp(-min(50.0, sums[best] - rest.max()))) if rest.size else 1.0
    return model.langs[best], share * float(sure), spans


def language_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: language, score and labelled spans, in the input's partitions."""
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for b in batches:
            found = identify(own, strings(b.column(1)))
            spans = [[{"start": s, "end": e, "lang": n} for s, e, n in x[2]] for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array(spans, spans_type)], ["doc_id", "lang_pred", "score", "spans"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(d, f, f"doc_id {kind}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>", 512)


def in_known_language(docs: DataFrame, model: Model, least: float = KEEP_AT, text_col: str = "text") -> DataFrame:
    """Rows whose text is in a known language with a score of at least ``least``; the others go.

    At ``KEEP_AT`` those that go are ``und`` texts, which have no letter, and texts whose labels are
    spread over so many languages that none has the share.  A text of one label scores at least 0.5,
    so gibberish and texts in unlearned languages or scripts stay under the label nearest to them.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: list[str]) -> list[bool]:
        return [lang != UNKNOWN and score >= least for lang, score, _ in identify(held.value, texts)]

    return keep_rows(docs, text_col, keep)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.filter(~held_out()))
    return language_spans(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
