"""Licence scan: Aho-Corasick finds notice phrases and identifier tags, a shunting-yard parser
evaluates the licence expressions behind the tags.

Words are lower-cased (A-Z only) runs of ASCII letters, digits and all characters beyond ASCII.
A phrase is found where its words stand consecutively; overlapping places all count.  One
automaton holds all phrases of words; it runs over a text's words joined by single spaces.  A
second one finds the tags in the raw text.  Behind a tag, on its line, the longest start that is an
expression is parsed, ``with`` binding tighter than ``and``, and ``and`` than ``or``.  Identifiers of the
table count by their family, others, ``LicenseRef-`` among them, as themselves, so that no part of an
expression is lost; a word without a capital or a digit is prose unless it is listed.  An expression
without a listed identifier or reference counts only where it fills its line.

The expression is kept as a tree of ``and`` and ``or`` in turn, never multiplied out: equal operands are
one, and an operand goes where another one of its node makes it needless (a or (a and b) is a).  Parsing
and evaluation take time in proportion to the text.

Defined results: a null or empty text has no words, places or labels and score 0; a tag without an
expression behind it gives nothing; repeated rows each give their row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, strings

#: Base phrases and labels, fixed by the query's contract.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Further notices of the method: phrase, label, weight of evidence.
NOTICES = (
    ("gnu lesser general public license", "lgpl", 0.9),
    ("gnu affero general public license", "agpl", 0.9),
    ("mozilla public license", "mpl", 0.9),
    ("bsd license", "bsd", 0.8),
    ("bsd 2 clause", "bsd", 0.8),
    ("bsd 3 clause", "bsd", 0.8),
    ("creative commons attribution", "cc-by", 0.8),
    ("cc0", "cc0", 0.6),
    ("public domain dedication", "cc0", 0.7),
    ("all rights reserved", "proprietary", 0.5),
    ("eclipse public license", "epl", 0.9),
)
BASE_WEIGHT, TAG_WEIGHT = 0.8, 1.0
TAGS = ("spdx-license-identifier:", "license-expression:")
# Identifiers of licences by family, without the endings below; any case.
FAMILIES = {
    "agpl": "AGPL AGPL-1.0 AGPL-3.0 AGPLv3",
    "lgpl": "LGPL LGPL-2.0 LGPL-2.1 LGPL-3.0 LGPLv2 LGPLv2.1 LGPLv3",
    "gpl": "GPL GPL-1.0 GPL-2.0 GPL-3.0 GPLv2 GPLv3",
    "apache": "Apache Apache-1.0 Apache-1.1 Apache-2 Apache-2.0",
    "cc-by": "CC-BY CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-SA CC-BY-NC CC-BY-ND CC-BY-NC-SA CC-BY-NC-ND",
    "cc0": "CC0 CC0-1.0",
    "mit": "MIT MIT-0 MIT-Modern-Variant",
    "mpl": "MPL MPL-1.0 MPL-1.1 MPL-2.0",
    "bsd": "BSD 0BSD BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-4-Clause",
    "epl": "EPL EPL-1.0 EPL-2.0",
    "eupl": "EUPL-1.1 EUPL-1.2",
    "cddl": "CDDL-1.0 CDDL-1.1",
    "artistic": "Artistic-1.0 Artistic-2.0",
    "bsl": "BSL-1.0",
    "isc": "ISC",
    "unlicense": "Unlicense",
    "zlib": "Zlib",
    "wtfpl": "WTFPL",
    "ofl": "OFL-1.0 OFL-1.1",
    "psf": "PSF-2.0 Python-2.0",
}
ENDINGS = ("-only", "-or-later", "+")
EXCEPTION = r"[a-z0-9.+-]*-(exception|note)(-[0-9.]+)?"
#: What may stand behind an expression that fills its line.
LINE_END = r"[ \t.;,]*(\*/|-->|[\"'])?[ \t\r]*(\n|$)"

#: Every byte but digits, letters (lowered) and those of characters beyond ASCII becomes a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_TOKEN = re.compile(r"[ \t]*(\(|\)|(?:DocumentRef-[A-Za-z0-9.-]+:)?[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?)")
_RANK = {"or": 1, "and": 2, "with": 3}
_LABEL = {x.lower(): label for label, found in FAMILIES.items() for x in found.split()}
_EXCEPTION = re.compile(EXCEPTION)
_LINE_END = re.compile(LINE_END)
_OWN = re.compile("[A-Z0-9]")
_REFERENCE = re.compile("(?i)(documentref-.*:)?licenseref-.")

SCHEMA = "doc_id {id}, n_words long, places array<struct<label:string,start:long,base:boolean>>, expressions array<struct<start:long,text:string,rpn:string,choices:string,labels:array<string>>>, score double"


def family(identifier: str) -> str | None:
    """The family of a listed identifier."""
    low = identifier.lower()
    found = _LABEL.get(low)
    for ending in ENDINGS:
        found = found or low.endswith(ending) and _LABEL.get(low[: -len(ending)]) or None
    return found


def label_of(identifier: str) -> str | None:
    """The family of a listed identifier, others as they are, in lower case; None for prose."""
    found = family(identifier)
    return found or (identifier.lower() if _OWN.search(identifier) or _REFERENCE.match(identifier) else None)


def parse(text: str, pos: int = 0) -> tuple[list[str], int]:
    """Shunting yard: the longest expression at ``pos``, in postfix order, and where it ends; empty where none is.

    Identifiers keep their case; operators are lower-cased.
    """
    out, stack, depth, want, listed = [], [], 0, "licence", False
    start, best = pos, (0, [], pos, False)
    while m := _TOKEN.match(text, pos):
        token, low = m[1], m[1].lower()
        if text.startswith(":", m.end()):
            # The next tag.
            break
        if want == "operator":
            if token == ")" and depth:
                while stack[-1] != "(":
                    out.append(stack.pop())
                stack.pop()
                depth -= 1
            elif low in _RANK:
                # An exception belongs to a licence, not to an expression.
                if low == "with" and (out[-1] in _RANK or stack and stack[-1] == "with"):
                    break
                while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                    out.append(stack.pop())
                stack.append(low)
                want = "exception" if low == "with" else "licence"
            else:
                break
        elif want == "exception":
            if not (_EXCEPTION.fullmatch(low) or label_of(token)) or low in _RANK:
                break
            out.append(token)
            want = "operator"
        elif token == "(":
            stack.append("(")
            depth += 1
        elif low not in _RANK and label_of(token):
            out.append(token)
            listed = listed or family(token) is not None or _REFERENCE.match(token) is not None
            want = "operator"
        else:
            break
        pos = m.end()
        if want == "operator" and not depth:
            # Outside of parentheses at most one operator of each rank waits.
            best = (len(out), list(stack), pos, listed)
    n, waiting, end, listed = best
    if not n or not listed and not _LINE_END.match(text, end):
        return [], start
    return out[:n] + waiting[::-1], end


class Choices:
    """Trees of ``and`` and ``or`` over licences; equal trees have one number."""

    def __init__(self):
        self.number: dict = {}
        self.nodes: list = []

    def node(self, key) -> int:
        """Number of a licence (text) or of an operator with a set of two or more numbers."""
        k = self.number.setdefault(key, len(self.nodes))
        if k == len(self.nodes):
            self.nodes.append(key)
        return k

    def closed(self, x) -> int:
        """Number of an operand that may still grow: needless operands go."""
        if isinstance(x, int):
            return x
        op, kids = x
        # An operand of the other operator that has one of these for its own says no more than that one.
        left = {k for k in kids if isinstance(self.nodes[k], str) or kids.isdisjoint(self.nodes[k][1])}
        return self.node((op, frozenset(left))) if len(left) > 1 else left.pop()

    def joined(self, op: str, left, right):
        """An operand that may grow, of two; the larger set of the same operator takes the other in."""
        sets = []
        for x in (left, right):
            if not isinstance(x, int) and x[0] == op:
                sets.append(x[1])
            else:
                k = self.closed(x)
                node = self.nodes[k]
                sets.append(set(node[1]) if not isinstance(node, str) and node[0] == op else {k})
        sets.sort(key=len)
        sets[1] |= sets[0]
        return op, sets[1]

    def shown(self, k: int) -> str:
        """The tree as an expression: licences by name, then the rest in order of appearance."""
        out, stack = [], [k]
        while stack:
            x = stack.pop()
            node = x if isinstance(x, str) else self.nodes[x]
            if isinstance(node, str):
                out.append(node)
                continue
            op, kids = node
            names = sorted((i for i in kids if isinstance(self.nodes[i], str)), key=lambda i: self.nodes[i])
            parts = []
            for i in [*names, *sorted(kids.difference(names))]:
                deep = op == "and" and not isinstance(self.nodes[i], str)
                parts += [f" {op} "] * bool(parts) + ["("] * deep + [i] + [")"] * deep
            stack += parts[::-1]
        return "".join(out)

    def licences(self, k: int) -> list[str]:
        """Families and names in the tree, exceptions left out."""
        seen, stack = {k}, [k]
        while stack:
            node = self.nodes[stack.pop()]
            if not isinstance(node, str):
                new = node[1] - seen
                seen |= new
                stack += new
        return sorted({self.nodes[i].split(" with ")[0] for i in seen if isinstance(self.nodes[i], str)})


def evaluate(rpn: list[str]) -> tuple[str, list[str]]:
    """A postfix expression as its tree, shown, and the labels in it."""
    tree, stack, k = Choices(), [], 0
    while k < len(rpn):
        token = rpn[k]
        if token in ("and", "or"):
            right, left = stack.pop(), stack.pop()
            stack.append(tree.joined(token, left, right))
        elif k + 2 < len(rpn) and rpn[k + 2] == "with":
            stack.append(tree.node(f"{label_of(token)} with {rpn[k + 1].lower()}"))
            k += 2
        else:
            stack.append(tree.node(label_of(token)))
        k += 1
    top = tree.closed(stack[-1])
    return tree.shown(top), tree.licences(top)


@lru_cache(maxsize=4)
def automata(base: tuple = BASE, notices: tuple = NOTICES):
    words, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    held: dict[str, list] = {}
    for phrase, label in base:
        held.setdefault(phrase, []).append((label, True, BASE_WEIGHT))
    for phrase, label, weight in notices:
        held.setdefault(phrase, []).append((label, False, weight))
    for phrase, found in held.items():
        words.add_word(f" {phrase} ", (phrase, found))
    for tag in TAGS:
        tags.add_word(tag, tag)
    words.make_automaton()
    tags.make_automaton()
    return words, tags


def scan(text: str, base: tuple = BASE, notices: tuple = NOTICES) -> tuple[int, list, list, float]:
    """Number of words, places in order, expressions in order, score of one whole text."""
    by_words, by_tags = automata(base, notices)
    raw = text.encode("utf-8", "surrogatepass")
    split = raw.translate(_TABLE).split(b" ")
    split = [w for w in split if w]
    joined = f" {b' '.join(split).decode('latin-1')} "
    places, doubt = [], 1.0
    # Matches come in order of their ends: one cursor counts the words before them.
    at, before = 0, 0
    for end, (phrase, found) in by_words.iter(joined):
        before += joined.count(" ", at, end)
        at = end
        for label, is_base, weight in found:
            places.append((before - 1 - phrase.count(" "), label, is_base))
            doubt *= 1 - weight
    expressions = []
    if b":" in raw:
        lowered = raw.translate(_LOWER).decode("latin-1")
        shown = raw.decode("latin-1")
        at, before = 0, 0
        for end, tag in by_tags.iter(lowered):
            rpn, stop = parse(shown, end + 1)
            if rpn:
                start = end + 1 - len(tag)
                before += len(raw[at:start].decode("utf-8", "replace"))
                at = start
                expressions.append((before, shown[end + 1 : stop].strip(), " ".join(rpn), *evaluate(rpn)))
                doubt *= 1 - TAG_WEIGHT
    return len(split), sorted(places), expressions, 1 - doubt


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: Iterable = BASE, notices: Iterable = NOTICES) -> DataFrame:
    """One row per document: words, places of phrases, evaluated expressions and the score."""
    base, notices = tuple(base), tuple(notices)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for b in batches:
            found = [scan(t, base, notices) for t in strings(b.column(1))]
            kinds = kinds or [pa.int64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("base", pa.bool_())])), pa.list_(pa.struct([("start", pa.int64()), ("text", pa.string()), ("rpn", pa.string()), ("choices", pa.string()), ("labels", pa.list_(pa.string()))])), pa.float64()]
            columns = [
                [x[0] for x in found],
                [[{"label": n, "start": s, "base": k} for s, n, k in x[1]] for x in found],
                [[{"start": s, "text": t, "rpn": r, "choices": c, "labels": n} for s, t, r, c, n in x[2]] for x in found],
                [x[3] for x in found],
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_words", "places", "expressions", "score"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(d, f, SCHEMA.format(id=d.schema["doc_id"].dataType.simpleString()))


def query(spark, sf_dir: str) -> DataFrame:
    places = F.filter("places", lambda p: p["base"])
    starts = F.transform(places, lambda p: p["start"])
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    every = F.concat(F.transform("places", lambda p: p["label"]), F.flatten(F.transform("expressions", lambda e: e["labels"])))
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        join(F.transform(places, lambda p: p["label"])).alias("base_labels"),
        join(every).alias("labels"),
        "score",
        F.array_join(F.transform("expressions", lambda e: e["choices"]), "; ").alias("choices"),
    )
