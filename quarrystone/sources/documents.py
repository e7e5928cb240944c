"""Registry documents: tables and references of HTML pages as rows, and which of many names stand in which of many texts.

A page is parsed by table functions, a row out for each row of its main table or each reference, so that what
follows are joins.  Names are searched in texts by one automaton over all of them where they are few enough to
be sent to every task, which is checked; beyond that names and texts meet on short windows of characters and
the rest is compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.text import strip, text_or_empty

#: Characters of names that go to every task as one automaton, and of the windows beyond.
MOST_CHARS, WINDOW = 1 << 20, 8
#: Cells of a row that tells of an entry, and the word of a heading's first cell.
LEAST_CELLS, HEADING = 3, "Name"
REFERENCE = re.compile(r"^\[(\d+)\]\s*(.+)", re.S)


class _Tables(HTMLParser):
    """Rows of all tables, each with its innermost table, and the texts of paragraphs and list items."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.texts: list[str] = []
        #: Open tables: number, parts of the open cell or None.
        self.open: list[list] = []
        self.blocks: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self.open.append([len(self.tables) - 1, None])
        elif self.open and tag == "tr":
            self._end_cell()
            self.tables[self.open[-1][0]].append([])
        elif self.open and tag in ("td", "th"):
            self._end_cell()
            if not self.tables[self.open[-1][0]]:
                self.tables[self.open[-1][0]].append([])
            self.open[-1][1] = []
        elif tag in ("p", "li"):
            self._end_block()
            self.blocks.append([])

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self._end_cell()
            self.open.pop()
        elif tag in ("td", "th", "tr") and self.open:
            self._end_cell()
        elif tag in ("p", "li", "ul", "ol"):
            self._end_block()

    def handle_data(self, data):
        # A nested table's text is text of the cells around it too.
        for _, parts in self.open:
            if parts is not None:
                parts.append(data)
        if self.blocks:
            self.blocks[-1].append(data)

    def _end_cell(self):
        number, parts = self.open[-1]
        if parts is not None:
            self.tables[number][-1].append(_plain("".join(parts)))
            self.open[-1][1] = None

    def _end_block(self):
        if self.blocks:
            self.texts.append(_plain("".join(self.blocks.pop())))

    def close(self):
        super().close()
        while self.open:
            self._end_cell()
            self.open.pop()
        self._end_block()


def _plain(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def parsed(html: str | None) -> _Tables:
    page = _Tables()
    page.feed(html or "")
    page.close()
    return page


class _MainTable:
    def eval(self, html: str | None) -> Iterator[tuple[int, list[str]]]:
        tables = parsed(html).tables
        yield from enumerate(max(tables, key=len) if tables else [])


class _References:
    def eval(self, html: str | None) -> Iterator[tuple[int, str, str]]:
        found = {}
        for k, text in enumerate(parsed(html).texts):
            if m := REFERENCE.match(text):
                # A number told twice has its last entry, at its first place.
                found[m[1]] = (found.get(m[1], (k,))[0], m[2])
        for ref, (k, entry) in found.items():
            yield k, f"[{ref}]", entry


#: Table functions of a page's HTML: rows of the table with most rows, the first of equals; references of the form ``[n] text``.
main_table = F.udtf(_MainTable, returnType="row int, cells array<string>")
references = F.udtf(_References, returnType="place int, ref string, entry string")


def entries(pages: DataFrame, key: str, html: str, project: Column | None = None) -> DataFrame:
    """(key, row, name, description, augmented): entries of each page's main table, with the references that their descriptions name.

    With ``project`` those stay whose name holds it or lies in it, whatever the case.
    """
    rows = pages.lateralJoin(main_table(F.col(html).outer())).filter(F.size("cells") >= LEAST_CELLS)
    rows = rows.select(*pages.columns, "row", F.col("cells")[0].alias("_name"), F.col("cells")[2].alias("_description"))
    rows = rows.filter((F.col("_name") != "") & ~F.col("_name").contains(HEADING))
    if project is not None:
        a, b = F.lower(strip(F.col("_name"))), F.lower(strip(text_or_empty(project)))
        rows = rows.filter(a.contains(b) | b.contains(a))
    rows = rows.select(F.col(key).alias("_key"), "row", "_name", "_description")
    refs = pages.lateralJoin(references(F.col(html).outer())).select(F.col(key).alias("_of"), "place", "ref", "entry")
    # A description names few references; they meet by page and number.
    named = rows.select("_key", "row", F.explode(F.array_distinct(F.regexp_extract_all("_description", F.lit(r"(\[[0-9]+\])")))).alias("_ref"))
    told = named.join(refs, (F.col("_key") == F.col("_of")) & (F.col("_ref") == F.col("ref"))).groupBy("_key", "row").agg(F.array_sort(F.collect_list(F.struct("place", F.concat("ref", F.lit(": "), "entry").alias("line")))).alias("_told"))
    lines = F.array_join(F.transform("_told", lambda x: x["line"]), "\n")
    out = rows.join(told, ["_key", "row"], "left")
    augmented = F.when(F.col("_told").isNull(), F.col("_description")).otherwise(F.concat("_description", F.lit("\n\nReferences:\n"), lines))
    return out.select(F.col("_key").alias(key), "row", F.col("_name").alias("name"), F.col("_description").alias("description"), augmented.alias("augmented"))


def _by_automaton(names: list[str], texts: DataFrame, text_key: str, text: str) -> DataFrame:
    kind = texts.schema[text_key].dataType.simpleString()
    held = texts.sparkSession.sparkContext.broadcast(sorted(set(names)))

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = ahocorasick.Automaton()
        for name in held.value:
            found.add_word(name, name)
        found.make_automaton()
        for b in batches:
            rows = [(k, n) for k, t in zip(b[text_key], b[text]) for n in {n for _, n in found.iter(t)}]
            yield pd.DataFrame(rows, columns=[text_key, "_name"])

    if not names:
        return texts.select(text_key, F.lit("").alias("_name")).limit(0)
    return texts.select(text_key, text).mapInPandas(f, f"`{text_key}` {kind}, _name string")


def _by_windows(names: DataFrame, texts: DataFrame, text_key: str, text: str) -> DataFrame:
    """Names meet texts on their first characters, each name by the longest window that it fills."""
    n = names.select(F.col("_name"), F.least(F.length("_name"), F.lit(WINDOW)).alias("_size")).distinct()
    n = n.withColumn("_window", F.expr("left(_name, _size)"))
    sizes = F.array(*map(F.lit, range(1, WINDOW + 1)))
    per_size = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - s + 1, F.lit(1))), lambda at: F.substring(text, at, s))
    windows = F.array_distinct(F.flatten(F.transform(sizes, per_size)))
    w = texts.filter(F.length(text) > 0).select(text_key, text, F.explode(windows).alias("_at")).filter("_at <> ''")
    met = w.join(n, F.col("_at") == F.col("_window")).filter(F.col(text).contains(F.col("_name")))
    return met.select(text_key, "_name").distinct()


def names_in_texts(names: DataFrame, texts: DataFrame, name_key: str, name: str, text_key: str, text: str, most_chars: int = MOST_CHARS) -> DataFrame:
    """(name_key, text_key) where the text holds the name, each pair once; null and empty names are in none."""
    n = names.select(F.col(name_key), F.col(name).cast("string").alias("_own")).filter("_own <> ''")
    t = texts.select(F.col(text_key), F.col(text).cast("string").alias("_text")).filter("_text IS NOT NULL")
    distinct = n.select(F.col("_own").alias("_name")).distinct()
    size = distinct.agg(F.coalesce(F.sum(F.length("_name")), F.lit(0)).alias("chars")).first()["chars"]
    if size <= most_chars:
        found = _by_automaton([r["_name"] for r in distinct.collect()], t, text_key, "_text")
    else:
        found = _by_windows(distinct, t, text_key, "_text")
    return n.join(found, F.col("_own") == F.col("_name")).select(name_key, text_key).distinct()
