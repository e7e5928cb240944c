"""Web pages: text, embedded JSON, listings and repository records."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.functions.text import frequency, strip, text_or_empty

#: Elements whose text counts; an element inside another one repeats its text.
ELEMENTS = ("p", "table", "li", "h1", "h2", "h3", "h4", "div", "span", "pre", "code")
LEAST_WORDS = 50
#: Pages of which a task holds the texts at once.
PAGES = 64
#: Least words of a page that was loaded by its address.
LOADED_WORDS = 15
#: Elements whose text may be the label of a number.
LABELS = ("h1", "h2", "h3", "p", "span", "div")
#: Parsable file endings by preference.
PRIORITY = {"csv": 10, "tsv": 9, "txt": 8, "data": 8, "zip": 7, "gz": 6}


class _Text(HTMLParser):
    """Text of every counted element, in the order of their start; scripts and styles hold none."""

    void = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str] | None]] = []
        self.parts: list[list[str]] = []
        self.all: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.void:
            return
        self.hidden += tag in ("script", "style")
        mine = [] if tag in ELEMENTS else None
        if mine is not None:
            self.parts.append(mine)
        self.open.append((tag, mine))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.hidden -= sum(t in ("script", "style") for t, _ in self.open[k:])
                del self.open[k:]
                return

    def handle_data(self, data):
        if self.hidden or not data.strip():
            return
        self.all.append(data)
        for _, mine in self.open:
            if mine is not None:
                mine.append(data)


def page_text(html: str | None) -> str:
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    text = " ".join("".join(p) for p in parser.parts if p)
    if len(text.split()) < LEAST_WORDS:
        text = " ".join(parser.all)
    return re.sub(r"\s+", " ", text).strip()


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    """Text of a page: of its counted elements, of the whole page where those hold few words."""
    return html.map(page_text)


def texts_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches with the text of the first column behind the others, ``PAGES`` rows at most in each."""
    for b in batches:
        for lo in range(0, b.num_rows, PAGES):
            part = b.slice(lo, PAGES)
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([page_text(x) for x in part.column(0).to_pylist()], pa.string())], names)


def with_text(pages: DataFrame, html: str, text: str = "text") -> DataFrame:
    """The other columns and the text of each page, which may be many times the page; texts leave a task some at a time."""
    kept = [c for c in pages.columns if c != html]
    schema = T.StructType([*[pages.schema[c] for c in kept], T.StructField(text, T.StringType())])
    return pages.select(html, *kept).mapInArrow(lambda batches: texts_of(batches, [*kept, text]), schema)


def loaded(pages: DataFrame, text: str, least: int = LOADED_WORDS) -> DataFrame:
    """Pages with enough words."""
    return pages.filter(F.size(F.split(strip(text_or_empty(text)), r"\s+")) >= least)


def embedded_json(html: Column | str) -> Column:
    """JSON of the page's data script, else of the body of its JSON script; null without either."""
    h = text_or_empty(html)
    next_ = F.regexp_extract(h, r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    other = F.regexp_extract(h, r'(?s)<script[^>]*type="application/json"[^>]*>(.*?)</script>', 1)
    body = F.get_json_object(F.get_json_object(other, "$.body"), "$[0].result.data.json")
    return F.coalesce(F.get_json_object(next_, "$.props.pageProps.dataset"), body)


def repository_record(json_: Column) -> Column:
    """Record of an embedded JSON: id, name, description, counts, area, types, task and DOI, by either spelling."""
    get = lambda *names: F.coalesce(*[F.get_json_object(json_, f"$.{n}") for n in names])
    return F.struct(
        get("ID", "id").try_cast("long").alias("id"), strip(text_or_empty(get("Name", "name"))).alias("name"), get("Abstract", "abstract").alias("description"),
        get("NumInstances", "numInstances").try_cast("long").alias("instances"), get("NumFeatures", "numFeatures").try_cast("long").alias("features"),
        get("Area", "area").alias("area"), F.transform(F.split(text_or_empty(get("Types", "types", "characteristics")), ","), strip).alias("types"), get("Task", "task").alias("task"), get("DOI", "doi").alias("doi"), frequency(get("Abstract", "abstract")).alias("frequency"),
    )


def is_time_series(types: Column) -> Column:
    return F.array_contains(F.transform(types, F.lower), F.lit("time-series"))


def links(html: Column | str) -> Column:
    """Link targets in order, each once."""
    return F.array_distinct(F.regexp_extract_all(text_or_empty(html), F.lit(r'(?i)href\s*=\s*["\']([^"\'#]+)["\']')))


def best_file(pages: DataFrame, key: str, html: str) -> DataFrame:
    """The linked file of a listing by preference of its ending, the first of equals; folders do not count."""
    d = pages.select(key, F.posexplode(links(html)).alias("_pos", "file"))
    ending = F.lower(F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1))
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), ending), F.lit(5))
    ok = ~F.col("file").endswith("/") & ~F.col("file").startswith("?") & ~F.col("file").rlike(r"(?i)readme|license|index\.html?$")
    return d.filter(ok).groupBy(key).agg(F.max_by("file", F.struct(rank, -F.col("_pos"))).alias("file"))


def standard_keys(records: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns under one name each, taken from the first spelling that is there."""
    have = {c.lower(): c for c in records.columns}
    return records.select(*[F.coalesce(*[F.col(f"`{have[s.lower()]}`") for s in spellings if s.lower() in have], F.lit(None)).alias(n) for n, spellings in names.items()])


def rows_of_table(html: str | None) -> list[list[str]]:
    """Cells of the table with most rows of at least three cells."""
    best: list[list[str]] = []
    for table in re.findall(r"(?is)<table.*?</table>", html or ""):
        rows = [[page_text(c) for c in re.findall(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>", r)] for r in re.findall(r"(?is)<tr.*?</tr>", table)]
        rows = [r for r in rows if len(r) >= 3]
        if len(rows) > len(best):
            best = rows
    return best


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def table_rows(html: pd.Series) -> pd.Series:
    return html.map(rows_of_table)


class _Parents(HTMLParser):
    """Texts of labels' elements with those of the elements around them, in the order of the labels' start."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        #: Open elements and their texts; the page itself comes first.
        self.open: list[list] = [["", []]]
        #: (parts of the label's text, parts of its parent's).
        self.found: list[tuple[list[str], list[str]]] = []

    def handle_starttag(self, tag, attrs):
        if tag in _Text.void:
            return
        parts: list[str] = []
        if tag in LABELS:
            self.found.append((parts, self.open[-1][1]))
        self.open.append([tag, parts])

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        if data.strip():
            for _, parts in self.open:
                parts.append(data.strip())


def labelled_number(html: str | None, label: str) -> int | None:
    """Last number of the element around the first label that has one; for features, else the rows of the first table of variables."""
    parser = _Parents()
    parser.feed(html or "")
    parser.close()
    for own, around in parser.found:
        text = "".join(own).lower()
        if text == label or f"number of {label}" in text:
            if digits := re.findall("[0-9]+", " ".join(around)):
                return int(digits[-1])
    if label == "features":
        for table in re.findall(r"(?is)<table.*?</table>", html or ""):
            head = re.search(r"(?is)<th[^>]*>(.*?)</th>", table)
            rows = len(re.findall(r"(?is)<tr\b", table))
            if head and re.search("(?i)variable|feature", head[1]) and rows > 1:
                return rows - 1
    return None


@F.pandas_udf(T.StructType([T.StructField("instances", T.LongType()), T.StructField("features", T.LongType())]))
def page_numbers(html: pd.Series) -> pd.DataFrame:
    """Counts of instances and features that a page shows; null where it shows none."""
    return pd.DataFrame({"instances": html.map(lambda h: labelled_number(h, "instances")).astype("Int64"), "features": html.map(lambda h: labelled_number(h, "features")).astype("Int64")})


def variable_table(headers: Column, rows: Column) -> Column:
    """Variables as a pipe table."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = line(F.transform(headers, lambda _: F.lit("---")))
    return F.array_join(F.concat(F.array(line(headers), rule), F.transform(rows, line)), "\n")
