"""Inspection of data files: delimited text, also in gzip and ZIP, by ranges of their bytes.

Spark lists the files and deals them to tasks; a task opens each and reads its head, or an archive's directory at
its end and the start of one member, never the whole file, so size does not matter.  Stores that only Spark
reads have no ranges: there, files up to ``LARGEST`` bytes are read whole by Spark and larger ones refused.
"""

from __future__ import annotations

import csv
import gzip
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT = T.StructType([
    T.StructField("status", T.StringType()), T.StructField("file_type", T.StringType()), T.StructField("column_count", T.IntegerType()), T.StructField("headers_sample", T.ArrayType(T.StringType())),
    T.StructField("data_type_estimate", T.StringType()), T.StructField("preview_rows_parsed", T.IntegerType()), T.StructField("extracted_file_name", T.StringType()), T.StructField("error", T.StringType()),
])
ROWS, SAMPLE, LARGEST = 1000, 10, 50 << 20
#: Bytes of a file, or of what an archive holds, that are parsed.
HEAD = 1 << 20
ENDINGS = (".csv", ".tsv", ".txt", ".data", ".dat")


def _failed(kind: str, why: str) -> dict:
    return {"status": "ERROR", "file_type": kind, "column_count": None, "headers_sample": None, "data_type_estimate": None, "preview_rows_parsed": None, "extracted_file_name": None, "error": why}


def _number(x: str) -> bool:
    try:
        float(x)
        return True
    except ValueError:
        return False


def inspect_delimited(content: bytes, name: str, kind: str = "DELIMITED") -> dict:
    """Columns, header and kind of series of a delimited text; a first row of numbers alone is no header."""
    text = content.decode("utf-8", "replace").lstrip("﻿")
    try:
        sep = csv.Sniffer().sniff(text[:8192], ",;\t| ").delimiter
    except csv.Error:
        sep = "\t" if name.endswith(".tsv") else ","
    rows = []
    for row in csv.reader(io.StringIO(text), delimiter=sep, skipinitialspace=sep == " "):
        if row:
            rows.append(row)
        if len(rows) > ROWS:
            break
    if not rows:
        return _failed(kind, "empty")
    width = max(set(map(len, rows)), key=lambda n: (sum(len(r) == n for r in rows), n))
    rows = [r for r in rows if len(r) == width]
    headless = all(_number(c) for c in rows[0])
    head = [f"col_{k}" for k in range(width)] if headless else [c.strip() for c in rows[0]]
    body = rows if headless else rows[1:]
    numeric = sum(bool(body) and all(_number(r[k]) or not r[k].strip() for r in body) for k in range(width))
    return {
        "status": "SUCCESS", "file_type": kind, "column_count": width, "headers_sample": head[:SAMPLE], "data_type_estimate": "Multivariate" if numeric > 1 else "Univariate",
        "preview_rows_parsed": min(len(body), ROWS), "extracted_file_name": name.rsplit("/", 1)[-1], "error": None,
    }


class Ranged(io.RawIOBase):
    """A file of a store, read where it is asked for only; ``taken`` counts the bytes."""

    def __init__(self, file, size: int):
        self.file, self.length, self.at, self.taken = file, size, 0, 0

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = max(0, offset + (0, self.at, self.length)[whence])
        return self.at

    def read(self, n: int = -1) -> bytes:
        n = max(0, self.length - self.at) if n is None or n < 0 else min(n, max(0, self.length - self.at))
        self.file.seek(self.at)
        got = self.file.read(n)
        self.at += len(got)
        self.taken += len(got)
        return got

    def readinto(self, into) -> int:
        got = self.read(len(into))
        into[: len(got)] = got
        return len(got)


def parsable_member(z: zipfile.ZipFile) -> zipfile.ZipInfo | None:
    """The largest member with one of the endings; hidden ones and folders do not count."""
    found = [m for m in z.infolist() if not m.is_dir() and "__MACOSX" not in m.filename and not m.filename.rsplit("/", 1)[-1].startswith(".") and m.filename.lower().endswith(ENDINGS)]
    return max(found, key=lambda m: m.file_size, default=None)


def inspect_file(file: io.IOBase, name: str) -> dict:
    """Dispatch by the first bytes: HTML is refused, archives give their largest parsable member."""
    try:
        start = file.read(512)
        if not start:
            return _failed("UNKNOWN", "empty")
        if start.lstrip().lower().startswith((b"<!doctype html", b"<html")):
            return _failed("HTML", "a page, no data file")
        file.seek(0)
        if start[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
            with zipfile.ZipFile(file) as z:
                best = parsable_member(z)
                if best is None:
                    return _failed("ZIP", "no parsable member")
                with z.open(best) as f:
                    return inspect_delimited(f.read(HEAD), best.filename, "ZIP")
        if start[:2] == b"\x1f\x8b":
            with gzip.GzipFile(fileobj=file) as f:
                return inspect_delimited(f.read(HEAD), name.removesuffix(".gz"), "GZIP")
        return inspect_delimited(file.read(HEAD), name)
    except Exception as e:  # a broken file is a result of its own
        return _failed("UNKNOWN", f"{type(e).__name__}: {e}"[:200])


def inspect(content: bytes | None, name: str) -> dict:
    return inspect_file(io.BytesIO(content or b""), name)


@F.pandas_udf(RESULT)
def inspected(content: pd.Series, name: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([inspect(c, n or "") for c, n in zip(content, name)])


def listed(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, length, content) of all files below a path; content is read only where it is used."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (r.option("pathGlobFilter", pattern) if pattern else r).load(path)


def ranges_of(spark: SparkSession, path: str) -> tuple[str, str] | None:
    """How a path of Spark's begins and how its files begin where tasks can read ranges; None for other stores."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    at = files.makeQualified(at)
    real = files.resolvePath(at).toString()
    try:
        arrow_fs.FileSystem.from_uri(real)
    except (OSError, NotImplementedError, ValueError):
        return None
    return at.toString(), real


def opened(shown: str, real: str, name: str):
    """The file ``name`` of a listing below ``shown``, for reading by ranges, as a task sees it at ``real``."""
    # The listing writes file:/x where the path says file:///x.
    below = name.split(shown.split(":", 1)[1].lstrip("/"), 1)[1]
    store, at = arrow_fs.FileSystem.from_uri(real)
    return store.open_input_file(at + below)


def heads(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(file, head): the first ``size`` bytes of all files below a path or pattern; no more is read where the store has ranges."""
    files = listed(spark, path)
    base = re.split(r"[*?\[{]", path)[0]
    known = ranges_of(spark, path if base == path else base.rsplit("/", 1)[0] or "/")
    if known is None:
        return files.select(F.col("_metadata.file_path").alias("file"), F.substring("content", 1, size).alias("head"))
    shown, real = (x.rstrip("/") for x in known)

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, name in zip(batch["file"], batch["path"]):
                with opened(shown, real, name) as got:
                    yield pd.DataFrame({"file": [file], "head": [got.read(size)]})

    return files.select(F.col("_metadata.file_path").alias("file"), "path").mapInPandas(f, "file string, head binary")


def inspect_files(spark: SparkSession, path: str, pattern: str | None = None, largest: int = LARGEST) -> DataFrame:
    """Inspects all files below a path: (path, length, bytes_read, result)."""
    files, known = listed(spark, path, pattern), ranges_of(spark, path)
    if known is None:
        read = files.filter(F.col("length") <= largest).select("path", "length", F.col("length").alias("bytes_read"), inspected("content", "path").alias("result"))
        refused = F.struct(*[F.lit({"status": "ERROR", "file_type": "UNKNOWN", "error": "too large"}.get(f.name)).cast(f.dataType).alias(f.name) for f in RESULT])
        rest = files.filter(F.col("length") > largest).select("path", "length", F.lit(0).cast("long").alias("bytes_read"), refused.alias("result"))
        return read.unionByName(rest).select("path", "length", "bytes_read", "result.*")
    shown, real = (x.rstrip("/") for x in known)
    names = [f.name for f in RESULT]

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, length in zip(batch["path"], batch["length"]):
                with opened(shown, real, name) as file:
                    ranged = Ranged(file, int(length))
                    found = inspect_file(ranged, name)
                out.append((name, length, ranged.taken, *(found[n] for n in names)))
            yield pd.DataFrame(out, columns=["path", "length", "bytes_read", *names])

    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("length", T.LongType()), T.StructField("bytes_read", T.LongType()), *RESULT.fields])
    return files.select("path", "length").mapInPandas(f, schema)


def write_archives(df: DataFrame, path: str, rows: int = 1000, member: str = "data.csv") -> DataFrame:
    """Writes the rows as ZIP files of one CSV of at most ``rows`` rows each, by the tasks that hold them; (path, n) of each."""
    spark, columns = df.sparkSession, df.columns
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    known = ranges_of(spark, path)
    if known is None:
        raise ValueError(f"tasks cannot write files to {path}")

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        store, at = arrow_fs.FileSystem.from_uri(known[1])
        for batch in batches:
            for k in range(0, len(batch), rows):
                rows_of = batch.iloc[k : k + rows]
                packed = io.BytesIO()
                with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(member, rows_of.to_csv(index=False, columns=columns))
                # A task that is run again writes the same names anew.
                name = f"{at.rstrip('/')}/part-{part:05d}-{n:05d}.zip"
                with store.open_output_stream(name) as out:
                    out.write(packed.getvalue())
                n += 1
                yield pd.DataFrame({"path": [name], "n": [len(rows_of)]})

    return df.mapInPandas(f, "path string, n long")


def raw_url(url):
    """Address of a repository's raw file for the address of its page."""
    return F.regexp_replace(F.replace(url, F.lit("/blob/"), F.lit("/")), r"^https?://github\.com/", "https://raw.githubusercontent.com/")
