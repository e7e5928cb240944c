"""Run files: wide CSV files of extractions to long facts, tables inside console logs, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.functions.constants import SCHEMA_MAP
from quarrystone.functions.text import head_of, normalize, project_of_file, stamp_of_file, strip, text_or_empty
from quarrystone.operators.inventory import carry_forward
from quarrystone.sources.data_files import heads

NO_VALUES = ("", "nan", "none", "[missing]", "unknown")


def read_csv(spark: SparkSession, path: str, recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """Header CSV as text, with its file's path."""
    r = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"')
    if recursive:
        r = r.option("recursiveFileLookup", True)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r.csv(path).select("*", F.col("_metadata.file_path").alias("_path"))


def read_runs(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Wide run files, each with its own header; columns are aligned by name."""
    out = None
    for p in paths:
        one = read_csv(spark, p)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def facts(wide: DataFrame, name: str = "Dataset Name", path: str = "_path", source: str = "Discovery Source", skip: Sequence[str] = ("Project", "Benchmark_Model", "Completeness (High Conf %)")) -> DataFrame:
    """One row a filled cell: project, dataset, field, value, normal form, confidence and file, runs not numbered yet."""
    drop = {name, path, source, *skip}
    fields = [c for c in wide.columns if c not in drop and not c.endswith((" (C)", " (Telemetry)"))]
    have = set(wide.columns)
    cell = lambda c: F.struct(F.lit(SCHEMA_MAP.get(c, c)).alias("field"), F.col(f"`{c}`").alias("value"), (F.col(f"`{c} (C)`") if f"{c} (C)" in have else F.lit(None).cast("string")).alias("confidence"))
    file = F.regexp_extract(path, "([^/]*)$", 1)
    project = F.lower(F.regexp_extract(file, r"(?i)Bench_([A-Za-z0-9\-]+)_", 1))
    project = F.when(F.lower(file).contains("kaggle"), "kagglets").when(project != "", project).otherwise("unknown")
    d = wide.select(
        project.alias("project"), F.col(f"`{name}`").alias("dataset"), (F.col(f"`{source}`") if source in have else F.lit(None).cast("string")).alias("source"), stamp_of_file(file).alias("stamp"), file.alias("file"),
        F.inline(F.array(*[cell(c) for c in fields])),
    )
    return d.withColumn("norm_value", normalize("value")).filter(~F.col("norm_value").isin(*NO_VALUES) & (strip(text_or_empty("dataset")) != ""))


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line) in exact order."""
    return texts.select(key, F.posexplode(F.split(text_or_empty(text), "\r?\n")).alias("line_no", "line"))


def read_logs(spark: SparkSession, path: str, head: int | None = None) -> DataFrame:
    """One row a file, whole or its first ``head`` characters, with its path; of a head only its bytes are read.  Empty files have no row."""
    if head is None:
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    # A character has four bytes at most, so the cut falls behind the head.
    return heads(spark, path, 4 * head).select("file", head_of(F.col("head").cast("string"), head).alias("text"))


def cells_of(line: Column) -> Column:
    """Stripped cells of a table row between pipes."""
    inner = F.regexp_replace(strip(line), r"^\|+|\|+$", "")
    return F.transform(F.split(inner, r"\|"), strip)


def is_row(line: Column) -> Column:
    return strip(line).startswith("|") & strip(line).endswith("|") & (F.length(strip(line)) > 1)


def markdown_tables(numbered: DataFrame, key: str, titles: Sequence[str] = ("Dataset Name", "Dataset"), project_mark: str | None = r"Processing Project:\s*(\S+)") -> DataFrame:
    """Unpivoted tables of logs: key, line_no, project, dataset, field, value.

    A row with one of ``titles`` is the header of the rows behind it; cells beyond the header's last
    column belong to it; alignment rows, rows of fewer than three cells and unnamed ones go.
    """
    d = numbered.withColumn("_row", is_row(F.col("line"))).withColumn("_c", F.when(F.col("_row"), cells_of(F.col("line"))))
    head = F.when(F.arrays_overlap("_c", F.array(*map(F.lit, titles))), F.col("_c"))
    d = carry_forward(d, key, "line_no", head, "_head")
    mark = F.nullif(F.regexp_extract("line", project_mark, 1), F.lit("")) if project_mark else F.lit(None).cast("string")
    d = carry_forward(d, key, "line_no", mark, "project")
    body = d.filter(F.col("_row") & head.isNull() & F.col("_head").isNotNull() & (F.size("_c") >= 3) & ~F.col("_c")[0].startswith("---") & ~F.lower(F.col("_c")[0]).isin("nan", "unknown", ""))
    n = F.size("_head")
    values = F.transform(F.sequence(F.lit(1), F.least(n, F.size("_c")) - 1), lambda i: F.struct(F.get("_head", i).alias("field"), F.when(i < n - 1, F.get("_c", i)).otherwise(F.array_join(F.slice("_c", i + 1, F.greatest(F.size("_c") - i, F.lit(1))), " | ")).alias("value")))
    out = body.filter(n >= 2).select(key, "line_no", "project", F.col("_c")[0].alias("dataset"), F.inline(values))
    return out.filter(~F.col("field").isin("Project", "Unnamed: 0", ""))


def pipe_facts(numbered: DataFrame, key: str) -> DataFrame:
    """Facts of lines that hold a dictionary or a pipe-separated record of dataset, field and value."""
    a = lambda g: F.nullif(F.regexp_extract("line", r"'dataset':\s*'([^']*)',\s*'field':\s*'([^']*)',\s*'value':\s*'([^']*)'", g), F.lit(""))
    b = lambda g: F.nullif(F.regexp_extract("line", r"^\s*([^|{]+?)\s*\|\s*([^|]+?)\s*\|\s*([^|]+?)\s*$", g), F.lit(""))
    return numbered.select(key, "line_no", F.coalesce(a(1), b(1)).alias("dataset"), F.coalesce(a(2), b(2)).alias("field"), F.coalesce(a(3), b(3)).alias("value")).dropna(subset=["dataset", "field", "value"])


def research_table(numbered: DataFrame, key: str, confidence: float = 0.85, title: str = "Dataset Name") -> DataFrame:
    """Cells of the table of a report: ``|||`` stands for a bar, the header names ``title``, a blank line ends it."""
    d = numbered.withColumn("line", F.replace(F.col("line"), F.lit("|||"), F.lit("|")))
    head = F.when(F.col("line").contains(title) & F.col("line").contains("|"), cells_of(F.col("line")))
    d = carry_forward(d, key, "line_no", head, "_head")
    ended = F.when(F.col("_head").isNotNull() & (strip(F.col("line")) == ""), F.lit(1)).otherwise(0)
    d = d.withColumn("_ended", F.sum(ended).over(Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    body = d.filter(F.col("_head").isNotNull() & head.isNull() & (F.col("_ended") == 0) & F.col("line").contains("|") & ~F.col("line").rlike(r"^[\s|:-]+$"))
    zipped = F.arrays_zip(F.col("_head").alias("field"), cells_of(F.col("line")).alias("value"))
    out = body.select(key, "line_no", F.inline(zipped)).filter(F.col("field").isNotNull() & F.col("value").isNotNull() & (F.col("value") != ""))
    return out.withColumn("confidence", F.lit(confidence))


def export(rows: DataFrame, path: str, prepend: dict[str, str] | None = None, empty_row: dict[str, str] | None = None) -> None:
    """Writes text CSV: numbers that are none are empty; an empty result gives the stub row, if one is given."""
    spark = rows.sparkSession
    text = [F.when(F.lower(F.col(f"`{c}`").cast("string")).isin("nan", "inf", "-inf", "infinity", "-infinity", "none"), "").otherwise(text_or_empty(F.col(f"`{c}`"))).alias(c) for c in rows.columns]
    out = rows.select(*[F.lit(v).alias(k) for k, v in (prepend or {}).items()], *text)
    if empty_row is not None and out.isEmpty():
        out = spark.createDataFrame([[empty_row.get(c, "") for c in out.columns]], ", ".join(f"`{c}` string" for c in out.columns))
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_ordered(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    """Writes text CSV in order of ``by`` (null first; ties by the other columns): within files, and over files by their names.

    Ranges are cut by all columns, so that a key of very many rows is several files.
    """
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in (*by, *(c for c in rows.columns if c not in by))]
    text = [text_or_empty(F.col(f"`{c}`")).alias(c) for c in rows.columns]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*text)
    # Spaces around a value are part of it.
    ordered.write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_ordered(spark: SparkSession, path: str, position: str = "position") -> DataFrame:
    """The rows of such a table with their ``position`` in it, from 1; an empty table has no rows.

    A file is one task's, as values may hold line ends, and its rows are numbered as they come; only the files' counts meet in one place.
    """
    columns = read_csv(spark, path).drop("_path").columns
    if not columns:
        return spark.createDataFrame([], f"`{position}` long")
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    placed = read.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns], F.col("_metadata.file_name").alias("_f"), F.monotonically_increasing_id().alias("_k"))
    counts = placed.groupBy("_f").agg(F.count(F.lit(1)).alias("_n"), F.min("_k").alias("_first"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_f")) - F.col("_n")).drop("_n")
    return placed.join(before, "_f").select((F.col("_before") + F.col("_k") - F.col("_first") + 1).alias(position), *[F.col(f"`{c}`") for c in columns])


def project_name(path: str | Column) -> Column:
    return project_of_file(path)
