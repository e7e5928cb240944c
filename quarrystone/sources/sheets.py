"""Registry sheets: expert hints, projects, and the lookup of one project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.text import hyperlink_label, strip, text_or_empty, urls_of


def hints(rows: DataFrame, cells: str, order: str) -> DataFrame:
    """One row a hint of ``[type, keyword, hint, ...]``, with a reference of its own."""
    d = rows.select(order, F.get(cells, 0).alias("type"), F.get(cells, 1).alias("keyword"), F.posexplode(F.slice(cells, 3, 1 << 30)).alias("_k", "hint"))
    return d.filter(strip(text_or_empty("hint")) != "").select("type", "keyword", "hint", F.format_string("HINT_%d_%d", F.col(order), F.col("_k")).alias("ref_id"))


def projects(rows: DataFrame, cells: str) -> DataFrame:
    """id, names, links, description, method of ``[id, names, links, description, method]``; short rows are padded."""
    at = lambda k: strip(text_or_empty(F.get(cells, k)))
    links = F.filter(F.transform(F.split(at(2), r"[,\s]+"), strip), lambda u: u.startswith("http"))
    d = rows.select(F.upper(at(0)).alias("id"), at(1).alias("names"), links.alias("links"), at(3).alias("description"), F.coalesce(at(4).try_cast("int"), F.lit(1)).alias("method"))
    return d.filter("id <> ''").withColumn("context", F.concat_ws(" - ", F.nullif("names", F.lit("")), F.nullif("description", F.lit(""))))


def resolve(rows: DataFrame, id_: str, names: str, wanted: str) -> DataFrame:
    """Rows whose id or one of whose names is ``wanted``, with all URLs that any column holds."""
    w = wanted.lower().strip().removeprefix("proj_")
    by_id = F.regexp_replace(F.lower(strip(hyperlink_label(id_))), "^proj_", "") == w
    by_name = F.array_contains(F.transform(F.split(F.lower(text_or_empty(names)), ","), strip), w)
    every = F.array_distinct(F.flatten(F.array(*[urls_of(F.col(f"`{c}`").cast("string")) for c in rows.columns])))
    return rows.filter(by_id | by_name).withColumn("urls", every)


def ensure_row(table: DataFrame, key: str, value: str, row: dict[str, str]) -> DataFrame:
    """Adds ``row`` where the key's value is absent."""
    spark = table.sparkSession
    new = spark.createDataFrame([[row.get(c, value if c == key else "") for c in table.columns]], ", ".join(f"`{c}` string" for c in table.columns))
    return table.unionByName(new.join(table.select(key), key, "left_anti").select(*table.columns))


def in_project(name: Column, project: Column) -> Column:
    """Whether either of two names holds the other."""
    a, b = F.lower(strip(text_or_empty(name))), F.lower(strip(text_or_empty(project)))
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def cited(descriptions: DataFrame, references: DataFrame, key: str, text: str, mark: str = r"\[([0-9]+)\]") -> DataFrame:
    """References named in a text as ``[n]``, joined to their entries by number."""
    d = descriptions.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text_or_empty(text), F.lit(mark)))).alias("ref"))
    joined = d.join(references.select(F.col("ref").cast("string").alias("ref"), "entry"), "ref")
    return joined.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("ref").cast("int").alias("r"), "entry"))), lambda x: x["entry"]).alias("entries"))
