"""Texts of pages, some at a time."""

import pyarrow as pa
from pyspark.sql import functions as F

from quarrystone.sources import pages


def test_texts_leave_some_at_a_time(spark):
    d = spark.range(200).coalesce(1).select("id", F.when(F.col("id") % 9 == 0, None).otherwise(F.concat(F.lit("<div>"), F.repeat(F.lit("<div>a b"), 60), F.col("id").cast("string"))).alias("html"))
    got = {r["id"]: r["text"] for r in pages.with_text(d, "html").collect()}
    assert got == {r["id"]: pages.page_text(r["html"]) for r in d.collect()}
    batch = pa.RecordBatch.from_pydict({"html": ["<p>a"] * 200, "id": list(range(200))})
    parts = list(pages.texts_of([batch], ["id", "text"]))
    assert max(b.num_rows for b in parts) == pages.PAGES and [x for b in parts for x in b.column(0).to_pylist()] == list(range(200))
