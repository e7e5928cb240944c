"""The page source: batch and stream, filters, first record of each id."""

from pyspark.sql import functions as F

from quarrystone.sources import harvest, store


def write(spark, path, rows, mode="append"):
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.mode(mode).option("parquet.block.row.count.limit", 2).parquet(str(path))


def test_batch_with_filters(spark, tmp_path):
    for lo in (0, 10, 20):
        write(spark, tmp_path / "p", [(k, f"u{k}", "h") for k in range(lo, lo + 5)])
    d = harvest.read_pages(spark, str(tmp_path / "p"))
    assert sorted(r["page_id"] for r in d.collect()) == [*range(5), *range(10, 15), *range(20, 25)]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = harvest.read_pages(spark, str(tmp_path / "p")).filter("page_id > 11 AND page_id <= 20 AND url <> 'u13'")
        assert sorted(r["page_id"] for r in some.collect()) == [12, 14, 20]
        assert some.rdd.getNumPartitions() == 4 and harvest.read_pages(spark, str(tmp_path / "p")).filter("page_id = 99").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_stream_goes_on_and_equals_batch(spark, tmp_path):
    at = store.Store(spark, str(tmp_path / "kb"))
    record = lambda d: d.select((F.col("page_id") % 4).alias("id"), "page_id", "url")
    for lo in (8, 0, 20):
        write(spark, tmp_path / "p", [(k, f"u{k}", None) for k in range(lo, lo + 3)])
        got = harvest.harvest_stream(record(harvest.stream_pages(spark, str(tmp_path / "p"))), at, "r", "id", "page_id", str(tmp_path / "ck"))
        want = harvest.first_records(record(harvest.read_pages(spark, str(tmp_path / "p"))), "id", "page_id")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert [v["number"] for v in at.versions("r")] == [1, 2, 3]
