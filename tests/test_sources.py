"""Sources, sinks and streams on small files."""

import gzip
import io
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quarrystone.functions.constants import TABS
from quarrystone.sources import data_files, pages, providers, runs, sheets, tables
from quarrystone.streaming import cells


def test_tabs_have_their_columns():
    assert {k: len(v) for k, v in TABS.items()} == {"Jobs": 10, "Datasets": 33, "Projects": 6, "Project_Dataset_Link": 9, "Datasets_Quarantined": 33, "Links_Quarantined": 9, "Datasets_Duplicates_Log": 6, "Citations": 8, "WebLinks": 4}


def test_tables_round_trip(spark, tmp_path):
    root = str(tmp_path / "kb")
    assert tables.read_table(spark, root, "Projects").count() == 0
    d = spark.createDataFrame([("PROJ_A", None, "=1+1")], "ProjectID string, Name string, Description string")
    tables.write_table(d, root, "Projects")
    r = tables.read_table(spark, root, "Projects").first()
    assert (r["ProjectID"], r["Name"], r["Description"], r["Type"]) == ("PROJ_A", "", "'=1+1", "")
    tables.append_row(spark, root, "Jobs", {"JobID": "J1", "Operational_Parameters": {"a": 1}})
    tables.append_row(spark, root, "Jobs", {"JobID": "J2"})
    assert {(r["JobID"], r["Operational_Parameters"]) for r in tables.read_table(spark, root, "Jobs").collect()} == {("J1", '{"a": 1}'), ("J2", "")}
    tables.wipe_tables(spark, root)
    assert tables.read_table(spark, root, "Projects").count() == 0


def test_sheet_with_header_below(spark, tmp_path):
    f = tmp_path / "s.csv"
    f.write_text('note,,\nProjectID,Name,junk\nP1,"=HYPERLINK(""http://a"",""x"")",1\n')
    r = tables.read_sheet(spark, str(f), TABS["Projects"]).collect()
    assert [(x["ProjectID"], x["Name"], x["Type"]) for x in r] == [("P1", "http://a", "")]


def test_run_files_to_facts(spark, tmp_path):
    (tmp_path / "Bench_Lotsa_q_20260701_1200.csv").write_text("Dataset Name,Domain,Domain (C),Type\nETTh1,Energy,0.9,nan\nX,,0.1,Dataset\n")
    (tmp_path / "Bench_kaggle_q.csv").write_text("Dataset Name,Frequency\nY,\"daily, or so\"\n")
    d = runs.read_runs(spark, [str(p) for p in sorted(tmp_path.glob("*.csv"))])
    got = {(r["project"], r["stamp"], r["dataset"], r["field"], r["norm_value"]) for r in runs.facts(d).collect()}
    assert got == {("lotsa", "20260701_1200", "ETTh1", "Domain", "energy"), ("lotsa", "20260701_1200", "X", "Type", "dataset"), ("kagglets", "00000000_0000", "Y", "Frequency", "daily, or so")}
    out = str(tmp_path / "out")
    runs.export(spark.createDataFrame([], "a string"), out, {"Project": "P"}, {"Project": "P", "a": "NONE_FOUND"})
    assert spark.read.option("header", True).csv(out).first().asDict() == {"Project": "P", "a": "NONE_FOUND"}


def test_ordered_export(spark, tmp_path):
    rows = [(None, " x ", 1), ("b", "y\n\"z\"", 2), ("a", "", 3), ("a", "q,r", 4), ("b", None, 2), ("a", "q,r", 4)]
    d = spark.createDataFrame(rows, "k string, v string, n int").repartition(3)
    runs.export_ordered(d, str(tmp_path / "out"), ["k", "n"])
    got = [tuple(r) for r in runs.read_ordered(spark, str(tmp_path / "out")).orderBy("position").collect()]
    assert got == [(1, "", " x ", "1"), (2, "a", "", "3"), (3, "a", "q,r", "4"), (4, "a", "q,r", "4"), (5, "b", "", "2"), (6, "b", 'y\n"z"', "2")]
    runs.export_ordered(d.filter("n > 9"), str(tmp_path / "none"), ["k"])
    assert runs.read_ordered(spark, str(tmp_path / "none")).count() == 0


def test_log_heads_read_no_more(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with open(tmp_path / "in" / "big one.log", "wb") as f:
        f.write("é中\U0001f600x".encode() * 10)
        f.truncate(1 << 33)
    (tmp_path / "in" / "empty.log").write_text("")
    for path in (f"{tmp_path}/in", f"{tmp_path}/in/*.log"):
        got = {r["file"].rsplit("/", 1)[1].replace("%20", " "): r["text"] for r in runs.read_logs(spark, path, 7).collect()}
        assert got == {"big one.log": "é中\U0001f600xé中\U0001f600"}
    for head in (None, 7):
        assert runs.read_logs(spark, f"{tmp_path}/in/empty.log", head).count() == 0


def test_header_rows_of_many_sheets(spark):
    rows = [("a", 0, ["x"]), ("a", 1, ["id", "y"]), ("a", 2, ["id", "name", "z"]), ("a", 3, ["name", "id"]), ("b", 0, ["q", None]), ("b", 1, ["w"]), ("c", 0, None), ("c", 1, ["id", "id"]), ("c", 20, ["id", "name"])]
    rows += [("d", k, ["x"]) for k in range(10)] + [("d", 10, ["id", "name", "note"]), (None, 5, ["note"])]
    got = {r["sheet"]: (r["row"], r["overlap"]) for r in tables.header_rows(spark.createDataFrame(rows, "s string, row int, cells array<string>"), "s", "cells", "row", ["id", "name", "note"]).collect()}
    assert got == {"a": (2, 2), "b": (0, 0), "c": (20, 2), "d": (0, 0), None: (5, 1)}


def test_log_tables(spark, tmp_path):
    (tmp_path / "a.log").write_text("x\nProcessing Project: P1\n| Dataset Name | A | B |\n|---|---|---|\n| d1 | 1 | 2 | 3 |\n| nan | 1 | 2 |\n| short | 1 |\nProcessing Project: P2\n| d2 | 4 | 5 |")
    got = {(r["project"], r["dataset"], r["field"], r["value"]) for r in runs.markdown_tables(runs.lines(runs.read_logs(spark, str(tmp_path)), "file", "text"), "file").collect()}
    assert got == {("P1", "d1", "A", "1"), ("P1", "d1", "B", "2 | 3"), ("P2", "d2", "A", "4"), ("P2", "d2", "B", "5")}
    lines = spark.createDataFrame([("f", 0, "{'dataset': 'x', 'field': 'y', 'value': 'z'}"), ("f", 1, "a | b | c"), ("f", 2, "nothing")], "file string, line_no int, line string")
    assert {(r["dataset"], r["field"], r["value"]) for r in runs.pipe_facts(lines, "file").collect()} == {("x", "y", "z"), ("a", "b", "c")}


def test_page_text():
    assert pages.page_text("<div>a<p>b</p></div><script>no</script>" + "<p>w</p>" * 60).startswith("ab b w w")
    assert pages.page_text("<b>few</b> words<style>x</style>") == "few words" and pages.page_text(None) == ""
    assert pages.rows_of_table("<table><tr><td>1</td><td>2</td><td>3</td></tr><tr><td>x</td></tr></table>") == [["1", "2", "3"]]


def test_inspection(spark, tmp_path):
    (tmp_path / "a.csv").write_text("t;x;y\n1;2;3\n4;5;6\n")
    (tmp_path / "b.data").write_text("1 2\n3 4\n5 6\n")
    (tmp_path / "c.csv.gz").write_bytes(gzip.compress(b"a,b\n1,x\n"))
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("__MACOSX/x.csv", "1,2\n" * 99)
        f.writestr("d/in.csv", "k,v\n1,2\n")
    (tmp_path / "d.zip").write_bytes(z.getvalue())
    (tmp_path / "e.csv").write_text("<!DOCTYPE html><html></html>")
    (tmp_path / "g.zip").write_bytes(b"PK\x03\x04broken")
    got = {r["path"].rsplit("/", 1)[-1]: r for r in data_files.inspect_files(spark, str(tmp_path)).collect()}
    assert (got["a.csv"]["column_count"], got["a.csv"]["data_type_estimate"], got["a.csv"]["preview_rows_parsed"]) == (3, "Multivariate", 2)
    assert got["b.data"]["headers_sample"] == ["col_0", "col_1"] and got["b.data"]["preview_rows_parsed"] == 3
    assert (got["c.csv.gz"]["file_type"], got["c.csv.gz"]["data_type_estimate"]) == ("GZIP", "Univariate")
    assert got["d.zip"]["extracted_file_name"] == "in.csv" and got["e.csv"]["file_type"] == "HTML"
    assert data_files.inspect(b"", "f.csv")["status"] == got["g.zip"]["status"] == "ERROR"


def test_sheets(spark):
    p = spark.createDataFrame([(["a1", "x, y", "http://a, junk http://b", "d", "-1"],), (["b"],), ([""],)], "cells array<string>")
    got = {r["id"]: (r["links"], r["method"]) for r in sheets.projects(p, "cells").collect()}
    assert got == {"A1": (["http://a", "http://b"], -1), "B": ([], 1)}
    t = spark.createDataFrame([("PROJ_A", "one, Two", "see http://x.org/y"), ("PROJ_B", "three", "")], "id string, names string, note string")
    assert [r["urls"] for r in sheets.resolve(t, "id", "names", "two").collect()] == [["http://x.org/y"]]
    assert sheets.ensure_row(t, "id", "PROJ_LOST", {}).count() == 3 and sheets.ensure_row(t, "id", "PROJ_A", {}).count() == 2
    d = spark.createDataFrame([(1, "as [2] and [1] say [2]")], "k int, text string")
    refs = spark.createDataFrame([(1, "one"), (2, "two")], "ref int, entry string")
    assert sheets.cited(d, refs, "k", "text").first()["entries"] == ["one", "two"]


def test_disabled_provider(spark):
    d = spark.createDataFrame([("p",), ("p",)], "prompt string")
    assert [r["answer"] for r in providers.Disabled().apply(d).collect()] == [None, None]


def test_stream_equals_batch(spark, tmp_path):
    from quarrystone.operators.catalog import fold_updates

    rows = [(f"k{k % 3}", k, v, c) for k, (v, c) in enumerate([("[missing]", 0.9), ("a", 0.1), ("b", 0.5), ("c", 0.4), ("d", 0.99), ("e", 1.0), ("f", 0.2), ("g", 0.95), ("h", 1.0)])]
    schema = "key string, ord long, value string, confidence double"
    for k in range(3):
        spark.createDataFrame(rows[3 * k : 3 * k + 3], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    out = cells.run_once(cells.upsert_stream(stream), "cells_out", str(tmp_path / "ck"), "update").collect()
    want = {r["key"]: (r["value"], r["confidence"]) for r in fold_updates(spark.createDataFrame(rows, schema), ["key"], "ord").collect()}
    last = {}
    for r in out:
        last[r["key"]] = (r["value"], r["confidence"])
    assert last == want


def test_series_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("Timestamp,Elapsed_Seconds,Total_VRAM_GB\n00:00:00,0,1.5\n00:00:05,5,CONTAINER_DEAD\n")
    s = cells.read_series(spark, str(tmp_path / "in"), "Timestamp string, Elapsed_Seconds long, Total_VRAM_GB string")
    assert cells.run_once(cells.numeric_samples(s, "Total_VRAM_GB"), "series_out", str(tmp_path / "ck")).count() == 1


def test_windowed_stream(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts timestamp, event_type string, event_id long").parquet(str(tmp_path / "in"))
    got = cells.run_once(cells.windowed_counts(s, "ts", "event_type"), "windows_out", str(tmp_path / "ck"), "complete")
    assert got.agg(F.sum("n")).first()[0] == e.count()


@pytest.mark.parametrize("html, file", [('<a href="x/">d</a><a href="a.txt">a</a><a href="b.CSV">b</a>', "b.CSV"), ('<a href="x.bin">x</a>', "x.bin")])
def test_best_file(spark, html, file):
    d = spark.createDataFrame([(1, html)], "k int, html string")
    assert pages.best_file(d, "k", "html").first()["file"] == file


def test_chunks_overlap_equals_one_by_one(spark):
    import random
    import re

    from quarrystone.operators import retrieval

    r = random.Random(1)
    texts = [" ".join(" ".join("w" * r.randint(1, 3) for _ in range(r.randint(1, 9))) + r.choice([".", "!", "\n", ""]) for _ in range(r.randint(0, 30))) for _ in range(60)] + [None, "", " \n "]
    for size, overlap in ((12, 0), (12, 5), (12, 20), (3, 2)):
        want = {}
        for k, t in enumerate(texts):
            sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", t or "") if s.strip()]
            out, now = [], []
            words = lambda xs: sum(len(x.split()) for x in xs)
            for s in sentences:
                if now and words(now) + words([s]) > size:
                    out.append(" ".join(now))
                    back = []
                    while len(back) < len(now) and words(now[-len(back) - 1 :]) <= overlap and words(now[-len(back) - 1 :]) + words([s]) <= size:
                        back = now[-len(back) - 1 :]
                    now = back
                now = [*now, s]
            want[k] = out + [" ".join(now)] * bool(now)
        got = {k: [] for k in want}
        docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
        for x in sorted(retrieval.chunks(docs, "id", "text", size, overlap).collect(), key=lambda x: x["chunk"]):
            got[x["id"]].append(x["text"])
        assert got == want


def test_embedder(spark):
    import numpy as np

    class Broken(providers.Embedder):
        def ready(self):
            return False

        def embed(self, texts):
            raise RuntimeError

    e = providers.first_ready([Broken(), providers.HashedWords(8)])
    d = spark.createDataFrame([(1, "a b a"), (2, "a b a"), (3, " "), (4, None), (5, "b a a")], "id int, text string")
    got = {r["id"]: r["embedding"] for r in e.apply(d).collect()}
    assert got[1] == got[2] == got[5] and got[3] is None and got[4] is None and abs(np.linalg.norm(got[1]) - 1) < 1e-6 and len(got[1]) == 8
    with pytest.raises(LookupError):
        providers.first_ready([Broken()])


def test_files_of_stores_without_ranges(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    monkeypatch.setattr(data_files, "ranges_of", lambda *_: None)
    got = data_files.inspect_files(spark, str(tmp_path), largest=3).collect()
    assert [(r["status"], r["error"]) for r in got] == [("ERROR", "too large")]
    got = data_files.inspect_files(spark, str(tmp_path)).collect()
    assert [(r["status"], r["column_count"], r["bytes_read"]) for r in got] == [("SUCCESS", 2, 8)]


def test_a_large_archive_is_read_in_part(spark, tmp_path):
    rows = b"a,b,c\n" + b"1,2,3\n" * ((16 << 20) // 6)
    path = tmp_path / "large.zip"
    with zipfile.ZipFile(path, "w") as z:
        for k in range(3000):
            z.writestr(f"notes/{k}.md", "x")
        with z.open("in/big.csv", "w", force_zip64=True) as f:
            for _ in range(64):
                f.write(rows)
        z.writestr("small.csv", "x,y\n1,2\n")
    with gzip.open(tmp_path / "large.csv.gz", "wb", compresslevel=1) as f:
        f.write(rows)
    (tmp_path / "plain file, large.csv").write_bytes(rows)
    (tmp_path / "none.zip").write_bytes(b"PK\x05\x06" + b"\0" * 18)
    try:
        assert path.stat().st_size > 1 << 30
        got = {r["path"].rsplit("/", 1)[-1]: r for r in data_files.inspect_files(spark, str(tmp_path)).collect()}
        for name in ("large.zip", "large.csv.gz", "plain file, large.csv"):
            r = got[name]
            assert (r["status"], r["column_count"], r["preview_rows_parsed"]) == ("SUCCESS", 3, 1000), r
            assert 0 < r["bytes_read"] < 3_000_000
        assert got["large.zip"]["extracted_file_name"] == "big.csv" and got["none.zip"]["error"] == "no parsable member"
    finally:
        path.unlink()


def test_job_stream_equals_batch(spark, tmp_path):
    from quarrystone.operators.inventory import anchored_jobs

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    want = {(str(r["user_id"]), r["event_id"]): r["job"] for r in anchored_jobs(e, "user_id", "ts", "event_id").collect()}
    middle = sorted(r["ts"] for r in e.collect())[500]
    for part in (e.filter(F.col("ts") < F.lit(middle)), e.filter(F.col("ts") >= F.lit(middle))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = cells.run_once(cells.anchored_jobs_stream(s, "user_id", "ts", "event_id"), "jobs_out", str(tmp_path / "ck"))
    assert {(r["key"], r["o"]): r["job"] for r in got.collect()} == want


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_shuffled_job_stream_equals_batch(spark, tmp_path):
    from quarrystone.operators.inventory import anchored_jobs

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    want = {(str(r["user_id"]), r["event_id"]): r["job"] for r in anchored_jobs(e, "user_id", "ts", "event_id").collect()}
    last = spark.sql("SELECT -1L AS user_id, -1L AS event_id, TIMESTAMP '2024-06-01' AS ts")
    more = last.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))
    late = spark.sql("SELECT 1L AS user_id, -2L AS event_id, TIMESTAMP '2024-01-02' AS ts")
    mixed = F.pmod(F.xxhash64("event_id"), F.lit(3))
    for part in (e.filter(mixed == 2), e.filter(mixed == 0), e.filter(mixed == 1), last, more, late):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        got = cells.run_once(cells.ordered_jobs_stream(s, "user_id", "ts", "event_id", late="40 days"), "ordered_out", str(tmp_path / "ck")).collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert len(got) == len(want) and {(r["key"], r["o"]): r["job"] for r in got} == want


def test_each_key_once_within_the_watermark(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:05"), ("b", "2024-01-01 00:00:01"), (None, "2024-01-01 00:00:02"), (None, "2024-01-01 00:00:03")]
    d = spark.createDataFrame(rows, "k string, ts string").select("k", F.to_timestamp("ts").alias("ts"))
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    got = cells.run_once(cells.unseen(s, "k", "ts"), "unseen_out", str(tmp_path / "ck")).collect()
    assert sorted(str(r["k"]) for r in got) == ["None", "a", "b"]


def test_cooldown_stream(spark, tmp_path):
    rows = [("a", 1, "2024-01-01 00:00:00"), ("a", 2, "2024-01-01 00:00:30"), ("a", 3, "2024-01-01 00:01:00"), ("b", 4, "2024-01-01 00:00:10"), ("a", 5, None)]
    d = spark.createDataFrame(rows, "k string, o long, ts string").select("k", "o", F.to_timestamp("ts").alias("ts"))
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    got = cells.run_once(cells.not_cooling(s, "k", "ts", "o", 60), "cool_out", str(tmp_path / "ck")).collect()
    assert {(r["key"], r["o"]) for r in got} == {("a", 1), ("a", 3), ("b", 4)}
