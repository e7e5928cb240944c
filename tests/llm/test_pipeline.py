"""Each pipeline stage on odd rows, and against plain versions."""

import pytest

import corpus_pipeline
from quarrystone.llm import langid, quality_classifier
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"
FILTERS = corpus_pipeline.STAGES[:-1]


@pytest.fixture
def clashing(spark):
    """Odd texts, one very long, with null and repeated ids, repeated rows, and columns with names that stages use."""
    rows = [(k, t, "en", "s", 1, 0.5, "x", 7) for k, t in enumerate(ODD)] + [(None, "no id here at all", "de", None, None, None, None, None)] * 2
    rows += [(3, "one", "en", "s", 1, 0.5, "x", 7)] * 2 + [(3, "another text of one id", None, "s", 1, 0.5, "x", 7), (50, "long words here " * 70_000, "en", "s", 1, 0.5, "x", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, _row string, component_id long")


@pytest.mark.parametrize("name, stage", FILTERS)
def test_filters_keep_rows_as_they_are(spark, clashing, name, stage):
    kept = stage(spark, clashing, SF)
    assert kept.schema == clashing.schema
    given, got = ([tuple(r) for r in d.collect()] for d in (clashing, kept))
    assert all(got.count(r) <= given.count(r) for r in got) and stage(spark, clashing.limit(0), SF).count() == 0
    if name == "ngram_join":
        assert [r[1] for r in got if r[0] == 3] == ["another text of one id"] and sum(r[0] is None for r in got) == 2
        assert {r[0] for r in got} == {None, *range(len(ODD)), 50}


def test_language_stage_equals_plain_rule(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs)
    rows = docs.collect()
    want = {r["doc_id"] for r, (lang, score, _) in zip(rows, langid.identify(model, [r["text"] or "" for r in rows])) if lang != langid.UNKNOWN and score >= langid.KEEP_AT}
    assert {r["doc_id"] for r in corpus_pipeline.by_language(spark, docs, SF).collect()} == want
    assert {r["doc_id"] for r in rows if any(c.isalpha() for c in r["text"] or "")} >= want


def test_quality_stage_equals_plain_rule(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    weights = quality_classifier.fit(docs, labels)
    want = {r["doc_id"] for r in docs.collect() if quality_classifier.score(weights, r["text"] or "") >= quality_classifier.PREDICT_AT}
    assert {r["doc_id"] for r in corpus_pipeline.by_quality(spark, docs, SF).collect()} == want and len(want) < docs.count()


def test_packing_stage_takes_odd_rows(spark, clashing):
    rows = corpus_pipeline.pack(spark, clashing, SF).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in clashing.collect()}
    assert corpus_pipeline.pack(spark, clashing.limit(0), SF).count() == 0
