"""Corpus pipeline: language, quality, near duplicates, packing.

Each stage takes all that its predecessor kept, written as Parquet and read again.

Defined results, of every stage: an empty table gives an empty result; the filters return rows as they
are, with any further columns whatever their names, and judge equal rows alike; ``doc_id`` and ``text``
may be null, other columns but those a stage names are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrystone.llm import langid, ngram_join, packing, quality_classifier
from quarrystone.llm.common import discard, materialize, shared_dir, table


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those spread over so many languages that none has a share.

    The model is learned from text and ``lang`` of all rows; rows where one is null teach nothing.  Null
    and empty texts go, so do all where nothing can be learned; very long texts are read whole.
    """
    return langid.in_known_language(docs, langid.learn(docs))


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, trained on the labels of ``docs``, rejects.

    Labels come by ``doc_id``; without any, and for empty or null texts, the score is the bias's.  A score
    at the threshold stays.
    """
    return quality_classifier.of_quality(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def by_similarity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest ``doc_id``.

    Texts without words are like no other and stay; of rows that repeat an id one stays, the one with
    the smallest text; rows without an id all stay.
    """
    return ngram_join.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences; a null or empty text is its end token alone."""
    return packing.pack_documents(docs)


STAGES = [("language_id", by_language), ("quality_classifier", by_quality), ("ngram_join", by_similarity), ("packing", pack)]

#: The models and the packing have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), folder, name)
        if before:
            discard(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
