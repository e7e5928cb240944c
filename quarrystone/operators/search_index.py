"""A text index that stays: postings in blocks with bounds of their scores, in a versioned table.

Documents come in batches; a batch is tokenised once, and its postings are appended, with the numbers of documents and
words so far in the version's note, so that a reader sees both of one version.  A bucket is a run of about
``BUCKET`` documents of a task, so blocks are made where the documents are read; a block holds the postings of a term in
a bucket, with the most occurrences, the shortest document and the most texts of one id in it.  Whatever the later
numbers of documents and words, these bound the score that the term gives to any document of the block.

A search brings the blocks of its terms together by bucket, and a task goes through its buckets: the sum of the
bounds over a query's terms bounds every document of a bucket, and a query whose k-th best score so far is above
it leaves the bucket out.  Of ``FIRST`` buckets at a time that with the best bounds is scored first.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarrystone.sources.store import Conflict, Store

from .retrieval import top_k
from .term_scores import K1, Asked, B, Best, arrow_kind, asked_blocks, counted, weigher, whole_words
from .work import folder, written

#: Documents of a bucket, about, and the buckets of a task that are put in order of their bounds.
BUCKET, FIRST = 256, 4


def postings(docs: DataFrame, id_: str, text: str, batch: str) -> DataFrame:
    """(term, bucket, n, words, max_tf, min_dl, most, docs): blocks of a batch, bucket by bucket, sorted by term in each."""
    kind, arrow_id, size = docs.schema[id_].dataType.simpleString(), arrow_kind(docs, id_), BUCKET

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for b in batches:
            for lo in range(0, b.num_rows, size):
                ids, lists = b.column(0).slice(lo, size), b.column(1).slice(lo, size)
                number += 1
                row, dl, code, tf, words = counted(lists)
                if not len(row):
                    continue
                place = np.empty(len(words), np.int64)
                place[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
                order = np.lexsort((row, place[code]))
                row, dl, code, tf = row[order], dl[order], code[order], tf[order]
                first = np.flatnonzero(np.diff(place[code], prepend=-1))
                ends = pa.array(np.append(first, len(code)), pa.int32())
                # Texts of one id in a block: a run of equal rows of one term.
                run = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(place[code], prepend=-1))
                texts = np.repeat(np.diff(np.append(run, len(row))), np.diff(np.append(run, len(row))))
                entries = pa.StructArray.from_arrays([ids.take(pa.array(row)), pa.array(tf, pa.int64()), pa.array(dl, pa.int64())], ["id", "tf", "dl"])
                yield pa.RecordBatch.from_arrays(
                    [words.take(pa.array(code[first])), pa.array([f"{batch}-{TaskContext.get().partitionId()}-{number}"] * len(first)), pa.array(np.diff(np.append(first, len(code))), pa.int64()), pa.array(np.add.reduceat(tf, first), pa.int64()),
                     pa.array(np.maximum.reduceat(tf, first), pa.int64()), pa.array(np.minimum.reduceat(dl, first), pa.int64()), pa.array(np.maximum.reduceat(texts, first), pa.int64()), pa.ListArray.from_arrays(ends, entries)],
                    ["term", "bucket", "n", "words", "max_tf", "min_dl", "most", "docs"],
                )

    return whole_words(docs, id_, text).mapInArrow(blocks, f"term string, bucket string, n long, words long, max_tf long, min_dl long, most long, docs array<struct<id:{kind},tf:long,dl:long>>")


class SearchIndex:
    """An index in a table of a store; several drivers may add batches."""

    def __init__(self, store: Store, table: str = "postings"):
        self.store, self.table = store, table

    def add(self, docs: DataFrame, id_: str, text: str, tries: int = 50) -> dict:
        """Appends a batch of new documents; their ids must not be in the index yet."""
        batch, path = uuid.uuid4().hex[:12], folder(docs.sparkSession)
        n = docs.count()
        made = written(postings(docs, id_, text, batch), path, "batch")
        # Every occurrence of a term is one of a document's words.
        words = made.agg(F.sum("words")).first()[0] or 0
        for k in range(tries):
            seen = self.store.latest(self.table)
            so_far = seen["note"] if seen else {"n": 0, "words": 0}
            try:
                return self.store.commit(self.table, made, seen, append=True, note={"n": so_far["n"] + n, "words": so_far["words"] + words})
            except Conflict:
                if k == tries - 1:
                    raise
        raise ValueError("no tries")

    def search(self, queries: DataFrame, query_id: str, query_text: str, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
        """(query_id, rank, id, score): BM25, of the documents that share a term with a query."""
        version = self.store.latest(self.table)
        if version is None:
            raise LookupError("nothing is indexed")
        blocks, note = self.store.read(self.table, version), version["note"]
        kind = queries.schema[query_id].dataType
        found = [_searched(blocks, note, asked, kind, max(1, k), k1, b) for asked in asked_blocks(queries, query_id, query_text)]
        if found:
            return reduce(DataFrame.unionByName, found)
        return queries.limit(0).join(blocks.select(F.inline("docs")).limit(0)).select(F.col(query_id).alias("query_id"), F.lit(0).cast("long").alias("rank"), "id", F.lit(0.0).alias("score"))


def _searched(blocks: DataFrame, note: dict, asked: Asked, query_type, k: int, k1: float, b: float) -> DataFrame:
    path, spark = folder(blocks.sparkSession), blocks.sparkSession
    numbers = written(spark.createDataFrame([(t, n) for n, t in enumerate(asked.terms)], "term string, _t int"), path, "terms")
    mine = blocks.join(numbers, "term")
    df = {r[0]: r[1] for r in mine.groupBy("_t").agg(F.sum("n").alias("n")).collect()}
    weight = weigher(df, len(asked.terms), note["n"], note["words"], k1, b)
    docs = blocks.schema["docs"].dataType.elementType["id"].dataType
    names, arrow_id, first = pa.array(asked.names, to_arrow_type(query_type)), to_arrow_type(docs), FIRST

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, open_, held = Best(asked, arrow_id, k), None, []
        for batch in batches:
            left = pa.Table.from_batches([batch]) if open_ is None else pa.concat_tables([open_, pa.Table.from_batches([batch])]).combine_chunks()
            bucket = left["bucket"].combine_chunks().dictionary_encode().indices.to_numpy(False)
            at = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
            for lo, hi in zip(at[:-2], at[1:-1]):
                held.append(bounded(left.slice(lo, hi - lo)))
                if len(held) == first:
                    score(held, kept)
                    held = []
            # The last bucket may go on in the next batch.
            open_ = left.slice(at[-2]) if len(at) > 1 else None
        score(held + ([bounded(open_)] if open_ is not None else []), kept)
        yield from kept.rows(names)

    def bounded(bucket: pa.Table) -> tuple[np.ndarray, pa.Table]:
        term, tf, dl, most = (bucket[c].to_numpy().astype(np.int64) for c in ("_t", "max_tf", "min_dl", "most"))
        return asked.sums(np.zeros(len(term), np.int64), term, weight(term, tf, dl) * most, 1)[0], bucket

    def score(buckets: list, kept: Best) -> None:
        for bound, bucket in sorted(buckets, key=lambda x: -x[0].sum()):
            wanted = (bound > 0) & (bound >= kept.least - 1e-6)
            if wanted.any():
                documents(bucket, wanted, kept)

    def documents(bucket: pa.Table, wanted: np.ndarray, kept: Best) -> None:
        lists = bucket["docs"].combine_chunks()
        entries = lists.flatten()
        term = np.repeat(bucket["_t"].to_numpy().astype(np.int64), lists.value_lengths().to_numpy(False))
        tf, dl = (entries.field(c).to_numpy(False) for c in ("tf", "dl"))
        ids = entries.field("id").dictionary_encode("encode")
        row, known = ids.indices.to_numpy(False).astype(np.int64), ids.dictionary
        order = np.lexsort((dl, term, row))
        row, term, w = row[order], term[order], weight(term, tf, dl)[order]
        for lo in range(0, len(known), asked.step()):
            n = min(asked.step(), len(known) - lo)
            a, z = np.searchsorted(row, [lo, lo + n])
            kept.take(np.where(wanted, asked.sums(row[a:z] - lo, term[a:z], w[a:z], n), 0), known.slice(lo, n))

    met = mine.select("bucket", "_t", "max_tf", "min_dl", "most", "docs").repartition("bucket").sortWithinPartitions("bucket", "_t")
    found = met.mapInArrow(best, f"query_id {query_type.simpleString()}, id {docs.simpleString()}, score double")
    return written(top_k(found, "query_id", "score", "id", k).select("query_id", "rank", "id", "score"), path, "best")
