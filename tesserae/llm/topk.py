"""Exact search for the vectors of highest integer inner product by MaxScore.

A component is a term, a shard (a batch of rows) has a posting for each: the components of its rows, kept as row numbers and
values where most are zero. What a term can add to a score is bounded by the query's component and the posting's extremes.
With the shard's terms in order of that bound, those whose bounds together stay below the query's current threshold are
non-essential: a row that scores nothing on the others can't be among the best. So the essential postings are traversed, and
the remaining terms are probed, highest bound first, only for rows that may still compete. A task keeps the best of all its
shards for each query, so thresholds rise from shard to shard; tasks' bests are merged by query.

Queries are a stated part of the rows. They go to all tasks in blocks of about ``BLOCK`` components, a block at a time, and each
block reads the rows once; no row is shuffled.

Defined cases: rows whose vector is null, or has a component that is null or not finite, are neither queries nor found; of
vectors of different lengths the components that both have count; a query without other rows has no result; rows that
share a query's id are the query's own, and of several such the least vector asks; a row with a null id may be found and is last
among equal scores; repeated rows are found each; scores are exact as long as they fit a long; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh_path
from .vectors import LARGEST, quantised

BEST, EVERY = 10, 100
#: Components of a block of queries and of a shard; share of zeros from which a posting is kept by row numbers.
BLOCK, SHARD, SPARSE = 1 << 20, 1 << 20, 0.75
EXACT = 1 << 53


class Shard:
    """Rows of one length with a posting for each component."""

    def __init__(self, ids: np.ndarray, is_null: np.ndarray, rows: np.ndarray):
        self.ids, self.is_null, self.size = ids, is_null, rows.shape[1]
        self.low, self.high = rows.min(axis=0), rows.max(axis=0)
        self.largest = int(max(-self.low.min(), self.high.max(), 1)) if self.size else 1
        self.kind = np.float64 if self.largest * LARGEST * max(1, self.size) < EXACT else np.int64
        columns = np.ascontiguousarray(rows.T)
        filled = np.count_nonzero(columns, axis=1)
        self.postings = []
        for column, n in zip(columns, filled, strict=True):
            at = np.flatnonzero(column) if n <= (1 - SPARSE) * len(ids) else None
            self.postings.append((at, (column if at is None else column[at]).astype(self.kind)))

    def traverse(self, term: int, weight: int, scores: np.ndarray) -> None:
        at, values = self.postings[term]
        if at is None:
            scores += weight * values
        else:
            scores[at] += weight * values

    def probe(self, term: int, weight: int, rows: np.ndarray, scores: np.ndarray) -> None:
        at, values = self.postings[term]
        if at is None:
            scores += weight * values[rows]
        elif len(at):
            place = np.minimum(np.searchsorted(at, rows), len(at) - 1)
            scores += np.where(at[place] == rows, weight * values[place], 0)

    def competing(self, query: np.ndarray, threshold: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows that score at least ``threshold``, if there is one, and their scores."""
        query = query[: self.size]
        bounds = np.maximum(np.maximum(query * self.low[: len(query)], query * self.high[: len(query)]), 0)
        order = np.argsort(bounds, kind="stable")
        reach = np.cumsum(bounds[order])
        spare = 0 if threshold is None else int(np.searchsorted(reach, threshold, side="left"))
        if spare and spare == len(order):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        scores = np.zeros(len(self.ids), dtype=self.kind)
        for term in order[spare:]:
            if query[term]:
                self.traverse(term, query[term], scores)
        if threshold is None:
            return np.arange(len(scores)), scores.astype(np.int64)
        rows = np.flatnonzero(scores + (reach[spare - 1] if spare else 0) >= threshold)
        scores = scores[rows]
        for i in range(spare - 1, -1, -1):
            if not len(rows):
                break
            self.probe(order[i], query[order[i]], rows, scores)
            good = scores + (reach[i - 1] if i else 0) >= threshold
            rows, scores = rows[good], scores[good]
        return rows, scores.astype(np.int64)


class Best:
    """The ``k`` highest scores of a query so far, ties by id, nulls last."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.is_null = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    @property
    def threshold(self) -> int | None:
        return int(self.scores[-1]) if len(self.scores) == self.k else None

    def add(self, scores: np.ndarray, ids: np.ndarray, is_null: np.ndarray) -> None:
        scores, ids, is_null = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.is_null, is_null])
        if len(scores) > self.k:
            near = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids, is_null = scores[near], ids[near], is_null[near]
        first = np.lexsort((ids, is_null, -scores))[: self.k]
        self.scores, self.ids, self.is_null = scores[first], ids[first], is_null[first]


def _shards(batch: pa.RecordBatch) -> Iterator[Shard]:
    sound, starts, whole = quantised(batch.column("embedding"))
    given = batch.column("vec_id")
    is_null = given.is_null().to_numpy(zero_copy_only=False)
    ids, lengths = given.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.diff(starts)
    for size in np.unique(lengths[sound]):
        all_rows = np.flatnonzero(sound & (lengths == size))
        step = max(1, SHARD // max(1, int(size)))
        for at in range(0, len(all_rows), step):
            rows = all_rows[at : at + step]
            yield Shard(ids[rows], is_null[rows], whole[starts[rows][:, None] + np.arange(size)])


def _searched(batches: Iterator[pa.RecordBatch], asked: list[tuple[int, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    bests = [Best(k) for _ in asked]
    for batch in batches:
        for shard in _shards(batch):
            for (own, query), best in zip(asked, bests, strict=True):
                rows, scores = shard.competing(query, best.threshold)
                if len(rows):
                    others = (shard.ids[rows] != own) | shard.is_null[rows]
                    rows = rows[others]
                    best.add(scores[others], shard.ids[rows], shard.is_null[rows])
    if not asked:
        return
    n = [len(b.scores) for b in bests]
    ids = pa.array(np.concatenate([b.ids for b in bests]), mask=np.concatenate([b.is_null for b in bests]))
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([i for i, _ in asked], dtype=np.int64), n)), ids, pa.array(np.concatenate([b.scores for b in bests]))], ["query_id", "vec_id", "score"])


def top_k(embeddings: DataFrame, k: int = BEST, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id ``every`` divides, the ``k`` other rows of highest inner product."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    with Scratch(spark) as scratch:
        finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        asking = rows.filter(F.col("vec_id") % every == 0).filter(F.col("embedding").isNotNull() & finite).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        asking = scratch.stash(asking, "search-queries")
        components = asking.agg(F.sum(F.size("embedding") + 1)).first()[0] or 0
        blocks = max(1, -(-components // BLOCK))
        parts = fresh_path(spark, "search-parts")
        for b in range(blocks):
            block = asking.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toArrow().combine_chunks()
            vectors = block.column("embedding").combine_chunks()
            _, starts, whole = quantised(vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors)
            asked = [(own, whole[starts[i] : starts[i + 1]]) for i, own in enumerate(block.column("vec_id").to_pylist())]
            found = rows.mapInArrow(lambda batches, asked=asked: _searched(batches, asked, k), "query_id long, vec_id long, score long")
            found.write.mode("append").parquet(parts)
    merged = spark.read.schema("query_id long, vec_id long, score long").parquet(parts)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return merged.withColumn("rank", place.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
