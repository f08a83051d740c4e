"""Centroid clustering: Lloyd's rounds over distinct vectors with their multiplicities, in exact integers.

1. Vectors become integers; equal ones are grouped and counted, so that copies, however many, are one row from here on.
2. Every round assigns each distinct vector to its nearest centroid and sums its components, weighted by its copies: within
   batches in numpy, then a row for each cluster and component of a task, which Spark adds up. Only the centroids
   (``k`` times the number of components) come to the driver. Rounds after which nothing moved are not repeated.
3. Assignments of the distinct vectors are joined back to the ids by the vector's digest; the many rows of heavy vectors
   stay where they are.

Defined cases: rows whose vector is null, has another number of components, or a component that is null or not finite, are
left out; rows with a null id are clustered, but start a centroid only after all others; rows that share an id are vectors
of their own (of those that share a starting centroid's id, the one of least digest goes first); with fewer than ``k`` vectors
there are as many centroids; with none the result is empty; other columns are ignored. Sums of distances stop at a long's end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, looked_up, stash
from .vectors import quantised

SIZE, CENTROIDS, ROUNDS = 64, 8, 10
#: Rows whose distances are computed at once, and sums that surely fit a long.
SLICE, SAFE = 8192, 1 << 62


def _rows(embeddings: DataFrame, size: int) -> DataFrame:
    """vec_id, key (digest of the vector), vector (packed integers) of the rows that are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sound, starts, whole = quantised(batch.column("embedding"))
            kept = np.flatnonzero(sound & (np.diff(starts) == size))
            packed = [whole[starts[i] : starts[i + 1]].astype("<i4").tobytes() for i in kept]
            keys = [hashlib.sha256(x).digest() for x in packed]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(kept)), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], ["vec_id", "key", "vector"])

    plain = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    return plain.mapInArrow(run, "vec_id long, key binary, vector binary")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(len(column), size).astype(np.int64)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid, the first of equals."""
    distances = np.stack([np.square(vectors - c).sum(axis=1) for c in centroids], axis=1)
    best = distances.argmin(axis=1)
    return best, distances[np.arange(len(vectors)), best]


def _moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, size + 1), dtype=object)  # the last column counts; Python's integers don't overflow
        for batch in batches:
            vectors, n = _matrix(batch.column("vector"), size), batch.column("n").to_numpy()
            for at in range(0, len(n), SLICE):
                part, weight = vectors[at : at + SLICE], n[at : at + SLICE]
                if int(weight.sum()) * max(1, int(np.abs(part).max())) >= SAFE:
                    part, weight = part.astype(object), weight.astype(object)
                cluster = nearest(vectors[at : at + SLICE], centroids)[0]
                for c in np.unique(cluster):
                    of = cluster == c
                    sums[c, :size] += (part[of] * weight[of, None]).sum(axis=0).astype(object)
                    sums[c, size] += int(weight[of].sum())
        place = [(c, i) for c in range(k) for i in range(size + 1) if sums[c, size]]
        columns = [pa.array([c for c, _ in place], pa.int32()), pa.array([i for _, i in place], pa.int32()), pa.array([Decimal(int(sums[x])) for x in place], pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "component", "total"])

    parts = distinct.mapInArrow(run, "cluster int, component int, total decimal(38,0)")
    totals = {(r["cluster"], r["component"]): int(r["total"]) for r in parts.groupBy("cluster", "component").agg(F.sum("total").alias("total")).collect()}
    return np.array([[totals[c, i] // totals[c, size] for i in range(size)] if (c, size) in totals else list(centroids[c]) for c in range(k)], dtype=np.int64)


def clusters(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every kept row of embeddings(vec_id, embedding)."""
    spark = embeddings.sparkSession
    rows = _rows(embeddings, size)
    begin = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "key", "vector").orderBy(F.col("h").asc_nulls_last(), "key").limit(k).collect()
    with Scratch(spark) as scratch:
        distinct = scratch.stash(rows.groupBy("key", "vector").agg(F.count(F.lit(1)).alias("n")), "cluster-distinct")
        centroids = np.array([np.frombuffer(r["vector"], dtype="<i4") for r in begin], dtype=np.int64).reshape(len(begin), size)
        for _ in range(rounds if len(begin) else 0):
            before, centroids = centroids, _moved(distinct, centroids)
            if np.array_equal(before, centroids):
                break

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = _matrix(batch.column("vector"), size)
                for at in range(0, len(vectors), SLICE):
                    cluster, distance = nearest(vectors[at : at + SLICE], centroids)
                    some = batch.slice(at, SLICE)
                    yield pa.RecordBatch.from_arrays([some.column("key"), some.column("n"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["key", "n", "cluster", "distance"])

        assigned = stash(distinct.mapInArrow(assign, "key binary, n long, cluster int, distance long"), "cluster-assigned")
    whole = F.sum(F.col("n").cast("decimal(20,0)") * F.col("distance")).alias("inertia")
    inertia = {r["cluster"]: int(r["inertia"]) for r in assigned.groupBy("cluster").agg(whole).collect()}
    as_long = lambda x: min(x, (1 << 63) - 1)
    about = [(c, as_long(x), as_long(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, x in inertia.items()]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = looked_up(rows.select("vec_id", "key"), assigned, "key", "n", F.coalesce("vec_id", F.lit(0)))
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
