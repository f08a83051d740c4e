"""Near-duplicate documents: many universal hash minima, banding, verification, connected components.

1. One pass gives each document its set's size and key and the minima of its shingles under universal hash functions.
   Documents with equal sets form a class, so exact copies, however many, are one row from here on. A class keeps its
   bands and a sketch: the low bytes of its minima, and a bitmap with a bit for each of its shingles' hash values. Two
   bitmaps differ in no more bits than the sets in shingles, so that test of pairs loses none; it is sharp for sets of
   up to some thousand shingles, the minima are for larger ones.
2. Bands of the minima put classes into buckets. A bucket's members are not paired with each other but with a few
   pivots, the same for all buckets of a group where possible, so candidates grow with the number of members. Pairs
   must have sizes and sketches that allow the similarity.
3. The remaining candidates are confirmed on their full sets.
4. Links are joined to components by alternating stars. A bucket that still holds several components may hide links
   between members that are no pivots. Its members outside its largest component are compared with those members of
   other components whose sizes allow the similarity: sizes are in classes of which only neighbours can be similar, and
   the members of a class in blocks of ``BLOCK``, so a row goes to the blocks that it must face, no task holds more
   than two blocks at once and only pairs that may be similar leave a block; these are confirmed as before. Thus every
   pair that shares a bucket is tested, excluded by size or already in one component, whatever the bucket's size.

With 32 bands of 5 minima a pair at the threshold of 0.8 shares no bucket with a probability of 3e-6.

Defined cases: null, empty and blank texts have empty sets, linked with nothing; documents with fewer words than a
shingle have their whole sequence as one shingle; rows with equal ids are the same document; a row with a null id is
linked with nothing and is its own (null) component, kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, drop, freed, looked_up, short_batches, stash, text_of
from .graph import components
from .modular import PRIME, mulmod, powers, sums
from .modular import mix as _mix

BANDS, ROWS = 32, 5
MINIMA = BANDS * ROWS
PIVOTS = 4
BLOCK = 1024
BITS = 2048

_generator = np.random.Generator(np.random.PCG64(20_240_229))
#: h(x) = (a x + b mod 2**64) >> 32 for 32-bit x: strongly universal. b is added after the minimum's candidates are odd.
_A = (_generator.integers(1, 1 << 63, MINIMA, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _generator.integers(0, 1 << 63, MINIMA, dtype=np.uint64)
_BASE = np.uint64(0x9FB21C651E98DF25)
_POINT = int(_generator.integers(1 << 40, PRIME))
_POWERS = powers(_POINT, np.arange(64), PRIME)
_VALUE = _generator.integers(1, PRIME, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[32, *range(9, 14)]] = False


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = powers(_POINT, np.arange(max(n, 2 * len(_POWERS))), PRIME)
    return _POWERS


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words in order: polynomials modulo a prime at a random point, over a random value for each byte, A-Z as a-z."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    inside = _IN_WORD[raw]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    lengths = edges[1::2] - edges[::2]
    if not len(lengths):
        return np.zeros(0, dtype=np.uint64)
    first = np.cumsum(lengths) - lengths
    letters = raw[inside]
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    hashed = sums(mulmod(_VALUE[letters], _powers(int(lengths.max()))[place], PRIME), first)
    return _mix(hashed ^ (lengths.astype(np.uint64) << np.uint64(40)))


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct shingles."""
    h = word_hashes(text)
    if not len(h):
        return h
    width = min(shingle, len(h))
    rolled = np.zeros(len(h) - width + 1, dtype=np.uint64)
    for i in range(width):
        rolled = _mix(rolled + h[i : len(h) - width + 1 + i] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(rolled if width == shingle else _mix(rolled ^ np.uint64(width)))


def minima(hashes: np.ndarray) -> np.ndarray:
    x = _mix(hashes) >> np.uint64(32)
    out = np.full(MINIMA, ~np.uint64(0))
    for i in range(0, len(x), 512):
        np.minimum(out, (x[None, i : i + 512] * _A[:, None] + _B[:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, dtype=bool)
    bits[(_mix(hashes ^ _BASE) % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(bits)


def bands_of(least: np.ndarray) -> np.ndarray:
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        h = _mix(h * _BASE + column)
    return h.view(np.int64)


def _signed(document: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n, key (of the set), bands, sketch; the last three null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            sizes, keys, bands, sketches = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, shingle)
                least = minima(s) if len(s) else None
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(bands_of(least) if len(s) else None)
                sketches.append(bitmap(s).tobytes() + least.astype(np.uint8).tobytes() if len(s) else None)
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "key", "bands", "sketch"])

    return document.mapInArrow(run, "doc_id long, n long, key binary, bands array<long>, sketch binary")


def _sets(document: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            sets = [shingle_set(t, shingle).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["id", "hashes"])

    wanted = broadcast_if_small(ids, 500_000)
    rows = document.join(wanted, document["doc_id"] == wanted["id"], "left_semi")
    return rows.mapInArrow(run, "id long, hashes binary").dropDuplicates(["id"])


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in freed(batches):
        good_a, good_b = [], []
        for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y")), strict=True):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= percent * (len(x) + len(y) - common):
                good_a.append(a)
                good_b.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(good_a, pa.int64()), pa.array(good_b, pa.int64())], ["a", "b"])


def _sketches(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps as 64-bit words and minima as bytes, a row each."""
    rows = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), BITS // 8 + MINIMA)
    return np.ascontiguousarray(rows[:, : BITS // 8]).view(np.uint64), rows[:, BITS // 8 :]


def _similar(n: np.ndarray, m: np.ndarray, x: tuple, y: tuple, percent: int) -> np.ndarray:
    """Which pairs' sizes and sketches allow the similarity; the minima may be six standard deviations below it."""
    p = percent / 100
    least = int(MINIMA * p - 6 * (MINIMA * p * (1 - p)) ** 0.5)
    differ = np.bitwise_count(x[0] ^ y[0]).sum(axis=1, dtype=np.int64)
    fits = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((100 + percent) * differ <= (100 - percent) * (n + m))
    return fits & (np.count_nonzero(x[1] == y[1], axis=1) >= least)


def _verified(document: DataFrame, classes: DataFrame, pairs: DataFrame, shingle: int, percent: int, scratch: Scratch) -> DataFrame | None:
    """Those of pairs(a, b) whose full sets are similar enough; None if the sketches leave no candidate."""
    sign = classes.select("id", "n", "sketch")
    joined = pairs.join(sign.toDF("a", "n_a", "x"), "a").join(sign.toDF("b", "n_b", "y"), "b").select("a", "b", "n_a", "n_b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            good = pa.array(_similar(n, m, _sketches(batch.column("x")), _sketches(batch.column("y")), percent))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in ("a", "b")], ["a", "b"])

    return _confirmed(document, scratch.stash(joined.mapInArrow(run, "a long, b long"), "near-likely"), shingle, percent, scratch)


def _confirmed(document: DataFrame, likely: DataFrame, shingle: int, percent: int, scratch: Scratch) -> DataFrame | None:
    ids = scratch.stash(likely.select(F.col("a").alias("id")).union(likely.select(F.col("b").alias("id"))).distinct(), "near-ids")
    if ids.isEmpty():
        return None
    sets = scratch.stash(_sets(document, ids, shingle), "near-sets")
    full = likely.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return scratch.stash(full.mapInArrow(lambda batches: _confirm(batches, percent), "a long, b long"), "near-links")


def _pairs(members: DataFrame, pivots: DataFrame) -> DataFrame:
    """members(bucket, id) with pivots(bucket, pivot), each pair once."""
    joined = members.join(pivots, "bucket").filter("id != pivot")
    return joined.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()


def _faced(few: pa.Table, many: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block's rows with another's that differ in component and whose sizes and sketches allow the similarity."""
    columns = lambda rows: (*(rows.column(c).to_numpy() for c in ("id", "n", "component")), *_sketches(rows.column("sketch")))
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    ids, n, component, bits, least = columns(many)
    for i, size, own, its_bits, its_least in zip(*columns(few), strict=True):
        at = np.flatnonzero((component != own) & (100 * np.minimum(n, size) >= percent * np.maximum(n, size)))
        at = at[_similar(n[at], size, (bits[at], least[at]), (its_bits, its_least), percent)]
        left.append(np.full(len(at), i))
        right.append(ids[at])
    return np.concatenate(left), np.concatenate(right)


def _across(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by ``meeting``, the few of it before the many; a meeting may begin in one batch and end in another."""

    def met(rows: pa.Table) -> pa.RecordBatch:
        x, y = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        meeting = rows.column("meeting").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(meeting)) + 1).tolist(), len(meeting)] if len(meeting) else [0]
        for a, b in zip(edges, edges[1:], strict=False):
            group = rows.slice(a, b - a)
            n_many = int(np.count_nonzero(group.column("is_many").to_numpy(zero_copy_only=False)))
            if 0 < n_many < b - a:
                left, right = _faced(group.slice(0, b - a - n_many), group.slice(b - a - n_many), percent)
                x.append(left)
                y.append(right)
        x, y = np.concatenate(x), np.concatenate(y)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    pending = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if pending is None else pa.concat_tables([pending, rows])
        meeting = rows.column("meeting").to_numpy()
        if not len(meeting):
            continue
        last = int(np.flatnonzero(np.diff(meeting))[-1]) + 1 if (meeting != meeting[0]).any() else 0
        pending = rows.slice(last)
        if last:
            yield met(rows.slice(0, last))
    if pending is not None and len(pending):
        yield met(pending)


def _hidden(classes: DataFrame, members: DataFrame, label: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): pairs across the components of each bucket of members(bucket, id, members) that may be similar."""
    labelled = members.filter("members > 2").select("bucket", "id").join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("part"))
    mixed = parts.groupBy("bucket").agg(F.max(F.struct("part", "component")).alias("largest"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    mixed = scratch.stash(mixed.select("bucket", F.col("largest.component").alias("largest")), "near-mixed")
    # Neighbours of a size class reach a little beyond the similarity, so that rounding can't part two sizes.
    size_class = F.floor(F.log("n") / math.log(100 / percent * 1.0001)).cast("int") if percent < 100 else F.col("n").cast("int")
    inside = labelled.join(mixed, "bucket").join(classes.select("id", "n", "sketch"), "id")
    inside = scratch.stash(inside.select("bucket", size_class.alias("size_class"), "id", "n", "component", "sketch", (F.col("component") != F.col("largest")).alias("apart"), F.xxhash64("id").alias("h")), "near-open")
    counts = inside.groupBy("bucket", "size_class").agg(F.count(F.lit(1)).alias("many"), F.count_if("apart").alias("few"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    counts = scratch.stash(counts.select("bucket", "size_class", blocks("many").alias("many_blocks"), blocks("few").alias("few_blocks")), "near-counts")
    block = lambda c: F.pmod(F.col("h"), F.col(c)).cast("int")
    placed = inside.join(counts, ["bucket", "size_class"]).withColumn("many_block", block("many_blocks")).withColumn("few_block", F.when(F.col("apart"), block("few_blocks")))
    numbered = lambda c: F.explode(F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)))
    few = counts.select("bucket", F.col("size_class").alias("few_class"), numbered("few_blocks").alias("few_block"))
    many = counts.select("bucket", F.col("size_class").alias("many_class"), numbered("many_blocks").alias("many_block"))
    meetings = few.join(many, "bucket").filter(F.abs(F.col("few_class") - F.col("many_class")) <= 1).withColumn("meeting", F.xxhash64("bucket", "few_class", "few_block", "many_class", "many_block"))
    meetings = scratch.stash(meetings, "near-meetings")
    row = ["id", "n", "component", "sketch"]
    of_few = placed.filter("apart").join(meetings.withColumnRenamed("few_class", "size_class").drop("many_block"), ["bucket", "size_class", "few_block"]).select("meeting", F.lit(False).alias("is_many"), *row)
    of_many = placed.join(meetings.withColumnRenamed("many_class", "size_class").drop("few_block"), ["bucket", "size_class", "many_block"]).select("meeting", F.lit(True).alias("is_many"), *row)
    facing = of_few.unionByName(of_many).repartition("meeting").sortWithinPartitions("meeting", "is_many")
    return facing.mapInArrow(lambda batches: _across(batches, percent), "a long, b long").distinct()


def _links(document: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Verified links between classes, enough of them for the components.

    What is joined by bucket or id is written first where it is an aggregate, so that a join reads two plain exchanges,
    which adaptive execution can split where a bucket is hot.
    """
    with Scratch(document.sparkSession) as scratch:
        banded = classes.select("id", F.explode("bands").alias("bucket"))
        shared = scratch.stash(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "near-shared")
        members = scratch.stash(banded.join(shared, "bucket"), "near-members")
        seeded = lambda i: F.min_by("id", F.xxhash64("id", F.lit(i)))
        pivots = members.groupBy("bucket").agg(F.array_distinct(F.array(*[seeded(i) for i in range(PIVOTS)])).alias("ps")).select("bucket", F.explode("ps").alias("pivot"))
        tested = scratch.stash(_pairs(members.select("bucket", "id"), scratch.stash(pivots, "near-pivots")), "near-pairs")
        links = _verified(document, classes, tested, shingle, percent, scratch)
        if links is None:
            links = tested.limit(0)
        label = components(links)
        fresh = scratch.stash(_hidden(classes, members, label, percent, scratch).join(tested, ["a", "b"], "left_anti"), "near-hidden")
        drop(label)
        more = _confirmed(document, fresh, shingle, percent, scratch)
        return stash(links if more is None else links.unionByName(more), "near-links")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (the least id of its component) for every row of docs(doc_id, text)."""
    short_batches(docs.sparkSession)
    document = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    signed = stash(_signed(document, shingle), "near-signed")
    some = signed.filter("n > 0 and doc_id is not null")
    classes = stash(some.groupBy("key").agg(F.min("doc_id").alias("id"), F.max("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies")), "near-classes")
    links = _links(document, classes, shingle, percent)
    label = components(links).withColumnRenamed("node", "id")
    # Only classes of several copies or with a link need their component looked up, by key.
    known = classes.select("key", "id", "copies").join(label, "id", "left").filter("copies > 1 or component is not null")
    known = stash(known.select("key", "copies", F.coalesce("component", "id").alias("component")), "near-known")
    drop(label)
    drop(links)
    drop(classes)
    rows = signed.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key"))
    out = looked_up(rows, known, "key", "copies", F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the least of their component, with docs' columns."""
    found = near_duplicates(docs, shingle, percent)
    removed = stash(found.filter("not kept").select(F.col("doc_id").alias("removed_id")).distinct(), "near-removed")
    drop(found)
    removed = broadcast_if_small(removed, 500_000)
    return docs.join(removed, docs["doc_id"] == removed["removed_id"], "left_anti").select(*[docs[f"`{c}`"] for c in docs.columns])
