"""Document fingerprints as threshold-scaled sketches, with DataFrame operations only.

A sketch keeps every shingle hash below a fixed fraction of the hash range (and the smallest one, so that no text with
words has an empty sketch). Sketches of any two texts therefore compare on the same part of the hash range however
unequal their lengths, the union's sketch is the union of the sketches, and containment is estimated as well as
resemblance.

Neighbours by ascending id are found in buckets of ids, as many as the rows ask for: quantiles, then equal parts of
each. A bucket's first document, found by a join with the buckets' first ids, is also put behind the bucket before, so a
window over a bucket sees every successor and no task holds the table.

Defined cases: null and empty texts have an empty fingerprint; two empty fingerprints have likeness 1, one has 0;
fewer words than a shingle are one shingle; rows with a null id come first, equal ids are ordered by text; an empty
table gives an empty result; other columns, whatever their names, are ignored; a text of any length is one row. Rows
that share an id share a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, let, text_of, words

SHINGLE = 5
#: The fraction of hashes kept is 2 to the power of minus this.
FRACTION_BITS = 2
KEPT_BITS = 32
DIGITS = 9

COARSE = 64
ROWS_PER_BUCKET = 200


def sketch(text: Column, shingle: int = SHINGLE) -> Column:
    """Ascending array of kept hashes: the fraction's hashes are below 2**KEPT_BITS after the shift."""
    shift = 64 - KEPT_BITS - FRACTION_BITS

    def of_words(ws: Column) -> Column:
        rolled = F.transform(
            F.slice(ws, 1, F.greatest(F.size(ws) - (shingle - 1), F.lit(1))),
            lambda w, i: F.shiftrightunsigned(F.xxhash64(w, *[F.get(ws, i + k) for k in range(1, shingle)]), shift),
        )
        return let(rolled, kept)

    def kept(hashes: Column) -> Column:
        low = F.filter(hashes, lambda h: h < (1 << KEPT_BITS))
        return let(low, lambda x: F.when(F.size(x) > 0, F.array_sort(F.array_distinct(x))).otherwise(F.filter(F.array(F.array_min(hashes)), lambda h: h.isNotNull())))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of_words)


def written(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.lpad(F.lower(F.hex(v)), DIGITS, "0")), "")


def resemblance(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Share of a's text that is in b's; 1 for an empty a."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column) -> Column:
    """Sketch of both texts together (without the shingles across their border)."""
    union = F.array_union(a, b)
    low = F.filter(union, lambda h: h < (1 << KEPT_BITS))
    return F.when(F.size(low) > 0, F.array_sort(low)).otherwise(F.slice(F.array_sort(union), 1, 1))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (text) of every row."""
    return docs.select("doc_id", written(sketch(text_of("text"))).alias("fingerprint"))


def _bucket(edges: list[int], parts: int) -> Column:
    """Coarse range by quantiles, then equal parts of it: ascends with the id."""
    inner = F.array(*[F.lit(e) for e in edges[1:-1]]).cast("array<long>")
    whole = F.array(*[F.lit(e) for e in edges]).cast("array<long>")
    doc_id = F.col("doc_id").cast("long")

    def within(c: Column) -> Column:
        low, high = F.get(whole, c).cast("double"), F.get(whole, c + 1).cast("double")
        part = F.floor((doc_id - low) / F.greatest(high - low, F.lit(1.0)) * parts)
        return c * parts + F.greatest(F.lit(0), F.least(part, F.lit(parts - 1)))

    return F.coalesce(let(F.size(F.filter(inner, lambda e: e <= doc_id)).cast("long"), within).cast("long"), F.lit(0))


def _heads(ids: DataFrame, bucket: Column, parts: int, scratch: Scratch) -> DataFrame:
    """(first, behind): the first id of each bucket and the bucket before it; the last bucket is before the first."""
    heads = ids.filter("doc_id is not null").groupBy(bucket.alias("bucket")).agg(F.min("doc_id").alias("first"))
    heads = scratch.stash(heads.withColumn("coarse", F.floor(F.col("bucket") / parts)), "fingerprint-heads")
    ends = heads.groupBy("coarse").agg(F.max("bucket").alias("end"))  # at most COARSE rows
    every = Window.orderBy("coarse")
    ends = ends.select("coarse", F.coalesce(F.lag("end").over(every), F.max("end").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    inside = F.lag("bucket").over(Window.partitionBy("coarse").orderBy("bucket"))
    return scratch.stash(heads.join(F.broadcast(ends), "coarse").select("first", F.coalesce(inside, F.col("before")).alias("behind")), "fingerprint-firsts")


def with_successor(docs: DataFrame, payload: list[Column], scratch: Scratch) -> DataFrame:
    """docs(doc_id, text) with the payload and a struct ``next`` of the next document's text and payload; the last one's next is the first.

    A text crosses the exchange once; what is next is made of the rows behind it.
    """
    ids = scratch.stash(docs.select("doc_id"), "fingerprint-ids")
    n, known, low, high = ids.agg(F.count(F.lit(1)), F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    edges = [0, 1]
    if known:
        cuts = ids.agg(F.percentile_approx("doc_id", [i / COARSE for i in range(1, COARSE)], 10_000)).first()[0]
        edges = [low, *sorted({c for c in cuts if low < c}), min(high + 1, (1 << 63) - 1)]
    parts = max(1, -(-n // (COARSE * ROWS_PER_BUCKET)))
    bucket = _bucket(edges, parts)
    firsts = _heads(ids, bucket, parts, scratch)
    rows = docs.select("doc_id", "text", bucket.alias("bucket"), *payload)
    names = rows.columns[3:]
    rows = rows.join(broadcast_if_small(firsts, 200_000), F.col("doc_id") == F.col("first"), "left").drop("first")
    if known < n:  # rows with a null id come first in the first bucket, and so behind the last
        last = firsts.agg(F.max("behind")).first()[0] or 0
        is_low = F.lit(False) if low is None else F.col("doc_id") == F.lit(low)
        rows = rows.withColumn("behind", F.when(F.col("doc_id").isNull(), F.lit(last).cast("long")).when(~is_low, F.col("behind")))
    rows = rows.withColumn("place", F.explode(F.when(F.col("behind").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.array(F.lit(-1).cast("long"), F.col("behind")))))
    rows = rows.withColumn("ghost", F.col("place") >= 0).withColumn("bucket", F.when(F.col("ghost"), F.col("place")).otherwise(F.col("bucket")))
    line = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "text")
    return rows.withColumn("next", F.lead(F.struct("text", *names)).over(line)).filter(~F.col("ghost")).select("doc_id", "text", *names, "next")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of the texts and of their edited texts, whose last quarter is the next document's beginning."""
    own = docs.select("doc_id", text_of("text").alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        rows = with_successor(own, [sketch(F.col("text")).alias("sketch")], scratch)
        scratch.paths = [p for p in scratch.paths if "fingerprint-firsts" not in p]  # read by the result
    rows = rows.select("doc_id", "text", "sketch", F.col("next.text").alias("next_text"), F.col("next.sketch").alias("next_sketch"))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    both = rows.select(
        "doc_id", "n_chars", "sketch", "next_sketch", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited")).alias("edited_sketch")
    )
    return both.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("sketch")).alias("fingerprint"), written(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("share_in_edited"), containment(F.col("sketch"), F.col("next_sketch")).alias("share_in_next"),
    )
