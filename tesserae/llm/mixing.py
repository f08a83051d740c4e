"""Mixing sources to target weights along a curriculum, with DataFrame operations only.

Every source has a weight schedule over training time 0..1, piecewise linear between knots. Its integral is the
source's share; targets are filled like vessels under a common water level, none above ``max_epochs`` times its
source. The documents of a source are queued in hash order, their cumulative words are the source's cumulative
demand, and inverting the integrated schedule at that demand gives each copy of a document its training position,
by which the result is range-sorted.

The running sums are of three levels: sums of groups of hash buckets, of buckets, and rows within a bucket, so no task
ever holds a whole source. Only the table of sources, counted first, may be broadcast.

Defined cases: a null source is a source of its own, after all others; a null or blank text has size 0 and is never
taken; repeated rows are separate documents; rows with a null id are queued by their texts; an empty table gives an
empty result; further columns, whatever their names, pass through when ``keep`` names them; the one document of a
source at which its target is reached gives its first words only, at a position like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, broadcast_if_small, let, stash

#: Knots (time, weight) of the schedules that sources get in turn; their integrals are 5, 2 and 1.
CURRICULUM = (((0.0, 6.0), (1.0, 4.0)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)))
ROWS_PER_BUCKET = 1024
BUCKETS_PER_GROUP = 1024

Schedule = Sequence[tuple[float, float]]


def integral(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False))


def _segments(schedule: Schedule) -> Column:
    """Array of (start time, weight there, slope, integral so far)."""
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        if t1 <= t0 or min(w0, w1) < 0:
            raise ValueError("knots must ascend in time and have no negative weight")
        out.append(F.struct(F.lit(t0).alias("t"), F.lit(w0).alias("w"), F.lit((w1 - w0) / (t1 - t0)).alias("s"), F.lit(done).alias("a")))
        done += (t1 - t0) * (w0 + w1) / 2
    return F.array(*out)


def _by_turn(rank: Column, values: list[Column]) -> Column:
    out = values[-1]
    for i, value in enumerate(values[:-1]):
        out = F.when(rank % len(values) == i, value).otherwise(out)
    return out


def source_targets(sizes: DataFrame, schedules: Sequence[Schedule] = CURRICULUM, share: float = 1.0, max_epochs: int = 3) -> DataFrame:
    """sizes(source, source_size, n_docs) -> the same with rank, weight, segments and target.

    A source is full if its limit per weight is below the level at which the remaining words stand when all fuller
    ones are taken out; those limits ascend, so the full ones are a prefix of that order.
    """
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    t = sizes.withColumn("rank", rank)
    t = t.withColumn("weight", _by_turn(F.col("rank"), [F.lit(float(integral(s))) for s in schedules]))
    t = t.withColumn("limit", (F.col("source_size") * max_epochs).cast("double"))
    t = t.withColumn("ratio", F.try_divide(F.col("limit"), F.col("weight")))
    order = Window.orderBy(F.col("ratio").asc_nulls_last(), "rank")
    t = t.withColumn("demand", F.sum("source_size").over(everything) * F.lit(float(share)))
    t = t.withColumn("before", F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("weights_on", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("full", F.coalesce(F.col("ratio") * F.col("weights_on") <= F.col("demand") - F.col("before"), F.lit(False)))
    rest = F.col("demand") - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(everything)
    level = F.try_divide(rest, F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything))
    t = t.withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(F.coalesce(F.col("weight") * level, F.lit(0.0))))
    t = t.withColumn("segments", _by_turn(F.col("rank"), [_segments(s) for s in schedules]))
    return t.select("source", "source_size", "n_docs", "rank", "weight", "segments", "target")


def position(share_done: Column, segments: Column, weight: Column) -> Column:
    """Time at which the integrated schedule reaches this share of its whole: the root of the segment's quadratic."""
    y = share_done * weight
    return let(
        F.element_at(F.filter(segments, lambda g: g["a"] <= y), -1),
        lambda g: g["t"]
        + F.coalesce(F.try_divide(2 * (y - g["a"]), g["w"] + F.sqrt(F.greatest(g["w"] * g["w"] + 2 * g["s"] * (y - g["a"]), F.lit(0.0)))), F.lit(0.0)),
    )


def mix(
    docs: DataFrame,
    schedules: Sequence[Schedule] = CURRICULUM,
    share: float = 1.0,
    max_epochs: int = 3,
    keep: Sequence[str] = (),
    sort: bool = True,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, positions (of its copies), last_words, and ``keep``.

    Copies are whole, but for the last one of the document of a source at which the target is reached: that has the
    words that still fit, ``last_words``. So the positions and ``taken`` speak of the same words, and a source's taken
    words equal its target rounded to a word.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    sized = docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "text").alias("h"), *[F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(keep)])
    sized = sized.withColumn("high", F.shiftrightunsigned("h", 33))
    narrow = stash(sized.select("doc_id", "source", "size", "h", "high"), "mix-sizes")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = stash(source_targets(sizes, schedules, share, max_epochs), "mix-targets")
    targets = broadcast_if_small(targets).withColumnRenamed("source", "of_source")

    def bucketed(rows: DataFrame) -> DataFrame:
        joined = rows.join(targets, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
        n_buckets = F.ceil(F.col("n_docs") / ROWS_PER_BUCKET)
        return joined.withColumn("bucket", F.col("high").cast("long") * n_buckets).withColumn("bucket", F.shiftright("bucket", 31))

    sums = stash(bucketed(narrow).groupBy("rank", "bucket").agg(F.sum("size").alias("words")).withColumn("group", F.floor(F.col("bucket") / BUCKETS_PER_GROUP)), "mix-sums")
    ahead_of = lambda *of: lambda by: F.coalesce(F.sum("words").over(Window.partitionBy(*of).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sums.groupBy("rank", "group").agg(F.sum("words").alias("words")).select("rank", "group", ahead_of("rank")("group").alias("before"))
    bases = sums.select("rank", "group", "bucket", ahead_of("rank", "group")("bucket").alias("inside")).join(groups, ["rank", "group"])
    bases = bases.select("rank", "bucket", (F.col("before") + F.col("inside")).alias("base"))
    rows = bucketed(sized if keep else narrow)
    within = Window.partitionBy("rank", "bucket").orderBy("high", "h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0))).join(bases, ["rank", "bucket"])
    rows = rows.withColumn("begin", F.col("base") + F.col("ahead"))
    rows = rows.withColumn("goal", F.round("target").cast("long"))
    rows = rows.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(F.lit(0)))
    rows = rows.withColumn("left", F.col("goal") - F.col("epochs") * F.col("source_size"))
    rows = rows.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("begin"))))
    rows = rows.withColumn("taken", F.col("epochs") * F.col("size") + F.col("extra"))
    copies = F.col("epochs") + F.when(F.col("extra") > 0, 1).otherwise(0)
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0).cast("int"))
    rows = rows.withColumn("last_words", F.when(F.col("extra") > 0, F.col("extra")).when(F.col("copies") > 0, F.col("size")).otherwise(0))
    share_done = lambda e: F.least(F.lit(1.0), (e * F.col("source_size") + F.col("begin")).cast("double") / F.col("goal"))
    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda e: position(share_done(e), F.col("segments"), F.col("weight"))))
    rows = rows.withColumn("positions", F.coalesce(positions, F.array().cast("array<double>")))
    # Documents that are not taken stand behind all others, spread by hash so that they don't meet in one range.
    rows = rows.withColumn("place", F.coalesce(F.get("positions", F.lit(0)), F.lit(1.0) + F.col("high") / F.lit(2.0**31)))
    if sort:
        rows = rows.orderBy("place", "doc_id")
    return rows.select("doc_id", "size", "source_size", "target", "taken", "positions", "last_words", *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep) if c != "doc_id"])


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its nth word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"[{SPACE}]*+{WORD}+"), F.lit(0)), F.lit(1), n.cast("int")), "")


def training_order(docs: DataFrame, schedules: Sequence[Schedule] = CURRICULUM, max_epochs: int = 3) -> DataFrame:
    """The documents themselves, a row for each copy that the mix takes, in training order, with docs' columns."""
    names = docs.columns
    mixed = mix(docs, schedules, max_epochs=max_epochs, keep=names, sort=False)
    # ``size`` and the like may also be names of docs: columns are read by place.
    taken = mixed.toDF(*[f"m{i}" for i in range(len(mixed.columns))])
    kept = [c for c in names if c != "doc_id"]
    first = len(mixed.columns) - len(kept)
    at = {"doc_id": F.col("m0")} | {c: F.col(f"m{first + i}") for i, c in enumerate(kept)}
    copies = taken.select(F.posexplode("m5").alias("copy", "position"), *taken.columns)
    is_cut = (F.col("copy") == F.size("m5") - 1) & (F.col("m6") < F.col("m1"))
    at["text"] = F.when(is_cut, first_words(at["text"], F.col("m6"))).otherwise(at["text"])
    return copies.orderBy("position", "m0").select(*[at[c].alias(c) for c in names])
