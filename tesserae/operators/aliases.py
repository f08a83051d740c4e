"""Entities by a table of aliases of any size, in place of the dictionary that the library comes with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, first_of

#: Shorter aliases count only where they are the whole text.
SHORTEST = 3
#: Lengths of the runs of characters by which aliases are found; an alias is found by one of the longest that fits.
RUNS = (3, 6, 12, 24, 48)
#: Runs of an alias, evenly spaced from its first to its last, of which the rarest is taken.
PLACES = 4


def _run_length(length: Column) -> Column:
    return first_of([(length >= n, F.lit(n)) for n in reversed(RUNS)], None)


def _alias_runs(alias: Column) -> Column:
    """Hashes of some runs of an alias."""
    n = _run_length(F.length(alias))
    starts = F.transform(F.sequence(F.lit(0), F.lit(PLACES - 1)), lambda i: F.floor(i * (F.length(alias) - n) / (PLACES - 1)).cast("int"))
    return F.transform(F.array_distinct(starts), lambda i: F.xxhash64(F.substring(alias, i + 1, n)))


def _text_runs(text: Column, lengths: Column) -> Column:
    """The distinct hashes of a text's runs of those lengths."""
    runs = lambda chars, n: F.transform(F.sequence(F.lit(1), F.size(chars) - n + 1), lambda i: F.xxhash64(F.array_join(F.slice(chars, i, n), "")))
    every = lambda chars: F.flatten(F.transform(F.filter(lengths, lambda n: n <= F.size(chars)), lambda n: runs(chars, n)))
    return F.array_distinct(F.transform(F.array(F.split(text, "")), every)[0])


def candidates(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(t, alias): texts and the aliases of known(alias) that share the alias's rarest run with it, which all that it contains do."""
    known = known.filter(F.length("alias") >= SHORTEST)
    runs = known.select("alias", F.explode(_alias_runs(F.col("alias"))).alias("run"))
    rarity = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    keys = runs.join(rarity.hint("merge"), "run").groupBy("alias").agg(F.min(F.struct("n", "run"))["run"].alias("run"))
    lengths = known.agg(F.collect_set(_run_length(F.length("alias"))).alias("lengths"))  # one row, of as many numbers as RUNS at most
    rows = texts.crossJoin(F.broadcast(lengths)).select("t", F.explode(_text_runs(F.col("t"), F.col("lengths"))).alias("run"))
    return rows.join(keys.hint("merge"), "run").select("t", "alias")


def matches(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(t, name, kind): for texts(t), distinct and clean, the entity of the alias that equals it, else of the first that it contains.

    aliases(place, alias, name, kind), first by place. Texts that equal none are searched: a text meets the aliases that share a rare
    run with it instead of all of them. Joins with aliases are merged, as a small file may hold more of them than a driver can broadcast.
    """
    known = aliases.select("place", clean(F.col("alias")).alias("alias"), "name", "kind").filter("alias != ''")
    known = known.groupBy("alias").agg(F.min(F.struct("place", "name", "kind")).alias("of"))
    looked = texts.join(known.hint("merge"), F.col("t") == F.col("alias"), "left").select("t", "of")
    equal = looked.filter("of is not null")
    inside = candidates(looked.filter("of is null").select("t"), known.select("alias")).filter(F.col("t").contains(F.col("alias")))
    first = inside.join(known.hint("merge"), "alias").groupBy("t").agg(F.min("of").alias("of"))
    return equal.unionByName(first).select("t", "of.name", "of.kind")


def entities(rows: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """rows with ``name`` and ``kind``. A text is looked up once, however many rows have it; null, blank and unknown ones are no known entity."""
    keyed = rows.withColumn("__t", clean(F.col(column)))
    found = matches(keyed.select(F.col("__t").alias("t")).filter("t != ''").distinct(), aliases)
    out = keyed.join(found, F.col("__t") == F.col("t"), "left").drop("__t", "t")
    return out.withColumn("name", F.coalesce("name", F.lit("Unknown Entity"))).withColumn("kind", F.coalesce("kind", F.lit("unknown")))
