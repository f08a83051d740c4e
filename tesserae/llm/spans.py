"""Spans of regular expressions by code points, and texts with spans taken out, as column expressions.

A pattern's matches and the texts between them come from two built-ins that walk the same matches; their lengths,
summed, are the positions. All of it takes time in proportion to the text and its spans. Patterns here repeat single characters only: repeated groups would recurse on long texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

SPAN = "struct<s:int,e:int,m:string>"
#: Private-use characters that stand in for others of the same length while patterns are matched.
MARK, OTHER = "\ue000", "\ue001"
#: Numbers that are summed, and characters of a text that are held, at a time: what a step copies is bounded by these.
BLOCK, CHUNK = 64, 256


def running(values: Column, combine: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """``combine`` (a sum or the like) of each number and all before it; ``values`` must not be empty.

    An aggregate copies what it has gathered at each step, so it only ever gathers the numbers of a block; then each block is
    combined with what is before it, found in the same way. That takes time in proportion to the numbers.
    """

    def few(array: Column) -> Column:
        add = lambda acc, x: F.concat(acc, F.array(F.coalesce(combine(F.get(acc, F.size(acc) - 1), x), x)))
        return F.aggregate(array, F.array().cast("array<int>"), add)

    def many(array: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / BLOCK).cast("int")), lambda i: few(F.slice(array, i * BLOCK + 1, F.lit(BLOCK))))

        def joined(inside: Column) -> Column:
            before = running(F.transform(inside, lambda x: F.element_at(x, -1)), combine, levels - 1)
            return let(before, lambda ends: F.flatten(F.transform(inside, lambda x, i: F.when(i == 0, x).otherwise(F.transform(x, lambda y: combine(F.get(ends, i - 1), y))))))

        return let(blocks, joined)

    return few(values) if levels == 0 else let(values, many)


def spans(text: Column, pattern: str) -> Column:
    """Array of (s, e, m) of all matches, leftmost first, not overlapping. ``text`` must be a plain column."""

    def positions(found: Column, between: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(found) - 1)
        ends = running(F.transform(numbers, lambda i: F.length(F.get(between, i)) + F.length(F.get(found, i))), lambda x, y: x + y)
        span = lambda e, m: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("m"))
        return F.zip_with(ends, found, span)

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(F.size(found) == 0, F.array().cast(f"array<{SPAN}>")).otherwise(let(F.split(text, pattern, -1), lambda between: positions(found, between))),
    )


def chunked(text: Column) -> Column:
    """The text in pieces of ``CHUNK`` characters, of which ``piece`` reads any part without walking the text from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def piece(chunks: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to before ``end``, or to the text's end; ``end`` must not lie before ``start``."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    inside = lambda i: F.coalesce(F.get(chunks, i), F.lit(""))
    across = F.concat(F.substring(inside(first), start % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(inside(last), F.lit(1), end % CHUNK))
    return F.when(first == last, F.substring(inside(first), start % CHUNK + 1, end - start)).otherwise(across)


def marked(text: Column, pattern: str) -> Column:
    """The text with what the pattern matches (single characters) replaced by MARK."""
    return F.regexp_replace(F.translate(text, MARK, OTHER), pattern, MARK)


def written(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, array: Column, mask: str) -> Column:
    """The text with every span replaced by ``mask``, overlapping ones by one."""
    sorted_spans = F.array_sort(F.transform(array, lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e"))))

    def whole(chunks: Column, order: Column, reached: Column) -> Column:
        def part(x: Column, i: Column) -> Column:
            at = F.when(i == 0, 0).otherwise(F.get(reached, i - 1))
            return F.when(x["s"] < at, "").otherwise(F.concat(piece(chunks, at, x["s"]), F.lit(mask)))

        rest = let(F.element_at(reached, -1), lambda at: piece(chunks, at, F.greatest(at, F.length(text))))
        return F.concat(F.array_join(F.transform(order, part), ""), rest)

    masked_text = let(chunked(text), lambda chunks: let(sorted_spans, lambda order: let(running(F.transform(order, lambda x: x["e"]), F.greatest), lambda reached: whole(chunks, order, reached))))
    return F.when(F.size(array) == 0, text).otherwise(masked_text)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")
