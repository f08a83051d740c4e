"""Text functions with Unicode-aware white space, and conditions chained in order of priority."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space, and the four separators that count as such too.
SPACE = r"[\s\x1c-\x1f]"
_CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def inline(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return strip(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def clean(c: Column, default: str = "") -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(default))))


def filled(c: Column, default: str) -> Column:
    """The value, or the default where it is null or empty."""
    return F.coalesce(F.when(c != "", c), F.lit(default))


def title(c: Column) -> Column:
    """A capital after anything that is no letter."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")


def is_upper(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def is_title(c: Column) -> Column:
    """Capitals only behind what has no case, small letters only behind what has; letters without case are like marks."""
    return c.rlike(r"[\p{Lu}\p{Lt}]") & ~c.rlike(rf"(^|[^{_CASED}])\p{{Ll}}") & ~c.rlike(rf"[{_CASED}][\p{{Lu}}\p{{Lt}}]")


def first_of(cases: Iterable[tuple[Column, Column | str]], default: Column | str | None) -> Column:
    """CASE WHEN in the given order."""
    out = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def contains_any(c: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def text_hash(c: Column) -> Column:
    return F.sha2(inline(c), 256)


def literal_pattern(word: str) -> str:
    """A word with what patterns give a meaning escaped."""
    return "".join(f"\\{ch}" if ch in r"\.^$*+?()[]{}|-" else ch for ch in word)
