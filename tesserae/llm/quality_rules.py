"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Statistics are bound once per row and every rule is a comparison on them. The base rules reject texts of under 20 words
and texts in which more than 30 % of the words stand in eight-word windows that occur twice or more; the table rejects
texts by ratios of symbols, exclamation marks and table bars to words, stop words, mean word length, and lines.

Defined cases: a null text counts as empty (and is rejected, having no words); repeated rows are judged each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, text_of, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
REPEATED_PERCENT = 30
#: Frequent words of the languages: English, German, French, Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "be", "with", "as", "by", "this", "are", "or", "an",
    "der", "die", "das", "und", "von", "zu", "den", "mit", "ist", "ein", "eine", "nicht", "sich", "für", "auf", "im", "dem", "des",
    "le", "la", "les", "de", "et", "un", "une", "du", "en", "que", "dans", "pour", "par", "sur", "qui", "au", "est", "pas",
    "el", "los", "las", "y", "se", "por", "con", "una", "no", "del", "para", "su", "al", "lo",
)


@dataclass(frozen=True)
class Rule:
    """Rejects texts of at least ``words`` words whose ``ratio`` is below ``low`` or above ``high``."""

    name: str
    ratio: str
    low: float = float("-inf")
    high: float = float("inf")
    words: int = 0


RULES = (
    Rule("mean_word_length", "word_chars / n_words", low=1.5, high=25.0),
    Rule("symbols_per_word", "n_symbols / n_words", high=0.4),
    Rule("exclamations_per_word", "n_bangs / n_words", high=0.5),
    Rule("stop_words", "n_stops / n_words", low=0.01, words=100),
    Rule("repeated_lines", "n_dup_lines / n_lines", high=0.5),
    Rule("ellipsis_lines", "n_ellipsis / n_lines", high=0.5),
    Rule("bullet_lines", "n_bullets / n_lines", high=0.9),
)
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bangs", "n_stops", "n_lines", "n_ellipsis", "n_bullets")


def _repeated_words(ws: Column) -> Column:
    """Words that stand in windows found twice or more: equal windows meet in sorted order, and the gaps between their
    starts, at most a window each, are the words they cover."""

    def covered(starts: Column) -> Column:
        return F.aggregate(F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x)

    def repeated(order: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        hits = F.filter(order, lambda x, i: F.when(i > 0, same(x, F.get(order, i - 1))).otherwise(False) | same(x, F.get(order, i + 1)))
        return let(F.array_sort(F.transform(hits, lambda x: x["i"])), covered)

    def windows(hashes: Column) -> Column:
        rolled = F.transform(F.slice(hashes, 1, F.size(hashes) - (WINDOW - 1)), lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)]))
        return let(rolled, lambda r: F.when(F.size(F.array_distinct(r)) == F.size(r), 0).otherwise(let(F.array_sort(F.transform(r, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), repeated)))

    return F.when(F.size(ws) <= WINDOW, 0).otherwise(let(F.transform(ws, lambda w: F.xxhash64(w)), windows))


def _count_of(text: Column, characters: str, any_of: str) -> Column:
    return F.when(text.rlike(any_of), F.length(text) - F.length(F.translate(text, characters, ""))).otherwise(0)


def statistics(text: Column) -> Column:
    """Struct of STATISTICS."""
    def of_words(ws: Column) -> list[Column]:
        return [
            F.size(ws).alias("n_words"),
            F.length(F.array_join(ws, "")).alias("word_chars"),
            _repeated_words(ws).alias("n_repeat_words"),
            F.aggregate(ws, F.lit(0), lambda n, w: n + F.when(F.length(w) <= 5, F.lower(w).isin(*STOP_WORDS).cast("int")).otherwise(0)).alias("n_stops"),
        ]

    def of_lines(lines: Column) -> list[Column]:
        return [
            F.size(lines).alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…"))).alias("n_ellipsis"),
            F.size(F.filter(lines, lambda x: F.substring(x, 1, 1).isin("-", "*", "•"))).alias("n_bullets"),
        ]

    with_words = let(words(text), lambda ws: F.struct(*of_words(ws)))
    with_lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")), lambda ls: F.struct(*of_lines(ls)))
    symbols = _count_of(text, SYMBOLS, "[#*$%&|<>]").alias("n_symbols")
    bangs = _count_of(text, "!", "!").alias("n_bangs")
    return let(
        F.struct(with_words.alias("w"), with_lines.alias("l"), symbols, bangs),
        lambda s: F.struct(
            *[F.coalesce(s["w"][c] if c in ("n_words", "word_chars", "n_repeat_words", "n_stops") else s["l"][c] if c in ("n_lines", "n_dup_lines", "n_ellipsis", "n_bullets") else s[c], F.lit(0)).cast("long").alias(c) for c in STATISTICS]
        ),
    )


def compiled(rules: tuple[Rule, ...], s: Column) -> Column:
    """Names of the rules that reject, from a struct of statistics."""

    def rejects(rule: Rule) -> Column:
        over, under = rule.ratio.split(" / ")
        ratio = F.try_divide(s[over], s[under])
        out = F.lit(False)
        if rule.low > float("-inf"):
            out = out | (ratio < rule.low)
        if rule.high < float("inf"):
            out = out | (ratio > rule.high)
        return F.coalesce(out, F.lit(False)) & (s["n_words"] >= rule.words)

    return F.filter(F.array(*[F.when(rejects(r), r.name) for r in rules]), lambda x: x.isNotNull())


def fails_base(s: Column) -> Column:
    return (s["n_words"] < LEAST_WORDS) | (100 * s["n_repeat_words"] > REPEATED_PERCENT * s["n_words"])


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs' columns as struct ``doc``, with the statistics, base_failed, rejected_by and kept."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), statistics(text_of("text")).alias("s"))
    rows = rows.select("doc", "s", fails_base(F.col("s")).alias("base_failed"), compiled(rules, F.col("s")).alias("rejected_by"))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def quality_rules(docs: DataFrame) -> DataFrame:
    rows = judged(docs.select("doc_id", "text"))
    return rows.select("doc.doc_id", *[f"s.{c}" for c in STATISTICS[:5]], "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects, with docs' columns.

    The verdict is one expression: a filter on columns of ``judged`` would be pushed below its projection, with the
    statistics once for each use.
    """
    return docs.filter(let(statistics(text_of("text")), lambda s: ~fails_base(s) & (F.size(compiled(rules, s)) == 0)))
