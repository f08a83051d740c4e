"""Secrets: certain patterns, and multipart credentials whose parts are weak alone.

Certain kinds, in order: assign (a named secret with a value), access (access identifiers), hex (long hexadecimal
runs). Weak candidates are key (40 characters of base64 in mixed case with digits), ident (20 capitals and digits) and
endpoint (web addresses): one is reported only if a complementary part stands within ``SCOPE`` characters. The interval
join of parts is within each document: the spans of a kind are disjoint and in order, so the last one that begins before
an interval ends is found by bisection and is the only one to compare. DataFrame operations only, one pass, no shuffle.

Defined cases: a null text counts as empty and has no spans; repeated rows are searched each; an empty table gives an
empty result; other columns, whatever their names, are ignored or passed on; a text of any length is searched whole.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, let, text_of, unboxed
from .spans import redacted, spans, written

BASE = ("assign", "access", "hex")
LINKED = ("ident", "key", "endpoint")
SCOPE = 256

_ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
_VALUE = "(?i)^(?:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
_ACCESS = "AKIA[A-Z0-9]{12,}+"
_HEX = "(?<![0-9a-f])[0-9a-f]{32,}+"
_KEY = "(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
_IDENT = "(?<![A-Za-z0-9])[A-Z0-9]{20}(?![A-Za-z0-9])"
_ENDPOINT = "https?://[A-Za-z0-9.-]+"


#: Steps of a bisection: no text holds more spans than they add up to.
_STEPS = [1 << k for k in range(26, -1, -1)]


def _meets(array: Column, low: Column, high: Column) -> Column:
    """Whether a span of the array, disjoint ones in order, begins at most at ``high`` and ends at least at ``low``."""

    def further(n: Column, step: Column) -> Column:
        return F.when(F.coalesce(F.get(array, n + step - 1)["s"] <= high, F.lit(False)), n + step).otherwise(n)

    begun = F.aggregate(F.filter(F.array(*[F.lit(k) for k in _STEPS]), lambda k: k <= F.size(array)), F.lit(0), further)
    return F.when(F.size(array) == 0, False).otherwise(let(begun, lambda n: (n > 0) & (F.get(array, n - 1)["e"] >= low)))


def _any(parts: Column, others: list[Column], reach: int) -> Column:
    """Those parts within ``reach`` of one of the others (-1: overlapping it)."""
    near = lambda x: functools.reduce(operator.or_, [_meets(o, x["s"] - reach, x["e"] + reach) for o in others])
    return F.when(F.size(parts) == 0, parts).otherwise(F.filter(parts, near))


def _outside(parts: Column, taken: list[Column]) -> Column:
    clear = lambda x: ~functools.reduce(operator.or_, [_meets(o, x["s"] + 1, x["e"] - 1) for o in taken])
    return F.when(F.size(parts) == 0, parts).otherwise(F.filter(parts, clear))


def _found(rows: DataFrame) -> DataFrame:
    """rows(doc, t) with the array ``found`` of spans (kind, start, end, score), by start, then kind."""
    t, c = F.col("t"), F.col
    rows = rows.withColumns(
        {
            "assign_text": F.when(t.rlike("(?i)password|passwd|secret|token|api_?key"), t).otherwise(""),
            "access_text": F.when(t.contains("AKIA"), t).otherwise(""),
            "hex_text": F.when(t.rlike("[0-9a-f]{32}"), t).otherwise(""),
            "weak_text": F.when(t.rlike("(?<![A-Z0-9])[A-Z0-9]{20}(?![A-Z0-9])|https?://") | t.contains("AKIA"), t).otherwise(""),
        }
    )
    rows = rows.withColumns(
        {
            "assign": F.filter(spans(c("assign_text"), _ASSIGN), lambda x: F.length(F.regexp_replace(x["m"], _VALUE, "")) >= 8),
            "access": spans(c("access_text"), _ACCESS), "hex": spans(c("hex_text"), _HEX), "endpoints": spans(c("weak_text"), _ENDPOINT),
        }
    )
    sure = [c("assign"), c("access"), c("hex")]
    mixed = lambda x: x["m"].rlike("[A-Z]") & x["m"].rlike("[a-z]") & x["m"].rlike("[0-9]")
    rows = rows.withColumns(
        {
            "keys": _outside(F.filter(spans(c("weak_text"), _KEY), mixed), sure),
            "idents": _outside(F.filter(spans(c("weak_text"), _IDENT), lambda x: x["m"].rlike("[A-Z]") & x["m"].rlike("[0-9]")), sure),
        }
    )
    ids, secret = [c("idents"), c("access")], [c("keys"), c("assign"), c("hex")]
    rows = rows.withColumns({"linked_idents": _any(c("idents"), secret, SCOPE), "linked_keys": _any(c("keys"), ids, SCOPE)})
    # An endpoint counts where an identifier and a secret both stand by it.
    rows = rows.withColumn("linked_endpoints", _any(_any(c("endpoints"), ids, SCOPE), secret, SCOPE))
    parts = {"assign": ("assign", 0.9), "access": ("access", 0.9), "hex": ("hex", 0.6), "ident": ("linked_idents", 0.7), "key": ("linked_keys", 0.8), "endpoint": ("linked_endpoints", 0.5)}
    ranked = lambda i, kind, score: lambda x: F.struct(x["s"].alias("start"), F.lit(i).alias("rank"), x["e"].alias("end"), F.lit(kind).alias("kind"), F.lit(score).alias("score"))
    every = F.concat(*[F.transform(name, ranked(i, kind, score)) for i, (kind, (name, score)) in enumerate(parts.items())])
    ordered = F.transform(F.array_sort(every), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score")))
    return rows.select("doc", "t", ordered.alias("found"))


def with_secrets(docs: DataFrame, text: str, out: str) -> DataFrame:
    """docs with the array ``out`` of spans (kind, start, end, score), by start, then kind."""
    rows = _found(boxed(docs, t=text_of(text)))
    return unboxed(rows, [c for c in docs.columns if c != out], **{out: F.col("found")})


def secrets(docs: DataFrame) -> DataFrame:
    """Counts of the certain kinds, a digest of their spans, and all spans in writing."""
    rows = with_secrets(docs.select("doc_id", "text"), "text", "found").select("doc_id", "found")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return rows.select("doc_id", *[count(k) for k in BASE], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


def masked(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with certain secrets and linked keys and identifiers masked in ``text``; endpoints stay. A null text stays null."""
    rows = _found(boxed(docs, t=text_of("text"))).withColumn("hidden", F.filter("found", lambda x: x["kind"] != "endpoint"))
    return unboxed(rows, docs.columns, text=F.when(F.size("hidden") == 0, F.col("doc")["text"]).otherwise(redacted(F.col("t"), F.col("hidden"), mask)))
