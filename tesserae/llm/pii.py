"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Base kinds, in order: email, ip, card (Luhn), phone; beyond them iban (mod 97) and ssn. Every span has a score: its
kind's own, raised if a word that goes with the kind stands near it, lowered if one does that speaks against it. A base
span is always reported, with its score; a span of another kind only if its score is at least ``LEAST``: so an iban is
unless its surroundings speak against it, and an ssn, which has no checksum, is only where they speak for it.
DataFrame operations only, one pass, no shuffle.

Defined cases: a null text counts as empty and has no spans; repeated rows are searched each; an empty table gives an
empty result; other columns, whatever their names, are ignored or passed on; a text of any length is searched whole.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, let, text_of, unboxed
from .spans import MARK, chunked, digits, marked, piece, redacted, spans, written

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
#: Characters on either side of a span in which words count, and the least score of a span that isn't of a base kind.
NEAR, LEAST = 48, 0.6
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.65, "ssn": 0.45}
RAISE = 0.2
#: Whole words that speak for a kind, and words that speak against it.
FOR = {
    "email": "e-?mails?|mail|contact|write|reach",
    "ip": "ip|ips|address|host|server|login|client",
    "card": "cards?|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|telephone|call|tel|mobile|fax|cell|telefon|téléphone|teléfono",
    "iban": "iban|account|bank|transfer|konto|compte|cuenta",
    "ssn": "ssn|ssns|social security|security number",
}
AGAINST = {
    "email": "example|sample",
    "ip": "version|release|build|section",
    "card": "order|invoice|isbn|serial|tracking|part",
    "phone": "order|invoice|serial|isbn|part",
    "iban": "order|serial|part|model|checksum",
    "ssn": "order|serial|part|model|invoice",
}

# A run of digits joined by single spaces or hyphens becomes a run of one character class, an address's dots that join
# labels stay dots and all others become marks: lengths don't change, and no pattern repeats a group without a bound.
_LOCAL = f"A-Za-z0-9._%+{MARK}-"
_EMAIL = f"(?:\\G|(?<![{_LOCAL}]))[{_LOCAL}]++@(?=[A-Za-z0-9-]+\\.)[A-Za-z0-9.-]+"
_LOOSE_DOT = "(?<![A-Za-z0-9-])\\.|\\.(?![A-Za-z0-9-])"
_IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
_CARD = f"[0-9][0-9{MARK}]{{12,}}"
_JOINT = "(?<=[0-9])[ -](?=[0-9])"
_PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
_IBAN = "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]{4}){2,7}(?:\\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_SSN = "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_NO_SSN = "^(?:000|666|9)|-00-|-0000$"


def luhn(number: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.split(F.reverse(number), ""), value), F.lit(0), lambda s, x: s + x) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether the code, its first four characters put last and letters counted from 10, leaves 1 modulo 97."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        v = F.when(c <= "9", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(v < 10, acc * 10 + v).otherwise(acc * 100 + v) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _parts_fit(address: Column) -> Column:
    return F.forall(F.split(address, "\\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda x: (F.length(x) <= 3) & (F.coalesce(F.when(F.length(x) <= 3, x).try_cast("int"), F.lit(0)) <= 255)))


def _length_of_digits(m: Column, low: int, high: int) -> Column:
    return F.length(digits(m)).between(low, high)


def _has_word(text: Column, words: str) -> Column:
    return text.rlike(f"(?i)(?<![\\p{{L}}0-9])(?:{words})(?![\\p{{L}}0-9])")


def _scored(chunks: Column, array: Column, kind: str) -> Column:
    def near(x: Column) -> Column:
        # A character more on either side shows whether the outermost word is whole.
        before = piece(chunks, F.greatest(F.lit(0), x["s"] - NEAR - 1), x["s"])
        after = piece(chunks, x["e"], x["e"] + NEAR + 1)
        around = F.concat(before, F.lit("\n"), after)
        shift = lambda words: F.when(_has_word(around, words), RAISE).otherwise(0.0)
        score = F.round(F.least(F.lit(1.0), SCORES[kind] + shift(FOR[kind]) - shift(AGAINST[kind])), 2)
        return F.struct(F.lit(kind).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), score.alias("score"))

    scored = F.transform(array, near)
    return scored if kind in BASE else F.filter(scored, lambda x: x["score"] >= LEAST)


def _compact(code: Column) -> Column:
    return F.replace(code, F.lit(" "), F.lit(""))


def _found(rows: DataFrame) -> DataFrame:
    """rows(doc, t) with the array ``found`` of spans (kind, start, end, score), by kind, then start."""
    t = F.col("t")
    # What a text can't have costs one look for a character or two.
    rows = rows.withColumns(
        {
            "email_text": F.when(t.contains("@"), marked(t, _LOOSE_DOT)).otherwise(""),
            "card_text": F.when(t.rlike("[0-9](?:[ -]?[0-9]){12}"), marked(t, _JOINT)).otherwise(""),
            "phone_text": F.when(t.contains("+"), t).otherwise(""),
            "ip_text": F.when(t.rlike("[0-9]\\.[0-9]++\\.[0-9]"), t).otherwise(""),
            "iban_text": F.when(t.rlike("[A-Z]{2}[0-9]{2}\\x20?[A-Z0-9]{4}"), t).otherwise(""),
            "ssn_text": F.when(t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"), t).otherwise(""),
        }
    )
    found = {
        "email": spans(F.col("email_text"), _EMAIL),
        "ip": F.filter(spans(F.col("ip_text"), _IP), lambda x: _parts_fit(x["m"])),
        "card": F.filter(spans(F.col("card_text"), _CARD), lambda x: _length_of_digits(x["m"], 13, 19) & luhn(digits(x["m"]))),
        "phone": F.filter(spans(F.col("phone_text"), _PHONE), lambda x: _length_of_digits(x["m"], 9, 15)),
        "iban": F.filter(spans(F.col("iban_text"), _IBAN), lambda x: F.length(_compact(x["m"])).between(15, 34) & mod97(_compact(x["m"]))),
        "ssn": F.filter(spans(F.col("ssn_text"), _SSN), lambda x: ~x["m"].rlike(_NO_SSN)),
    }
    rows = rows.withColumns({f"{kind}_spans": found[kind] for kind in KINDS})
    some = functools.reduce(operator.or_, [F.size(f"{kind}_spans") > 0 for kind in KINDS])
    scored = let(F.when(some, chunked(t)).otherwise(F.array().cast("array<string>")), lambda chunks: F.concat(*[_scored(chunks, F.col(f"{kind}_spans"), kind) for kind in KINDS]))
    return rows.select("doc", "t", scored.alias("found"))


def with_personal_data(docs: DataFrame, text: str, out: str) -> DataFrame:
    """docs with the array ``out`` of spans (kind, start, end, score), by kind, then start."""
    rows = _found(boxed(docs, t=text_of(text)))
    return unboxed(rows, [c for c in docs.columns if c != out], **{out: F.col("found")})


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, all spans in writing and, in the same order, their scores."""
    rows = with_personal_data(docs.select("doc_id", "text"), "text", "found").select("doc_id", "found")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    scores = F.array_join(F.transform("found", lambda x: x["score"].cast("string")), ",")
    return rows.select("doc_id", *[count(k) for k in BASE], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"), scores.alias("scores"))


def masked(docs: DataFrame, mask: str = "[PERSONAL]") -> DataFrame:
    """docs with personal data masked in ``text``; a null text stays null."""
    rows = _found(boxed(docs, t=text_of("text")))
    return unboxed(rows, docs.columns, text=F.when(F.size("found") == 0, F.col("doc")["text"]).otherwise(redacted(F.col("t"), F.col("found"), mask)))
