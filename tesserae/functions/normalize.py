"""Numbers, units, periods, entities, families and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dictionaries import ENTITIES, FAMILIES, SCALES, UNIT_HINTS, UNITS
from .text import clean, contains_any, filled, first_of, literal_pattern, strip, title

# The pattern of a number.
NUMBER = r"([0-9,]+(?:\.[0-9]+)?)"


def _group(c: Column, pattern: str, i: int = 1) -> Column:
    return F.regexp_extract(c, pattern, i)


def number(text: Column, hint: Column | None = None) -> Column:
    """Struct (value, multiplier, scale); parentheses or a hyphen make it negative, percentages aren't scaled."""
    t = strip(F.coalesce(text, F.lit("")))
    in_parentheses = _group(t, r"\(\s*([0-9,]+(?:\.[0-9]+)?)\s*\)")
    negative = (in_parentheses != "") | (t.contains("-") & ~t.rlike(r"(?U)\b[0-9]{4}-[0-9]{2,4}\b"))
    digits = F.when(in_parentheses != "", in_parentheses).otherwise(_group(t, NUMBER))
    value = F.replace(digits, F.lit(","), F.lit("")).try_cast("double")
    value = F.when(negative, -F.abs(value)).otherwise(value)
    whole = F.concat(F.lower(t), F.lit(" "), F.lower(F.coalesce(hint, F.lit("")) if hint is not None else F.lit("")))
    scaled = value.isNotNull() & ~contains_any(whole, ("%", "percent", "per cent"))
    hits = [(scaled & whole.rlike(rf"(?U)\b{w}\b"), w, f) for w, f in SCALES]
    multiplier = first_of([(c, F.lit(f)) for c, _, f in hits], F.lit(1.0))
    return F.struct((value * multiplier).alias("value"), multiplier.alias("multiplier"), first_of([(c, w) for c, w, _ in hits], "none").alias("scale"))


def unit(raw: Column, predicate: Column | None = None) -> Column:
    u, p = clean(raw), F.lower(F.coalesce(predicate, F.lit(""))) if predicate is not None else F.lit("")
    exact = [(u.isin(*words), name) for name, words in UNITS]
    inside = [((u != "") & u.rlike(rf"(?U)\b{literal_pattern(w)}\b"), name) for name, words in UNITS for w in words]
    hinted = [((p != "") & contains_any(p, words), name) for name, words in UNIT_HINTS]
    return first_of(exact + inside + hinted, F.when(u != "", strip(raw)))


# Patterns of periods.
QUARTER = r"(?U)\b(q[1-4]|first quarter|second quarter|third quarter|fourth quarter)\s*(?:of|:)?\s*(?:fy\s*([0-9]{2,4})|([0-9]{4}))?"
YEAR_RANGE = r"(?U)\b(?:fy\s*)?([0-9]{2,4})[-/]([0-9]{2,4})\b"
FISCAL_YEAR = r"(?U)\b(?:fy\s*([0-9]{2,4})|fiscal\s*(?:year\s*)?([0-9]{4}))\b"
MONTH_FIRST = r"(?:as\s+of\s+)?([a-zA-Z]+)\s+([0-9]{1,2}),?\s+([0-9]{4})"
DAY_FIRST = r"(?:as\s+of\s+)?([0-9]{1,2})\s+([a-zA-Z]+),?\s+([0-9]{4})"
CALENDAR_YEAR = r"(?U)\b(201[89]|202[0-9])\b"
# Names of months.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
QUARTER_WORDS = ("first", "second", "third", "fourth")


def either(a: Column, b: Column) -> Column:
    return F.when(a != "", a).otherwise(b)


def quarter_code(found: Column) -> Column:
    return first_of([(found.startswith(w), f"Q{i + 1}") for i, w in enumerate(QUARTER_WORDS)], F.upper(found))


def _year(token: Column) -> Column:
    """Four digits are a year, fewer (or three) count from 2000."""
    n = token.try_cast("int")
    return F.when(F.length(token) == 4, n).otherwise(n + 2000)


def _day(year: Column, month: Column | int, day: Column | int) -> Column:
    pad = lambda x, n: F.lpad((F.lit(x) if isinstance(x, int) else x).cast("string"), n, "0")
    return F.try_to_date(F.concat_ws("-", pad(year, 4), pad(month, 2), pad(day, 2)), "yyyy-MM-dd")


def _fiscal(start: Column, end: Column) -> Column:
    return F.concat(F.lit("FY"), start.cast("string"), F.lit("-"), F.substring(end.cast("string"), -2, 2))


def _named_day(low: Column) -> tuple[Column, Column]:
    """The month's number, if a day of a month is named at all, and the date, if there is such a day."""
    month_first = low.rlike(MONTH_FIRST)
    name = F.when(month_first, _group(low, MONTH_FIRST)).otherwise(_group(low, DAY_FIRST, 2))
    day = F.when(month_first, _group(low, MONTH_FIRST, 2)).otherwise(_group(low, DAY_FIRST, 1))
    year = F.when(month_first, _group(low, MONTH_FIRST, 3)).otherwise(_group(low, DAY_FIRST, 3))
    month = first_of([(name.isin(m, m[:3]), F.lit(i + 1)) for i, m in enumerate(MONTHS)], None)
    return month, _day(year, month, day)


def period_fault(raw: Column) -> Column:
    """What is wrong with a period: null, or that it names a day that doesn't exist, where no rule before that of days takes it."""
    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    numbers = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in ((m, i + 1, m[:3], i + 1) if m != m[:3] else (m, i + 1))])

    def of_parts(text: Column, parts: Column) -> Column:
        month = F.try_element_at(numbers, F.get(parts, F.lit(0)))
        return F.when(month.isNotNull() & _day(F.get(parts, F.lit(2)), month, F.get(parts, F.lit(1))).isNull(), F.concat(F.lit("no such day: "), text))

    def of_text(text: Column) -> Column:
        taken = text.contains("since inception") | text.contains("cumulative") | text.rlike(QUARTER) | text.rlike(YEAR_RANGE) | text.rlike(FISCAL_YEAR)
        month_first = F.array(*[_group(text, MONTH_FIRST, i) for i in (1, 2, 3)])
        parts = F.when(text.rlike(MONTH_FIRST), month_first).otherwise(F.array(*[_group(text, DAY_FIRST, i) for i in (2, 1, 3)]))
        return F.when(~taken, once(parts, lambda found: of_parts(text, found)))

    return once(F.lower(strip(F.coalesce(raw, F.lit("")))), of_text)


def checked_period(raw: Column) -> Column:
    """Struct (period, fault): what a period means and what is wrong with it."""
    return F.struct(period(raw).alias("period"), period_fault(raw).alias("fault"))


def period(raw: Column) -> Column:
    """Struct (type, start, end, canonical, raw). A day that doesn't exist is no day; ``period_fault`` says so."""
    t = strip(F.coalesce(raw, F.lit("")))
    low = F.lower(t)
    q, qy = _group(low, QUARTER), filled(either(_group(low, QUARTER, 2), _group(low, QUARTER, 3)), "2024")
    code, q_year = quarter_code(q), _year(qy)
    r1, r2 = _group(low, YEAR_RANGE), _group(low, YEAR_RANGE, 2)
    f = either(_group(low, FISCAL_YEAR), _group(low, FISCAL_YEAR, 2))
    _, dated = _named_day(low)
    calendar = _group(t, CALENDAR_YEAR)
    none = F.lit(None).cast("date")

    def out(kind: str, start: Column, end: Column, canonical: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), start.alias("start"), end.alias("end"), canonical.alias("canonical"), t.alias("raw"))

    starts = first_of([(code == "Q1", _day(q_year - 1, 4, 1)), (code == "Q2", _day(q_year - 1, 7, 1)), (code == "Q3", _day(q_year - 1, 10, 1))], _day(q_year, 1, 1))
    ends = first_of([(code == "Q1", _day(q_year - 1, 6, 30)), (code == "Q2", _day(q_year - 1, 9, 30)), (code == "Q3", _day(q_year - 1, 12, 31))], _day(q_year, 3, 31))
    return first_of(
        [
            (t == "", out("unspecified", none, none, F.lit("unspecified"))),
            (low.contains("since inception") | low.contains("cumulative"), out("cumulative", none, none, F.lit("since_inception"))),
            (q != "", out("quarter", starts, ends, F.concat(code, F.lit(" "), _fiscal(q_year - 1, q_year)))),
            (r1 != "", out("fiscal_year", _day(_year(r1), 4, 1), _day(_year(r2), 3, 31), _fiscal(_year(r1), _year(r2)))),
            (f != "", out("fiscal_year", _day(_year(f) - 1, 4, 1), _day(_year(f), 3, 31), _fiscal(_year(f) - 1, _year(f)))),
            (dated.isNotNull(), out("as_of", dated, dated, dated.cast("string"))),
            (calendar != "", out("calendar_year", _day(calendar, 1, 1), _day(calendar, 12, 31), F.concat(F.lit("CY"), calendar))),
        ],
        out("unspecified", none, none, t),
    )


def entity(raw: Column) -> Column:
    """Struct (canonical, type)."""
    n = clean(raw)
    known = lambda name, kind: F.struct(F.lit(name).alias("canonical"), F.lit(kind).alias("type"))
    exact = [(n.isin(name.lower(), *aliases), known(name, kind)) for name, kind, aliases in ENTITIES]
    inside = [(contains_any(n, [a for a in aliases if len(a) >= 3]), known(name, kind)) for name, kind, aliases in ENTITIES]
    other = F.struct(title(strip(F.coalesce(raw, F.lit("")))).alias("canonical"), F.lit("organization").alias("type"))
    return first_of([(n == "", known("Unknown Entity", "unknown")), *exact, *inside], other)


def family(predicate: Column) -> Column:
    p = clean(predicate)
    cases = []
    for name, members in FAMILIES:
        hit = p.isin(*members)
        for m in members:
            if len(m) >= 4:
                hit = hit | p.contains(m) | F.lit(m).contains(p)
        cases.append((hit, name))
    return F.when(F.coalesce(predicate, F.lit("")) == "", "UNKNOWN_FAMILY").otherwise(first_of(cases, F.upper(F.replace(p, F.lit(" "), F.lit("_")))))


def fingerprint(subject: Column, predicate: Column, scope: Column, start: Column, end: Column, unit_: Column, basis: Column) -> Column:
    part = lambda c, default: clean(filled(c.cast("string"), default))
    parts = [part(subject, ""), part(predicate, ""), part(scope, "consolidated"), part(start, "none"), part(end, "none"), part(unit_, "none"), part(basis, "standard")]
    return F.sha2(F.concat_ws("|", *parts), 256)


def coarse_key(subject: Column, predicate: Column, scope: Column) -> Column:
    return F.concat_ws("::", clean(subject), clean(predicate), clean(filled(scope, "consolidated")))


def blocking_key(subject: Column, predicate: Column) -> Column:
    return F.concat_ws("::", clean(filled(subject, "unknown")), F.lower(family(predicate)))
