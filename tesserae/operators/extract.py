"""Metric facts from evidence atoms: ordered rules of patterns, first match per predicate, grounded in the atom."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import CALENDAR_YEAR, QUARTER, either, entity, fingerprint, number, period, period_fault, quarter_code, unit
from ..functions.text import filled, first_of, inline, literal_pattern, strip, title

if TYPE_CHECKING:
    import pandas as pd

# Building blocks of the metric patterns.
AMOUNT = r"(?:(?:₹|rs\.?|inr)\s*([0-9,]+(?:\.[0-9]+)?)\s*(cr|crore|million|mn|bn|billion)?|([0-9,]+(?:\.[0-9]+)?)\s*(cr|crore|million|mn|bn|billion))"
NUM = r"([0-9,]+(?:\.[0-9]+)?)"
PCT = r"([0-9]+(?:\.[0-9]+)?)\s*(%|per\s*cent)"
#: What a name and its number may have between them; letters and digits of any script end it.
WORD_CHAR = r"\p{L}\p{N}_"
GAP = rf"[^{WORD_CHAR}\n\r]*[:=]?\s*"
EBITDA = rf"(?<![{WORD_CHAR}])ebitda(?![{WORD_CHAR}])"
ASIDE = r"\s*(?:\([0-9,]+\)\s*)?"
WHEN = r"(?:(?:in\s*)?(?:fy|q[1-4])[0-9]{2,4}\s*)?"
SHARE = r"\s*(?:/\s*[0-9.]+%\s*)?"
VOLUME = r"(bn|billion|mn|million)"
TONS = r"(mn\s*tons|thousand\s*tonnes|tonnes|k\s*tons|tons)"
AREA = r"(mn\s*sq\s*ft|sq\s*ft)"
AT_LEAST = r"(?:>|>=)?\s*"


@dataclass(frozen=True)
class Metric:
    """A metric's patterns; a text without any of ``names`` can't match them."""

    predicate: str
    kind: str
    unit: str
    names: tuple[str, ...]
    patterns: tuple[str, ...]


F_, O_, M_ = "financial_metric", "operational_metric", "macroeconomic_metric"
# The metric rules in order, each with its patterns in order.
METRICS = (
    Metric("revenue from services", F_, "INR", ("revenue",), (AMOUNT + r"\s*(?:in\s*)?(?:(?:fy|q[1-4])[0-9]{2,4}\s*)?revenue", r"(?:revenue(?:\s+from\s+services)?)" + GAP + AMOUNT)),
    Metric("service EBITDA", F_, "INR", ("ebitda",), (AMOUNT + r"\s*service\s+ebitda", r"service\s+ebitda" + GAP + AMOUNT)),
    Metric("adjusted EBITDA", F_, "INR", ("ebitda",), (AMOUNT + SHARE + WHEN + r"adj\.?\s*ebitda", r"(?:adj\.?|adjusted)\s+ebitda" + GAP + AMOUNT)),
    Metric("EBITDA", F_, "INR", ("ebitda",), (AMOUNT + SHARE + WHEN + EBITDA, EBITDA + GAP + AMOUNT)),
    Metric("express parcel shipments volume", O_, "shipments", ("express",), (AT_LEAST + NUM + r"\s*" + VOLUME + r"\+?" + ASIDE + r"express\s+parcel\s+shipments", r"express\s+parcel\s+(?:shipments|shipment\s+volume)" + GAP + AT_LEAST + NUM + r"\s*" + VOLUME)),
    Metric("PTL freight tonnage", O_, "tonnes", ("part-truckload", "ptl"), (NUM + r"\s*" + TONS + r"\+?" + ASIDE + r"(?:part-truckload|ptl)", r"(?:part-truckload|ptl)(?:\s+freight)?\s+tonnage" + GAP + NUM + r"\s*" + TONS)),
    Metric("pin codes covered", O_, "pin_codes", ("pin",), (r"([0-9,]{4,6})" + ASIDE + r"pin\s*codes", r"pin\s*codes\s*(?:covered)?" + GAP + r"([0-9,]{4,6})")),
    Metric("last-mile delivery centres", O_, "centres", ("last-mile",), (r"([0-9,]{3,6})" + ASIDE + r"last-mile\s+delivery\s+centres", r"last-mile\s+delivery\s+centres" + GAP + r"([0-9,]{3,6})")),
    Metric("count of 46-ft tractors", O_, "vehicles", ("tractors",), (r"([0-9,]{2,5})" + ASIDE + r"(?:count\s+of\s+)?46-ft\s+tractors", r"(?:count\s+of\s+46-ft\s+tractors|tractors)" + GAP + r"([0-9,]{2,5})")),
    Metric("workforce strength", O_, "persons", ("workforce",), (r"([0-9,]{4,6})" + ASIDE + r"workforce\s+strength", r"workforce\s+strength" + GAP + r"([0-9,]{4,6})")),
    Metric("logistics area under management", O_, "sq_ft", ("logistics",), (NUM + r"\s*" + AREA + ASIDE + r"logistics\s+area", r"logistics\s+area\s+under\s+management" + GAP + NUM + r"\s*" + AREA)),
    Metric(
        "real GDP growth rate", M_, "percent", ("gdp", "economic", "domestic"),
        (
            r"(?:real\s+(?:gross\s+domestic\s+product|\(gdp\)|gdp)[^.\n]{0,60}?(?:grow(?:th)?|expanded|moderated|projected)[^.\n]{0,30}?(?:by|to|at|of)?\s*" + PCT + ")",
            r"(?:economic\s+growth)[^.\n]{0,30}?(?:of|at|by|to)?\s*" + PCT,
            PCT + r"\s*(?:real\s+gdp\s+growth|gdp\s+growth)",
            r"(?:real\s+gdp\s+growth|gdp\s+growth)" + GAP + PCT,
        ),
    ),
    Metric("headline CPI inflation", M_, "percent", ("inflation",), (r"(?:(?:headline\s+)?cpi\s+inflation|retail\s+inflation|headline\s+inflation)[^.\n]{0,30}?(?:declined\s+to|moderated\s+to|stood\s+at|at|of|to)?\s*" + PCT, PCT + r"\s*(?:headline\s+cpi\s+inflation|cpi\s+inflation|retail\s+inflation)")),
    Metric("gross fiscal deficit", M_, "percent", ("deficit", "gfd"), (r"(?:(?:gross\s+)?fiscal\s+deficit|gfd)[^.\n]{0,40}?(?:declining\s+to|contained\s+at|budgeted\s+at|stood\s+at|at|of)?\s*" + PCT + r"\s*(?:of\s+gdp)?", PCT + r"\s*(?:of\s+gdp\s+)?(?:fiscal\s+deficit|gfd)")),
    Metric("current account deficit", M_, "percent", ("deficit", "cad"), (r"(?:current\s+account\s+deficit|cad)[^.\n]{0,40}?(?:contained\s+at|declined\s+to|widened\s+to|projected\s+at|at|of)?\s*" + PCT + r"\s*(?:of\s+gdp)?", PCT + r"\s*(?:of\s+gdp\s+)?(?:current\s+account\s+deficit|cad)")),
)


LABELS = "|".join(literal_pattern(name) for name in dict.fromkeys(n for m in METRICS for n in m.names))


def _has(t: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | t.contains(w)
    return out


# What is looked for, in order, and what it stands for.
def subject(page_text: Column) -> Column:
    t = F.lower(page_text)
    return first_of(
        [
            (_has(t, "spoton"), "Spoton Logistics"),
            (_has(t, "delhivery"), "Delhivery Limited"),
            (_has(t, "reserve bank of india", " rbi ", "rbi annual report"), "Reserve Bank of India"),
            (_has(t, "international monetary fund", " imf "), "International Monetary Fund"),
            (_has(t, "economic survey", "indian economy"), "Republic of India"),
        ],
        "Delhivery Limited",
    )


# What is looked for, in order, and what it stands for.
def time_text(text: Column) -> Column:
    """The period that an atom speaks of, in short; null if none."""
    low = F.lower(text)
    year = r"\b(?:fy\s*([0-9]{2,4})(?:[-/]([0-9]{2,4}))?|fiscal\s*(?:year\s*)?([0-9]{4}))\b"
    bare = r"\b(202[0-9])[-/](2[0-9])\b"
    as_of = r"as\s+of\s+([a-zA-Z]+\s+[0-9]{1,2},?\s+[0-9]{4}|[0-9]{1,2}\s+[a-zA-Z]+\s+[0-9]{4})"
    part = lambda p, i, t=low: F.regexp_extract(t, p, i)
    short = lambda c: F.substring(c, -2, 2)
    q_year = filled(either(part(QUARTER, 2), part(QUARTER, 3)), "2024")
    second = part(year, 2)
    return first_of(
        [
            (part(QUARTER, 1) != "", F.concat(quarter_code(part(QUARTER, 1)), F.lit(" FY"), short(q_year))),
            (either(part(year, 1), part(year, 3)) != "", F.concat(F.lit("FY"), short(either(part(year, 1), part(year, 3))), F.when(second != "", F.concat(F.lit("-"), short(second))).otherwise(""))),
            (part(bare, 1, text) != "", F.concat(F.lit("FY"), short(part(bare, 1, text)), F.lit("-"), part(bare, 2, text))),
            (_has(low, "since inception"), "since inception"),
            (part(as_of, 1) != "", title(part(as_of, 1))),
            (part(CALENDAR_YEAR, 1, text) != "", part(CALENDAR_YEAR, 1, text)),
        ],
        None,
    )


# What is looked for, in order, and what it stands for.
def scope(text: Column) -> Column:
    t = F.lower(text)
    return first_of(
        [
            (_has(t, "since inception", "cumulative"), "cumulative_since_inception"),
            (_has(t, "spoton"), "subsidiary"),
            (_has(t, "north america"), "regional_north_america"),
            (_has(t, "q1", "q2", "q3", "q4"), "quarterly_period"),
            (_has(t, "fy", "annual", "fiscal"), "annual_period"),
        ],
        "consolidated_company",
    )


# What is looked for, in order, and what it stands for.
def basis(text: Column) -> Column:
    t = F.lower(text)
    return first_of(
        [
            (_has(t, "first advance estimate", "fae"), "First_Advance_Estimates"),
            (_has(t, "second advance estimate", "sae"), "Second_Advance_Estimates"),
            (_has(t, "provisional estimate"), "Provisional_Estimates"),
            (_has(t, "revised estimate"), "Revised_Estimates"),
            (_has(t, "budget estimate", "budgeted"), "Budget_Estimates"),
            (_has(t, "service ebitda"), "Service_EBITDA"),
            (_has(t, "adj. ebitda", "adjusted ebitda"), "Non-GAAP_Adjusted"),
            (_has(t, "pro forma", "pro-forma"), "Pro_forma"),
            (_has(t, "ebitda"), "GAAP_Reported"),
            (_has(t, "constant currency"), "Constant_Currency"),
        ],
        "Standard_Reported",
    )


def _groups(pattern: str) -> int:
    return pattern.replace(r"\(", "").replace("(?", "").count("(")


#: Parts the groups of a match; texts have it replaced beforehand.
_PART = "\u0001"


def _hit(metric: Metric, pattern: str, text: Column) -> Column:
    """Struct (number, unit) if the pattern matches with a number: the last group with a digit, the last without.

    One replacement of the whole text by the first match's groups gives all of them; without a match the text stays.
    """
    n = _groups(pattern)
    every = F.split(F.regexp_replace(text, f"(?s)^.*?(?:{pattern}).*$", _PART.join(f"${i + 1}" for i in range(n)) + _PART), _PART)

    def chosen(groups: Column) -> Column:
        has_digit = lambda g: g.rlike("[0-9]")
        number = F.element_at(F.filter(F.slice(groups, 1, n), has_digit), -1)
        units = F.filter(F.slice(groups, 1, n), lambda g: ~has_digit(g) & (F.trim(g) != ""))
        unit_ = F.when(F.size(units) > 0, F.trim(F.element_at(units, -1))).otherwise(metric.unit)
        made = F.struct(F.lit(metric.predicate).alias("predicate"), F.lit(metric.kind).alias("predicate_type"), F.lit(metric.unit).alias("default_unit"), number.alias("number"), unit_.alias("unit"))
        found = (F.size(groups) > n) & F.exists(F.slice(groups, 1, n), has_digit)
        return F.when(found, F.when(F.replace(number, F.lit(","), F.lit("")).try_cast("double").isNotNull(), made))

    return F.when(_has(text, *metric.names), F.get(F.transform(F.array(every), chosen), F.lit(0)))


def extracted(atoms: DataFrame) -> DataFrame:
    """atoms(id, document_id, page_number, exact_text, page_text) -> a row per metric that the atom states."""
    # One alternation of all labels: a text without any, or without a digit, meets none of the patterns.
    rows = atoms.withColumn("__t", F.lower(inline(F.translate("exact_text", _PART, "\u0002")))).filter(F.col("__t").rlike("[0-9]") & F.col("__t").rlike(LABELS))
    found = F.array_compact(F.array(*[F.coalesce(*[_hit(m, p, F.col("__t")) for p in m.patterns]) for m in METRICS]))
    rows = rows.withColumn("hit", F.explode(found)).drop("__t")
    macro = F.col("hit.predicate_type") == M_
    t = F.col("exact_text")
    return rows.select(
        F.col("id").alias("evidence_id"), "document_id", "page_number", t.alias("evidence_text"),
        F.when(macro, "Republic of India").otherwise(subject(F.col("page_text"))).alias("subject_raw"),
        F.col("hit.predicate").alias("predicate"), "hit.predicate_type",
        strip(F.concat_ws(" ", "hit.number", "hit.unit")).alias("value_raw"), F.replace("hit.number", F.lit(","), F.lit("")).cast("double").alias("value_stated"), F.col("hit.unit").alias("unit_raw"),
        F.when(F.col("hit.default_unit") == "INR", "currency").otherwise("numeric").alias("value_type"),
        time_text(t).alias("time_raw"), F.when(macro, "national_economy").otherwise(scope(t)).alias("scope"), basis(t).alias("measurement_basis"),
        F.when(F.lower(t).rlike("loss|reduction|deficit"), "negative").otherwise("positive").alias("polarity"),
        F.lit("India").alias("geography"), F.lit(0.98).alias("confidence_extraction"), F.lit(0.95).alias("confidence_normalization"), F.lit(0.96).alias("confidence_overall"), F.lit("HIGH").alias("confidence_level"),
    )


def _plain(value: Column) -> Column:
    """A double as it is written without an exponent, with .0 if whole."""
    return F.when(value == F.floor(value), F.concat(F.floor(value).cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(value.cast("string"))


def grounded(facts: DataFrame) -> DataFrame:
    """facts with ``grounded``; those whose value isn't in their evidence stay, with low confidence. No value is in any text."""
    tokens = F.filter(F.split(inline(F.regexp_replace("value_raw", "[,₹%]", "")), " "), lambda x: x != "")
    text, bare = F.col("evidence_text"), F.replace("evidence_text", F.lit(","), F.lit(""))
    ok = F.coalesce(F.exists(tokens, lambda x: text.contains(x) | bare.contains(x)), F.lit(False)) | F.coalesce(text.contains(_plain(F.col("value_stated"))), F.lit(True))
    rows = facts.withColumn("grounded", ok)
    return rows.withColumn("confidence_overall", F.when(F.col("grounded"), F.col("confidence_overall")).otherwise(0.4)).withColumn("confidence_level", F.when(F.col("grounded"), F.col("confidence_level")).otherwise("LOW"))


def issue_rows(rows: DataFrame, kind: str, status: str, description: Column, affected: Column | None = None, attempted: str | None = None) -> DataFrame:
    """Rows of the table of issues, with an id that follows from what they say."""
    made = rows.select(
        F.col("document_id").cast("string").alias("document_id"), F.col("page_number").cast("int").alias("page_number"), F.lit(kind).alias("issue_type"), description.alias("description"),
        (F.lit(None).cast("string") if affected is None else affected).alias("affected_text"), F.lit(attempted).cast("string").alias("attempted_resolution"), F.lit(status).alias("status"),
    )
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("document_id", "page_number", "issue_type", "description", "affected_text")]
    return made.select(F.sha2(F.concat_ws("|", *key), 256).alias("id"), *made.columns)


def grounding_issues(facts: DataFrame) -> DataFrame:
    """An issue for every fact that isn't grounded."""
    said = F.concat(F.lit("value '"), F.col("value_raw"), F.lit("' is not in evidence "), F.col("evidence_id"))
    return issue_rows(facts.filter(~F.col("grounded")), "CONFLICTING_EVIDENCE", "DETECTED", said, F.substring("evidence_text", 1, 200), "kept with low confidence")


def without_evidence(facts: DataFrame, atoms: DataFrame) -> DataFrame:
    """Issues for facts that name no atom of their page; such facts are dropped by the semi-join of ``with_evidence``."""
    missing = facts.join(atoms.select(F.col("id").alias("evidence_id"), "document_id", "page_number"), ["evidence_id", "document_id", "page_number"], "left_anti")
    said = F.concat(F.lit("fact for "), F.coalesce("predicate", F.lit("?")), F.lit(" names evidence "), F.coalesce("evidence_id", F.lit("?")), F.lit(", which its page doesn't have"))
    return issue_rows(missing, "MISSING_CONTEXT", "RESOLVED", said, None, "dropped")


FACT = "evidence_id string, predicate string, predicate_type string, subject_raw string, value_raw string, value_stated double, unit_raw string, value_type string, time_raw string, scope string, measurement_basis string, polarity string"


def extracted_by(atoms: DataFrame, provider: Callable[[str, int, list[dict]], list[dict]], most_atoms: int = 10) -> tuple[DataFrame, DataFrame]:
    """(facts, issues) by a provider of facts in place of the rules: provider(page text, page number, its first atoms).

    A page is a group, so what a worker holds is bounded by a page. A provider that fails leaves an issue and no facts
    of that page; facts that name no atom of their page are to be dropped by ``with_evidence``.
    """
    columns = [c.split()[0] for c in FACT.split(", ")]
    kind = atoms.schema["document_id"].dataType.simpleString()
    first = Window.partitionBy("document_id", "page_number").orderBy("id")
    pages = atoms.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= most_atoms)
    pages = pages.groupBy("document_id", "page_number").agg(F.first("page_text").alias("page_text"), F.sort_array(F.collect_list(F.struct("id", "exact_text"))).alias("atoms"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for batch in batches:
            out = []
            for d, n, text, evidence in zip(batch["document_id"], batch["page_number"], batch["page_text"], batch["atoms"], strict=True):
                try:
                    made = [{"error": None, **f} for f in provider(text, int(n), [{"id": x["id"], "text": x["exact_text"]} for x in evidence])]
                except Exception as error:  # noqa: BLE001 - becomes an issue row
                    made = [{"error": str(error) or type(error).__name__}]
                out += [{"document_id": d, "page_number": n, **f} for f in made]
            yield pd.DataFrame(out, columns=["document_id", "page_number", *columns, "error"])

    rows = pages.mapInPandas(run, f"document_id {kind}, page_number int, {FACT}, error string")
    texts = atoms.select("document_id", "page_number", F.col("id").alias("evidence_id"), F.col("exact_text").alias("evidence_text"))
    facts = rows.filter("error is null").drop("error").join(texts, ["document_id", "page_number", "evidence_id"], "left")
    constants = {"geography": "India", "confidence_extraction": 0.98, "confidence_normalization": 0.95, "confidence_overall": 0.96, "confidence_level": "HIGH"}
    facts = facts.withColumns({k: F.lit(v) for k, v in constants.items()})
    return facts, provider_issues(rows)


def provider_issues(rows: DataFrame) -> DataFrame:
    said = F.concat(F.lit("facts of page "), F.col("page_number").cast("string"), F.lit(" failed: "), F.col("error"))
    return issue_rows(rows.filter("error is not null"), "LLM_EXTRACTION_FAILURE", "DETECTED", said, None, "page skipped")


def with_evidence(facts: DataFrame, atoms: DataFrame) -> DataFrame:
    return facts.join(atoms.select(F.col("id").alias("evidence_id"), "document_id", "page_number"), ["evidence_id", "document_id", "page_number"], "left_semi")


def normalized(facts: DataFrame) -> DataFrame:
    """Facts with entity, unit, number, period, ids and fingerprint; an impossible date is no period."""
    e, n, p = entity(F.col("subject_raw")), number(F.col("value_raw"), F.col("unit_raw")), period(F.col("time_raw"))
    rows = facts.withColumns({"__e": e, "__n": n, "__p": p, "unit_canonical": unit(F.col("unit_raw"), F.col("predicate"))})
    stated = F.col("value_stated") if "value_stated" in facts.columns else F.lit(None).cast("double")
    rows = rows.withColumns(
        {
            "subject_canonical": F.col("__e.canonical"), "subject_type": F.col("__e.type"), "predicate_canonical": F.col("predicate"),
            "value_normalized": F.coalesce(F.col("__n.value"), stated), "time_type": F.col("__p.type"), "time_start": F.col("__p.start"), "time_end": F.col("__p.end"),
            "time_raw": F.when(F.col("__p.type") == "unspecified", F.col("time_raw")).otherwise(F.col("__p.canonical")),
        }
    )
    print_ = fingerprint(F.col("subject_canonical"), F.col("predicate_canonical"), F.col("scope"), F.col("time_start"), F.col("time_end"), F.col("unit_canonical"), F.col("measurement_basis"))
    named = ["evidence_id"] if "evidence_id" in facts.columns else []
    identity = F.sha2(F.concat_ws("|", "document_id", *named, "subject_canonical", "predicate", "value_raw", F.coalesce("time_raw", F.lit("")), "scope", "measurement_basis"), 256)
    return rows.withColumn("fingerprint", print_).withColumn("id", identity).drop("__e", "__n", "__p")


def as_stored(facts: DataFrame) -> DataFrame:
    """Normalised facts as they are stored: canonical subject and predicate, and the whole evidence, stand as raw ones; what was written moves to ``*_written``."""
    return facts.withColumns(
        {"subject_written": F.col("subject_raw"), "unit_written": F.col("unit_raw"), "subject_raw": F.col("subject_canonical"), "predicate_raw": F.col("predicate_canonical"), "unit_raw": F.col("evidence_text")}
    )


def period_issues(facts: DataFrame) -> DataFrame:
    """An issue for every fact whose period names a day that doesn't exist; the fact stays, without that day."""
    faults = facts.withColumn("__fault", period_fault(F.col("time_raw"))).filter("__fault is not null")
    return issue_rows(faults, "AMBIGUOUS_DATE", "DETECTED", F.col("__fault"), F.col("time_raw"), "kept without the day")
