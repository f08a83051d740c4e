"""Scalars on literal texts, entities by a table of aliases, members of blocks."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tesserae.functions import normalize as N
from tesserae.operators import aliases as L
from tesserae.operators import extract as X
from tesserae.operators import resolve as R
from tesserae.plans import api

from .test_pairs import FACT, some

NUMBERS = [
    ("₹8,142 Cr", None, 81420000000.0, 1e7, "cr"), ("50 Lakhs", None, 5000000.0, 1e5, "lakhs"), ("1.4 Mn Tons", None, 1400000.0, 1e6, "mn"), (">2.8 Bn", None, 2800000000.0, 1e9, "bn"),
    ("(127) Cr", None, -1270000000.0, 1e7, "cr"), ("6.4%", None, 6.4, 1.0, "none"), ("4.7 per cent", "percent", 4.7, 1.0, "none"), ("8,142cr", None, 8142.0, 1.0, "none"),
    ("-5 mn", None, -5000000.0, 1e6, "mn"), ("n/a", None, None, 1.0, "none"), (", 500", None, None, 1.0, "none"), ("5 thousand million", None, 5000.0, 1e3, "thousand"),
]
UNITS = [
    ("₹", None, "INR"), ("Rs.", None, "INR"), ("Cr", None, "INR"), ("mn tons", None, "metric_tonnes"), ("express parcel shipments", None, "shipments"), ("pin codes", None, "pin_codes"), ("%", None, "percent"), ("per cent", None, "percent"),
    (None, "service EBITDA", "INR"), (None, "real GDP growth rate", "percent"), (None, "PTL freight tonnage", "metric_tonnes"), ("bn", "revenue", "shipments"), ("mn", "revenue", "INR"), ("mn", "turnover", "mn"), (None, None, None),
]
PERIODS = [
    ("FY24", "fiscal_year", "2023-04-01", "2024-03-31", "FY2023-24"), ("FY2024/25", "fiscal_year", "2024-04-01", "2025-03-31", "FY2024-25"), ("Q4 FY24", "quarter", "2024-01-01", "2024-03-31", "Q4 FY2023-24"),
    ("Q1 FY25", "quarter", "2024-04-01", "2024-06-30", "Q1 FY2024-25"), ("since inception", "cumulative", None, None, "since_inception"), ("March 31, 2024", "as_of", "2024-03-31", "2024-03-31", "2024-03-31"),
    ("31 March 2024", "as_of", "2024-03-31", "2024-03-31", "2024-03-31"), ("2024", "calendar_year", "2024-01-01", "2024-12-31", "CY2024"), ("Q3", "quarter", "2023-10-01", "2023-12-31", "Q3 FY2023-24"),
    ("Q1:2024-25", "quarter", "2023-04-01", "2023-06-30", "Q1 FY2023-24"), ("2024-03-31", "fiscal_year", "2024-04-01", "2003-03-31", "FY2024-03"), ("FY97", "fiscal_year", "2096-04-01", "2097-03-31", "FY2096-97"),
    ("1999", "unspecified", None, None, "1999"), ("", "unspecified", None, None, "unspecified"), ("second quarter of fy 2025", "quarter", "2024-07-01", "2024-09-30", "Q2 FY2024-25"), ("February 31, 2024", "calendar_year", "2024-01-01", "2024-12-31", "CY2024"),
]
ENTITIES = [
    ("Delhivery Ltd.", "Delhivery Limited", "organization"), ("delhivery", "Delhivery Limited", "organization"), ("RBI", "Reserve Bank of India", "central_bank"), ("Indian Economy", "Republic of India", "country"),
    ("IMF", "International Monetary Fund", "multilateral_institution"), ("Acme Company", "Delhivery Limited", "organization"), ("o'neil corp", "O'Neil Corp", "organization"), (" ", "Unknown Entity", "unknown"), (None, "Unknown Entity", "unknown"),
]
FAMILY = [
    ("revenue from services", "REVENUE"), ("total revenue", "REVENUE"), ("service EBITDA", "EBITDA"), ("adjusted EBITDA", "EBITDA"), ("ptl freight tonnage", "FREIGHT_VOLUME"), ("express parcel shipments volume", "PARCEL_VOLUME"), ("real GDP growth rate", "GDP_GROWTH"),
    ("gross fiscal deficit", "FISCAL_DEFICIT"), ("current account deficit", "CURRENT_ACCOUNT_DEFICIT"), ("volume", "FREIGHT_VOLUME"), (" ", "REVENUE"), ("", "UNKNOWN_FAMILY"), ("net promoter score", "NET_PROMOTER_SCORE"),
]
ATOMS = [
    ("e1", "As per the first advance estimates of national accounts, India's real GDP is estimated to grow by 6.4 per cent in FY25."),
    ("e2", "Gross fiscal deficit declining to 4.7 per cent of GDP in FY25."),
    ("e3", "Delhivery reported revenue of ₹8,142 Cr in FY24."),
    ("e4", "Adjusted EBITDA: ₹76 Cr in Q4 FY24"),
    ("e5", ">2.8 Bn express parcel shipments since inception"),
    ("e6", "18,793 pin codes covered as of March 31, 2024"),
]
FOUND = [
    ("e1", "real GDP growth rate", "6.4 per cent", "Republic of India", "FY25", "First_Advance_Estimates", "positive", True), ("e2", "gross fiscal deficit", "4.7 per cent", "Republic of India", "FY25", "Standard_Reported", "negative", True),
    ("e4", "adjusted EBITDA", "76 cr", "Delhivery Limited", "Q4 FY24", "Non-GAAP_Adjusted", "positive", True), ("e4", "EBITDA", "76 cr", "Delhivery Limited", "Q4 FY24", "Non-GAAP_Adjusted", "positive", True),
    ("e5", "express parcel shipments volume", "2.8 bn", "Delhivery Limited", "since inception", "Standard_Reported", "positive", True), ("e6", "pin codes covered", "18,793 pin_codes", "Delhivery Limited", "March 31, 2024", "Standard_Reported", "positive", True),
]


def test_scalars(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = frame([r[:2] for r in NUMBERS], "t string, h string").select("t", N.number(F.col("t"), F.col("h")).alias("n")).select("t", "n.*").collect()
    assert [tuple(r) for r in got] == [(t, v, m, s) for t, _, v, m, s in NUMBERS]
    got = frame([r[:2] for r in UNITS], "t string, h string").select("t", "h", N.unit(F.col("t"), F.col("h"))).collect()
    assert [tuple(r) for r in got] == UNITS
    got = frame([r[:1] for r in PERIODS], "t string").select("t", N.period(F.col("t")).alias("p")).select("t", "p.type", F.col("p.start").cast("string"), F.col("p.end").cast("string"), "p.canonical").collect()
    assert [tuple(r) for r in got] == PERIODS
    got = frame([r[:1] for r in ENTITIES], "t string").select("t", N.entity(F.col("t")).alias("e")).select("t", "e.*").collect()
    assert [tuple(r) for r in got] == ENTITIES
    got = frame([r[:1] for r in FAMILY], "t string").select("t", N.family(F.col("t"))).collect()
    assert [tuple(r) for r in got] == FAMILY
    rows = frame(ATOMS, "id string, exact_text string").withColumns({"document_id": F.lit("d"), "page_number": F.lit(1), "page_text": F.lit("Delhivery")})
    got = X.grounded(X.extracted(rows)).select("evidence_id", "predicate", "value_raw", "subject_raw", "time_raw", "measurement_basis", "polarity", "grounded").collect()
    assert sorted(tuple(r) for r in got) == sorted(FOUND)


def test_faults_of_periods(spark):
    texts = ["February 31, 2024", "31 june 2023", "29 February 2023", "29 February 2024", "Q1 February 31, 2024", "FY24 February 31, 2024", "since inception February 31, 2024", "Smarch 40, 2024", "", None, "2024"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(N.checked_period(F.col("t"))["fault"]).collect()
    assert [r[0] for r in got] == ["no such day: february 31, 2024", "no such day: 31 june 2023", "no such day: 29 february 2023", *[None] * 8]


def brute_alias(text, aliases):
    t = (text or "").strip().lower()
    ranked = sorted((place, alias.strip().lower(), name, kind) for place, alias, name, kind in aliases)
    equal = [x for x in ranked if t and x[1] == t]
    inside = [x for x in ranked if t and len(x[1]) >= L.SHORTEST and x[1] in t]
    return (equal + inside)[0][2:] if equal + inside else ("Unknown Entity", "unknown")


def test_entities_by_aliases(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abé ", k=n))
    aliases = [(i, word(rng.randint(1, 6)), f"name {i}", f"kind {i % 3}") for i in range(300)] + [(500, "", "empty", "x"), (501, "Aaa", "late", "x"), (1, " AAA ", "early", "x")]
    texts = [word(rng.randint(0, 14)) for _ in range(400)] + [None, "", " ", "aa", "AAA", "é\U0001f600é", "x" * 5000 + "aaa"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, raw string").withColumns({"t": F.lit("clash"), "alias": F.lit("clash")})
    got = {r["i"]: (r["name"], r["kind"]) for r in L.entities(rows.drop("t"), "raw", spark.createDataFrame(aliases, "place int, alias string, name string, kind string")).collect()}
    assert got == {i: brute_alias(t, aliases) for i, t in enumerate(texts)}


def test_aliases_are_not_broadcast_and_meet_few_texts(spark):
    """However small the tables seem, no alias goes through the driver, and aliases that differ by a number meet few texts."""
    aliases = spark.range(3000).selectExpr("id AS place", "'large ring works ' || id || ' ltd' AS alias", "'name ' || id AS name", "'kind' AS kind")
    texts = spark.range(3000).selectExpr("'the large ring works ' || id || ' ltd site' AS t")
    plan = L.matches(texts, aliases)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "CartesianProduct" not in plan
    assert 3000 <= L.candidates(texts, aliases.select("alias")).count() <= 30_000
    found = L.entities(texts.selectExpr("t AS raw"), "raw", aliases)
    assert found.filter("regexp_extract(raw, '[0-9]+', 0) = substr(name, 6)").count() == 3000


def test_members_of_blocks(spark):
    rows = some(3, 120)
    facts = spark.createDataFrame(rows, FACT)
    got = {r["block"]: (r["facts"], r["members"]) for r in R.block_members(facts, 4).collect()}
    by = {}
    for r in R.with_block(facts).select("block", "id").collect():
        by.setdefault(r["block"], []).append(r["id"])
    assert got == {b: (len(ids), sorted(ids)[:4]) for b, ids in by.items()}
    plan = R.block_members(facts, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # before the exchange and after it


def test_numbers_as_a_console_writes_them(spark):
    """Products of decimals by ten million keep the digits that were written, however the double comes out."""
    cases = [(8.1234 * 1e7, "81234000"), (1.1281 * 1e7, "11281000"), (38.1811 * 1e7, "381811000"), (0.0581 * 1e7, "581000"), (81e8, "8100000000"), (6.4, "6.4"), (1234567.75, "1234567.75"), (12345678.25, "12345678.25"), (-2.5, "-2.5"), (0.0, "0"), (1e20, "1" + "0" * 20), (None, None)]
    cases += [(n / 10000 * 1e7, str(n * 1000)) for n in range(1, 60000, 7)]
    rows = spark.createDataFrame(cases, "value double, want string")
    wrong = rows.withColumn("got", api.shown_number(F.col("value"))).filter("not got <=> want")
    assert [tuple(r) for r in wrong.limit(5).collect()] == []
    assert any(v % 1 for v, _ in cases[12:])
    facts = spark.createDataFrame([("a", 32.3811 * 1e7), ("b", 6.0e7)], "id string, value_normalized double").withColumns({c: F.lit("x") for c in ("subject_canonical", "subject_raw", "predicate_canonical", "predicate", "value_raw", "evidence_text")})
    assert [r["id"] for r in api.console_filter(facts, search="323811").collect()] == ["a"]
