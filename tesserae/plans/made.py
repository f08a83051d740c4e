"""Texts made from the rows of ``orders``, one of several kinds for each row, beside SQL that says what each of them means.

The letters stand for numbers of the row; a text and what it means are SQL that both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: v has four digits, vv is v with a comma, c and dd two digits, d and e one, y is a year from 2018 to 2026, yy its end, q a quarter.
LETTERS = (
    "o_orderkey AS id", "1000 + (o_custkey * 13) % 9000 AS v", "10 + o_custkey % 90 AS c", "1 + o_custkey % 9 AS d", "o_custkey % 10 AS e", "CAST(2018 + o_custkey % 9 AS INT) AS y", "CAST(1 + o_custkey % 4 AS INT) AS q",
    "CAST(10 + o_custkey % 19 AS INT) AS dd", "o_orderkey % {n} AS kind",
)
MORE = ("substr(CAST(v AS STRING), 1, 1) || ',' || substr(CAST(v AS STRING), 2) AS vv", "right(CAST(y AS STRING), 2) AS yy", "CAST(d || '.' || e AS DOUBLE) AS de")
Cases = list[tuple[str, ...]]


def letters(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.selectExpr(*[x.format(n=n) for x in LETTERS]).selectExpr("*", *MORE)


def letters_sql(n: int) -> str:
    inner = ", ".join(LETTERS).format(n=n)
    return f"(SELECT *, {', '.join(MORE)} FROM (SELECT {inner} FROM orders))".replace("AS STRING", "AS VARCHAR")


def chosen(values: list[str], kind: str) -> str:
    return f"CAST(CASE kind {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(values))} END AS {kind})"


def rows(spark: SparkSession, sf_dir: str, cases: Cases, given: tuple[str, ...]) -> DataFrame:
    """id and the ``given`` columns, which are the first of each case."""
    made = [chosen([case[i] for case in cases], "STRING") + f" AS {name}" for i, name in enumerate(given)]
    return letters(spark, sf_dir, len(cases)).selectExpr("id", *made)


def oracle(cases: Cases, columns: dict[str, str]) -> str:
    """id and all columns of the cases, by name and type."""
    made = [chosen([case[i] for case in cases], kind) + f' AS "{name}"' for i, (name, kind) in enumerate(columns.items())]
    return f"SELECT id, {', '.join(made)} FROM {letters_sql(len(cases))}".replace("AS STRING", "AS VARCHAR")


#: text, hint, value, factor, scale word.
NUMBERS: Cases = [
    ("'₹' || vv || ' Cr'", "NULL", "v * 1e7", "1e7", "'cr'"), ("c || ' Lakhs'", "NULL", "c * 1e5", "1e5", "'lakhs'"), ("d || ' lakh'", "NULL", "d * 1e5", "1e5", "'lakh'"), ("d || '.' || e || ' Mn Tons'", "NULL", "de * 1e6", "1e6", "'mn'"),
    ("'>' || d || '.' || e || ' Bn'", "NULL", "de * 1e9", "1e9", "'bn'"), ("'(' || c || ') Cr'", "NULL", "-(c * 1e7)", "1e7", "'cr'"), ("d || '.' || e || '%'", "NULL", "de", "1e0", "'none'"), ("d || '.' || e || ' per cent'", "'percent'", "de", "1e0", "'none'"),
    ("vv || 'cr'", "NULL", "v", "1e0", "'none'"), ("'-' || d || ' mn'", "NULL", "-(d * 1e6)", "1e6", "'mn'"), ("'n/a'", "NULL", "NULL", "1e0", "'none'"), ("', ' || c", "NULL", "NULL", "1e0", "'none'"), ("c || ' thousand million'", "NULL", "c * 1e3", "1e3", "'thousand'"),
    ("d || ' trillion'", "NULL", "d * 1e12", "1e12", "'trillion'"), ("d || ' tn'", "NULL", "d * 1e12", "1e12", "'tn'"), ("CAST(v AS STRING)", "'crore'", "v * 1e7", "1e7", "'crore'"), ("v || ' cré'", "NULL", "v", "1e0", "'none'"), ("v || ' crश'", "NULL", "v", "1e0", "'none'"),
    ("v || ' écr'", "NULL", "v", "1e0", "'none'"), ("(y - 1) || '-' || yy || ' sum ' || c", "NULL", "y - 1", "1e0", "'none'"), ("NULL", "'mn'", "NULL", "1e0", "'none'"), ("''", "NULL", "NULL", "1e0", "'none'"),
]

#: raw, predicate, unit.
UNITS: Cases = [
    ("'₹'", "NULL", "'INR'"), ("c || ' crore'", "NULL", "'INR'"), ("c || ' bps'", "NULL", "'basis_points'"), ("c || ' pin codes'", "NULL", "'pin_codes'"), ("c || ' employees'", "NULL", "'persons'"), ("c || ' trucks'", "NULL", "'vehicles'"),
    ("c || ' delivery centres'", "NULL", "'centres'"), ("c || ' sq ft'", "NULL", "'sq_ft'"), ("c || ' days'", "NULL", "'days'"), ("c || ' usd'", "NULL", "'USD'"), ("c || ' mn tons'", "NULL", "'metric_tonnes'"), ("'per cent'", "NULL", "'percent'"),
    ("NULL", "'service EBITDA ' || c", "'INR'"), ("NULL", "'real GDP growth rate'", "'percent'"), ("''", "'PTL freight tonnage'", "'metric_tonnes'"), ("NULL", "'express parcel count'", "'shipments'"), ("NULL", "'pin code reach'", "'pin_codes'"),
    ("NULL", "'tractor count'", "'vehicles'"), ("NULL", "'delivery center count'", "'centres'"), ("NULL", "'area leased'", "'sq_ft'"), ("NULL", "'workforce size'", "'persons'"), ("'bn'", "'revenue'", "'shipments'"), ("'mn'", "'revenue'", "'INR'"),
    ("'mn'", "'turnover'", "'mn'"), ("NULL", "NULL", "NULL"), ("c || ' widgets'", "NULL", "c || ' widgets'"), ("c || ' daysश'", "NULL", "c || ' daysश'"), ("c || ' édays'", "NULL", "c || ' édays'"),
]

_FY = ("'fiscal_year'", "make_date(y - 1, 4, 1)", "make_date(y, 3, 31)", "'FY' || (y - 1) || '-' || yy", "NULL")
_CY = ("'calendar_year'", "make_date(y, 1, 1)", "make_date(y, 12, 31)", "'CY' || y")
_DAY = ("'as_of'", "make_date(y, 3, dd)", "make_date(y, 3, dd)", "y || '-03-' || dd", "NULL")
#: raw, type, start, end, as written after normalising, fault.
PERIODS: Cases = [
    ("'FY' || yy", *_FY), ("'FY' || (y - 1) || '/' || yy", *_FY), ("(y - 1) || '-' || yy", *_FY), ("'fiscal year ' || y", *_FY), ("'March ' || dd || ', ' || y", *_DAY), ("dd || ' March ' || y", *_DAY), ("CAST(y AS STRING)", *_CY, "NULL"),
    ("'as of 5 Dec ' || y", "'as_of'", "make_date(y, 12, 5)", "make_date(y, 12, 5)", "y || '-12-05'", "NULL"), ("'since inception'", "'cumulative'", "NULL", "NULL", "'since_inception'", "NULL"),
    ("'Q' || q || ' FY' || yy", "'quarter'", "CASE WHEN q < 4 THEN make_date(y - 1, 3 * q + 1, 1) ELSE make_date(y, 1, 1) END", "CASE q WHEN 1 THEN make_date(y - 1, 6, 30) WHEN 2 THEN make_date(y - 1, 9, 30) WHEN 3 THEN make_date(y - 1, 12, 31) ELSE make_date(y, 3, 31) END", "'Q' || q || ' FY' || (y - 1) || '-' || yy", "NULL"),
    ("'second quarter of fy ' || y", "'quarter'", "make_date(y - 1, 7, 1)", "make_date(y - 1, 9, 30)", "'Q2 FY' || (y - 1) || '-' || yy", "NULL"), ("'Q3'", "'quarter'", "make_date(2023, 10, 1)", "make_date(2023, 12, 31)", "'Q3 FY2023-24'", "NULL"),
    ("'Q1:' || (y - 1) || '-' || yy", "'quarter'", "make_date(y - 2, 4, 1)", "make_date(y - 2, 6, 30)", "'Q1 FY' || (y - 2) || '-' || right(CAST(y - 1 AS STRING), 2)", "NULL"), ("y || '-03-31'", "'fiscal_year'", "make_date(y, 4, 1)", "make_date(2003, 3, 31)", "'FY' || y || '-03'", "NULL"),
    ("'February 31, ' || y", *_CY, "'no such day: february 31, ' || y"), ("'31 June ' || y", *_CY, "'no such day: 31 june ' || y"), ("'199' || e", "'unspecified'", "NULL", "NULL", "'199' || e", "NULL"), ("''", "'unspecified'", "NULL", "NULL", "'unspecified'", "NULL"), ("NULL", "'unspecified'", "NULL", "NULL", "'unspecified'", "NULL"),
    ("'FY' || yy || 'é'", "'unspecified'", "NULL", "NULL", "'FY' || yy || 'é'", "NULL"), ("'Smarch ' || dd || ', ' || y", *_CY, "NULL"),
]

#: raw, canonical, type.
ENTITIES: Cases = [
    ("'Delhivery Ltd.'", "'Delhivery Limited'", "'organization'"), ("'delhivery unit ' || c", "'Delhivery Limited'", "'organization'"), ("'desk ' || c || ' of the RBI'", "'Reserve Bank of India'", "'central_bank'"), ("'Indian Economy'", "'Republic of India'", "'country'"),
    ("'IMF'", "'International Monetary Fund'", "'multilateral_institution'"), ("'Spoton hub ' || c", "'Spoton Logistics'", "'subsidiary'"), ("'Acme Company ' || c", "'Delhivery Limited'", "'organization'"), ("'o''neil unit ' || c", "'O''Neil Unit ' || c", "'organization'"),
    ("' '", "'Unknown Entity'", "'unknown'"), ("NULL", "'Unknown Entity'", "'unknown'"), ("'ACME UNIT ' || c", "'Acme Unit ' || c", "'organization'"),
]

#: predicate, family.
FAMILY: Cases = [
    ("'Total Revenue ' || c", "'REVENUE'"), ("'EBITDA of unit ' || c", "'EBITDA'"), ("'freight tonnage in ' || c", "'FREIGHT_VOLUME'"), ("'parcel volume in ' || c", "'PARCEL_VOLUME'"), ("'pin codes in zone ' || c", "'NETWORK_REACH'"), ("'delivery centres in ' || c", "'DELIVERY_CENTRES'"),
    ("'tractors in ' || c", "'FLEET_SIZE'"), ("'headcount of ' || c", "'WORKFORCE'"), ("'warehouse area of ' || c", "'LOGISTICS_AREA'"), ("'gdp growth of ' || c", "'GDP_GROWTH'"), ("'cpi inflation of ' || c", "'INFLATION'"), ("'fiscal deficit of ' || c", "'FISCAL_DEFICIT'"),
    ("'current account deficit of ' || c", "'CURRENT_ACCOUNT_DEFICIT'"), ("'net promoter score ' || c", "'NET_PROMOTER_SCORE_' || c"), ("''", "'UNKNOWN_FAMILY'"), ("NULL", "'UNKNOWN_FAMILY'"), ("' '", "'REVENUE'"), ("'volume'", "'FREIGHT_VOLUME'"),
]

_DE, _ADJUSTED = "d || '.' || e", ("c || ' cr'", "'Delhivery Limited'", "'Q4 FY' || yy", "'Non-GAAP_Adjusted'", "'positive'", "'Q4 FY' || (y - 1) || '-' || yy", "'INR'", "c * 1e7", "'currency'")
#: An atom's text, and what it states: predicate, value as written, subject, period as written, basis, polarity, period, unit, value, type of value.
ATOMS: list[tuple[str, list[tuple[str, ...]]]] = [
    (
        f"'As per the first advance estimates of national accounts, India''s real GDP is estimated to grow by ' || {_DE} || ' per cent in FY' || yy || '.'",
        [("'real GDP growth rate'", f"{_DE} || ' per cent'", "'Republic of India'", "'FY' || yy", "'First_Advance_Estimates'", "'positive'", "'FY' || (y - 1) || '-' || yy", "'percent'", "de", "'numeric'")],
    ),
    (f"'Gross fiscal deficit declining to ' || {_DE} || ' per cent of GDP in FY' || yy || '.'", [("'gross fiscal deficit'", f"{_DE} || ' per cent'", "'Republic of India'", "'FY' || yy", "'Standard_Reported'", "'negative'", "'FY' || (y - 1) || '-' || yy", "'percent'", "de", "'numeric'")]),
    ("'Delhivery reported revenue of ₹' || vv || ' Cr in FY' || yy || '.'", []),
    ("'Adjusted EBITDA: ₹' || c || ' Cr in Q4 FY' || yy", [("'adjusted EBITDA'", *_ADJUSTED), ("'EBITDA'", *_ADJUSTED)]),
    (f"'>' || {_DE} || ' Bn express parcel shipments since inception'", [("'express parcel shipments volume'", f"{_DE} || ' bn'", "'Delhivery Limited'", "'since inception'", "'Standard_Reported'", "'positive'", "'since_inception'", "'shipments'", "de * 1e9", "'numeric'")]),
    ("c || ',' || (100 + v % 900) || ' pin codes covered as of March ' || dd || ', ' || y", [("'pin codes covered'", "c || ',' || (100 + v % 900) || ' pin_codes'", "'Delhivery Limited'", "'March ' || dd || ', ' || y", "'Standard_Reported'", "'positive'", "y || '-03-' || dd", "'pin_codes'", "c * 1000 + 100 + v % 900", "'numeric'")]),
]
STATED = ("predicate", "value_raw", "subject_raw", "time_raw", "measurement_basis", "polarity", "period", "unit_canonical", "value_normalized", "value_type")


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rows(spark, sf_dir, [(text,) for text, _ in ATOMS], ("exact_text",))
    return made.select(F.col("id").cast("string").alias("id"), F.lit("d").alias("document_id"), F.lit(1).alias("page_number"), "exact_text", F.lit("Delhivery").alias("page_text"))


def stated_sql(columns: dict[str, str]) -> str:
    """A row for each fact that an atom states: ``evidence_id`` and columns by SQL of the names in STATED and ``evidence_text``."""
    out = []
    for i, (text, stated) in enumerate(ATOMS):
        for fact in stated:
            known = ", ".join(f"{x} AS f_{name}" for name, x in [*zip(STATED, fact, strict=True), ("evidence_text", text)])
            out.append(f"SELECT CAST(id AS STRING) AS evidence_id, {', '.join(f'{x} AS {name}' for name, x in columns.items())} FROM (SELECT id, {known} FROM {letters_sql(len(ATOMS))} WHERE kind = {i})")
    return " UNION ALL ".join(out).replace("AS STRING", "AS VARCHAR")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page with a table for each order: a row with empty cells, one without, one that is too short."""
    table = "named_struct('bbox', array(0.0D, 0.0D, 9.0D, 9.0D), 'headers', array('Metric', 'FY' || yy), 'rows', array(array('Revenue', '₹' || v || ' Cr'), array('', de || '%'), array('Orders', ''), array('x', ''), array('Trips', ' ' || c, 'more')))"
    made = letters(spark, sf_dir, 1)
    return made.selectExpr("CAST(id AS STRING) AS document_id", "1 AS page_number", "'Revenue ₹' || v || ' Cr' AS raw_text", "0 AS n_images", f"array({table}) AS tables")


PAGES_SQL = (
    "SELECT CAST(id AS VARCHAR) AS document_id, 'Table 1' AS section_heading, unnest([0, 1, 2, 4])::INT AS row_index, "
    "unnest(['Metric: Revenue | FY' || yy || ': ₹' || v || ' Cr', 'FY' || yy || ': ' || de || '%', 'Metric: Orders', 'Metric: Trips | FY' || yy || ': ' || c || ' | Col_2: more']) AS exact_text FROM " + letters_sql(1)
)
