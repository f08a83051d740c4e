"""Facts and pages made from the star-schema tables: each reporting view of the same figures is a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_of
from ..operators.atoms import paragraph_atoms
from ..operators.extract import extracted, grounded, normalized
from .store import materialized


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _crore(amount: Column) -> Column:
    """Rupees as text in crore with four decimals, by whole-number arithmetic."""
    n = F.round(amount / 1000, 0).cast("long")
    return F.concat(F.lit("₹"), F.floor(n / 10000).cast("string"), F.lit("."), F.lpad((n % 10000).cast("string"), 4, "0"), F.lit(" Cr"))


def _million(amount: Column) -> Column:
    return F.concat(F.lit("₹"), F.round(amount / 1_000_000, 0).cast("long").cast("string"), F.lit(" mn"))


def line_pages(docs: DataFrame, document_id: Column, page_number: Column, text: str) -> DataFrame:
    """Texts as pages whose blocks are their lines."""
    box = "struct<x0:double,y0:double,x1:double,y1:double,text:string>"
    blocks = F.transform(F.split(text, "\n"), lambda x: F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1"), x.alias("text")).cast(box))
    tables = F.array().cast("array<struct<bbox:array<double>,headers:array<string>,rows:array<array<string>>>>")
    images = F.when(F.length(text) < 400, 1).otherwise(0)
    return docs.select(document_id.alias("document_id"), page_number.alias("page_number"), F.col(text).alias("raw_text"), images.alias("n_images"), blocks.alias("blocks"), tables.alias("tables"))


def placed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, nation = table(spark, sf_dir, "orders"), table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name")
    fiscal = F.year("o_orderdate") + F.when(F.month("o_orderdate") >= 4, 1).otherwise(0)
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"), "c_name", "n_name", "n_nationkey", "n_regionkey", fiscal.alias("fy"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures by nation and year in several ledgers, and by customer and year in the accounts and their audit."""
    placed = placed_orders(spark, sf_dir)
    money = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("gross"), F.col("l_discount").cast("decimal(4,2)").alias("discount"))
    lines = money.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    by_orders = placed.groupBy("n_name", "fy").agg(F.sum("price").alias("amount"), F.count(F.lit(1)).alias("orders"))
    by_lines = lines.groupBy("n_name", "fy").agg(F.sum("gross").alias("gross"), F.sum(F.col("gross") * (1 - F.col("discount"))).alias("net"))
    by_region = placed.groupBy("n_regionkey", "fy").agg(F.sum("price").alias("amount"))
    by_customer = placed.groupBy("c_name", "fy").agg(F.sum("price").alias("amount"))

    def figures(df: DataFrame, subject: str, views: dict[str, str]) -> DataFrame:
        parts = ", ".join(f"struct('{document}' AS document_id, {subject} AS subject, fy, CAST({amount} AS DECIMAL(38,6)) AS amount)" for document, amount in views.items())
        return df.selectExpr(f"inline(array({parts}))")

    region = "concat('NATION_', n_regionkey)"
    every = figures(by_orders, "n_name", {"ledger_orders": "amount", "ops_report": "orders"})
    every = every.unionByName(figures(by_lines, "n_name", {"ledger_gross": "gross", "ledger_net": "net", "restated": "gross"})).unionByName(figures(by_region, region, {"regional": "amount"}))
    every = every.unionByName(figures(by_customer, "c_name", {"accounts": "amount", "accounts_audited": "amount"}))
    document = F.col("document_id")
    per = lambda values, default: first_of([(document == k, v) for k, v in values.items()], default)
    rows = every.withColumns(
        {
            "predicate": per({"ledger_orders": "total revenue", "regional": "total revenue", "accounts": "total revenue", "accounts_audited": "total revenue", "ledger_net": "turnover", "ops_report": "shipments volume"}, "revenue from operations"),
            "value_raw": F.when(document == "ops_report", F.col("amount").cast("long").cast("string")).when(document == "restated", _million(F.col("amount"))).otherwise(_crore(F.col("amount"))),
            "unit_raw": F.when(document == "restated", "mn").when(document != "ops_report", "Cr"),
            "scope": F.when(document == "regional", "regional_view").otherwise("consolidated"),
            "measurement_basis": per({"ledger_gross": "GAAP_Reported", "restated": "GAAP_Reported", "ledger_net": "Non-GAAP_Adjusted"}, "Standard_Reported"),
        }
    )
    # Rows are distinct as they are; the aggregate keeps what follows from being planned anew for each branch.
    return rows.select(
        "document_id", F.col("subject").alias("subject_raw"), "predicate", F.lit("financial_metric").alias("predicate_type"), "value_raw", "unit_raw", F.concat(F.lit("FY"), F.col("fy").cast("string")).alias("time_raw"), "scope",
        "measurement_basis", F.lit("positive").alias("polarity"), F.concat_ws(" ", "subject", "predicate", "value_raw").alias("evidence_text"), F.lit("HIGH").alias("confidence_level"), F.lit(None).cast("int").alias("page_number"),
    ).distinct()


#: Lines of a report's page, as SQL of n (the nation), fy, yy, v, d, e, and what they state: predicate, value as written,
#: value, unit as written, unit, scope, basis, period ("fy", "q1" to "q4", "ever", "day" or ""), polarity. A line that
#: states nothing has none.
_FY, _Q3 = "'FY' || yy", "'Q3 FY' || yy"
_PCT = "d || '.' || e || ' per cent'"
_PCT_VALUE = "CAST(d || '.' || e AS DOUBLE)"
LINES = (
    (
        "CASE WHEN n % 10 = 3 THEN 'North America ' ELSE '' END || 'revenue from services: ₹' || v || '.5 Cr in ' || CASE WHEN n % 2 = 0 THEN " + _FY + " ELSE " + _Q3 + " END || CASE WHEN n % 7 = 0 THEN ' after a loss.' ELSE '.' END",
        [("revenue from services", "v || '.5 cr'", "(v + 0.5) * 1e7", "cr", "INR", "CASE WHEN n % 10 = 3 THEN 'regional_north_america' WHEN n % 2 = 0 THEN 'annual_period' ELSE 'quarterly_period' END", "'Standard_Reported'", "fy_or_q3", "CASE WHEN n % 7 = 0 THEN 'negative' ELSE 'positive' END")],
    ),
    (
        "'Service EBITDA: Rs. ' || v || ' mn in Q4 FY' || yy || '.'",
        [(p, "v || ' mn'", "v * 1e6", "mn", "INR", "'quarterly_period'", "'Service_EBITDA'", "q4", "'positive'") for p in ("service EBITDA", "EBITDA")],
    ),
    (
        "'Adjusted EBITDA: ₹' || v || ' Cr in Q1 FY' || yy || '.'",
        [(p, "v || ' cr'", "v * 1e7", "cr", "INR", "'quarterly_period'", "'Non-GAAP_Adjusted'", "q1", "'positive'") for p in ("adjusted EBITDA", "EBITDA")],
    ),
    ("(2 + n % 3) || '.8 bn express parcel shipments since inception'", [("express parcel shipments volume", "(2 + n % 3) || '.8 bn'", "CAST((2 + n % 3) || '.8' AS DOUBLE) * 1e9", "bn", "shipments", "'cumulative_since_inception'", "'Standard_Reported'", "ever", "'positive'")]),
    ("v || ' tonnes part-truckload freight'", [("PTL freight tonnage", "v || ' tonnes'", "CAST(v AS DOUBLE)", "tonnes", "metric_tonnes", "'consolidated_company'", "'Standard_Reported'", "", "'positive'")]),
    ("(10000 + v) || ' pin codes covered as of March 31, ' || fy", [("pin codes covered", "(10000 + v) || ' pin_codes'", "CAST(10000 + v AS DOUBLE)", "pin_codes", "pin_codes", "'consolidated_company'", "'Standard_Reported'", "day", "'positive'")]),
    ("(fy + 980) || ' last-mile delivery centres'", [("last-mile delivery centres", "(fy + 980) || ' centres'", "CAST(fy + 980 AS DOUBLE)", "centres", "centres", "'consolidated_company'", "'Standard_Reported'", "", "'positive'")]),
    (
        "CASE WHEN n % 10 = 0 THEN 'Spoton runs ' ELSE 'we run ' END || (100 + n) || ' 46-ft tractors'",
        [("count of 46-ft tractors", "(100 + n) || ' vehicles'", "CAST(100 + n AS DOUBLE)", "vehicles", "vehicles", "CASE WHEN n % 10 = 0 THEN 'subsidiary' ELSE 'consolidated_company' END", "'Standard_Reported'", "", "'positive'")],
    ),
    (
        "CASE WHEN n % 10 = 5 THEN 'Spoton ' ELSE 'our ' END || 'workforce strength ' || (20000 + v)",
        [("workforce strength", "(20000 + v) || ' persons'", "CAST(20000 + v AS DOUBLE)", "persons", "persons", "CASE WHEN n % 10 = 5 THEN 'subsidiary' ELSE 'consolidated_company' END", "'Standard_Reported'", "", "'positive'")],
    ),
    ("(n + 1) || '.25 mn sq ft logistics area under management'", [("logistics area under management", "(n + 1) || '.25 mn sq ft'", "(n + 1.25) * 1e6", "mn sq ft", "sq_ft", "'consolidated_company'", "'Standard_Reported'", "", "'positive'")]),
    ("'Real GDP is projected to grow by ' || " + _PCT + " || ' in FY' || yy || '.'", [("real GDP growth rate", _PCT, _PCT_VALUE, "per cent", "percent", "'national_economy'", "'Standard_Reported'", "fy", "'positive'")]),
    (
        "'Headline CPI inflation moderated to ' || " + _PCT + " || ' in FY' || yy || ' as per the ' || CASE WHEN n % 2 = 0 THEN 'first' ELSE 'second' END || ' advance estimates.'",
        [("headline CPI inflation", _PCT, _PCT_VALUE, "per cent", "percent", "'national_economy'", "CASE WHEN n % 2 = 0 THEN 'First_Advance_Estimates' ELSE 'Second_Advance_Estimates' END", "fy", "'positive'")],
    ),
    (
        "'Gross fiscal deficit ' || CASE WHEN n % 2 = 0 THEN 'budgeted' ELSE 'stood' END || ' at ' || " + _PCT + " || ' of GDP in FY' || yy || '.'",
        [("gross fiscal deficit", _PCT, _PCT_VALUE, "per cent", "percent", "'national_economy'", "CASE WHEN n % 2 = 0 THEN 'Budget_Estimates' ELSE 'Standard_Reported' END", "fy", "'negative'")],
    ),
    (
        "'Current account deficit widened to ' || d || '.' || e || '% of GDP in FY' || yy || CASE WHEN n % 2 = 0 THEN ', pro forma.' ELSE '.' END",
        [("current account deficit", "d || '.' || e || ' %'", _PCT_VALUE, "%", "percent", "'national_economy'", "CASE WHEN n % 2 = 0 THEN 'Pro_forma' ELSE 'Standard_Reported' END", "fy", "'negative'")],
    ),
    ("'Revenue growth was strong in FY' || yy || '.'", []),
    ("'EBITDA é ' || v || ' cr'", []),
    ("'service ebitda मार्जिन ₹' || v || ' cr'", []),
    ("'real gdp, then as now, is of no concern to ' || v || ' of us'", []),
)
#: Reports speak of years of two digits, which are counted from 2000.
YEARS_ON = 25
#: The letters of the lines, from numbers of orders by nation and year; v is never taken for a year.
_LETTERS = ("right(CAST(fy AS STRING), 2) AS yy", "3000 + CAST(k AS INT) % 4000 AS v", "4 + n % 4 AS d", "fy % 10 AS e")


def report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each nation with a page for each year: lines that state all metrics, and some that state none."""
    k = placed_orders(spark, sf_dir).groupBy(F.col("n_nationkey").cast("int").alias("n"), (F.col("fy") + YEARS_ON).cast("int").alias("fy")).agg(F.count(F.lit(1)).alias("k"))
    texts = k.selectExpr("n", "fy", *_LETTERS).selectExpr("n", "fy", "concat_ws('\\n', " + ", ".join(line for line, _ in LINES) + ") AS text")
    return line_pages(texts, F.concat(F.lit("report_"), F.col("n").cast("string")), F.col("fy"), "text")


def report_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to paragraphs to grounded facts, from text alone."""
    pages = materialized(report_pages(spark, sf_dir), "report-pages")
    found = paragraph_atoms(pages).withColumn("id", F.sha2(F.concat_ws("|", "document_id", "page_number", "exact_text"), 256))
    return grounded(extracted(found.join(pages.select("document_id", "page_number", F.col("raw_text").alias("page_text")), ["document_id", "page_number"])))


_stored: dict[tuple, DataFrame] = {}
INPUTS = ("orders", "customer", "nation", "lineitem")


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """What tells whether the input files are still the same."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load([f"{sf_dir}/{t}.parquet" for t in INPUTS])
    return tuple(sorted(tuple(r) for r in files.select("path", "length", "modificationTime").collect()))


COLUMNS = (
    "id", "document_id", "page_number", "subject_raw", "subject_canonical", "subject_type", "predicate", "predicate_canonical", "predicate_type", "value_raw", "value_normalized", "unit_raw", "unit_canonical",
    "time_type", "time_start", "time_end", "time_raw", "scope", "measurement_basis", "polarity", "evidence_text", "confidence_level", "fingerprint",
)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the claims and of the reports' texts, normalised: written once per state of the input files, and read by every query."""
    key = (spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir))
    if key not in _stored:
        made = normalized(claims(spark, sf_dir)).select(*COLUMNS).unionByName(normalized(report_facts(spark, sf_dir)).select(*COLUMNS))
        _stored[key] = materialized(made.withColumn("created_at", F.lit("2024-01-01").cast("timestamp")), "facts")
    return _stored[key]


_PERIODS = {  # type, start, end, as written after normalising
    "fy": ("'fiscal_year'", "make_date(fy - 1, 4, 1)", "make_date(fy, 3, 31)", "'FY' || (fy - 1) || '-' || yy"),
    "q1": ("'quarter'", "make_date(fy - 1, 4, 1)", "make_date(fy - 1, 6, 30)", "'Q1 FY' || (fy - 1) || '-' || yy"),
    "q4": ("'quarter'", "make_date(fy, 1, 1)", "make_date(fy, 3, 31)", "'Q4 FY' || (fy - 1) || '-' || yy"),
    "ever": ("'cumulative'", "NULL", "NULL", "'since_inception'"),
    "day": ("'as_of'", "make_date(fy, 3, 31)", "make_date(fy, 3, 31)", "fy || '-03-31'"),
    "": ("'unspecified'", "NULL", "NULL", "NULL"),
}
_PERIODS["fy_or_q3"] = (
    "CASE WHEN n % 2 = 0 THEN 'fiscal_year' ELSE 'quarter' END", "CASE WHEN n % 2 = 0 THEN make_date(fy - 1, 4, 1) ELSE make_date(fy - 1, 10, 1) END",
    "CASE WHEN n % 2 = 0 THEN make_date(fy, 3, 31) ELSE make_date(fy - 1, 12, 31) END", "CASE WHEN n % 2 = 0 THEN '' ELSE 'Q3 ' END || 'FY' || (fy - 1) || '-' || yy",
)
_FAMILY = (
    ("EBITDA", "ebitda"), ("revenue", "revenue"), ("turnover", "revenue"), ("freight", "freight_volume"), ("shipments", "parcel_volume"), ("pin codes", "network_reach"), ("centres", "delivery_centres"), ("tractors", "fleet_size"),
    ("workforce", "workforce"), ("logistics area", "logistics_area"), ("GDP", "gdp_growth"), ("inflation", "inflation"), ("fiscal deficit", "fiscal_deficit"), ("current account", "current_account_deficit"),
)


def _stated() -> str:
    """The lines' facts in the oracle's SQL, from what LINES says of them."""
    out = []
    for line, stated in LINES:
        for predicate, raw, value, unit_raw, unit, scope, basis, when, polarity in stated:
            kind, start, end, time = _PERIODS[when]
            macro = scope == "'national_economy'"
            subject = "'Republic of India'" if macro else "CASE WHEN n % 5 = 0 THEN 'Spoton Logistics' ELSE 'Delhivery Limited' END"
            subject_type = "'country'" if macro else "CASE WHEN n % 5 = 0 THEN 'subsidiary' ELSE 'organization' END"
            of = "macroeconomic_metric" if macro else "financial_metric" if unit == "INR" else "operational_metric"
            out.append(
                f"SELECT 'report_' || n AS document_id, fy AS page_number, {subject} AS subject_canonical, {subject_type} AS subject_type, '{predicate}' AS predicate_canonical, '{of}' AS predicate_type, {raw} AS value_raw, '{unit_raw}' AS unit_raw, "
                f"'{unit}' AS unit_canonical, CAST({value} AS DOUBLE) AS value_normalized, {kind} AS time_type, {time} AS time_raw, CAST({start} AS DATE) AS time_start, CAST({end} AS DATE) AS time_end, {scope} AS scope, {basis} AS measurement_basis, "
                f"{polarity} AS polarity, {line} AS evidence_text FROM letters"
            )
    return " UNION ALL ".join(out)


#: The same facts in the oracle's SQL.
FACTS_SQL = f"""
placed AS (
  SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price, c_name, n_name, CAST(n_nationkey AS INT) AS n_nationkey, n_regionkey,
         CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 4 THEN 1 ELSE 0 END AS INT) AS fy
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
by_orders AS (SELECT n_name, fy, sum(price) AS amount, count(*) AS orders FROM placed GROUP BY ALL),
by_lines AS (
  SELECT n_name, fy, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS gross,
         sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS net
  FROM lineitem JOIN placed ON l_orderkey = o_orderkey GROUP BY ALL),
by_region AS (SELECT n_regionkey, fy, sum(price) AS amount FROM placed GROUP BY ALL),
by_customer AS (SELECT c_name, fy, sum(price) AS amount FROM placed GROUP BY ALL),
figures AS (
  SELECT 'ledger_orders' AS document_id, n_name AS subject, 'total revenue' AS predicate, amount AS x, 'Cr' AS unit_raw, 'Standard_Reported' AS basis, 'consolidated' AS scope, fy FROM by_orders
  UNION ALL SELECT 'ledger_gross', n_name, 'revenue from operations', gross, 'Cr', 'GAAP_Reported', 'consolidated', fy FROM by_lines
  UNION ALL SELECT 'ledger_net', n_name, 'turnover', net, 'Cr', 'Non-GAAP_Adjusted', 'consolidated', fy FROM by_lines
  UNION ALL SELECT 'restated', n_name, 'revenue from operations', gross, 'mn', 'GAAP_Reported', 'consolidated', fy FROM by_lines
  UNION ALL SELECT 'ops_report', n_name, 'shipments volume', orders, NULL, 'Standard_Reported', 'consolidated', fy FROM by_orders
  UNION ALL SELECT 'accounts', c_name, 'total revenue', amount, 'Cr', 'Standard_Reported', 'consolidated', fy FROM by_customer
  UNION ALL SELECT 'accounts_audited', c_name, 'total revenue', amount, 'Cr', 'Standard_Reported', 'consolidated', fy FROM by_customer
  UNION ALL SELECT 'regional', 'NATION_' || n_regionkey, 'total revenue', amount, 'Cr', 'Standard_Reported', 'regional_view', fy FROM by_region),
texts AS (
  SELECT *, CASE unit_raw WHEN 'Cr' THEN CAST(round(x / 1000, 0) AS BIGINT) WHEN 'mn' THEN CAST(round(x / 1000000, 0) AS BIGINT) ELSE CAST(x AS BIGINT) END AS n FROM figures),
raw AS (
  SELECT *, CASE unit_raw WHEN 'Cr' THEN '₹' || (n // 10000) || '.' || lpad(CAST(n % 10000 AS VARCHAR), 4, '0') || ' Cr' WHEN 'mn' THEN '₹' || n || ' mn' ELSE CAST(n AS VARCHAR) END AS value_raw FROM texts),
ledgers AS (
  SELECT document_id, CAST(NULL AS INT) AS page_number, upper(substr(subject, 1, 1)) || lower(substr(subject, 2)) AS subject_canonical, 'organization' AS subject_type, predicate AS predicate_canonical, 'financial_metric' AS predicate_type, value_raw, unit_raw,
         CASE WHEN predicate = 'shipments volume' THEN 'shipments' ELSE 'INR' END AS unit_canonical,
         CASE unit_raw WHEN 'Cr' THEN CAST((n // 10000) || '.' || lpad(CAST(n % 10000 AS VARCHAR), 4, '0') AS DOUBLE) * 1e7 WHEN 'mn' THEN CAST(n AS DOUBLE) * 1e6 ELSE CAST(n AS DOUBLE) END AS value_normalized,
         'fiscal_year' AS time_type, 'FY' || (fy - 1) || '-' || right(CAST(fy AS VARCHAR), 2) AS time_raw, make_date(fy - 1, 4, 1) AS time_start, make_date(fy, 3, 31) AS time_end,
         scope, basis AS measurement_basis, 'positive' AS polarity, subject || ' ' || predicate || ' ' || value_raw AS evidence_text
  FROM raw),
letters AS (SELECT n, fy, {", ".join(_LETTERS).replace("STRING", "VARCHAR")} FROM (SELECT n_nationkey AS n, fy + {YEARS_ON} AS fy, count(*) AS k FROM placed GROUP BY ALL)),
reports AS ({_stated()}),
keyed AS MATERIALIZED (
  SELECT *, lower(subject_canonical) || '::' || CASE {" ".join(f"WHEN contains(predicate_canonical, '{w}') THEN '{f}'" for w, f in _FAMILY)} END AS block,
         sha256(document_id || '|' || CASE WHEN page_number IS NULL THEN '' ELSE sha256(document_id || '|' || page_number || '|' || evidence_text) || '|' END || subject_canonical || '|' || predicate_canonical || '|' || value_raw || '|'
                || coalesce(time_raw, '') || '|' || scope || '|' || measurement_basis) AS id
  FROM (SELECT * FROM ledgers UNION ALL BY NAME SELECT * FROM reports)),
pairs AS MATERIALIZED (
  SELECT a.block, a.subject_canonical AS subject, a.predicate_canonical AS predicate, {", ".join(f"a.{c} AS a_{s}, b.{c} AS b_{s}" for c, s in (("id", "id"), ("document_id", "doc"), ("value_raw", "raw"), ("value_normalized", "value"), ("unit_canonical", "unit"), ("time_type", "type"), ("time_raw", "time"), ("time_start", "start"), ("time_end", "end"), ("scope", "scope"), ("measurement_basis", "basis"), ("polarity", "polarity"), ("evidence_text", "text"), ("unit_raw", "token")))}
  FROM keyed a JOIN keyed b ON a.block = b.block AND a.document_id <> b.document_id AND a.id < b.id),
measured AS (
  SELECT *, abs(a_value - b_value) AS delta, CASE WHEN greatest(abs(a_value), abs(b_value)) > 0 THEN abs(a_value - b_value) / greatest(abs(a_value), abs(b_value)) * 100.0 ELSE 0.0 END AS pct,
         a_start IS NOT NULL AND b_start IS NOT NULL AND a_end IS NOT NULL AND b_end IS NOT NULL AS dated, lower(coalesce(a_time, '')) AS a_when, lower(coalesce(b_time, '')) AS b_when, lower(a_basis || ' ' || b_basis) AS bases FROM pairs),
compared AS MATERIALIZED (
  SELECT *, pct <= 0.5 OR delta <= 0.01 AS value_match, a_unit = b_unit AS unit_match, a_polarity = b_polarity AS polarity_match,
         CASE WHEN a_type = 'cumulative' AND b_type = 'cumulative' THEN 'BOTH_CUMULATIVE' WHEN dated AND a_start = b_start AND a_end = b_end THEN 'SAME_PERIOD'
              WHEN dated AND ((a_start >= b_start AND a_end <= b_end) OR (b_start >= a_start AND b_end <= a_end)) THEN 'SUB_PERIOD' WHEN dated THEN 'DIFFERENT_PERIOD'
              WHEN a_when <> '' AND a_when = b_when THEN 'SAME_PERIOD' WHEN a_when = '' AND b_when = '' THEN 'UNSPECIFIED' ELSE 'DIFFERENT_PERIOD' END AS temporal_relation,
         CASE WHEN a_scope = b_scope THEN 'SAME_SCOPE' WHEN 'subsidiary' IN (a_scope, b_scope) THEN 'SUBSIDIARY_VS_PARENT' WHEN contains(a_scope || b_scope, 'regional') THEN 'REGIONAL_DIFFERENCE' ELSE 'DIFFERENT_SCOPE' END AS scope_relation,
         CASE WHEN a_basis = b_basis THEN 'SAME_BASIS' WHEN contains(bases, 'advance') THEN 'FAE_VS_SAE' WHEN regexp_matches(bases, 'gaap|adjusted|service') THEN 'GAAP_VS_NON_GAAP'
              WHEN contains(bases, 'budget') THEN 'BUDGET_VS_ACTUAL' ELSE 'DIFFERENT_BASIS' END AS basis_relation
  FROM measured),
decided AS MATERIALIZED (
  SELECT *, temporal_relation IN ('SAME_PERIOD', 'BOTH_CUMULATIVE', 'UNSPECIFIED') AS temporal_match, scope_relation = 'SAME_SCOPE' AS scope_match, basis_relation = 'SAME_BASIS' AS basis_match,
         CASE WHEN NOT scope_match THEN 'SCOPE_DIFFERENCE' WHEN NOT temporal_match THEN 'TEMPORALLY_EVOLVES'
              WHEN value_match AND basis_match AND lower(a_text) <> lower(b_text) THEN 'UNIT_EQUIVALENT' WHEN value_match AND basis_match AND polarity_match THEN 'CORROBORATES'
              WHEN NOT value_match AND NOT basis_match THEN 'RECONCILES' WHEN NOT value_match THEN 'CONTRADICTS' ELSE 'UNCERTAIN' END AS relationship_type
  FROM compared)
"""
