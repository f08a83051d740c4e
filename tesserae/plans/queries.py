"""Named queries over the star-schema and text tables, one per operator or group of operators, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.text import text_hash
from ..operators import aliases as L
from ..operators import atoms as A
from ..operators import extract as X
from ..operators import resolve as R
from . import api, made, store
from .fixtures import FACTS_SQL, facts, line_pages, report_facts, report_pages, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def over_facts(select: str) -> str:
    return f"WITH {FACTS_SQL} {select}"


# Scalars over texts made from orders.
@query(made.oracle(made.NUMBERS, {"text": "STRING", "hint": "STRING", "value": "DOUBLE", "multiplier": "DOUBLE", "scale": "STRING"}))
def num_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made.rows(spark, sf_dir, made.NUMBERS, ("text", "hint")).select("id", "text", "hint", N.number(F.col("text"), F.col("hint")).alias("n")).select("id", "text", "hint", "n.*")


@query(made.oracle(made.UNITS, {"raw": "STRING", "hint": "STRING", "unit": "STRING"}))
def unit_exact_word_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made.rows(spark, sf_dir, made.UNITS, ("raw", "hint")).select("id", "raw", "hint", N.unit(F.col("raw"), F.col("hint")).alias("unit"))


@query(made.oracle(made.PERIODS, {"raw": "STRING", "type": "STRING", "start": "STRING", "end": "STRING", "canonical": "STRING", "fault": "STRING"}))
def time_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made.rows(spark, sf_dir, made.PERIODS, ("raw",)).select("id", "raw", N.checked_period(F.col("raw")).alias("c")).select("id", "raw", "c.period", "c.fault")
    return rows.select("id", "raw", "period.type", F.col("period.start").cast("string").alias("start"), F.col("period.end").cast("string").alias("end"), "period.canonical", "fault")


@query(made.oracle(made.ENTITIES, {"raw": "STRING", "canonical": "STRING", "type": "STRING"}))
def entity_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made.rows(spark, sf_dir, made.ENTITIES, ("raw",)).select("id", "raw", N.entity(F.col("raw")).alias("e")).select("id", "raw", "e.*")


@query(made.oracle(made.FAMILY, {"predicate": "STRING", "family": "STRING"}))
def family_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made.rows(spark, sf_dir, made.FAMILY, ("predicate",)).select("id", "predicate", N.family(F.col("predicate")).alias("family"))


@query(made.stated_sql({c: f"f_{c}" for c in ("predicate", "value_raw", "subject_raw", "time_raw", "measurement_basis", "polarity")} | {"grounded": "true"}))
def extract_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.grounded(X.extracted(made.atoms(spark, sf_dir))).select("evidence_id", "predicate", "value_raw", "subject_raw", "time_raw", "measurement_basis", "polarity", "grounded")


_STORED = {
    "subject_raw": "f_subject_raw", "predicate_raw": "f_predicate", "unit_raw": "f_evidence_text", "value_raw": "f_value_raw", "value_normalized": "CAST(f_value_normalized AS DOUBLE)", "value_type": "f_value_type", "unit_canonical": "f_unit_canonical",
    "time_raw": "f_period", "geography": "'India'", "confidence_extraction": "0.98::DOUBLE", "confidence_normalization": "0.95::DOUBLE", "confidence_overall": "0.96::DOUBLE", "confidence_level": "'HIGH'",
}


@query(made.stated_sql(_STORED))
def facts_as_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored columns of facts: what stands as raw subject, predicate and unit, the value's type, and the constants."""
    return X.as_stored(X.normalized(X.grounded(X.extracted(made.atoms(spark, sf_dir))))).select("evidence_id", *_STORED)


@query("SELECT CAST(id AS VARCHAR) AS evidence_id, id % 3 <> 0 AS grounded, CASE WHEN id % 3 = 0 THEN 0.4 ELSE 0.96 END::DOUBLE AS confidence_overall, CASE WHEN id % 3 = 0 THEN 'LOW' ELSE 'HIGH' END AS confidence_level, CASE WHEN id % 3 = 0 THEN concat('value ', chr(39), v + 1, chr(39), ' is not in evidence ', id) END AS issue FROM " + made.letters_sql(3))
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts whose value stands in their evidence, and others, which stay with low confidence and an issue."""
    rows = made.letters(spark, sf_dir, 3).selectExpr(
        "CAST(id AS STRING) AS evidence_id", "'d' AS document_id", "1 AS page_number", "'revenue: ₹' || vv || ' Cr' AS evidence_text", "CASE WHEN kind = 0 THEN CAST(v + 1 AS STRING) ELSE vv END AS value_raw",
        "CAST(CASE WHEN kind = 0 THEN v + 1 ELSE v END AS DOUBLE) AS value_stated", "0.96D AS confidence_overall", "'HIGH' AS confidence_level",
    )
    out = X.grounded(rows)
    issues = X.grounding_issues(out).select(F.regexp_extract("description", "evidence (.*)$", 1).alias("evidence_id"), F.col("description").alias("issue"))
    return out.join(issues, "evidence_id", "left").select("evidence_id", "grounded", "confidence_overall", "confidence_level", "issue")


_FAULTS = [i for i, case in enumerate(made.PERIODS) if case[5] != "NULL"]


@query(f"SELECT CAST(id AS VARCHAR) AS document_id, 'AMBIGUOUS_DATE' AS issue_type, {made.chosen([case[5] for case in made.PERIODS], 'VARCHAR')} AS description, {made.chosen([case[0] for case in made.PERIODS], 'VARCHAR')} AS affected_text FROM {made.letters_sql(len(made.PERIODS))} WHERE kind IN ({', '.join(map(str, _FAULTS))})".replace("AS STRING", "AS VARCHAR"))
def impossible_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of facts whose period names a day that doesn't exist."""
    rows = made.rows(spark, sf_dir, made.PERIODS, ("time_raw",)).select(F.col("id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), "time_raw")
    return X.period_issues(rows).select("document_id", "issue_type", "description", "affected_text")


@query(over_facts("SELECT block, count(*) AS facts, string_agg(id, ',' ORDER BY id) FILTER (place <= 5) AS first_members FROM (SELECT block, id, row_number() OVER (PARTITION BY block ORDER BY id) AS place FROM keyed) GROUP BY block"))
def block_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with their size and their first five members by id."""
    return R.block_members(facts(spark, sf_dir), 5).select("block", "facts", F.array_join("members", ",").alias("first_members"))


_ALIASES = """WITH aliases AS (
  SELECT p_partkey * 5 + form AS place, p_name || CASE form WHEN 0 THEN ' ' || p_partkey || ' ltd' WHEN 1 THEN ' no. ' || p_partkey || ' inc' WHEN 2 THEN ' works ' || p_partkey WHEN 3 THEN ' ' || p_partkey ELSE ' group ' || p_partkey END AS alias,
    'Maker of ' || p_name || ' ' || p_partkey AS name, p_type AS kind FROM part, range(5) AS f(form)
), raws AS (
  SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN upper(p_name) || ' ' || p_partkey WHEN 1 THEN 'The ' || p_name || ' Works ' || p_partkey || '9 site' WHEN 2 THEN p_name || ' Group ' || p_partkey WHEN 3 THEN '  ' || p_name || ' No. ' || p_partkey || ' Inc ' END AS raw
  FROM orders JOIN part ON p_partkey = o_custkey
), texts AS (SELECT DISTINCT raw, lower(trim(raw)) AS t FROM raws WHERE raw IS NOT NULL),
found AS (
  SELECT raw, first(name ORDER BY NOT t = alias, place) AS name, first(kind ORDER BY NOT t = alias, place) AS kind FROM texts JOIN aliases ON t = alias OR contains(t, alias) GROUP BY raw
) SELECT id, raw, coalesce(name, 'Unknown Entity') AS name, coalesce(kind, 'unknown') AS kind FROM raws LEFT JOIN found USING (raw)"""


@query(_ALIASES)
def entity_by_alias_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of orders' texts by a table of five aliases for each part: equal first, else the first alias that the text contains."""
    forms = "explode(array(' ' || p_partkey || ' ltd', ' no. ' || p_partkey || ' inc', ' works ' || p_partkey, ' ' || p_partkey, ' group ' || p_partkey))"
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    aliases = parts.selectExpr("p_name", "p_partkey", "p_type", f"pos{forms} AS (form, ending)").selectExpr("p_partkey * 5 + form AS place", "p_name || ending AS alias", "'Maker of ' || p_name || ' ' || p_partkey AS name", "p_type AS kind")
    raw = "CASE o_orderkey % 5 WHEN 0 THEN upper(p_name) || ' ' || p_partkey WHEN 1 THEN 'The ' || p_name || ' Works ' || p_partkey || '9 site' WHEN 2 THEN p_name || ' Group ' || p_partkey WHEN 3 THEN '  ' || p_name || ' No. ' || p_partkey || ' Inc ' END"
    rows = table(spark, sf_dir, "orders").join(parts, F.col("o_custkey") == F.col("p_partkey")).selectExpr("o_orderkey AS id", f"{raw} AS raw")
    return L.entities(rows, "raw", aliases).select("id", "raw", "name", "kind")


# The claims and what follows from them.
FACT = "document_id, subject_canonical, predicate_canonical, value_raw, value_normalized, unit_canonical, time_raw, CAST(time_start AS VARCHAR) AS time_start, CAST(time_end AS VARCHAR) AS time_end, scope, measurement_basis"


def _facts(df: DataFrame) -> DataFrame:
    return df.select("document_id", "subject_canonical", "predicate_canonical", "value_raw", "value_normalized", "unit_canonical", "time_raw", F.col("time_start").cast("string").alias("time_start"), F.col("time_end").cast("string").alias("time_end"), "scope", "measurement_basis")


@query(over_facts(f"SELECT {FACT} FROM keyed"))
def normalize_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(facts(spark, sf_dir))


@query(over_facts("SELECT id, sha256(lower(subject_canonical || '|' || predicate_canonical || '|' || scope || '|' || coalesce(time_start::VARCHAR, 'none') || '|' || coalesce(time_end::VARCHAR, 'none') || '|' || unit_canonical || '|' || measurement_basis)) AS fingerprint FROM keyed"))
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select("id", "fingerprint")


@query(over_facts("SELECT id, block, lower(subject_canonical || '::' || predicate_canonical || '::' || scope) AS coarse FROM keyed"))
def blocking_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_block(facts(spark, sf_dir)).select("id", "block", N.coarse_key(F.col("subject_canonical"), F.col("predicate_canonical"), F.col("scope")).alias("coarse"))


@query(over_facts("SELECT block, count(*) AS facts, count(DISTINCT document_id) AS documents FROM keyed GROUP BY block"))
def block_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.block_sizes(facts(spark, sf_dir))


@query(over_facts("SELECT p.block, facts, candidate_pairs FROM (SELECT block, count(*) AS candidate_pairs FROM pairs GROUP BY ALL) p JOIN (SELECT block, count(*) AS facts FROM keyed GROUP BY ALL) k USING (block) WHERE candidate_pairs > 1000"))
def oversized_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.oversized_blocks(facts(spark, sf_dir), 1000)


@query(over_facts("SELECT block, a_id, b_id FROM pairs"))
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.candidate_pairs(facts(spark, sf_dir)).select("block", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


_METRICS = """, n AS (SELECT count(*) AS total_facts, count(DISTINCT block) AS blocks FROM keyed), c AS (SELECT count(*) AS candidate_pairs FROM pairs),
w AS (SELECT sum(m * (m - 1) // 2) AS within FROM (SELECT count(*) AS m FROM keyed GROUP BY document_id)),
x AS (SELECT CAST(total_facts * (total_facts - 1) // 2 - within AS BIGINT) AS cross_document_pairs FROM n, w)
SELECT total_facts, blocks, total_facts * (total_facts - 1) // 2 AS naive_comparisons, cross_document_pairs, candidate_pairs,
       round((total_facts * (total_facts - 1) // 2 - candidate_pairs) * 100.0::DOUBLE / (total_facts * (total_facts - 1) // 2), 2) AS reduction_percent,
       round((total_facts * (total_facts - 1) // 2) / greatest(candidate_pairs, 1)::DOUBLE, 2) AS efficiency_multiplier FROM n, c, x"""


@query(f"WITH {FACTS_SQL} {_METRICS}")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.retrieval_metrics(facts(spark, sf_dir))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.compared(R.candidate_pairs(facts(spark, sf_dir))).withColumns({"a_id": F.col("a.id"), "b_id": F.col("b.id")})


#: Four decimals of the number as it is written: rounding a product of it by ten thousand would turn 13.64374999 into a tie.
_FOUR = "round(CAST(CAST({0} AS VARCHAR) AS DECIMAL(38, 15)), 4)::DOUBLE"


@query(over_facts(f"SELECT a_id, b_id, value_match, {_FOUR.format('delta')} AS value_delta_abs, {_FOUR.format('pct')} AS value_delta_pct, unit_match FROM compared"))
def compare_value_and_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).select("a_id", "b_id", "dimensions.value_match", "dimensions.value_delta_abs", "dimensions.value_delta_pct", "dimensions.unit_match")


@query(over_facts("SELECT a_id, b_id, temporal_match, temporal_relation, scope_match, scope_relation, basis_match, basis_relation, polarity_match FROM decided"))
def compare_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = "dimensions."
    return _compared(spark, sf_dir).select("a_id", "b_id", d + "temporal_match", d + "temporal_relation", d + "scope_match", d + "scope_relation", d + "basis_match", d + "basis_relation", d + "polarity_match")


@query(over_facts("SELECT 'temporal' AS dimension, temporal_relation AS relation, count(*) AS n FROM decided GROUP BY ALL UNION ALL SELECT 'scope', scope_relation, count(*) FROM decided GROUP BY ALL UNION ALL SELECT 'basis', basis_relation, count(*) FROM decided GROUP BY ALL"))
def relations_by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("dimensions")
    pairs = F.array(*[F.struct(F.lit(name).alias("dimension"), d[f"{name}_relation"].alias("relation")) for name in ("temporal", "scope", "basis")])
    return _compared(spark, sf_dir).select(F.inline(pairs)).groupBy("dimension", "relation").agg(F.count(F.lit(1)).alias("n"))


_MESSAGES = """SELECT a_id, b_id, concat_ws('; ', CASE WHEN NOT value_match THEN 'value: ' || chr(39) || a_raw || chr(39) || ' vs ' || chr(39) || b_raw || chr(39) END, CASE WHEN NOT unit_match THEN 'unit: ' || chr(39) || a_unit || chr(39) || ' vs ' || chr(39) || b_unit || chr(39) END,
 CASE temporal_relation WHEN 'SUB_PERIOD' THEN 'period within period: ' || coalesce(a_time, 'None') || ' vs ' || coalesce(b_time, 'None') WHEN 'DIFFERENT_PERIOD' THEN 'other period: ' || coalesce(a_time, 'None') || ' vs ' || coalesce(b_time, 'None') END,
 CASE WHEN NOT scope_match THEN 'scope: ' || lower(a_scope) || ' vs ' || lower(b_scope) END, CASE WHEN NOT basis_match THEN 'basis: ' || a_basis || ' vs ' || b_basis END, CASE WHEN NOT polarity_match THEN 'polarity: ' || a_polarity || ' vs ' || b_polarity END) AS messages FROM decided"""


@query(over_facts(_MESSAGES))
def important_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).select("a_id", "b_id", F.concat_ws("; ", "important_differences").alias("messages"))


_CONFIDENCE = "CASE relationship_type WHEN 'SCOPE_DIFFERENCE' THEN 0.92 WHEN 'TEMPORALLY_EVOLVES' THEN 0.9 WHEN 'UNIT_EQUIVALENT' THEN 0.98 WHEN 'CORROBORATES' THEN 0.96 WHEN 'RECONCILES' THEN 0.93 WHEN 'CONTRADICTS' THEN 0.95 ELSE 0.5 END::DOUBLE"


@query(over_facts(f"SELECT a_id AS fact_a_id, b_id AS fact_b_id, sha256(a_id || '|' || b_id) AS id, relationship_type, {_CONFIDENCE} AS confidence FROM decided"))
def decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.relationships(facts(spark, sf_dir)).select("fact_a_id", "fact_b_id", "id", "relationship_type", "confidence")


@query(over_facts(", types AS (SELECT unnest(['CORROBORATES','CONTRADICTS','RECONCILES','TEMPORALLY_EVOLVES','SCOPE_DIFFERENCE','UNIT_EQUIVALENT','UNCERTAIN']) AS relationship_type) SELECT t.relationship_type, count(d.a_id) AS n FROM types t LEFT JOIN decided d USING (relationship_type) GROUP BY ALL"))
def breakdown_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.breakdown(R.relationships(facts(spark, sf_dir)))


@query(over_facts("SELECT relationship_type, count(*) AS n FROM decided GROUP BY ALL"))
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims, normalised, blocked, compared and decided: relationships by type."""
    return api.counts(R.relationships(facts(spark, sf_dir)), "relationship_type")


_WHEN = "coalesce({0}_time, 'unspecified period')"
_SAID = "{0}_doc || ' states ' || {0}_raw"
_SAME = _WHEN.format("a") + " || ' (' || a_scope || ', ' || a_basis || '): ' || " + _SAID.format("a") + " || '; ' || " + _SAID.format("b")
_EXPLAINED = f"""subject || ' / ' || predicate || ': ' || CASE relationship_type
 WHEN 'CORROBORATES' THEN 'the sources corroborate each other for ' || {_SAME} WHEN 'CONTRADICTS' THEN 'contradiction for ' || {_SAME}
 WHEN 'UNIT_EQUIVALENT' THEN a_raw || ' and ' || b_raw || ' are the same figure in other units, ' || format('{{:,.2f}}', a_value)
 WHEN 'RECONCILES' THEN 'reconciled by context, ' || a_raw || ' on ' || a_basis || ' and ' || b_raw || ' on ' || b_basis
 WHEN 'TEMPORALLY_EVOLVES' THEN 'evolves from ' || a_raw || ' in ' || {_WHEN.format("a")} || ' to ' || b_raw || ' in ' || {_WHEN.format("b")}
 WHEN 'SCOPE_DIFFERENCE' THEN a_raw || ' covers ' || a_scope || ', ' || b_raw || ' covers ' || b_scope ELSE a_raw || ' and ' || b_raw || ' need clarification' END"""


@query(over_facts(f"SELECT a_id AS fact_a_id, b_id AS fact_b_id, {_EXPLAINED} AS explanation FROM decided"))
def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.relationships(facts(spark, sf_dir)).select("fact_a_id", "fact_b_id", "explanation")


_CITED = "{0}_doc || '.pdf (page ' || coalesce({0}_page::VARCHAR, '?') || ') states ' || {0}_raw"
_CITED_SAME = _WHEN.format("a") + " || ' (' || a_scope || ', ' || a_basis || '): ' || " + _CITED.format("a") + " || '; ' || " + _CITED.format("b")
_CITES = f"""subject || ' / ' || predicate || ': ' || CASE relationship_type
 WHEN 'CORROBORATES' THEN 'the sources corroborate each other for ' || {_CITED_SAME} WHEN 'CONTRADICTS' THEN 'contradiction for ' || {_CITED_SAME}
 WHEN 'UNIT_EQUIVALENT' THEN {_CITED.format("a")} || ' and ' || {_CITED.format("b")} || ' are the same figure in other units, ' || format('{{:,.2f}}', a_value)
 WHEN 'RECONCILES' THEN 'reconciled by context, ' || {_CITED.format("a")} || ' on ' || a_basis || ' and ' || {_CITED.format("b")} || ' on ' || b_basis
 WHEN 'TEMPORALLY_EVOLVES' THEN 'evolves from ' || {_CITED.format("a")} || ' in ' || {_WHEN.format("a")} || ' to ' || {_CITED.format("b")} || ' in ' || {_WHEN.format("b")}
 WHEN 'SCOPE_DIFFERENCE' THEN {_CITED.format("a")} || ' covers ' || a_scope || ', ' || {_CITED.format("b")} || ' covers ' || b_scope ELSE {_CITED.format("a")} || ' and ' || {_CITED.format("b")} || ' need clarification' END"""


@query(over_facts(f", p AS (SELECT d.*, x.page_number AS a_page, y.page_number AS b_page FROM decided d JOIN keyed x ON x.id = a_id JOIN keyed y ON y.id = b_id) SELECT a_id AS fact_a_id, b_id AS fact_b_id, {_CITES} AS explanation FROM p"))
def explain_with_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explanations that name the file and the page of either fact. There are eight ledgers and a report for each nation, whatever the scale."""
    f = facts(spark, sf_dir)
    return R.relationships(f, documents=F.broadcast(_documents(f))).select("fact_a_id", "fact_b_id", "explanation")


@query(over_facts("SELECT 'first' AS step, a_id AS fact_a_id, b_id AS fact_b_id, relationship_type FROM decided WHERE NOT (starts_with(a_doc, 'report_') OR a_doc = 'restated' OR starts_with(b_doc, 'report_') OR b_doc = 'restated') UNION ALL SELECT 'second', a_id, b_id, relationship_type FROM decided WHERE starts_with(a_doc, 'report_') OR a_doc = 'restated' OR starts_with(b_doc, 'report_') OR b_doc = 'restated'"))
def resolve_in_two_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledgers first, then reports and restatements against each other and against what is known: together all pairs, each once."""
    f = facts(spark, sf_dir)
    late = F.col("document_id").startswith("report_") | (F.col("document_id") == "restated")
    first, second = f.filter(~late), f.filter(late)
    steps = {"first": R.relationships(first), "second": R.relationships(second, known=first)}
    columns = lambda name: steps[name].select(F.lit(name).alias("step"), "fact_a_id", "fact_b_id", "relationship_type")
    return columns("first").unionByName(columns("second"))


@query(over_facts("SELECT block, a_id, b_id FROM pairs"))
def hot_block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs, with every block of more than 64 facts cut into tiles of about that many."""
    return R.candidate_pairs(facts(spark, sf_dir).select("id", "document_id", "subject_canonical", "predicate_canonical"), tile=64).select("block", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


@query(over_facts("SELECT a_id AS fact_a_id, b_id AS fact_b_id FROM decided WHERE relationship_type <> 'RECONCILES'"))
def upsert_pairs_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.relationships(facts(spark, sf_dir)).select("fact_a_id", "fact_b_id", "relationship_type")
    stored = found.filter("relationship_type = 'RECONCILES'").select(F.col("fact_b_id").alias("fact_a_id"), F.col("fact_a_id").alias("fact_b_id"))
    stored = store.materialized(stored, "stored-pairs")  # pairs are stored when more are found
    return R.new_relationships(stored, found).select("fact_a_id", "fact_b_id")


@query(over_facts("SELECT id FROM keyed WHERE predicate_canonical ILIKE '%revenue%' AND subject_canonical ILIKE '%nation_1%' AND document_id = 'ledger_gross'"))
def facts_filter_ilike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.fact_filter(facts(spark, sf_dir), predicate="revenue", subject="nation_1", document_id="ledger_gross", confidence="high").select("id")


@query(over_facts("SELECT id FROM keyed WHERE predicate_canonical ILIKE '%12%' OR subject_canonical ILIKE '%12%' OR value_raw ILIKE '%12%'"))
def facts_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.fact_filter(facts(spark, sf_dir), search="12").select("id")


@query(over_facts("SELECT id, value_raw FROM keyed ORDER BY id LIMIT 50 OFFSET 100"))
def facts_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.list_facts(facts(spark, sf_dir), limit=50, offset=100).select("id", "value_raw")


def _documents(df: DataFrame) -> DataFrame:
    return df.select(F.col("document_id").alias("id")).distinct().withColumn("filename", F.concat("id", F.lit(".pdf")))


@query(over_facts("SELECT id, document_id || '.pdf' AS filename, coalesce(time_raw, '') AS period, coalesce(time_type, 'unspecified') AS time_type, scope, measurement_basis, 'India' AS geography FROM keyed"))
def facts_enriched_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    return api.enriched(f, _documents(f)).select("id", "filename", F.col("context.raw").alias("period"), F.col("context.type").alias("time_type"), "context.scope", "context.measurement_basis", F.col("context.geography").alias("geography"))


@query(over_facts("SELECT a_doc, b_doc, relationship_type, count(*) AS n FROM decided GROUP BY ALL"))
def relationships_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    both = api.relationships_side_by_side(R.relationships(f), f)
    return both.groupBy(F.col("fact_a.document_id").alias("a_doc"), F.col("fact_b.document_id").alias("b_doc"), "relationship_type").agg(F.count(F.lit(1)).alias("n"))


@query(over_facts("SELECT a_id, b_id FROM decided WHERE subject ILIKE '%nation_3%' AND a_doc = 'ledger_net' AND relationship_type = 'RECONCILES'"))
def relationships_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    return api.relationship_filter(R.relationships(f), f, kind="reconciles", subject="nation_3", document_id="ledger_net").select(F.col("fact_a_id").alias("a_id"), F.col("fact_b_id").alias("b_id"))


@query(over_facts("SELECT 'subject' AS what, subject_canonical AS value FROM keyed UNION SELECT 'predicate', predicate_canonical FROM keyed"))
def distinct_subjects_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    one = lambda what, c: api.distinct_values(f, c).select(F.lit(what).alias("what"), "value")
    return one("subject", "subject_canonical").unionByName(one("predicate", "predicate_canonical"))


@query(over_facts("SELECT document_id AS id, count(*) AS fact_count, count_if(n IS NULL) AS issue_count FROM (SELECT document_id, 1 AS n FROM keyed) GROUP BY ALL"))
def document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    return api.document_counts(_documents(f), f, f.filter("value_normalized is null")).select("id", "fact_count", "issue_count")


def _overview_sql() -> str:
    counts = "(SELECT count(DISTINCT document_id) FROM keyed) AS documents, (SELECT count(*) FROM documents) AS pages, (SELECT count(*) FROM documents WHERE text <> '') AS atoms, total_facts AS facts, (SELECT count(*) FROM decided) AS relationships, 0 AS issues, blocks,"
    return over_facts(_METRICS.replace("SELECT total_facts, blocks,", "SELECT " + counts))


@query(_overview_sql())
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, pages = facts(spark, sf_dir), table(spark, sf_dir, "documents")
    out = api.overview(_documents(f), pages, pages.filter("text != ''"), f, R.relationships(f), f.filter("value_normalized is null"))
    return out.withColumn("issues", F.col("issues").cast("int"))


@query(over_facts("SELECT 'confidence' AS what, 'HIGH' AS value, count(*) AS n FROM keyed GROUP BY ALL UNION ALL SELECT 'relationship', relationship_type, count(*) FROM decided GROUP BY ALL UNION ALL SELECT 'issue', event_type, count(*) FROM events GROUP BY ALL"))
def overview_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    return api.overview_breakdowns(f, R.relationships(f), table(spark, sf_dir, "events").withColumnRenamed("event_type", "issue_type"))


@query(over_facts("SELECT count(*) AS total_candidates_evaluated, count(*) AS total_relationships_stored, " + ", ".join(f"count_if(relationship_type = '{t}') AS {t}" for t in ("CORROBORATES", "CONTRADICTS", "RECONCILES", "TEMPORALLY_EVOLVES", "SCOPE_DIFFERENCE", "UNIT_EQUIVALENT", "UNCERTAIN")) + " FROM decided"))
def resolution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    return api.resolution_summary(f, R.relationships(f)).select("total_candidates_evaluated", "total_relationships_stored", "breakdown.*")


@query(over_facts("SELECT tab, n FROM (SELECT count(*) AS \"ALL\", " + ", ".join(f"count_if(relationship_type = '{t}') AS {t}" for t in ("CONTRADICTS", "RECONCILES", "NONE")) + " FROM decided) UNPIVOT (n FOR tab IN (\"ALL\", CONTRADICTS, RECONCILES, NONE))"))
def tab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.tab_counts(R.relationships(facts(spark, sf_dir)), "relationship_type", ("CONTRADICTS", "RECONCILES", "NONE"))


_SEARCHED = "lower(subject_canonical || chr(0) || predicate_canonical || chr(0) || value_raw || chr(0) || evidence_text)"


@query(over_facts(f"SELECT id FROM keyed WHERE predicate_type = 'financial_metric' AND (contains({_SEARCHED}, '81') OR contains(CAST(CAST(value_normalized AS DECIMAL(38,0)) AS VARCHAR), '81'))"))
def console_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.console_filter(facts(spark, sf_dir), predicate_type="financial_metric", confidence="HIGH", search="81").select("id")


@query(over_facts("SELECT id FROM keyed WHERE subject_canonical = 'Spoton Logistics' AND contains(lower(evidence_text), 'spoton r')"))
def console_search_in_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.console_filter(facts(spark, sf_dir), subject="Spoton Logistics", search="SPOTON R").select("id")


@query(over_facts(", r AS (SELECT sha256(a_id || '|' || b_id) AS id, relationship_type FROM decided) SELECT 'first' AS how, min(id) AS id FROM r WHERE relationship_type = 'RECONCILES' UNION ALL SELECT 'named', min(id) FROM r"))
def relationship_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.relationships(facts(spark, sf_dir)).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    named = api.chosen(rows, rows.agg(F.min("id")).first()[0], tab="RECONCILES")
    return api.chosen(rows, "none", tab="RECONCILES").select(F.lit("first").alias("how"), "id").unionByName(named.select(F.lit("named").alias("how"), "id"))


@query(over_facts(", r AS (SELECT sha256(a_id || '|' || b_id) AS id, * FROM decided WHERE relationship_type = 'CONTRADICTS' ORDER BY 1 LIMIT 20 OFFSET 5) SELECT id, a_raw, b_raw, a_doc, b_doc FROM r"))
def relationships_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    rows = R.relationships(f).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    out = api.list_relationships(rows, f, limit=20, offset=5, kind="contradicts")
    return out.select("id", F.col("fact_a.value_raw").alias("a_raw"), F.col("fact_b.value_raw").alias("b_raw"), F.col("fact_a.document_id").alias("a_doc"), F.col("fact_b.document_id").alias("b_doc"))


@query(over_facts("SELECT sha256(a_id || '|' || b_id) AS id FROM decided WHERE relationship_type IN ('CORROBORATES', 'UNIT_EQUIVALENT')"))
def corroborations(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    return api.relationship_filter(R.relationships(f), f, types=("CORROBORATES", "UNIT_EQUIVALENT"), least_confidence=0.85).select("id")


@query(over_facts("SELECT id FROM keyed WHERE predicate_type = 'operational_metric' AND document_id IN ('report_3', 'report_4')"))
def facts_by_type_and_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.fact_filter(facts(spark, sf_dir), predicate_type="operational_metric", document_ids=("report_3", "report_4")).select("id")


@query(over_facts("SELECT document_id, page_number, subject_canonical, predicate_canonical, predicate_type, value_raw, value_normalized, unit_raw, unit_canonical, time_type, time_raw, scope, measurement_basis, polarity, evidence_text, true AS grounded FROM keyed WHERE page_number IS NOT NULL"))
def facts_from_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to facts: pages, paragraphs, extraction, grounding and normalisation; all metrics, and lines that state none."""
    rows = X.normalized(report_facts(spark, sf_dir))
    return rows.select("document_id", "page_number", "subject_canonical", "predicate_canonical", "predicate_type", "value_raw", "value_normalized", "unit_raw", "unit_canonical", "time_type", "time_raw", "scope", "measurement_basis", "polarity", "evidence_text", "grounded")


@query(over_facts("SELECT relationship_type, min(sha256(a_id || '|' || b_id)) AS id FROM decided GROUP BY ALL"))
def sample_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.sample_per(R.relationships(facts(spark, sf_dir)), "relationship_type").select("relationship_type", "id")


@query(over_facts("SELECT id FROM keyed WHERE document_id <> 'restated'"))
def reprocess_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.without_document(facts(spark, sf_dir), ["restated"]).select("id")


@query(over_facts("SELECT a_id AS fact_a_id, b_id AS fact_b_id FROM decided WHERE a_doc <> 'restated' AND b_doc <> 'restated'"))
def reprocess_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    return store.without_facts(R.relationships(f), store.without_document(f, ["restated"])).select("fact_a_id", "fact_b_id")


@query(over_facts("SELECT DISTINCT subject_canonical AS canonical_name, subject_type AS entity_type FROM keyed WHERE subject_canonical NOT LIKE 'Nation_1%'"))
def entity_get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = facts(spark, sf_dir).select(F.col("subject_canonical").alias("canonical_name"), F.col("subject_type").alias("entity_type"), "created_at")
    return store.new_entities(found, found.filter("canonical_name like 'Nation_1%'")).select("canonical_name", "entity_type")


# Text tables.
@query("SELECT doc_id, sha256(text) AS content_hash FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("filename"), F.col("doc_id").alias("id"))
    return store.new_documents(docs).select("doc_id", "content_hash")


@query("SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS source_hash FROM documents")
def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text_hash(F.col("text")).alias("source_hash"))


def _line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages whose blocks are their lines."""
    return line_pages(table(spark, sf_dir, "documents"), F.col("doc_id").cast("string"), F.lit(1), "text")


_LINES = """WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block_no FROM documents),
h AS (SELECT *, trim(line) AS s, length(trim(line)) < 90 AND trim(line) <> '' AND ((upper(trim(line)) = trim(line) AND lower(trim(line)) <> trim(line))
  OR (regexp_matches(trim(line), '\\p{Lu}') AND NOT regexp_matches(trim(line), '(^|[^\\p{L}])\\p{Ll}') AND NOT regexp_matches(trim(line), '\\p{L}\\p{Lu}') AND NOT ends_with(trim(line), '.'))) AS is_heading FROM l)"""


@query(_LINES + ", c AS (SELECT *, last_value(CASE WHEN is_heading THEN s END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_no ROWS UNBOUNDED PRECEDING) AS heading FROM h) SELECT CAST(doc_id AS VARCHAR) AS document_id, block_no::INT AS block_no, heading, sha256(s) AS text_hash, (instr(text, s) - 1)::INT AS char_start FROM c WHERE NOT is_heading AND length(s) >= 3")
def paragraph_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.paragraph_atoms(_line_pages(spark, sf_dir)).select("document_id", "block_no", F.col("section_heading").alias("heading"), F.sha2("exact_text", 256).alias("text_hash"), "char_start")


@query(_LINES + ", n AS (SELECT *, lead(s) OVER (PARTITION BY doc_id ORDER BY block_no) AS t FROM h) SELECT CAST(doc_id AS VARCHAR) AS document_id, block_no::INT AS block_no, s || chr(10) || t AS exact_text, CASE WHEN instr(text, s) > 0 THEN (instr(text, s) - 1)::INT END AS char_start FROM n WHERE t IS NOT NULL AND length(s) > 1 AND length(t) > 1 AND ((regexp_matches(s, '[0-9]') AND length(s) < 40) OR (regexp_matches(t, '[0-9]') AND length(t) < 40))")
def compound_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.card_atoms(_line_pages(spark, sf_dir)).select("document_id", "block_no", "exact_text", "char_start")


@query("SELECT CAST(doc_id AS VARCHAR) AS document_id, 'OCR_FAILURE' AS issue_type, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS affected_text FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) BETWEEN 1 AND 29")
def scanned_pages_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.scanned_page_issues(_line_pages(spark, sf_dir)).filter("affected_text is not null").select("document_id", "issue_type", "affected_text")


_ROLLUP = _LINES + """, p AS (SELECT doc_id, count_if(NOT is_heading AND length(s) >= 3) AS paragraphs FROM h GROUP BY ALL),
n AS (SELECT *, lead(s) OVER (PARTITION BY doc_id ORDER BY block_no) AS t FROM h),
c AS (SELECT doc_id, count_if(t IS NOT NULL AND length(s) > 1 AND length(t) > 1 AND ((regexp_matches(s, '[0-9]') AND length(s) < 40) OR (regexp_matches(t, '[0-9]') AND length(t) < 40))) AS cards FROM n GROUP BY ALL)
SELECT CAST(d.doc_id AS VARCHAR) AS id, 1 AS pages, (length(regexp_replace(d.text, '^\\s+|\\s+$', '', 'g')) < 30)::INT AS scanned_pages, (paragraphs + cards)::BIGINT AS atoms, 0 AS table_atoms,
       (length(regexp_replace(d.text, '^\\s+|\\s+$', '', 'g')) < 30)::INT AS issues FROM documents d JOIN p USING (doc_id) JOIN c USING (doc_id)"""


@query(_ROLLUP)
def document_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's pages, scanned pages, atoms, table atoms and issues, as a run over all documents leaves them."""
    pages = _line_pages(spark, sf_dir)
    scanned = pages.select("document_id", "page_number", A.is_scanned(F.col("raw_text"), F.col("n_images")).alias("is_scanned"))
    return api.document_rollup(pages.select(F.col("document_id").alias("id")), scanned, A.atoms(pages), A.scanned_page_issues(pages))


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 25")
def first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pages of each document by number: sources as documents, their texts as pages."""
    pages = table(spark, sf_dir, "documents").select("source", F.col("source").alias("document_id"), F.col("doc_id").alias("page_number"))
    return api.first_pages(pages, 25).select("source", F.col("page_number").alias("doc_id"))


@query("SELECT CAST(doc_id AS VARCHAR) AS document_id, step, stage, status, progress_percentage, error_message FROM documents JOIN (VALUES (false, 0, 'INGESTION', 'PROCESSING', 10, NULL), (false, 1, 'INGESTION', 'PROCESSING', 40, NULL), (false, 2, 'INGESTION_COMPLETED', 'COMPLETED', 100, NULL), (false, 3, 'FACT_EXTRACTION', 'PROCESSING', 100, NULL), (false, 4, 'FACT_EXTRACTION_COMPLETED', 'COMPLETED', 100, NULL), (true, 0, 'INGESTION', 'PROCESSING', 10, NULL), (true, 1, 'INGESTION', 'FAILED', 10, 'no text')) AS s(failed, step, stage, status, progress_percentage, error_message) ON failed = (n_chars < 100)")
def job_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.when(F.col("n_chars") < 100, "no text").alias("error"))
    return store.job_events(docs)


@query(made.PAGES_SQL)
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table_atoms(made.pages(spark, sf_dir)).select("document_id", "section_heading", "row_index", "exact_text")


def _extraction(pages: DataFrame) -> DataFrame:
    texts = A.atoms(pages).join(pages.select("document_id", "page_number", F.col("raw_text").alias("page_text")), ["document_id", "page_number"])
    return X.grounded(X.extracted(texts)).select("document_id", "evidence_id", "evidence_text", "predicate", "value_raw", "subject_raw", "time_raw", "measurement_basis", "polarity", "grounded")


@query()
def extract_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms, extraction and grounding over all documents and all reports' pages, as a service runs them over pages."""
    return _extraction(_line_pages(spark, sf_dir).unionByName(report_pages(spark, sf_dir)))


@query()
def table_row_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as tables: a row for each line, a cell for each stretch between commas, the first line as headers."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.split(x, ","))
    made = F.struct(F.lit(None).cast("array<double>").alias("bbox"), F.get(lines, F.lit(0)).alias("headers"), F.slice(lines, F.lit(2), F.size(lines)).alias("rows"))
    pages = table(spark, sf_dir, "documents").filter("text is not null")
    pages = pages.select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), F.col("text").alias("raw_text"), F.array(made).alias("tables"))
    return A.table_atoms(pages).select("document_id", "row_index", "exact_text", "char_start")


@query("SELECT event_type AS issue_type, count(*) AS n FROM events WHERE event_type <> '' GROUP BY ALL")
def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.counts(table(spark, sf_dir, "events").withColumnRenamed("event_type", "issue_type"), "issue_type")


@query("SELECT event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND user_id = 1")
def issues_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    least = events.agg(F.min("event_type").alias("event_type"))
    rows = events.join(F.broadcast(least), "event_type", "left_semi").select("event_id", F.col("user_id").cast("string").alias("document_id"), F.lit("ISSUE").alias("issue_type"), F.lit("OPEN").alias("status"))
    return api.issue_filter(rows, document_id="1", issue_type="issue").select("event_id")


@query("SELECT user_id::VARCHAR AS document_id, max_by(event_type, (ts, event_id)) AS stage, max(ts) AS updated_at FROM events GROUP BY user_id")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("document_id"), F.col("event_type").alias("stage"), F.lit("PROCESSING").alias("status"), F.col("event_id").alias("progress_percentage"), F.col("ts").alias("created_at"))
    return store.job_states(events).select("document_id", "stage", "updated_at")


def entry(spark: SparkSession) -> DataFrame:
    return flagship(spark, "/root/testdata/sf0.001")

