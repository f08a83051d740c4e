"""Reads over the tables: filtered pages, enriched rows, counts, overview. Every function returns a lazy frame."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.dictionaries import RELATIONSHIPS
from ..functions.text import filled
from ..operators.resolve import retrieval_metrics


def page(df: DataFrame, limit: int = 50, offset: int = 0, by: str = "created_at") -> DataFrame:
    """Newest first, the id breaking ties."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1 to 200 and offset not negative")
    return df.orderBy(F.col(by).desc(), "id").offset(offset).limit(limit)


def _like(c: str, text: str) -> Column:
    return F.col(c).ilike("%" + text.replace("\\", "\\\\") + "%")


def fact_filter(facts: DataFrame, *, document_id: str = "", subject: str = "", predicate: str = "", predicate_type: str = "", confidence: str = "", search: str = "", document_ids: tuple[str, ...] = ()) -> DataFrame:
    """Only filters that aren't empty apply."""
    if document_id:
        facts = facts.filter(F.col("document_id") == document_id)
    if document_ids:
        facts = facts.filter(F.col("document_id").isin(*document_ids))
    if subject:
        facts = facts.filter(_like("subject_canonical", subject))
    if predicate:
        facts = facts.filter(_like("predicate_canonical", predicate))
    if predicate_type:
        facts = facts.filter(F.col("predicate_type") == predicate_type)
    if confidence:
        facts = facts.filter(F.col("confidence_level") == confidence.upper())
    if search:
        facts = facts.filter(_like("predicate_canonical", search) | _like("subject_canonical", search) | _like("value_raw", search))
    return facts


def list_facts(facts: DataFrame, limit: int = 50, offset: int = 0, **filters: str) -> DataFrame:
    return page(fact_filter(facts, **filters), limit, offset)


def get(df: DataFrame, row_id: str) -> Row:
    """The row of that id; KeyError if there is none."""
    row = df.filter(F.col("id") == row_id).head()
    if row is None:
        raise KeyError(row_id)
    return row


def shown_number(value: Column) -> Column:
    """A double as a console writes it: all its digits, without an exponent, and whole ones without a point.

    15 digits count, so that 8.1234 times ten million is 81234000, not 81233999.99999999 or 8.123399999999999E7.
    """
    digits = F.format_string("%.14e", value).cast("decimal(38,15)").cast("string")
    plain = F.when(value % 1 == 0, value.cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(digits, r"\.?0*$", ""))
    return F.when((F.abs(value) < 1e21) & ((value == 0) | (F.abs(value) >= 1e-6)), plain).otherwise(value.cast("string"))


def console_filter(facts: DataFrame, *, subject: str = "ALL", predicate_type: str = "ALL", confidence: str = "ALL", search: str = "") -> DataFrame:
    """Equality on what isn't ALL, and the search text anywhere, case aside, in names, value or evidence."""
    for column, wanted in (("subject_canonical", subject), ("predicate_type", predicate_type), ("confidence_level", confidence)):
        if wanted != "ALL":
            facts = facts.filter(F.col(column) == wanted)
    if search.strip():
        texts = [F.col(c) for c in ("subject_canonical", "subject_raw", "predicate_canonical", "predicate", "value_raw", "evidence_text")]
        hits = [F.coalesce(F.lower(t).contains(search.lower()), F.lit(False)) for t in texts]
        hits.append(F.coalesce(shown_number(F.col("value_normalized")).contains(search.lower()), F.lit(False)))
        facts = facts.filter(functools.reduce(operator.or_, hits))
    return facts


def chosen(rows: DataFrame, row_id: str | None, column: str = "relationship_type", tab: str = "ALL") -> DataFrame:
    """The row of that id, else the newest of the tab; at most one."""
    tabbed = rows if tab == "ALL" else rows.filter(F.col(column) == tab)
    first = tabbed.orderBy(F.desc("created_at"), "id").limit(1).withColumn("__n", F.lit(1))
    named = rows.filter(F.col("id") == F.lit(row_id)).withColumn("__n", F.lit(0))
    return named.unionByName(first).orderBy("__n").limit(1).drop("__n")


def tab_counts(rows: DataFrame, column: str, tabs: Sequence[str]) -> DataFrame:
    """(tab, n): the number of all rows as ALL, and of each tab's, 0 where there are none."""
    counts = rows.agg(F.count(F.lit(1)).alias("t_ALL"), *[F.count_if(F.col(column) == t).alias(f"t_{t}") for t in tabs])
    pairs = F.array(*[F.struct(F.lit(t).alias("tab"), F.col(f"t_{t}").alias("n")) for t in ("ALL", *tabs)])
    return counts.select(F.inline(pairs))


def first_pages(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Each document's pages by number, the first ``max_pages`` of them (none or 0: all)."""
    if not max_pages:
        return pages
    nth = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number"))
    return pages.withColumn("__n", nth).filter(F.col("__n") <= max_pages).drop("__n")


def document_rollup(documents: DataFrame, pages: DataFrame, atoms: DataFrame, issues: DataFrame) -> DataFrame:
    """Documents with their numbers of pages, scanned pages, atoms, table atoms and issues, each counted before the join."""
    per = lambda df, **counts: df.groupBy(F.col("document_id").alias("id")).agg(*[c.alias(k) for k, c in counts.items()])
    rows = F.count(F.lit(1))
    parts = [
        per(pages, pages=rows, scanned_pages=F.count_if("is_scanned")),
        per(atoms, atoms=rows, table_atoms=F.count_if(F.col("extraction_method") == "table_parser")),
        per(issues, issues=rows),
    ]
    out = documents
    for part in parts:
        out = out.join(part, "id", "left")
    return out.fillna(0, ["pages", "scanned_pages", "atoms", "table_atoms", "issues"])


def list_documents(documents: DataFrame, facts: DataFrame, issues: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of documents with their numbers of facts and issues, which are counted for that page only."""
    some = page(documents, limit, offset)
    mine = lambda df: df.join(F.broadcast(some.select(F.col("id").alias("document_id"))), "document_id", "left_semi")  # noqa: E731 - at most 200 ids
    return document_counts(some, mine(facts), mine(issues)).orderBy(F.desc("created_at"), "id")


def list_relationships(relationships: DataFrame, facts: DataFrame, limit: int = 50, offset: int = 0, **filters: str) -> DataFrame:
    """A page of relationships, and then their facts side by side."""
    some = page(relationship_filter(relationships, facts, **filters), limit, offset)
    ids = F.broadcast(some.select(F.explode(F.array("fact_a_id", "fact_b_id")).alias("id")).distinct())  # at most 400
    return relationships_side_by_side(some, facts.join(ids, "id", "left_semi")).orderBy(F.desc("created_at"), "id")


def list_issues(issues: DataFrame, limit: int = 50, offset: int = 0, **filters: str) -> DataFrame:
    return page(issue_filter(issues, **filters), limit, offset)


def as_json(rows: DataFrame) -> DataFrame:
    """One column, ``json``: the row as an object, nulls included."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def resolution_summary(facts: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: pairs evaluated, relationships stored for them, their numbers by type, and blocking's metrics."""
    ids = facts.select(F.col("id").alias("fact_id"))
    mine = stored.join(ids, stored["fact_a_id"] == ids["fact_id"], "left_semi")
    mine = mine.join(ids, mine["fact_b_id"] == ids["fact_id"], "left_semi")
    types = [F.count_if(F.col("relationship_type") == t).alias(t) for t in RELATIONSHIPS]
    counted = mine.agg(F.count(F.lit(1)).alias("total_relationships_stored"), F.struct(*types).alias("breakdown"))
    metrics = retrieval_metrics(facts)
    return metrics.select(F.col("candidate_pairs").alias("total_candidates_evaluated"), F.struct(*metrics.columns).alias("retrieval_metrics")).crossJoin(counted)  # one row each


def enriched(facts: DataFrame, documents: DataFrame, atoms: DataFrame | None = None) -> DataFrame:
    """Facts with their document's file name and their atom, responses' defaults filled in."""
    out = facts.join(documents.select(F.col("id").alias("document_id"), "filename"), "document_id", "left")
    if atoms is not None:
        out = out.join(atoms.select(F.col("id").alias("evidence_id"), F.col("exact_text").alias("atom_text"), "section_heading"), "evidence_id", "left")
    context = F.struct(
        filled(F.col("time_type"), "unspecified").alias("type"), F.col("time_start").alias("start"), F.col("time_end").alias("end"), filled(F.col("time_raw"), "").alias("raw"),
        filled(F.col("geography") if "geography" in facts.columns else F.lit(None).cast("string"), "India").alias("geography"), filled(F.col("scope"), "consolidated").alias("scope"), filled(F.col("measurement_basis"), "standard").alias("measurement_basis"),
    )
    return out.withColumn("context", context)


def relationships_side_by_side(relationships: DataFrame, facts: DataFrame) -> DataFrame:
    side = lambda s: facts.select(F.col("id").alias(f"fact_{s}_id"), F.struct(*facts.columns).alias(f"fact_{s}"))
    return relationships.join(side("a"), "fact_a_id", "left").join(side("b"), "fact_b_id", "left")


def relationship_filter(relationships: DataFrame, facts: DataFrame, *, kind: str = "", subject: str = "", document_id: str = "", types: tuple[str, ...] = (), least_confidence: float | None = None) -> DataFrame:
    if kind:
        relationships = relationships.filter(F.col("relationship_type") == kind.upper())
    if types:
        relationships = relationships.filter(F.col("relationship_type").isin(*types))
    if least_confidence is not None:
        relationships = relationships.filter(F.col("confidence") >= least_confidence)
    if subject or document_id:
        mine = fact_filter(facts, subject=subject, document_id=document_id).select(F.col("id").alias("fact_a_id"))
        relationships = relationships.join(mine, "fact_a_id", "left_semi")
    return relationships


def issue_filter(issues: DataFrame, document_id: str = "", issue_type: str = "", status: str = "") -> DataFrame:
    for column, value in (("document_id", document_id), ("issue_type", issue_type.upper()), ("status", status.upper())):
        if value:
            issues = issues.filter(F.col(column) == value)
    return issues


def distinct_values(facts: DataFrame, column: str) -> DataFrame:
    return facts.select(F.col(column).alias("value")).distinct().filter(F.trim("value") != "").orderBy("value")


def counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def document_counts(documents: DataFrame, facts: DataFrame, issues: DataFrame) -> DataFrame:
    """Documents with their numbers of facts and issues."""
    per = lambda df, name: df.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias(name))
    out = documents.join(per(facts, "fact_count"), "id", "left").join(per(issues, "issue_count"), "id", "left")
    return out.withColumn("fact_count", F.coalesce("fact_count", F.lit(0))).withColumn("issue_count", F.coalesce("issue_count", F.lit(0)))


def sample_per(df: DataFrame, column: str, n: int = 1) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(column).orderBy("id"))).filter(F.col("__n") <= n).drop("__n")


def overview(documents: DataFrame, pages: DataFrame, atoms: DataFrame, facts: DataFrame, relationships: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: the sizes of the tables, and blocking's metrics."""
    tables = {"documents": documents, "pages": pages, "atoms": atoms, "facts": facts, "relationships": relationships, "issues": issues}
    out = retrieval_metrics(facts).drop("total_facts")
    for name, df in tables.items():
        out = out.crossJoin(df.agg(F.count(F.lit(1)).alias(name)))  # all of one row
    return out


def overview_breakdowns(facts: DataFrame, relationships: DataFrame, issues: DataFrame) -> DataFrame:
    """(what, value, n): facts by confidence, relationships by type, issues by type."""
    parts = (("confidence", facts, "confidence_level"), ("relationship", relationships, "relationship_type"), ("issue", issues, "issue_type"))
    out = [counts(df, c).select(F.lit(what).alias("what"), F.col(c).alias("value"), "n") for what, df, c in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def fact_card(side: str, label: str) -> Column:
    """A fact of a side-by-side row, in lines."""
    f = F.col(side)
    line = lambda name, *parts: F.concat(F.lit(f"  {name}: "), *[F.coalesce(p.cast("string"), F.lit("-")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.concat_ws(
        "\n", F.concat(F.lit(f"[{label}] document "), F.coalesce(f["document_id"], F.lit("-"))), line("subject", f["subject_canonical"], " (", f["subject_raw"], ")"), line("predicate", f["predicate_canonical"]),
        line("value", f["value_raw"], " = ", F.format_number(f["value_normalized"], 2), " ", f["unit_canonical"]), line("period", filled(f["time_raw"], "unspecified")), line("scope", filled(f["scope"], "consolidated")),
        line("basis", filled(f["measurement_basis"], "actual")), line("evidence", f["evidence_text"]),
    )


def report(side_by_side: DataFrame) -> DataFrame:
    """(id, report): both facts, the comparison and the explanation of each relationship as text."""
    d = F.col("dimensions")
    matrix = F.format_string("  value delta %.2f %% (%s), units %s, period %s, scope %s, basis %s", d["value_delta_pct"], F.format_number(d["value_delta_abs"], 4), F.when(d["unit_match"], "compatible").otherwise("incompatible"), d["temporal_relation"], d["scope_relation"], d["basis_relation"])
    verdict = F.format_string("=> %s (%.1f %%): %s", F.col("relationship_type"), F.col("confidence") * 100, F.col("explanation"))
    return side_by_side.select("id", F.concat_ws("\n", fact_card("fact_a", "A"), fact_card("fact_b", "B"), matrix, verdict).alias("report"))


def demonstration(relationships: DataFrame, facts: DataFrame, issues: DataFrame) -> DataFrame:
    """(case_number, found, report): a corroboration, a contradiction, two reconciled pairs, and all issues that were kept."""
    cases = ((1, F.col("relationship_type").isin("CORROBORATES", "UNIT_EQUIVALENT") & (F.col("confidence") >= 0.85), 1), (2, F.col("relationship_type") == "CONTRADICTS", 1), (3, F.col("relationship_type") == "RECONCILES", 2))
    picked = [relationships.filter(condition).orderBy("id").limit(n).withColumn("case_number", F.lit(number)) for number, condition, n in cases]
    some = picked[0].unionByName(picked[1]).unionByName(picked[2])
    ids = F.broadcast(some.select(F.explode(F.array("fact_a_id", "fact_b_id")).alias("id")).distinct())  # at most 8
    texts = report(relationships_side_by_side(some, facts.join(ids, "id", "left_semi"))).join(some.select("id", "case_number"), "id")
    lines = F.format_string("page %s, %s (%s): %s", F.coalesce(F.col("page_number").cast("string"), F.lit("-")), F.col("issue_type"), F.col("status"), F.coalesce("description", F.lit("")))
    failures = issues.select(F.lit(4).alias("case_number"), lines.alias("report"))
    return texts.select("case_number", "report").unionByName(failures)


def health(spark) -> DataFrame:  # noqa: ANN001
    return spark.range(1).select(F.lit("ok").alias("status"), F.version().alias("version"))
