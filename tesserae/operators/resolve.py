"""Facts to relationships: blocking, comparison, decision, explanation, upsert, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dictionaries import RELATIONSHIPS
from ..functions.normalize import blocking_key
from ..functions.text import clean, filled, first_of

TOLERANCE_PERCENT, TOLERANCE = 0.5, 0.01


def with_block(facts: DataFrame) -> DataFrame:
    return facts.withColumn("block", blocking_key(F.col("subject_canonical"), F.col("predicate_canonical")))


def block_sizes(facts: DataFrame) -> DataFrame:
    return with_block(facts).groupBy("block").agg(F.count(F.lit(1)).alias("facts"), F.count_distinct("document_id").alias("documents"))


def block_members(facts: DataFrame, most: int) -> DataFrame:
    """Blocks with their number of facts and the ids of their first members. Each task keeps ``most`` of a block before the exchange."""
    rows = with_block(facts).select("block", "id")
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy("id"))).filter(F.col("place") <= most)
    members = first.groupBy("block").agg(F.array_sort(F.collect_list("id")).alias("members"))
    return rows.groupBy("block").agg(F.count(F.lit(1)).alias("facts")).join(members, "block")


#: Facts of a block that a task compares with as many others at once, and blocks that are cut at most: their number is broadcast.
TILE, CUT_BLOCKS = 4096, 100_000


def _blocked(facts: DataFrame) -> DataFrame:
    return with_block(facts).select("block", F.struct(*facts.columns).alias("f"))


def tiles(blocked: DataFrame, tile: int = TILE) -> DataFrame:
    """(block, tiles) of the blocks with more facts than a tile has. A tile grows with all facts, so there are ``CUT_BLOCKS`` at most."""
    sizes = blocked.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    bound = F.greatest(F.lit(tile), F.expr(f"total div {CUT_BLOCKS}"))
    return sizes.crossJoin(F.broadcast(total)).filter(F.col("n") > bound).select("block", F.ceil(F.col("n") / bound).cast("int").alias("tiles"))  # total is one row


def _with_tile(blocked: DataFrame, cut: DataFrame, name: str) -> DataFrame:
    rows = blocked.join(F.broadcast(cut.withColumnRenamed("tiles", name)), "block", "left")
    return rows.withColumn(name, F.coalesce(name, F.lit(1)))


def tile_cells(blocked: DataFrame, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """The two sides (block, i, j, f) of a self-join by triangular cells: tile i faces tile j, i <= j, and each two tiles meet in one cell."""
    rows = _with_tile(blocked, tiles(blocked, tile), "t").withColumn("k", F.pmod(F.xxhash64("f.id"), F.col("t")).cast("int"))
    left = rows.select("block", F.col("k").alias("i"), F.explode(F.sequence("k", F.col("t") - 1)).alias("j"), "f")
    right = rows.select("block", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"), F.col("k").alias("j"), "f")
    return left, right


def _delta_cells(new: DataFrame, old: DataFrame, tile: int) -> tuple[DataFrame, DataFrame]:
    """The two sides of a join of new with old facts by rectangular cells."""
    cut_new, cut_old = tiles(new, tile), tiles(old, tile)
    both = lambda rows: _with_tile(_with_tile(rows, cut_new, "t"), cut_old, "u")
    at = lambda c: F.pmod(F.xxhash64("f.id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    return both(new).select("block", at("t").alias("i"), every("u").alias("j"), "f"), both(old).select("block", every("t").alias("i"), at("u").alias("j"), "f")


def _joined(left: DataFrame, right: DataFrame, once: Column) -> DataFrame:
    """Pairs of facts that share a cell, of two documents, the smaller id first."""
    pairs = left.withColumnRenamed("f", "x").join(right.withColumnRenamed("f", "y"), ["block", "i", "j"]).filter((F.col("x.document_id") != F.col("y.document_id")) & once)
    in_order = F.col("x.id") < F.col("y.id")
    side = lambda first, second: F.struct(*[F.when(in_order, F.col(f"{first}.{c}")).otherwise(F.col(f"{second}.{c}")).alias(c) for c in left.schema["f"].dataType.names])
    return pairs.select("block", side("x", "y").alias("a"), side("y", "x").alias("b"))


def candidate_pairs(facts: DataFrame, known: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """Structs a and b of facts of one block and two documents, each unordered pair once, the smaller id first.

    An equi-join on the block, with the inequalities as its residual. Hot blocks are cut into tiles by their sizes, and each
    two tiles are a key of their own, so that a block of any size is many tasks' work. With ``known`` facts, whose pairs are
    made already, only pairs of the (other) facts with each other and with known ones are made, known ones never meet.
    """
    new = _blocked(facts)
    left, right = tile_cells(new, tile)
    pairs = _joined(left, right, (F.col("i") < F.col("j")) | (F.col("x.id") < F.col("y.id")))
    if known is None:
        return pairs
    left, right = _delta_cells(new, _blocked(known.select(*facts.columns)), tile)
    return pairs.unionByName(_joined(left, right, F.col("x.id") != F.col("y.id")))


def retrieval_metrics(facts: DataFrame) -> DataFrame:
    """Naive, cross-document and candidate pair counts by algebra on group sizes, without making a pair."""
    pairs = lambda n: F.expr(f"({n} * ({n} - 1)) div 2")
    by_document = facts.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_facts"), F.coalesce(F.sum(pairs("n")), F.lit(0)).alias("within_documents"))
    blocked = with_block(facts).groupBy("block", "document_id").agg(F.count(F.lit(1)).alias("n"))
    blocks = blocked.groupBy("block").agg(F.sum("n").alias("n"), F.sum(pairs("n")).alias("within")).agg(F.coalesce(F.sum(pairs("n") - F.col("within")), F.lit(0)).alias("candidate_pairs"), F.count(F.lit(1)).alias("blocks"))
    out = by_document.crossJoin(blocks)  # one row each
    naive = F.expr("(total_facts * (total_facts - 1)) div 2")
    out = out.withColumn("naive_comparisons", naive).withColumn("cross_document_pairs", naive - F.col("within_documents"))
    reduction = F.when(F.col("naive_comparisons") > 0, (F.col("naive_comparisons") - F.col("candidate_pairs")) * 100.0 / F.col("naive_comparisons")).otherwise(100.0)
    return out.select(
        "total_facts", "blocks", "naive_comparisons", "cross_document_pairs", "candidate_pairs", F.round(reduction, 2).alias("reduction_percent"),
        F.round(F.col("naive_comparisons") / F.greatest(F.col("candidate_pairs"), F.lit(1)), 2).alias("efficiency_multiplier"),
    )


def compared(pairs: DataFrame) -> DataFrame:
    """pairs with the struct ``dimensions`` and the messages ``important_differences``."""
    a, b = lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}")
    both = a("value_normalized").isNotNull() & b("value_normalized").isNotNull()
    delta = F.abs(a("value_normalized") - b("value_normalized"))
    most = F.greatest(F.abs(a("value_normalized")), F.abs(b("value_normalized")))
    percent = F.when(most > 0, delta / most * 100.0).otherwise(0.0)
    value_match = F.when(both, (percent <= TOLERANCE_PERCENT) | (delta <= TOLERANCE)).otherwise(clean(a("value_raw")) == clean(b("value_raw")))
    unit_a, unit_b = clean(a("unit_canonical")), clean(b("unit_canonical"))
    unit_match = F.when((unit_a == "") | (unit_b == ""), True).otherwise(unit_a == unit_b)
    raw_a, raw_b = clean(a("time_raw")), clean(b("time_raw"))
    dated = a("time_start").isNotNull() & a("time_end").isNotNull() & b("time_start").isNotNull() & b("time_end").isNotNull()
    inside = lambda x, y: (x("time_start") >= y("time_start")) & (x("time_end") <= y("time_end"))
    relation = first_of(
        [
            (F.coalesce((a("time_type") == "cumulative") & (b("time_type") == "cumulative"), F.lit(False)), "BOTH_CUMULATIVE"),
            (dated & (a("time_start") == b("time_start")) & (a("time_end") == b("time_end")), "SAME_PERIOD"),
            (dated & (inside(a, b) | inside(b, a)), "SUB_PERIOD"),
            (dated, "DIFFERENT_PERIOD"),
            ((raw_a != "") & (raw_a == raw_b), "SAME_PERIOD"),
            ((raw_a == "") & (raw_b == ""), "UNSPECIFIED"),
        ],
        "DIFFERENT_PERIOD",
    )
    scope_a, scope_b = clean(filled(a("scope"), "consolidated")), clean(filled(b("scope"), "consolidated"))
    one_is = lambda *words: scope_a.isin(*words) | scope_b.isin(*words)
    scope_relation = first_of([(scope_a == scope_b, "SAME_SCOPE"), (one_is("subsidiary", "spoton"), "SUBSIDIARY_VS_PARENT"), (scope_a.contains("regional") | scope_b.contains("regional"), "REGIONAL_DIFFERENCE")], "DIFFERENT_SCOPE")
    basis_a, basis_b = clean(filled(a("measurement_basis"), "standard")), clean(filled(b("measurement_basis"), "standard"))
    one_has = lambda pattern: basis_a.rlike(pattern) | basis_b.rlike(pattern)
    basis_relation = first_of([(basis_a == basis_b, "SAME_BASIS"), (one_has("advance|fae|sae"), "FAE_VS_SAE"), (one_has("gaap|adjusted|service"), "GAAP_VS_NON_GAAP"), (one_has("budget"), "BUDGET_VS_ACTUAL")], "DIFFERENT_BASIS")
    polarity_match = clean(filled(a("polarity"), "positive")) == clean(filled(b("polarity"), "positive"))
    rows = pairs.withColumns(
        {
            "__delta": F.when(both, delta).otherwise(0.0), "__percent": F.when(both, percent).otherwise(0.0), "__value": value_match, "__unit": unit_match,
            "__time": relation, "__scope": scope_relation, "__basis": basis_relation, "__polarity": polarity_match,
        }
    )
    dimensions = F.struct(
        F.col("__value").alias("value_match"), F.round("__delta", 4).alias("value_delta_abs"), F.round("__percent", 4).alias("value_delta_pct"), F.col("__unit").alias("unit_match"),
        F.col("__time").isin("BOTH_CUMULATIVE", "SAME_PERIOD", "UNSPECIFIED").alias("temporal_match"), F.col("__time").alias("temporal_relation"),
        (F.col("__scope") == "SAME_SCOPE").alias("scope_match"), F.col("__scope").alias("scope_relation"),
        (F.col("__basis") == "SAME_BASIS").alias("basis_match"), F.col("__basis").alias("basis_relation"), F.col("__polarity").alias("polarity_match"),
    )
    shown = lambda c: F.coalesce(c, F.lit("None"))
    versus = lambda text, c: F.concat(F.lit(text), shown(a(c)), F.lit(" vs "), shown(b(c)))
    quoted = lambda text, c: F.concat(F.lit(text + "'"), shown(a(c)), F.lit("' vs '"), shown(b(c)), F.lit("'"))
    scopes = lambda text: F.concat(F.lit(text), scope_a, F.lit(" vs "), scope_b)
    messages = F.array_compact(
        F.array(
            F.when(~F.col("__value"), quoted("value: ", "value_raw")),
            F.when(~F.col("__unit"), quoted("unit: ", "unit_canonical")),
            F.when(F.col("__time") == "SUB_PERIOD", versus("period within period: ", "time_raw")).when(F.col("__time") == "DIFFERENT_PERIOD", versus("other period: ", "time_raw")),
            F.when(F.col("__scope") != "SAME_SCOPE", scopes("scope: ")),
            F.when(F.col("__basis") != "SAME_BASIS", versus("basis: ", "measurement_basis")),
            F.when(~F.col("__polarity"), versus("polarity: ", "polarity")),
        )
    )
    return rows.select(*pairs.columns, dimensions.alias("dimensions"), messages.alias("important_differences"))


#: What is compared as the raw unit.
RAW_UNIT = {"as_shipped": "evidence_text", "unit_token": "unit_raw"}


def decided(rows: DataFrame, mode: str = "as_shipped") -> DataFrame:
    """rows with the struct ``decision`` (type, confidence, basis, variable): the first rule that holds.

    mode "as_shipped" compares evidence texts for the raw unit, "unit_token" the captured tokens.
    """
    d = lambda c: F.col(f"dimensions.{c}")
    said = lambda x: F.col(f"{x}.unit_said") if "unit_said" in rows.schema[x].dataType.names else clean(F.col(f"{x}.{RAW_UNIT[mode]}"))
    raw_a, raw_b = said("a"), said("b")
    units_differ = (raw_a != "") & (raw_b != "") & (raw_a != raw_b)
    made = lambda kind, confidence, basis, variable: F.struct(F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"), F.lit(basis).alias("reasoning_basis"), F.lit(variable).cast("string").alias("reconciliation_variable"))
    decision = first_of(
        [
            (~d("scope_match"), made("SCOPE_DIFFERENCE", 0.92, "context_matrix", "operational_scope")),
            (~d("temporal_match"), made("TEMPORALLY_EVOLVES", 0.90, "context_matrix", "time_period")),
            (d("value_match") & d("basis_match") & units_differ, made("UNIT_EQUIVALENT", 0.98, "deterministic", "unit_scale")),
            (d("value_match") & d("basis_match") & d("polarity_match"), made("CORROBORATES", 0.96, "deterministic", None)),
            (~d("value_match") & ~d("basis_match"), made("RECONCILES", 0.93, "context_matrix", "measurement_basis")),
            (~d("value_match") & d("basis_match"), made("CONTRADICTS", 0.95, "deterministic", None)),
        ],
        made("UNCERTAIN", 0.50, "context_matrix", None),
    )
    return rows.withColumn("decision", decision)


def cited(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """facts with ``source``, the file and the page that each comes from, so that no pair has to look for it.

    A caller whose documents are few may pass them with a broadcast hint; then the facts aren't shuffled for it either.
    """
    page = F.col("page_number").cast("string") if "page_number" in facts.columns else F.lit(None).cast("string")
    named = facts.join(documents.select(F.col("id").alias("document_id"), "filename"), "document_id", "left")
    return named.withColumn("source", F.concat(F.coalesce("filename", "document_id", F.lit("a document")), F.lit(" (page "), F.coalesce(page, F.lit("?")), F.lit(")"))).drop("filename", "page_number")


def explained(rows: DataFrame) -> DataFrame:
    """rows with the sentence ``explanation``, which names files and pages if the rows are ``cited``."""
    a, b = lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}")
    raw = lambda x: F.coalesce(x("value_raw"), F.lit("None"))
    is_cited = "source" in rows.schema["a"].dataType.names
    name = lambda x: x("source") if is_cited else F.coalesce(x("document_id"), F.lit("a document"))
    source = lambda x: F.concat(name(x), F.lit(" states "), raw(x))
    told = source if is_cited else raw
    when = lambda x: filled(x("time_raw"), "unspecified period")
    basis = lambda x: filled(x("measurement_basis"), "standard")
    scope = lambda x: filled(x("scope"), "consolidated")
    what = F.concat(filled(a("subject_canonical"), "unknown"), F.lit(" / "), filled(a("predicate_canonical"), "unknown"))
    figure = F.when(a("value_normalized") != 0, F.format_number(a("value_normalized"), 2)).otherwise(raw(a))
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    kind = F.col("decision.type")
    text = first_of(
        [
            (kind == "CORROBORATES", say(what, ": the sources corroborate each other for ", when(a), " (", scope(a), ", ", basis(a), "): ", source(a), "; ", source(b))),
            (kind == "UNIT_EQUIVALENT", say(what, ": ", told(a), " and ", told(b), " are the same figure in other units, ", figure)),
            (kind == "RECONCILES", say(what, ": reconciled by context, ", told(a), " on ", basis(a), " and ", told(b), " on ", basis(b))),
            (kind == "TEMPORALLY_EVOLVES", say(what, ": evolves from ", told(a), " in ", when(a), " to ", told(b), " in ", when(b))),
            (kind == "SCOPE_DIFFERENCE", say(what, ": ", told(a), " covers ", scope(a), ", ", told(b), " covers ", scope(b))),
            (kind == "CONTRADICTS", say(what, ": contradiction for ", when(a), " (", scope(a), ", ", basis(a), "): ", source(a), "; ", source(b))),
        ],
        say(what, ": ", told(a), " and ", told(b), " need clarification"),
    )
    return rows.withColumn("explanation", text)


#: What a comparison, a decision or an explanation reads of a fact; nothing else goes through the join, of texts only a digest, of files and pages a name.
COMPARED = (
    "id", "document_id", "subject_canonical", "predicate_canonical", "value_raw", "value_normalized", "unit_canonical", "time_type", "time_start", "time_end", "time_raw", "scope", "measurement_basis", "polarity",
)


def compared_columns(facts: DataFrame, mode: str = "as_shipped", documents: DataFrame | None = None) -> DataFrame:
    said = clean(F.col(RAW_UNIT[mode])) if RAW_UNIT[mode] in facts.columns else F.lit("")
    kept = facts.select(*[c for c in COMPARED if c in facts.columns], F.when(said == "", said).otherwise(F.md5(said)).alias("unit_said"), *[c for c in ("page_number",) if documents is not None and c in facts.columns])
    return kept if documents is None else cited(kept, documents)


def relationships(facts: DataFrame, mode: str = "as_shipped", known: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """Relationships of all candidate pairs; with ``known`` facts, of the pairs that aren't among those alone; with ``documents``, explained by file and page."""
    rows = explained(decided(compared(candidate_pairs(compared_columns(facts, mode, documents), None if known is None else compared_columns(known, mode, documents))), mode))
    return rows.select(
        F.sha2(F.concat_ws("|", F.col("a.id"), F.col("b.id")), 256).alias("id"), F.col("a.id").alias("fact_a_id"), F.col("b.id").alias("fact_b_id"), F.col("decision.type").alias("relationship_type"),
        F.col("decision.confidence").alias("confidence"), "explanation", "dimensions", "important_differences", F.col("decision.reasoning_basis").alias("reasoning_basis"), F.col("decision.reconciliation_variable").alias("reconciliation_variable"),
    )


def oversized_blocks(facts: DataFrame, most_pairs: int) -> DataFrame:
    """Blocks with more candidate pairs than that, by algebra on group sizes. It warns of them; no pair is dropped."""
    pairs = lambda n: F.expr(f"({n} * ({n} - 1)) div 2")
    per = with_block(facts).groupBy("block", "document_id").agg(F.count(F.lit(1)).alias("n")).groupBy("block").agg(F.sum("n").alias("n"), F.sum(pairs("n")).alias("within"))
    return per.select("block", F.col("n").alias("facts"), (pairs("n") - F.col("within")).alias("candidate_pairs")).filter(F.col("candidate_pairs") > most_pairs)


#: Bits of the table of marks by which pairs that can't be stored are told, in words of 64: at most 2^18 words are broadcast.
MARK_BITS = 1 << 24


def _pair(df: DataFrame) -> DataFrame:
    return df.withColumns({"low": F.least("fact_a_id", "fact_b_id"), "high": F.greatest("fact_a_id", "fact_b_id")})


def _marked(stored: DataFrame, found: DataFrame) -> DataFrame:
    """found with ``marked``: false for pairs that surely aren't stored. Others may be, all that are stored among them."""
    place = F.pmod(F.xxhash64("low", "high"), F.lit(MARK_BITS))
    bit = lambda rows: rows.withColumn("place", place).withColumns({"word": F.expr("place div 64"), "bit": F.expr("shiftleft(1L, CAST(place % 64 AS INT))")})
    words = bit(stored).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    marked = F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False))
    return bit(found).join(F.broadcast(words), "word", "left").withColumn("marked", marked).drop("place", "word", "bit", "bits")


def new_relationships(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Those found whose unordered pair isn't stored yet.

    Only pairs that a table of marks of a fixed size can't tell from stored ones are shuffled to be compared. The more are stored, the more
    these are; it never changes the result.
    """
    known = _pair(stored).select("low", "high")
    rows = _marked(known, _pair(found))
    asked = rows.filter("marked").join(known.distinct(), ["low", "high"], "left_anti")
    return rows.filter("NOT marked").unionByName(asked).select(*found.columns)


def breakdown(rows: DataFrame) -> DataFrame:
    """Count of every relationship type, 0 where there is none."""
    types = rows.sparkSession.createDataFrame([(t,) for t in RELATIONSHIPS], "relationship_type string")
    counts = rows.groupBy("relationship_type").agg(F.count(F.lit(1)).alias("n"))
    return types.join(counts, "relationship_type", "left").select("relationship_type", F.coalesce("n", F.lit(0)).alias("n"))
