"""Candidate pairs of hot blocks and of growing tables, and explanations by file and page."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tesserae.operators import resolve as R
from tesserae.plans import store as S
from tesserae.plans.service import Service

from .test_service import extract

FACT = "id string, document_id string, page_number int, subject_canonical string, predicate_canonical string, value_raw string, value_normalized double, unit_raw string, unit_canonical string, time_type string, time_start date, time_end date, time_raw string, scope string, measurement_basis string, polarity string, evidence_text string"


def fact(i, document, subject="Acme", predicate="total revenue", value=1.0):
    return (f"f{i:05d}", document, i % 7, subject, predicate, f"₹{value} Cr", value, "Cr", "INR", "fiscal_year", None, None, "FY24", "consolidated", "Standard", "positive", f"revenue of {value}")


def some(seed, n):
    rng = random.Random(seed)
    return [fact(i, f"d{rng.randint(0, 4)}", rng.choice(["Acme"] * 6 + ["Beta", "Gamma"]), rng.choice(["total revenue", "turnover", "headcount"]), float(rng.randint(1, 3))) for i in range(n)]


def pairs(rows):
    return sorted((r["a"]["id"], r["b"]["id"]) for r in rows.collect())


def test_tiles_make_the_same_pairs(spark):
    facts = spark.createDataFrame(some(1, 150), FACT).repartition(3)
    blocked = R.with_block(facts).select("block", "id", "document_id")
    a, b = blocked.toDF("block", "x", "d"), blocked.toDF("block", "y", "e")
    want = sorted(tuple(r) for r in a.join(b, "block").filter("d != e and x < y").select("x", "y").collect())
    assert want and pairs(R.candidate_pairs(facts)) == want
    for tile in (1, 5, 40):
        assert pairs(R.candidate_pairs(facts, tile=tile)) == want
    assert R.candidate_pairs(facts.limit(0)).count() == 0


def test_no_cell_of_a_hot_block_is_large(spark):
    """100,000 facts of one block: both sides of every cell are about a tile, and every two tiles meet once."""
    facts = spark.range(100_000).select(F.concat(F.lit("f"), F.col("id")).alias("id"), F.lit("d").alias("document_id"), F.lit("Acme").alias("subject_canonical"), F.lit("total revenue").alias("predicate_canonical"))
    left, right = R.tile_cells(R._blocked(facts))
    n = -(-100_000 // R.TILE)
    for side in (left, right):
        cells = {(r["i"], r["j"]): r["count"] for r in side.groupBy("i", "j").count().collect()}
        assert set(cells) == {(i, j) for j in range(n) for i in range(j + 1)} and max(cells.values()) < 1.1 * R.TILE


def test_cut_blocks_are_bounded(spark, monkeypatch):
    """However many blocks are hot, no more than ``CUT_BLOCKS`` are cut; the pairs stay the same."""
    rows = [fact(i, f"d{i % 3}", f"S{i % 20}") for i in range(400)]
    facts = spark.createDataFrame(rows, FACT)
    want = pairs(R.candidate_pairs(facts))
    assert R.tiles(R._blocked(facts), 5).count() == 20
    monkeypatch.setattr(R, "CUT_BLOCKS", 10)
    assert R.tiles(R._blocked(facts), 5).count() == 0 and pairs(R.candidate_pairs(facts, tile=5)) == want


def test_new_facts_meet_known_ones_and_each_other(spark):
    rows = some(2, 160)
    facts = spark.createDataFrame(rows, FACT)
    old, new = spark.createDataFrame(rows[:90], FACT), spark.createDataFrame(rows[90:], FACT)
    first, every = pairs(R.candidate_pairs(old)), pairs(R.candidate_pairs(facts))
    for tile in (4096, 9):
        second = pairs(R.candidate_pairs(new, old, tile))
        assert sorted(first + second) == every and not set(first) & set(second)
    nothing = facts.limit(0)
    assert pairs(R.candidate_pairs(nothing, facts)) == [] and pairs(R.candidate_pairs(facts, nothing)) == every
    one, two = R.relationships(old).collect(), R.relationships(new, known=old).collect()
    assert sorted(map(str, one + two)) == sorted(map(str, R.relationships(facts).collect()))


def test_explanations_name_file_and_page(spark):
    facts = spark.createDataFrame([fact(1, "d1"), fact(2, "d2", value=2.0), fact(3, "gone")], FACT)
    documents = spark.createDataFrame([("d1", "one.pdf"), ("d2", "two.pdf")], "id string, filename string")
    said = {r["fact_a_id"] + r["fact_b_id"]: r["explanation"] for r in R.relationships(facts, documents=documents).collect()}
    assert "one.pdf (page 1) states ₹1.0 Cr; two.pdf (page 2) states ₹2.0 Cr" in said["f00001f00002"]
    assert "gone (page 3) states ₹1.0 Cr" in said["f00002f00003"] and len(said) == 3
    assert "d1 states ₹1.0 Cr; d2 states" in {r["fact_b_id"]: r["explanation"] for r in R.relationships(facts.filter("id != 'f00003'")).collect()}["f00002"]
    assert "? " not in said["f00001f00003"] and "(page ?)" in R.relationships(facts.drop("page_number"), documents=documents).first()["explanation"]


def test_no_pair_is_shuffled_for_its_sources(spark):
    facts = spark.createDataFrame(some(5, 60), FACT)
    documents = spark.createDataFrame([("d1", "one.pdf")], "id string, filename string")
    for known in (None, facts.limit(20)):
        plan = R.relationships(facts, known=known, documents=documents)._jdf.queryExecution().executedPlan().toString().split("\n")
        joins = [i for i, line in enumerate(plan) if "Join [" in line or "JoinExec" in line]
        assert "[block#" in plan[joins[0]] and not any("Exchange" in line for line in plan[: joins[0]])


def test_few_pairs_are_shuffled_when_few_are_stored(spark, monkeypatch):
    """Pairs are new unless stored in either order, with marks that tell nearly all and with marks that tell nothing."""
    found = spark.range(20_000).selectExpr("'a' || id AS fact_a_id", "'b' || id % 500 AS fact_b_id", "id")
    found = found.unionByName(spark.createDataFrame([(None, None, -1), ("a1", None, -2)], "fact_a_id string, fact_b_id string, id long"))
    stored = found.filter("id % 1000 = 7 OR id = -1").selectExpr("fact_b_id AS fact_a_id", "fact_a_id AS fact_b_id", "id").unionByName(found.filter("id = 5")).unionByName(found.filter("id = 5"))
    assert R._marked(R._pair(stored).select("low", "high"), R._pair(found)).filter("marked").count() < 60
    for bits in (R.MARK_BITS, 64):
        monkeypatch.setattr(R, "MARK_BITS", bits)
        got = R.new_relationships(stored, found)
        assert got.columns == found.columns and sorted(r["id"] for r in got.collect()) == sorted([i for i in range(20_000) if i % 1000 != 7 and i != 5] + [-1, -2])
        assert R.new_relationships(stored.limit(0), found).count() == 20_002


def test_service_resolves_by_steps(spark, tmp_path):
    """What comes in later is paired with what is there; a reprocessed document is paired anew; a run for some documents hides nothing."""
    service = Service(S.Store(spark, str(tmp_path / "store")), extract)
    texts = {"a": "Delhivery reported revenue: ₹8,142 Cr in FY24.", "b": "Delhivery reported revenue: ₹8,500 Cr in FY24.", "c": "Delhivery reported revenue: ₹8,900 Cr in FY23."}
    (tmp_path / "ab").mkdir()
    for name in "ab":
        (tmp_path / "ab" / f"{name}.pdf").write_text(texts[name])
    ids = {r["filename"][0]: r["document_id"] for r in service.upload(str(tmp_path / "ab")).collect()}
    assert service.resolve((ids["a"],))["total_relationships_stored"] == 0
    assert service.resolve()["total_relationships_stored"] == 1
    assert "a.pdf (page 1) states" in service.relationships().first()["explanation"]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "c.pdf").write_text(texts["c"])
    ids["c"] = service.upload(str(tmp_path / "c")).first()["document_id"]
    assert service.resolve()["total_relationships_stored"] == 3 and service.table("resolved").count() == 3
    service.reprocess(ids["b"])
    assert service.table("relationships").count() == 1 and service.table("resolved").count() == 2
    assert service.resolve()["total_relationships_stored"] == 3 and service.resolve()["total_relationships_stored"] == 3
