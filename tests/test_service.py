"""Store, sources, stream and the calls of a user, on small made-up documents."""

from __future__ import annotations

import json
import logging

import pytest
from pyspark.sql import functions as F

from tesserae.operators import atoms as A
from tesserae.operators import extract as X
from tesserae.plans import api, store as S
from tesserae.plans.service import Service
from tesserae.sources import files
from tesserae.streaming.ingest import follow

ONE = ["Delhivery annual report", "KEY FIGURES", "Delhivery reported revenue: ₹8,142 Cr in FY24.", "18,793 pin codes covered as of March 31, 2024", "2.8 bn express parcel shipments since inception"]
TWO = ["Delhivery presentation", "Delhivery reported revenue: ₹8,500 Cr in FY24.", "2.8 bn express parcel shipments since inception"]


def extract(content: bytes) -> list[dict]:
    """Pages parted by form feeds, blocks by line ends, and cells of tables by bars."""
    if content.startswith(b"broken"):
        raise ValueError("no such format")
    out = []
    for i, text in enumerate(content.decode().split("\f")):
        lines = text.split("\n")
        blocks = [{"x0": 1.004, "y0": 10.0 * j, "x1": 99.0, "y1": 10.0 * j + 9, "text": x} for j, x in enumerate(lines) if "|" not in x]
        rows = [x.split("|") for x in lines if "|" in x]
        tables = [{"bbox": [0.0, 900.0, 100.0, 950.456], "headers": rows[0], "rows": rows[1:]}] if rows else []
        out.append({"page_number": i + 1, "raw_text": text, "n_images": int(text.startswith("scan")), "blocks": blocks, "tables": tables})
    return out


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, text in {"one.pdf": "\n".join(ONE) + "\fscan", "deep/two.PDF": "\n".join(TWO), "copy.pdf": "\n".join(ONE) + "\fscan", "bad.pdf": "broken", "notes.txt": "x"}.items():
        (tmp_path / "in" / name).write_text(text)
    return tmp_path


def test_upload_reprocess_resolve(spark, folder, caplog):
    service = Service(S.Store(spark, str(folder / "store")), extract)
    with caplog.at_level(logging.INFO, "tesserae"):
        said = {r["filename"]: r for r in service.upload(str(folder / "in")).collect()}
    lines = [json.loads(r.message) for r in caplog.records if r.name == "tesserae"]
    assert [(x["stage"], x["status"]) for x in lines] == [("INGESTION", "STARTED"), ("INGESTION", "COMPLETED"), ("FACT_EXTRACTION", "STARTED"), ("FACT_EXTRACTION", "COMPLETED")]
    assert lines[1]["pages"] == 3 and lines[3]["facts"] == 5 and lines[1]["duration_ms"] > 0
    assert {k: r["status"] for k, r in said.items()} == {"one.pdf": "SUCCESS", "two.PDF": "SUCCESS", "copy.pdf": "SUCCESS", "bad.pdf": "SUCCESS", "notes.txt": "REJECTED"}
    assert "duplicate" in said["one.pdf"]["message"] and said["copy.pdf"]["message"].endswith("facts: 3")  # the first name
    assert service.documents().count() == 3 and service.documents(limit=1, offset=1).count() == 1
    one, two, bad = (said[n]["document_id"] for n in ("copy.pdf", "two.PDF", "bad.pdf"))
    assert service.document(one)["page_count"] == 2 and service.document(one)["fact_count"] == 3 and service.document(one)["issue_count"] == 1
    with pytest.raises(KeyError):
        service.document("none")
    jobs = lambda d: [(r["stage"], r["status"], r["progress_percentage"], r["error_message"]) for r in service.table("jobs").filter(F.col("document_id") == d).orderBy("step").collect()]
    assert jobs(one) == [("INGESTION", "PROCESSING", 10, None), ("INGESTION", "PROCESSING", 40, None), ("INGESTION_COMPLETED", "COMPLETED", 100, None), ("FACT_EXTRACTION", "PROCESSING", 100, None), ("FACT_EXTRACTION_COMPLETED", "COMPLETED", 100, None)]
    assert jobs(bad) == [("INGESTION", "PROCESSING", 10, None), ("INGESTION", "FAILED", 10, "no such format")]
    issues = {r["issue_type"]: r for r in service.issues().collect()}
    assert set(issues) == {"OCR_FAILURE", "PDF_EXTRACTION_FAILURE", "UPLOAD_REJECTED"} and issues["OCR_FAILURE"]["status"] == "UNRESOLVED" and issues["OCR_FAILURE"]["affected_text"] == "scan"
    assert service.issues(issue_type="ocr_failure", status="unresolved").count() == 1
    assert service.resolve_issue(issues["OCR_FAILURE"]["id"], "typed in")["attempted_resolution"] == "typed in"
    assert service.get("issues", issues["OCR_FAILURE"]["id"])["status"] == "RESOLVED"
    # The same folder again changes nothing.
    before = {t: service.table(t).count() for t in ("documents", "document_pages", "atoms", "facts", "entities", "issues")}
    service.upload(str(folder / "in"))
    assert {t: service.table(t).count() for t in before} == before
    summary = service.resolve()
    assert summary["total_candidates_evaluated"] == summary["total_relationships_stored"] == 2
    assert {k: n for k, n in summary["breakdown"].asDict().items() if n} == {"CONTRADICTS": 1, "CORROBORATES": 1}
    assert service.resolve()["total_relationships_stored"] == 2 and service.relationships().count() == 2
    row = service.relationships(kind="contradicts").first()
    assert {row["fact_a"]["value_raw"], row["fact_b"]["value_raw"]} == {"8,142 cr", "8,500 cr"}
    assert service.relationship(row["id"])["id"] == row["id"]
    assert service.resolve((one,))["total_candidates_evaluated"] == 0
    fact = service.facts(search="revenue", document_id=one).first()
    assert fact["filename"] == "copy.pdf" and fact["atom_text"] == ONE[2] and fact["section_heading"] == "KEY FIGURES" and fact["context"]["scope"] == "annual_period"
    assert service.overview()["pages"] == 3 and service.overview()["relationships"] == 2
    done = service.reprocess(one)
    assert (done["facts_extracted"], done["filename"]) == (3, "copy.pdf") and service.table("facts").count() == 5 and service.table("relationships").count() == 0
    assert service.resolve()["total_relationships_stored"] == 2
    cases = {(r["case_number"]): r["report"] for r in api.demonstration(service.table("relationships"), service.table("facts"), service.table("issues")).orderBy("case_number").collect()}
    assert set(cases) == {1, 2, 4} and "81,420,000,000.00 INR" in cases[2] and "CONTRADICTS (95.0 %)" in cases[2]
    assert json.loads(api.as_json(service.table("documents").filter(F.col("id") == two)).first()["json"])["page_count"] == 1


def test_provider_of_facts(spark, folder):
    def provider(text, page, atoms):
        if "presentation" in text:
            raise RuntimeError("no answer")
        common = {"predicate": "headcount", "predicate_type": "operational_metric", "subject_raw": "RBI", "unit_raw": "persons", "value_type": "numeric", "time_raw": "FY24", "scope": "s", "measurement_basis": "b", "polarity": "positive"}
        first = min(atoms, key=lambda a: "8,142" not in a["text"])
        return [{**common, "evidence_id": first["id"], "value_raw": "8,142 persons", "value_stated": 8142.0}, {**common, "evidence_id": first["id"], "value_raw": "77", "value_stated": 77.0}, {**common, "evidence_id": "made up", "value_raw": "1", "value_stated": 1.0}]

    service = Service(S.Store(spark, str(folder / "store")), extract, provider)
    service.upload(str(folder / "in"))
    facts = {r["value_raw"]: r for r in service.table("facts").collect()}
    assert set(facts) == {"8,142 persons", "77"} and facts["77"]["confidence_level"] == "LOW" and facts["8,142 persons"]["subject_canonical"] == "Reserve Bank of India"
    kinds = {(r["issue_type"], r["status"]) for r in service.table("issues").collect()}
    assert {("LLM_EXTRACTION_FAILURE", "DETECTED"), ("MISSING_CONTEXT", "RESOLVED"), ("CONFLICTING_EVIDENCE", "DETECTED")} <= kinds


def test_a_write_that_failed_is_never_seen(spark, tmp_path):
    store = S.Store(spark, str(tmp_path))
    store.append("t", spark.createDataFrame([(1, "a")], "id int, x string"))
    bad = spark.createDataFrame([(2, "b")], "id int, x string").withColumn("x", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        store.append("t", bad)
    assert store.read("t").count() == 1
    store.add_new("t", spark.createDataFrame([("c", 1), ("d", 3), ("d", 3)], "x string, id int"))
    assert sorted(tuple(r) for r in store.read("t").collect()) == [(1, "a"), (3, "d")]
    store.replace("t", store.read("t").filter("id = 3"))
    assert [tuple(r) for r in store.read("t").collect()] == [(3, "d")] and not store.exists("u")


def test_a_store_sees_what_another_one_wrote(spark, tmp_path):
    """Logs and columns are remembered, but never older than the files of the log."""
    one, two = S.Store(spark, str(tmp_path)), S.Store(spark, str(tmp_path))
    assert not two.exists("t")
    one.append("t", spark.createDataFrame([(1, "a")], "id int, x string"))
    assert [tuple(r) for r in two.read("t").collect()] == [(1, "a")]
    two.append("t", spark.createDataFrame([("b", 2)], "x string, id int"))
    assert sorted(tuple(r) for r in one.read("t").collect()) == [(1, "a"), (2, "b")]
    one.replace("t", spark.createDataFrame([(3.5,)], "y double"))
    assert [r.asDict() for r in two.read("t").collect()] == [{"y": 3.5}] and two.append("t", spark.createDataFrame([(4.5, 0)], "y double, z int")) == 1
    assert sorted(r["y"] for r in one.read("t").collect()) == [3.5, 4.5]


def test_first_of_equal_contents(spark):
    rows = [("3", "b", "h", b"x"), ("1", "b", "h", b"x"), ("2", "a", "h", b"x"), ("4", "c", None, None), ("5", "c", None, None), ("6", "d", "k", b"y")]
    docs = spark.createDataFrame(rows, "id string, filename string, content_hash string, content binary")
    assert sorted(r["id"] for r in S.new_documents(docs).collect()) == ["2", "4", "5", "6"]
    assert sorted(r["id"] for r in S.new_documents(docs, docs.filter("id = '1'")).collect()) == ["4", "5", "6"]
    found = spark.createDataFrame([("E", "late", ["x"], 2), ("E", "early", ["y"], 1), ("F", "f", [], 1)], "canonical_name string, entity_type string, aliases array<string>, created_at int")
    assert {r["canonical_name"]: (r["entity_type"], r["aliases"]) for r in S.new_entities(found, found.filter("canonical_name = 'F'")).collect()} == {"E": ("early", ["y"])}


def test_files_are_found_in_order(spark, folder):
    names = [r["path"].rsplit("/", 1)[1] for r in files.found_files(spark, str(folder / "in")).collect()]
    assert names == ["bad.pdf", "copy.pdf", "one.pdf"] and files.found_files(spark, str(folder / "in"), "*.[pP][dD][fF]").count() == 4


def test_stream_that_runs_again_changes_nothing(spark, folder, tmp_path):
    pages = files.pages(files.documents(files.uploads(spark, str(folder / "in"))), extract).filter("error is null")
    pages.write.parquet(str(tmp_path / "pages"))
    store = S.Store(spark, str(tmp_path / "store"))
    counts = []
    for checkpoint in ("a", "b"):  # a new checkpoint replays all pages
        stream = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "pages"))
        follow(stream, store, str(tmp_path / checkpoint)).awaitTermination()
        counts.append({t: store.read(t).count() for t in ("atoms", "facts", "issues")})
    assert counts[0] == counts[1] and counts[0]["facts"] == 5 and counts[0]["issues"] == 1


def test_tables_of_a_page(spark):
    text = "Metric|FY24\nRevenue|₹8,142 Cr\n|6.4% growth\n Orders |\nlonger than ten|\nKEY FIGURES\nx\n\ny12\n\n \nparagraph one\n\nparagraph two"
    row = {**extract(text.encode())[0], "document_id": "d", "error": None}
    row["tables"][0] |= {"headers": [None, " ", "FY24"], "rows": [["Revenue", "₹8,142 Cr", "9", "10"], ["", "6.4%", " y "], [" ", "nothing"], ["a", None, None]]}
    row["blocks"] = [{"x0": 1.0, "y0": 1.0, "x1": 2.0, "y1": 2.0, "text": "KEY FIGURES"}, {"x0": 3.0, "y0": 1.004, "x1": 4.0, "y1": 2.0, "text": "one paragraph\n \nanother 7\n\n x"}, {"x0": 1.0, "y0": 905.0, "x1": 95.0, "y1": 955.0, "text": "inside the table 5"}]
    row["raw_text"] = "KEY FIGURES one paragraph another 7 Revenue"
    page = spark.createDataFrame([row], files.PAGE)
    tables = {r["row_index"]: r for r in A.table_atoms(page).collect()}
    assert set(tables) == {0, 1} and tables[0]["exact_text"] == "Col_0: Revenue | : ₹8,142 Cr | FY24: 9 | Col_3: 10" and tables[0]["char_start"] == 36
    assert tables[1]["char_start"] is None and tables[1]["bbox"] == [0.0, 900.0, 100.0, 950.46]
    info = tables[1]["table_cell_info"]
    assert (info["table_index"], info["headers"], info["raw_cells"]) == (1, ["Col_0", "", "FY24"], ["", "6.4%", "y"])
    paragraphs = [(r["exact_text"], r["section_heading"], r["char_start"], r["bbox"]) for r in A.paragraph_atoms(page).orderBy("paragraph").collect()]
    assert paragraphs == [("one paragraph", "KEY FIGURES", 12, [3.0, 1.0, 4.0, 2.0]), ("another 7", "KEY FIGURES", 26, [3.0, 1.0, 4.0, 2.0])]
    cards = A.card_atoms(page).orderBy("block_no").collect()
    assert [(r["exact_text"], r["char_start"], r["bbox"]) for r in cards] == [
        ("KEY FIGURES\none paragraph\n \nanother 7\n\n x", 0, [1.0, 1.0, 4.0, 2.0]), ("one paragraph\n \nanother 7\n\n x\ninside the table 5", None, [3.0, 1.0, 95.0, 955.0]),
    ]
    assert A.atoms(page).filter("char_end = char_start + length(exact_text)").count() == 4


def test_ocr_text_takes_the_place_of_a_scan(spark):
    rows = [("scan", 1, "x" * 31), ("scan", 1, "x" * 30), ("scan", 0, "x" * 31), ("y" * 40, 1, "x" * 31), ("scan", 1, None)]
    pages = spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows)], "document_id string, page_number int, raw_text string, n_images int, ocr_text string")
    assert [r["raw_text"][0] for r in A.with_ocr_text(pages).orderBy("page_number").collect()] == ["x", "s", "s", "y", "s"]
    assert A.scanned_page_issues(A.with_ocr_text(pages)).count() == 2


def test_grounding(spark):
    rows = [("8,142 cr", 8142.0, "revenue 8142 cr", True), ("77", 77.0, "nothing", False), ("77", 77.0, "it is 77.0", True), ("77", None, "nothing", True), (None, None, "nothing", True)]
    facts = spark.createDataFrame([(*r[:3], "d", 1, "e", 0.9, "HIGH", i) for i, r in enumerate(rows)], "value_raw string, value_stated double, evidence_text string, document_id string, page_number int, evidence_id string, confidence_overall double, confidence_level string, i int")
    out = X.grounded(facts).orderBy("i").collect()
    assert [r["grounded"] for r in out] == [r[3] for r in rows] and out[1]["confidence_overall"] == 0.4
    assert [r["status"] for r in X.grounding_issues(X.grounded(facts)).collect()] == ["DETECTED"]


def test_a_batch_reads_nothing_that_is_stored(spark, folder, tmp_path, monkeypatch):
    """With times of arrival: pages that come again are dropped by the stream's state, a batch that runs again by its name."""
    pages = files.pages(files.documents(files.uploads(spark, str(folder / "in"))), extract).filter("error is null")
    rows = pages.withColumn("arrived", F.lit("2024-01-01").cast("timestamp"))
    store = S.Store(spark, str(tmp_path / "store"))

    def run():
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "pages"))
        follow(stream, store, str(tmp_path / "checkpoint"), arrived="arrived").awaitTermination()
        return {t: store.read(t).count() for t in ("document_pages", "atoms", "facts", "issues")}

    rows.write.parquet(str(tmp_path / "pages"))
    before = run()
    assert before["facts"] == 5 and before["document_pages"] == 3
    monkeypatch.setattr(S.Store, "add_new", None)
    rows.withColumn("arrived", F.lit("2024-01-01 01:00:00").cast("timestamp")).write.mode("append").parquet(str(tmp_path / "pages"))
    assert run() == before
    new = rows.withColumn("document_id", F.concat(F.lit("new "), "document_id")).withColumn("arrived", F.lit("2024-01-01 02:00:00").cast("timestamp"))
    new.write.mode("append").parquet(str(tmp_path / "pages"))
    assert run()["document_pages"] == 6
    one = spark.createDataFrame([(1,)], "id int")
    assert (store.append("t", one, once="batch"), store.append("t", one, once="batch")) == (1, 0) and store.read("t").count() == 1


def test_a_failed_reprocess_leaves_all_as_it_was(spark, folder):
    service = Service(S.Store(spark, str(folder / "store")), extract)
    one = {r["filename"]: r["document_id"] for r in service.upload(str(folder / "in")).collect()}["two.PDF"]
    service.resolve()
    before = {t: sorted(map(str, service.table(t).collect())) for t in ("facts", "relationships")}

    def broken(*_):
        raise RuntimeError("no answer")

    monkeyed = service._extracted
    service._extracted = broken
    with pytest.raises(RuntimeError):
        service.reprocess(one)
    service._extracted = monkeyed
    assert before == {t: sorted(map(str, service.table(t).collect())) for t in ("facts", "relationships")}


def test_pages_by_ranges(spark, tmp_path):
    """A file of many pages is read by several tasks, a range at a time; what can't be read is an error of its own."""
    (tmp_path / "long").write_text("\f".join(f"page {i}" for i in range(100)))
    (tmp_path / "short").write_text("only")
    (tmp_path / "torn").write_text("\f".join(["fine"] * 10 + ["torn"]))
    parts = lambda path: open(path).read().split("\f")

    def read(path, first, last):
        texts = parts(path)[first:last]
        if "torn" in texts:
            raise ValueError("torn page")
        return [{"page_number": first + i + 1, "raw_text": x} for i, x in enumerate(texts)]

    found = spark.createDataFrame([(n, str(tmp_path / n)) for n in ("long", "short", "torn", "gone")], "document_id string, path string")
    pages = files.paged(found, lambda path: len(parts(path)), read, pages_per_task=8).withColumn("task", F.spark_partition_id()).cache()
    assert {r["page_number"]: r["raw_text"] for r in pages.filter("document_id = 'long'").collect()} == {i + 1: f"page {i}" for i in range(100)}
    assert pages.filter("document_id = 'short'").count() == 1 and pages.filter("document_id = 'torn' and error is null").count() == 8
    assert {r["document_id"]: r["error"] for r in pages.filter("error is not null").collect()}.keys() == {"torn", "gone"}
    ranges = files.paged(found, lambda path: len(parts(path)), read, pages_per_task=8)._jdf.queryExecution().toString()
    assert "RepartitionByExpression" in ranges


def test_a_write_is_one_job(spark, tmp_path):
    """Rows are counted by the write itself."""
    store = S.Store(spark, str(tmp_path))
    assert store.append("t", spark.range(7)) == 7 and store.add_new("t", spark.range(5, 12)) == 5 and store.replace("t", spark.range(3)) == 3 and store.append("t", spark.range(0)) == 0
