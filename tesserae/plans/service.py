"""The calls that a user makes: upload, reprocess, resolve, and reads, over the tables of a store."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..operators import atoms as A
from ..operators import extract as X
from ..operators import resolve as R
from ..sources import files
from . import api
from .store import EXTRACTION, FAILED, INGESTION, Store, drop, materialized, new_documents, new_entities, without_document, without_facts

log = logging.getLogger("tesserae")

SCHEMAS = {
    "documents": "id string, filename string, content_hash string, file_size_bytes long, page_count int, storage_path string, created_at timestamp",
    "document_pages": f"{files.PAGE}, has_tables boolean, is_scanned boolean",
    "issues": "id string, document_id string, page_number int, issue_type string, description string, affected_text string, attempted_resolution string, status string, created_at timestamp",
    "resolved": "id string, document_id string",
    "jobs": "document_id string, step int, stage string, status string, progress_percentage int, error_message string, created_at timestamp",
}


@contextmanager
def stage(name: str, **extra: object) -> Iterator[dict]:
    """A line of JSON at the start and the end of a stage; what it puts into the dictionary goes into the last one."""
    say = lambda status, **more: log.info(json.dumps({"stage": name, "status": status, **extra, **more}, default=str))
    began, found = time.time(), {}
    say("STARTED")
    try:
        yield found
    except Exception as error:
        say("FAILED", error=str(error))
        raise
    say("COMPLETED", duration_ms=round((time.time() - began) * 1000, 2), **found)


class Service:
    """Tables: documents, document_pages, atoms, facts, entities, relationships, issues, jobs."""

    def __init__(self, store: Store, extract: Callable[[bytes], list[dict]] | None = None, provider: Callable[[str, int, list[dict]], list[dict]] | None = None):
        self.store, self.spark, self.extractor, self.provider = store, store.spark, extract, provider

    def table(self, name: str) -> DataFrame:
        if self.store.exists(name):
            return self.store.read(name)
        if name in SCHEMAS:
            return self.spark.createDataFrame([], SCHEMAS[name])
        raise KeyError(name)

    def _issues(self, rows: DataFrame) -> None:
        self.store.add_new("issues", rows.withColumn("created_at", F.current_timestamp()))

    def _jobs(self, documents: DataFrame, states: tuple, first: int, error: str | None = None) -> None:
        rows = [(first + i, *s) for i, s in enumerate(states)]
        steps = self.spark.createDataFrame(rows, "step int, stage string, status string, progress_percentage int")
        message = F.when(F.col("status") == "FAILED", F.col(error)) if error else F.lit(None).cast("string")
        events = documents.crossJoin(F.broadcast(steps))  # a few states for each document
        self.store.append("jobs", events.select("document_id", "step", "stage", "status", "progress_percentage", message.alias("error_message"), F.current_timestamp().alias("created_at")))

    def upload(self, path: str, suffix: str = ".pdf") -> DataFrame:
        """Ingest every file under the folder: (document_id, filename, status, message) for each."""
        if self.extractor is None:
            self.extractor = files.pdf_extractor()
        # Contents are hashed as they are read and not written; of new documents they are read once more.
        found = materialized(files.uploads(self.spark, path, suffix).drop("content"), "uploads")
        self._issues(files.upload_issues(found))
        with stage("INGESTION", path=path) as said:
            stored = self.store.read("documents") if self.store.exists("documents") else None
            fresh = materialized(new_documents(files.documents(found), stored), "fresh")
            pages = materialized(files.pages(files.with_content(fresh), self.extractor), "pages")
            said |= self._ingested(fresh, pages)
            drop(pages)
        self.extract(fresh.select(F.col("id").alias("document_id")))
        counts = self.table("facts").groupBy("document_id").agg(F.count(F.lit(1)).alias("n")) if self.store.exists("facts") else self.spark.createDataFrame([], "document_id string, n long")
        # Of files with one content the first is the document, the others are its duplicates.
        names = fresh.select("id", F.col("filename").alias("first_name"))
        rows = found.select(F.col("content_hash").alias("document_id"), "filename", "rejected").join(counts, "document_id", "left").join(names, F.col("document_id") == F.col("id"), "left")
        is_new = F.coalesce(F.col("filename") == F.col("first_name"), F.lit(False))
        message = F.when(F.col("rejected").isNotNull(), F.col("rejected")).when(is_new, F.concat(F.lit("ingested, facts: "), F.coalesce("n", F.lit(0)).cast("string"))).otherwise("duplicate of a stored document")
        return rows.select(F.when(F.col("rejected").isNull(), F.col("document_id")).alias("document_id"), "filename", F.when(F.col("rejected").isNull(), "SUCCESS").otherwise("REJECTED").alias("status"), message.alias("message"))

    def _ingested(self, fresh: DataFrame, pages: DataFrame) -> dict:
        failed = pages.filter("error is not null and page_number is null").groupBy(F.col("document_id")).agg(F.first("error").alias("error"))
        good = pages.join(failed, "document_id", "left_anti")
        counts = good.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("page_count"))
        documents = fresh.join(counts, "id", "left").withColumn("page_count", F.coalesce("page_count", F.lit(0))).withColumn("created_at", F.current_timestamp())
        atoms = A.atoms(good)
        # Documents come last: until then a run that failed is not seen, and what it wrote is skipped by its ids.
        kept = good.withColumn("has_tables", F.size("tables") > 0).withColumn("is_scanned", A.is_scanned(F.col("raw_text"), F.col("n_images")))
        old = self.table("document_pages")
        n_pages = self.store.append("document_pages", kept.join(old.select("document_id", "page_number"), ["document_id", "page_number"], "left_anti"))
        n_atoms = self.store.add_new("atoms", atoms)
        self._issues(A.scanned_page_issues(good).unionByName(files.extraction_issues(pages)))
        ids = fresh.select(F.col("id").alias("document_id"))
        self._jobs(ids.join(failed, "document_id", "left_anti"), INGESTION, 0)
        self._jobs(failed, FAILED, 0, "error")
        n = self.store.add_new("documents", documents.select(*[c.split()[0] for c in SCHEMAS["documents"].split(", ")]))
        return {"documents": n, "pages": n_pages, "atoms": n_atoms}

    def _extracted(self, ids: DataFrame, max_pages: int | None = None) -> DataFrame:
        """Facts of documents(document_id) from their stored atoms, grounded and normalised, written aside; their issues are stored."""
        pages = api.first_pages(self.table("document_pages").join(ids, "document_id", "left_semi"), max_pages)
        atoms = self.table("atoms")
        texts = atoms.join(pages.select("document_id", "page_number", F.col("raw_text").alias("page_text")), ["document_id", "page_number"])
        if self.provider is None:
            stated = X.extracted(texts)
        else:
            stated, issues = X.extracted_by(texts, self.provider)
            stated = materialized(stated, "stated")
            self._issues(issues.unionByName(X.without_evidence(stated, atoms)))
            stated = X.with_evidence(stated, atoms)
        grounded = materialized(X.grounded(stated), "grounded")
        self._issues(X.grounding_issues(grounded).unionByName(X.period_issues(grounded)))
        facts = materialized(X.normalized(grounded).withColumn("created_at", F.current_timestamp()), "normalized")
        drop(grounded)
        return facts

    def _followed(self, facts: DataFrame, ids: DataFrame) -> None:
        """Entities of new facts, and the states of their documents' jobs."""
        entities = facts.select(F.col("subject_canonical").alias("canonical_name"), F.col("subject_type").alias("entity_type"), "created_at")
        self.store.append("entities", new_entities(entities, self.store.read("entities") if self.store.exists("entities") else None))
        done = ids.join(self.table("documents").filter("page_count > 0").select(F.col("id").alias("document_id")), "document_id", "left_semi")
        self._jobs(done, EXTRACTION, len(INGESTION))

    def extract(self, ids: DataFrame, max_pages: int | None = None) -> None:
        """Facts of documents(document_id) from their stored atoms: grounded, normalised, with entities and issues."""
        with stage("FACT_EXTRACTION") as said:
            facts = self._extracted(ids, max_pages)
            said["facts"] = self.store.add_new("facts", facts)
            self._followed(facts, ids)
            drop(facts)

    def reprocess(self, document_id: str) -> Row:
        """Extract the document anew; then its facts take the place of the old ones in one write, and the relationships that hung on these go.

        If the extraction fails, all stays as it was. The document's pairs are to be resolved again.
        """
        document = self.get("documents", document_id)
        ids = self.spark.createDataFrame([(document_id,)], "document_id string")
        with stage("FACT_EXTRACTION", document_id=document_id) as said:
            facts = self._extracted(ids)
            others = without_document(self.table("facts"), [document_id])
            said["facts"] = n = facts.dropDuplicates(["id"]).count()
            kept = self.table("relationships") if self.store.exists("relationships") else None
            kept = None if kept is None else materialized(without_facts(kept, others), "kept")
            self.store.replace("facts", others.unionByName(facts.dropDuplicates(["id"]).select(*others.columns)))
            if kept is not None:
                self.store.replace("relationships", kept)
                drop(kept)
            if self.store.exists("resolved"):
                self.store.replace("resolved", without_document(self.table("resolved"), [document_id]))
            self._followed(facts, ids)
            drop(facts)
        return Row(document_id=document_id, filename=document["filename"], status="SUCCESS", facts_extracted=n)

    def resolve(self, document_ids: tuple[str, ...] = ()) -> Row:
        """Relationships of all candidate pairs that have none yet, and the summary of them all.

        Facts that were there when all were resolved aren't paired with each other again: only with new ones. A run for some
        documents pairs their facts alone, and so resolves nothing for the runs after it.
        """
        facts = api.fact_filter(self.table("facts"), document_ids=document_ids)
        resolved = self.table("resolved").select(F.col("id"))
        with stage("RESOLUTION") as said:
            new = materialized(facts.join(resolved, "id", "left_anti"), "unresolved")
            known = facts.join(resolved, "id", "left_semi")
            found = R.relationships(new, known=known, documents=self.table("documents"))
            self.store.upsert_relationships(found.withColumn("created_at", F.current_timestamp()))
            if not document_ids:
                self.store.append("resolved", new.select("id", "document_id"))
            drop(new)
            summary = api.resolution_summary(facts, self.table("relationships")).first()
            said["relationships"] = summary["total_relationships_stored"]
        return summary

    def get(self, table: str, row_id: str) -> Row:
        return api.get(self.table(table), row_id)

    def document(self, document_id: str) -> Row:
        one = self.table("documents").filter(F.col("id") == document_id)
        return api.get(api.document_counts(one, self.table("facts"), self.table("issues")), document_id)

    def documents(self, limit: int = 50, offset: int = 0) -> DataFrame:
        return api.list_documents(self.table("documents"), self.table("facts"), self.table("issues"), limit, offset)

    def facts(self, limit: int = 50, offset: int = 0, **filters: str) -> DataFrame:
        return api.enriched(api.list_facts(self.table("facts"), limit, offset, **filters), self.table("documents"), self.table("atoms"))

    def relationships(self, limit: int = 50, offset: int = 0, **filters: str) -> DataFrame:
        return api.list_relationships(self.table("relationships"), self.table("facts"), limit, offset, **filters)

    def relationship(self, relationship_id: str) -> Row:
        return api.get(api.relationships_side_by_side(self.table("relationships").filter(F.col("id") == relationship_id), self.table("facts")), relationship_id)

    def issues(self, limit: int = 50, offset: int = 0, **filters: str) -> DataFrame:
        return api.list_issues(self.table("issues"), limit, offset, **filters)

    def resolve_issue(self, issue_id: str, note: str | None = None) -> Row:
        from .store import resolved_issue

        self.get("issues", issue_id)
        self.store.replace("issues", resolved_issue(self.table("issues"), issue_id, note))
        return self.get("issues", issue_id)

    def overview(self) -> Row:
        return api.overview(*[self.table(t) for t in ("documents", "document_pages", "atoms", "facts", "relationships", "issues")]).first()
