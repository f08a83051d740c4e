"""Incremental tables: idempotent ingest, first-wins entities, reprocessing, relationship upsert, issues, jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.resolve import new_relationships


def materialized(df: DataFrame, name: str) -> DataFrame:
    """Written to the folder that executors share (a temporary one in a local session without it), and read back."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tesserae-")
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Delete the folder of a ``materialized`` table, when all that reads it is written."""
    jvm, spark = table.sparkSession.sparkContext._jvm, table.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def new_documents(incoming: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Of equal contents the first (by file name, id and path); contents already stored are dropped. No content equals none.

    Only hashes, names, ids and paths are shuffled, not contents, and equal hashes are reduced before.
    """
    names = [c for c in ("filename", "id", "storage_path") if c in incoming.columns]
    first = incoming.filter("content_hash is not null").groupBy("content_hash").agg(F.min(F.struct(*names)).alias("first"))
    if stored is not None:
        first = first.join(stored.select("content_hash"), "content_hash", "left_anti")
    kept = incoming.join(first.select("content_hash", "first.*"), ["content_hash", *names], "left_semi")
    return kept.select(*incoming.columns).unionByName(incoming.filter("content_hash is null"))


def new_entities(found: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Entities not stored yet; the first writer's row wins, with all its columns."""
    others = [c for c in found.columns if c != "canonical_name"]
    first = found.groupBy("canonical_name").agg(F.min_by(F.struct(*others), F.struct("created_at", "entity_type")).alias("e")).select("canonical_name", "e.*")
    return (first if stored is None else first.join(stored.select("canonical_name"), "canonical_name", "left_anti")).select(*found.columns)


def without_document(table: DataFrame, document_ids: list[str]) -> DataFrame:
    return table.filter(~F.col("document_id").isin(*document_ids) | F.col("document_id").isNull())


def without_facts(relationships: DataFrame, facts: DataFrame) -> DataFrame:
    """Relationships whose two facts are still there: the cascade of a reprocess."""
    ids = facts.select(F.col("id").alias("fact_id"))
    kept = relationships.join(ids, relationships["fact_a_id"] == ids["fact_id"], "left_semi")
    return kept.join(ids, kept["fact_b_id"] == ids["fact_id"], "left_semi")


def resolved_issue(issues: DataFrame, issue_id: str, note: str | None = None) -> DataFrame:
    mine = F.col("id") == issue_id
    return issues.withColumn("status", F.when(mine, "RESOLVED").otherwise(F.col("status"))).withColumn("attempted_resolution", F.when(mine & F.lit(bool(note)), F.lit(note)).otherwise(F.col("attempted_resolution")))


def job_states(events: DataFrame) -> DataFrame:
    """Latest state of each document's job: events(document_id, stage, status, progress_percentage, created_at)."""
    last = F.max(F.struct("created_at", "progress_percentage", "stage", "status"))
    return events.groupBy("document_id").agg(last.alias("j")).select("document_id", "j.stage", "j.status", "j.progress_percentage", F.col("j.created_at").alias("updated_at"))


# States of a document's job, in order: stage, status, percentage.
INGESTION = (("INGESTION", "PROCESSING", 10), ("INGESTION", "PROCESSING", 40), ("INGESTION_COMPLETED", "COMPLETED", 100))
EXTRACTION = (("FACT_EXTRACTION", "PROCESSING", 100), ("FACT_EXTRACTION_COMPLETED", "COMPLETED", 100))
FAILED = (("INGESTION", "PROCESSING", 10), ("INGESTION", "FAILED", 10))


def job_events(documents: DataFrame) -> DataFrame:
    """documents(document_id, error) -> the states that each one's job goes through, in order of ``step``."""
    states = lambda rows: F.array(*[F.struct(F.lit(a).alias("stage"), F.lit(b).alias("status"), F.lit(c).alias("progress_percentage")) for a, b, c in rows])
    path = F.when(F.col("error").isNotNull(), states(FAILED)).otherwise(states(INGESTION + EXTRACTION))
    rows = documents.select("document_id", "error", F.posexplode(path).alias("step", "state"))
    return rows.select("document_id", "step", "state.*", F.when(F.col("state.status") == "FAILED", F.col("error")).alias("error_message"))


class Store:
    """Parquet tables under one folder.

    Every write goes to a folder of its own, and only a line of the table's log makes it part of the table: a write
    that failed is never seen. A replacement hides what was written before it. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._logs: dict[str, tuple[list[str], list]] = {}
        self._schemas: dict[str, StructType] = {}

    def _log(self, name: str) -> list:
        """Lines of the table's log. They are read by a job only when its folder lists other files than at the last look."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}.log")
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        files = sorted(f for s in system.listStatus(path) if (f := s.getPath().getName()).startswith("part-"))
        if self._logs.get(name, ([], []))[0] != files:
            lines = self.spark.read.schema("n int, replaces boolean, folder string").json([f"{self.path}/{name}.log/{f}" for f in files])
            self._logs[name] = (files, lines.orderBy("n").collect())
        return self._logs[name][1] if files else []

    def _folders(self, name: str) -> list[str]:
        folders: list[str] = []
        for line in self._log(name):
            folders = [line["folder"]] if line["replaces"] else [*folders, line["folder"]]
        return [f"{self.path}/{name}/{f}" for f in folders]

    def exists(self, name: str) -> bool:
        return bool(self._log(name))

    def read(self, name: str) -> DataFrame:
        if not (folders := self._folders(name)):
            raise KeyError(name)
        return self.spark.read.schema(self._schema(folders)).parquet(*folders)

    def _schema(self, folders: list[str]) -> StructType:
        """All folders of a table have the columns of its first one, which never changes."""
        if folders[0] not in self._schemas:
            self._schemas[folders[0]] = self.spark.read.parquet(*folders).schema
        return self._schemas[folders[0]]

    def _write(self, name: str, rows: DataFrame, replaces: bool, once: str | None = None) -> int:
        """The number of rows written, which the write itself counts. What is written ``once`` under a name isn't again."""
        log = self._log(name)
        if once and any(line["folder"] == once for line in log):
            return 0
        folder, n, seen = once or uuid.uuid4().hex, len(log), Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{self.path}/{name}/{folder}")
        line = self.spark.range(1).select(F.lit(n).alias("n"), F.lit(replaces).alias("replaces"), F.lit(folder).alias("folder"))
        line.coalesce(1).write.mode("append").json(f"{self.path}/{name}.log")
        return seen.get.get("n", 0)

    def replace(self, name: str, table: DataFrame) -> int:
        return self._write(name, table, True)

    def append(self, name: str, rows: DataFrame, once: str | None = None) -> int:
        if folders := self._folders(name):
            rows = rows.select(*self._schema(folders).names)
        return self._write(name, rows, False, once)

    def add_new(self, name: str, rows: DataFrame, key: str = "id") -> int:
        """Append the rows whose key isn't stored yet, so that what is written again changes nothing."""
        rows = rows.dropDuplicates([key])
        return self.append(name, rows.join(self.read(name).select(key), key, "left_anti") if self.exists(name) else rows)

    def upsert_relationships(self, found: DataFrame) -> int:
        if self.exists("relationships"):
            found = new_relationships(self.read("relationships"), found)
        return self.append("relationships", found)
