"""Files as documents: found recursively, checked, hashed; their pages by an extractor that may be plugged in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import issue_rows

PAGE = "document_id string, page_number int, raw_text string, n_images int, blocks array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>, tables array<struct<bbox:array<double>,headers:array<string>,rows:array<array<string>>>>, error string"


def uploads(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """Every file under the folder: its content, its hash as id, and why it is rejected, if it is."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    why = F.when(~F.lower("path").endswith(suffix), "not a " + suffix).when(F.col("length") == 0, "empty")
    return files.select("path", name.alias("filename"), F.col("length").alias("file_size_bytes"), F.sha2("content", 256).alias("content_hash"), "content", why.alias("rejected"))


def found_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Paths and sizes of the files below a folder that match the pattern, in order; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("file_size_bytes")).orderBy("path")


def upload_issues(uploaded: DataFrame) -> DataFrame:
    rows = uploaded.filter("rejected is not null").select(F.lit(None).cast("string").alias("document_id"), F.lit(None).cast("int").alias("page_number"), "path", "rejected")
    return issue_rows(rows, "UPLOAD_REJECTED", "DETECTED", F.concat("path", F.lit(": "), "rejected"), None, "file skipped")


def documents(accepted: DataFrame) -> DataFrame:
    rows = accepted.filter("rejected is null")
    content = [c for c in ("content",) if c in accepted.columns]
    return rows.select(F.col("content_hash").alias("id"), "filename", "content_hash", "file_size_bytes", F.col("path").alias("storage_path"), *content)


def with_content(documents_: DataFrame) -> DataFrame:
    """Documents with their files' contents, read from these files only; one that has changed meanwhile is left out.

    Their paths pass the driver, as all paths do when Spark lists files.
    """
    spark, paths = documents_.sparkSession, [r["storage_path"] for r in documents_.select("storage_path").collect()]
    if not paths:
        return documents_.withColumn("content", F.lit(None).cast("binary"))
    contents = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("storage_path"), "content")
    return documents_.join(contents, "storage_path").filter(F.sha2("content", 256) == F.col("content_hash"))


def paged(files: DataFrame, count: Callable[[str], int], read: Callable[[str, int, int], list[dict]], pages_per_task: int = 64) -> DataFrame:
    """Pages of files(document_id, path) by ranges: ``count`` tells a file's pages, ``read`` gives those from a first to before a last one.

    A range is a row of its own, dealt out by file and place, so that a file of any size is many tasks' work and no row holds a
    whole file. A file whose pages can't be counted, or a range that can't be read, is a row with ``error``.
    """
    names = [c.split()[0] for c in ("document_id", "page_number", "raw_text", "n_images", "blocks", "tables", "error")]
    failed = lambda document_id, error: pd.DataFrame([dict.fromkeys(names) | {"document_id": document_id, "error": str(error) or type(error).__name__}])

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for document_id, path in zip(batch["document_id"], batch["path"], strict=True):
                try:
                    n, error = count(path), None
                except Exception as fault:  # noqa: BLE001 - becomes a row
                    n, error = 0, str(fault) or type(fault).__name__
                firsts = range(0, n, pages_per_task) if error is None else [0]
                yield pd.DataFrame([(document_id, path, first, min(first + pages_per_task, n), error) for first in firsts], columns=["document_id", "path", "first", "last", "error"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for document_id, path, first, last, error in zip(*(batch[c] for c in ("document_id", "path", "first", "last", "error")), strict=True):
                if error is not None:
                    yield failed(document_id, error)
                    continue
                try:
                    rows = [{"document_id": document_id, "error": None, "n_images": 0, "blocks": [], "tables": [], **p} for p in read(path, int(first), int(last))]
                except Exception as fault:  # noqa: BLE001 - becomes an issue row
                    yield failed(document_id, fault)
                    continue
                if rows:
                    yield pd.DataFrame(rows)[names]

    ranges = files.select("document_id", "path").mapInPandas(counted, "document_id string, path string, first int, last int, error string")
    return ranges.repartition("document_id", "first").mapInPandas(run, PAGE)


def pages(documents_: DataFrame, extract: Callable[[bytes], list[dict]]) -> DataFrame:
    """Pages of documents by ``extract`` (bytes -> page dicts without document_id); a failure is a row with ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for document_id, content in zip(batch["id"], batch["content"], strict=True):
                try:
                    rows = [{"document_id": document_id, "error": None, "n_images": 0, "blocks": [], "tables": [], **p} for p in extract(bytes(content))]
                except Exception as error:  # noqa: BLE001 - becomes an issue row
                    rows = [{"document_id": document_id, "page_number": None, "raw_text": None, "n_images": None, "blocks": None, "tables": None, "error": str(error)}]
                if rows:
                    yield pd.DataFrame(rows)[[c.split()[0] for c in ("document_id", "page_number", "raw_text", "n_images", "blocks", "tables", "error")]]

    return documents_.select("id", "content").mapInPandas(run, PAGE)


def extraction_issues(pages_: DataFrame) -> DataFrame:
    return issue_rows(pages_.filter("error is not null"), "PDF_EXTRACTION_FAILURE", "DETECTED", F.col("error"), None, "raw text only")


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> DataFrame:
    """A table of a database, read in ranges of a whole-number key where one is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def pdf_extractor() -> Callable[[bytes], list[dict]]:
    """Pages by PyMuPDF, where it is installed."""
    import fitz

    def extract(content: bytes) -> list[dict]:
        out = []
        with fitz.open(stream=content, filetype="pdf") as pdf:
            for i, p in enumerate(pdf):
                blocks = [{"x0": b[0], "y0": b[1], "x1": b[2], "y1": b[3], "text": b[4]} for b in p.get_text("blocks") if b[6] == 0]
                tables = [{"bbox": list(t.bbox), "headers": list(t.header.names), "rows": t.extract()} for t in p.find_tables().tables]
                out.append({"page_number": i + 1, "raw_text": p.get_text(), "n_images": len(p.get_images()), "blocks": blocks, "tables": tables})
        return out

    return extract
