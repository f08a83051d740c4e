"""The same programs over a folder that grows: each micro-batch of new pages becomes stored pages, atoms, facts and issues."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import atoms as A
from ..operators import extract as X
from ..plans.store import Store, drop, materialized


def follow(pages: DataFrame, store: Store, checkpoint: str, arrived: str | None = None, late: str = "1 day") -> StreamingQuery:
    """pages: a stream of page rows; what comes again changes nothing.

    With a column ``arrived`` of times, a page that comes again within ``late`` is dropped by the stream's own state, which the
    watermark bounds, and a batch that is run again is known by its name: nothing that is stored is read, so a batch costs the
    same however long the history is. Without it, what is stored already is skipped by its id, for which its ids are read.
    """
    if arrived:
        pages = pages.withWatermark(arrived, late).dropDuplicatesWithinWatermark(["document_id", "page_number"])
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def batch(rows: DataFrame, number: int) -> None:
        rows = materialized(rows.dropDuplicates(["document_id", "page_number"]), "batch")
        found = A.atoms(rows)
        texts = found.join(rows.select("document_id", "page_number", F.col("raw_text").alias("page_text")), ["document_id", "page_number"])
        grounded = materialized(X.grounded(X.extracted(texts)), "batch-facts")
        kept = rows.withColumn("has_tables", F.size("tables") > 0).withColumn("is_scanned", A.is_scanned(F.col("raw_text"), F.col("n_images")))
        issues = X.grounding_issues(grounded).unionByName(X.period_issues(grounded)).unionByName(A.scanned_page_issues(rows))
        page = F.sha2(F.concat_ws("|", "document_id", F.col("page_number").cast("string")), 256)
        made = {"document_pages": kept.withColumn("page_id", page), "atoms": found, "facts": X.normalized(grounded), "issues": issues}
        for name, table in made.items():
            key = "page_id" if name == "document_pages" else "id"
            if arrived:
                store.append(name, table.dropDuplicates([key]), once=f"{stream}-{number}")
            else:
                store.add_new(name, table, key)
        drop(grounded)
        drop(rows)

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
