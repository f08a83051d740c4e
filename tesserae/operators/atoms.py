"""Pages to evidence atoms: tables rendered row by row, headings carried forward, paragraphs split, cards joined.

pages(document_id, page_number, raw_text, n_images, blocks: array<struct<x0,y0,x1,y1,text>>,
tables: array<struct<bbox,headers,rows>>). Everything stays within a page, so nothing is ordered beyond one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_title, is_upper, strip, text_hash
from .extract import issue_rows

SCANNED_CHARS, MIN_ROW, MIN_ATOM, CARD_CHARS, HEADING_CHARS, MARGIN = 30, 10, 3, 40, 90, 5


def is_scanned(raw_text: Column, n_images: Column) -> Column:
    return (F.length(strip(F.coalesce(raw_text, F.lit("")))) < SCANNED_CHARS) & (n_images > 0)


def is_heading(text: Column) -> Column:
    return _is_heading(strip(text))


def _is_heading(s: Column) -> Column:
    return (F.length(s) < HEADING_CHARS) & (s != "") & ~s.contains("\n") & (is_upper(s) | (is_title(s) & ~s.endswith(".")))


def with_ocr_text(pages: DataFrame) -> DataFrame:
    """pages(..., ocr_text): text by OCR takes the place of a scanned page's text if it is longer than that limit."""
    better = is_scanned(F.col("raw_text"), F.col("n_images")) & (F.length(strip(F.coalesce("ocr_text", F.lit("")))) > SCANNED_CHARS)
    return pages.withColumn("raw_text", F.when(better, F.col("ocr_text")).otherwise(F.col("raw_text"))).withColumn("n_images", F.when(better, 0).otherwise(F.col("n_images")))


def scanned_page_issues(pages: DataFrame) -> DataFrame:
    scanned = pages.filter(is_scanned(F.col("raw_text"), F.col("n_images")))
    text = strip(F.coalesce("raw_text", F.lit("")))
    said = F.format_string("page %s is scanned, with %s characters of text", F.col("page_number").cast("string"), F.length(text).cast("string"))
    return issue_rows(scanned, "OCR_FAILURE", "UNRESOLVED", said, F.when(text != "", F.substring(text, 1, 200)), "page kept for inspection")


def position(page_text: Column, text: Column) -> Column:
    """First occurrence of the text in its page, else of its first 30 characters, from 0; null if there is none."""
    at = F.nullif(F.instr(page_text, text), F.lit(0))
    start = F.nullif(F.instr(page_text, F.substring(text, 1, 30)), F.lit(0))
    return F.coalesce(at, start) - 1


def _box(*corners: Column) -> Column:
    return F.array(*[F.round(c, 2) for c in corners])


def table_atoms(pages: DataFrame) -> DataFrame:
    """A row of a table as "header: cell | ...". A header that is absent is Col_i, one that is empty stays so."""
    tables = pages.select("document_id", "page_number", "raw_text", F.posexplode("tables").alias("table_index", "table"))
    rows = tables.select("*", F.posexplode("table.rows").alias("row_index", "cells"))
    column = lambda i: F.concat(F.lit("Col_"), i.cast("string"))
    rows = rows.withColumn("headers", F.coalesce(F.transform("table.headers", lambda h, i: F.coalesce(strip(h), column(i))), F.array().cast("array<string>")))
    blank = lambda c: strip(F.coalesce(c, F.lit(""))) == ""
    shown = F.transform("cells", lambda c, i: F.when(~blank(c), F.concat(F.coalesce(F.get("headers", i), column(i)), F.lit(": "), strip(c))))
    rows = rows.withColumn("exact_text", F.array_join(F.array_compact(shown), " | ")).filter(F.length("exact_text") >= MIN_ROW)
    first = F.get("cells", F.lit(0))
    start = F.when(first != "", F.nullif(F.instr("raw_text", strip(first)), F.lit(0)) - 1)
    raw = F.transform("cells", lambda c: strip(F.coalesce(c, F.lit(""))))
    info = F.struct((F.col("table_index") + 1).alias("table_index"), "row_index", "headers", raw.alias("raw_cells"))
    return rows.select(
        "document_id", "page_number", F.concat(F.lit("Table "), (F.col("table_index") + 1).cast("string")).alias("section_heading"), "exact_text", start.alias("char_start"),
        F.transform("table.bbox", lambda x: F.round(x, 2)).alias("bbox"), info.alias("table_cell_info"), F.lit("table_parser").alias("extraction_method"), "table_index", "row_index",
    )


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _sections(marked: Column) -> Column:
    """Blocks with the heading before them, the last one of all and the block after them, cut at headings, so that none is searched for."""
    at = F.array_compact(F.transform(marked, lambda m, i: F.when(m["is_heading"], i)))

    def section(m: Column, starts: Column, last: Column, k: Column) -> Column:
        start, heading = starts[k], F.when(k > 0, F.get(m, starts[k])["stripped"])
        members = F.slice(m, start + 1, F.coalesce(F.get(starts, k + 1), F.size(m)) - start)
        cell = lambda x, j: F.struct(x["block"].alias("block"), x["is_heading"].alias("is_heading"), heading.alias("heading"), last.alias("last_heading"), F.get(m, start + j + 1)["block"].alias("next_block"))
        return F.transform(members, cell)

    cut = lambda m, starts: _let(F.when(F.size(starts) > 1, m[F.element_at(starts, -1)]["stripped"]), lambda last: F.flatten(F.transform(starts, lambda _, k: section(m, starts, last, k))))
    return _let(F.concat(F.array(F.lit(0)), at), lambda starts: cut(marked, starts))


def blocks_with_headings(pages: DataFrame) -> DataFrame:
    """A row per block with ``heading`` carried forward, ``last_heading`` of the page and the block after it.

    All within the page's row: no text crosses an exchange, let alone once for each of its blocks.
    """
    stripped = F.transform("blocks", lambda b: F.struct(b.alias("block"), strip(b["text"]).alias("stripped")))
    marked = F.transform(stripped, lambda m: F.struct(m["block"].alias("block"), m["stripped"].alias("stripped"), _is_heading(m["stripped"]).alias("is_heading")))
    rows = pages.select("document_id", "page_number", "raw_text", "tables", F.posexplode(_let(marked, _sections)).alias("block_no", "of"))
    return rows.select("document_id", "page_number", "raw_text", "tables", "block_no", "of.block", F.col("of.block.text").alias("text"), "of.is_heading", "of.heading", "of.last_heading", "of.next_block")


def paragraph_atoms(pages: DataFrame) -> DataFrame:
    b = F.col("block")
    around = lambda t: (b["x0"] >= t["bbox"][0] - MARGIN) & (b["y0"] >= t["bbox"][1] - MARGIN) & (b["x1"] <= t["bbox"][2] + MARGIN) & (b["y1"] <= t["bbox"][3] + MARGIN)
    free = blocks_with_headings(pages).filter(~F.col("is_heading") & ~F.exists(F.coalesce("tables", F.array().cast(pages.schema["tables"].dataType)), lambda t: F.coalesce(around(t), F.lit(False))))
    split = free.select("*", F.posexplode(F.split("text", r"\n\s*\n")).alias("paragraph", "raw")).withColumn("exact_text", strip(F.col("raw"))).filter(F.length("exact_text") >= MIN_ATOM)
    split = split.withColumn("char_start", position(F.col("raw_text"), F.col("exact_text")))
    return split.select("document_id", "page_number", F.col("heading").alias("section_heading"), "exact_text", "char_start", _box(b["x0"], b["y0"], b["x1"], b["y1"]).alias("bbox"), F.lit("native_text").alias("extraction_method"), "block_no", "paragraph")


def card_atoms(pages: DataFrame) -> DataFrame:
    """Neighbouring blocks of which one is a short text with a digit."""
    one, two = strip(F.col("text")), strip(F.col("next_block.text"))
    short = lambda t: t.rlike("[0-9]") & (F.length(t) < CARD_CHARS)
    rows = blocks_with_headings(pages).filter(F.col("next_block").isNotNull() & (short(one) | short(two)) & (F.length(one) > 1) & (F.length(two) > 1))
    b, after = F.col("block"), F.col("next_block")
    start = F.nullif(F.instr("raw_text", one), F.lit(0)) - 1
    return rows.select(
        "document_id", "page_number", F.col("last_heading").alias("section_heading"), F.concat(one, F.lit("\n"), two).alias("exact_text"), start.alias("char_start"),
        _box(b["x0"], b["y0"], after["x1"], after["y1"]).alias("bbox"), F.lit("compound_card").alias("extraction_method"), "block_no",
    )


def atoms(pages: DataFrame) -> DataFrame:
    """All atoms of the pages, with span, content hash and an id derived from them."""
    parts = table_atoms(pages).withColumn("n", F.col("row_index")).unionByName(paragraph_atoms(pages).withColumn("n", F.col("block_no")), allowMissingColumns=True).unionByName(card_atoms(pages).withColumn("n", F.col("block_no")), allowMissingColumns=True)
    parts = parts.withColumn("char_end", F.col("char_start") + F.length("exact_text")).withColumn("source_hash", text_hash(F.col("exact_text")))
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("document_id", "page_number", "extraction_method", "table_index", "n", "paragraph", "source_hash")]
    return parts.withColumn("id", F.sha2(F.concat_ws("|", *key), 256)).drop("n")
