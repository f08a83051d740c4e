"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing is a DataFrame plan. Payload digests are grouped; of equal payloads the one with the largest id becomes the
response and the others revisit it. Only groups of two or more are looked up by the pages, without a shuffle of payloads
while these groups are few; beyond that, payloads that very many pages share are broadcast still. Records go through
Spark's text sink with CRLF CRLF between them, so any file system that Spark writes to will do.

Archives are written without compression, so that Spark cuts each into splits. Reading splits them further at
"CRLF CRLF WARC/1.1 CRLF". A piece so found need not be a record: payloads may contain that very sequence. Each task
gives, for every piece, its offset and the offset at which its declared length says that its successor starts, with the
chain inside the task's own split already followed to its exit. Pointer jumping over the splits' entries from each
file's start then finds which pieces are reachable: these are records, the others are parts of the record before them.
Records whose payload was cut into pieces are put together again in a second pass, for those records alone.

Defined cases: a null payload counts as empty; a null url is written empty; a null id stays null; repeated rows are
written each (those with the largest id are all responses); an empty table gives an empty result; a payload of any
length is one record, written and put together in one row; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, let, looked_up, stash, text_of

# Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SEPARATOR = len(END) + len(MAGIC)
#: Integers of a piece: where its content starts in the split, its length, where its successor's content would start
#: (-1: none), where its chain leaves the split.
SCAN = "file string, block long, place long, size long, next long, exit long, complete boolean, page string, kind string, payload_bytes long, digest string, refers string, split_bytes long"


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of 40 hex digits: five digits at a time are four letters."""

    def letters(i: int) -> list[Column]:
        number = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        return [F.substring(F.lit(BASE32), F.shiftright(number, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1)) for k in range(4)]

    return F.concat(*[x for i in range(8) for x in letters(i)])


def revisits(pages: DataFrame, least_bytes: int, scratch: Scratch) -> DataFrame:
    """pages(page_id, url, html, digest) with ``refers``: the id of the equal payload that holds it, null if itself."""
    long_enough = F.octet_length("html") >= least_bytes
    groups = pages.filter(long_enough).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n"))
    shared = scratch.stash(groups.filter("n > 1"), "warc-shared")
    joined = looked_up(pages, shared, "digest", "n", F.struct("page_id", "url"))
    other = F.coalesce(long_enough & ~F.col("page_id").eqNullSafe(F.col("holder")) & F.col("holder").isNotNull(), F.lit(False))
    return joined.select("page_id", "url", "html", "digest", F.when(other, F.col("holder")).alias("refers"))


def records(rows: DataFrame) -> DataFrame:
    """One column, ``value``: the record without the line ends behind it."""
    revisit = F.col("refers").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    held = rows.select(
        revisit.alias("revisit"), name("page_id").alias("id"), name("refers").alias("refers"), block.alias("block"),
        F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", "").alias("url"), let(F.col("digest"), base32_of_hex).alias("digest"),
    )
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    return held.select(
        F.concat(
            F.lit(MAGIC),
            line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
            line("WARC-Record-ID", F.col("id")),
            line("WARC-Date", F.lit(DATE)),
            line("WARC-Target-URI", F.col("url")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", F.col("refers")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
            line("Content-Type", F.lit("application/http; msgtype=response")),
            line("Content-Length", F.octet_length("block").cast("string")),
            F.lit("\r\n"),
            F.col("block"),
        ).alias("value")
    )


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, compression: str = "none", records_per_file: int = 100_000) -> None:
    """Write pages(page_id, url, html) as archives under ``path``."""
    rows = pages.select("page_id", F.col("url").cast("string"), text_of("html").alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    with Scratch(pages.sparkSession) as scratch:
        out = records(revisits(rows, least_bytes, scratch))
        out.write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", records_per_file).text(path)


_LENGTH = re.compile(rb"^content-length:[ \t]*([0-9]+)[ \t]*$", re.I | re.M)
_FIELD = {
    "kind": re.compile(rb"^warc-type:[ \t]*(\S+)", re.I | re.M),
    "page": re.compile(rb"^warc-record-id:[ \t]*<urn:page:(-?[0-9]*)>", re.I | re.M),
    "digest": re.compile(rb"^warc-payload-digest:[ \t]*sha1:(\S+)", re.I | re.M),
    "refers": re.compile(rb"^warc-refers-to:[ \t]*<urn:page:(-?[0-9]*)>", re.I | re.M),
}


def payload_of(block: bytes, kind: str, declared: str | None) -> tuple[int, str | None]:
    """Bytes and digest of the full payload in an HTTP block: a revisit's come from its headers."""
    http, _, payload = block.partition(b"\r\n\r\n")
    if kind == "revisit":
        found = _LENGTH.search(http.replace(b"\r\n", b"\n"))
        return int(found[1]) if found else 0, declared
    return len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(piece: bytes) -> tuple[int, int, dict[str, str | None]] | None:
    """Length of the header with the blank line, declared length of the block, fields; None if this is no record."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    head = piece[:end].replace(b"\r\n", b"\n")
    length = _LENGTH.search(head)
    if not length:
        return None
    return end + 4, int(length[1]), {k: (m[1].decode("ascii", "replace") if (m := p.search(head)) else None) for k, p in _FIELD.items()}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    magic = MAGIC.encode()
    current: tuple[str, int] | None = None
    rows: list[list] = []
    place = 0

    def flush() -> Iterator[pa.RecordBatch]:
        exits: dict[int, int] = {}
        for r in reversed(rows):
            exits[r[2]] = r[5] = exits.get(r[4], r[4])
            r[12] = place
        for i in range(0, len(rows), 20_000):
            names = [x.split()[0] for x in SCAN.split(", ")]
            types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
            columns = zip(*rows[i : i + 20_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, types[x.split()[1]]) for c, x in zip(columns, SCAN.split(", "), strict=True)], names)

    for batch in batches:
        for file, block, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")), strict=True):
            if (file, block) != current:
                yield from flush()
                current, rows, place = (file, block), [], 0
            skip = len(magic) if block == 0 and not rows and value.startswith(magic) else 0
            head = _header(value[skip:])
            if head is None:
                rows.append([file, block, place, len(value), -1, -1, False, None, None, None, None, None, 0])
            else:
                header, length, field = head
                body = skip + header
                complete = len(value) >= body + length
                n, digest = payload_of(value[body : body + length], field["kind"] or "", field["digest"]) if complete else (None, None)
                after = place + body + length + SEPARATOR
                rows.append([file, block, place, len(value), after, after, complete, field["page"], field["kind"], n, digest, field["refers"], 0])
            place += len(value) + SEPARATOR
    yield from flush()


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", END + MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _walk(key: tuple, rows):  # noqa: ANN001, ANN202
    """Rows of one split on the chain from its entry; the others belong to the record before them."""
    import pandas as pd

    rows = rows.sort_values("at", kind="stable")
    expected, owner, reached, owners = rows["entry"].iloc[0], -1, [], []
    for at, after in zip(rows["at"].tolist(), rows["after"].tolist(), strict=True):
        hit = at == expected
        if hit:
            owner, expected = at, after
        reached.append(hit)
        owners.append(owner)
    return pd.DataFrame({"file": rows["file"], "block": rows["block"], "at": rows["at"], "reached": reached, "owner": owners})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to for every record reachable from its file's start."""
    with Scratch(spark) as scratch:
        scan = scratch.stash(_pieces(spark, path).mapInArrow(_scan, SCAN), "warc-scan")
        ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        splits = scan.groupBy("file", "block").agg(F.max("split_bytes").alias("bytes"))
        splits = splits.withColumn("base", F.coalesce(F.sum("bytes").over(ahead), F.lit(0))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("file")))
        splits = scratch.stash(splits.drop("bytes"), "warc-splits")
        few = broadcast_if_small(splits, 100_000)
        placed = scan.join(few, ["file", "block"]).withColumn("at", F.col("base") + F.col("place"))
        placed = placed.withColumn("after", F.when(F.col("next") >= 0, F.col("base") + F.col("next"))).withColumn("leaves", F.when(F.col("exit") >= 0, F.col("base") + F.col("exit")))
        most = splits.agg(F.max("n")).first()[0] or 1
        rows = placed.join(_entries(placed, most, scratch), ["file", "block"], "left").withColumn("entry", F.coalesce("entry", F.lit(-1)))
        walked = rows.select("file", "block", "at", F.coalesce("after", F.lit(-1)).alias("after"), "entry").groupBy("file", "block").applyInPandas(_walk, "file string, block long, at long, reached boolean, owner long")
        found = scratch.stash(placed.select("file", "block", "at", "complete", "after", "page", "kind", "payload_bytes", "digest", "refers").join(walked, ["file", "block", "at"]), "warc-found")
        result = found.filter("reached and complete").select("page", "kind", "payload_bytes", "digest", "refers")
        cut = found.filter("reached and not complete and after is not null").select("file", F.col("at").alias("owner"))
        if not cut.isEmpty():
            result = result.unionByName(_mended(spark, path, few, found, cut, scratch))
        number = lambda c: F.when(F.col(c) != "", F.col(c)).cast("long")
        return stash(result.select(number("page").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), number("refers").alias("refers_to")), "warc-records")


def _entries(placed: DataFrame, most_splits: int, scratch: Scratch) -> DataFrame:
    """(file, block, entry): the piece at which the chain from the file's start enters each split, by pointer jumping.

    Nodes are the files' starts and the pieces that some chain, right or wrong, jumps to from another split. After k
    rounds pointers go 2**k splits further and all nodes up to 2**k - 1 jumps from a start are reached.
    """
    targets = placed.select("file", F.col("leaves").alias("at")).filter("at is not null")
    starts = placed.filter("at = 0").select("file", "at").distinct()
    nodes = targets.unionByName(starts).distinct()
    jump = scratch.stash(placed.join(nodes, ["file", "at"], "left_semi").select("file", "at", "leaves", "block"), "warc-jump")
    home, reached = jump.select("file", "at", "block"), jump.filter("at = 0").select("file", "at")
    pointers = jump.select("file", "at", "leaves").filter("leaves is not null")
    for _ in range(math.ceil(math.log2(most_splits))):
        step = reached.join(pointers, ["file", "at"]).select("file", F.col("leaves").alias("at"))
        reached = scratch.stash(reached.unionByName(step.join(home, ["file", "at"], "left_semi")).distinct(), "warc-reached")
        onward = pointers.select("file", F.col("at").alias("leaves"), F.col("leaves").alias("then"))
        pointers = scratch.stash(pointers.join(onward, ["file", "leaves"]).select("file", "at", F.col("then").alias("leaves")), "warc-pointers")
    return reached.join(home, ["file", "at"]).groupBy("file", "block").agg(F.min("at").alias("entry"))


def _mended(spark: SparkSession, path: str, splits: DataFrame, found: DataFrame, cut: DataFrame, scratch: Scratch) -> DataFrame:
    """Records whose payload holds the separator: their pieces are read again and put together.

    A piece belongs to the record before it, in its own split or, ahead of the first record there, in an earlier one.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = found.groupBy("file", "block").agg(F.max("owner").alias("last")).select("file", "block", F.max("last").over(before).alias("carried"))
    owned = found.select("file", "block", "at", "owner").join(broadcast_if_small(scratch.stash(last, "warc-last"), 100_000), ["file", "block"])
    owned = owned.select("file", "at", F.when(F.col("owner") >= 0, F.col("owner")).otherwise(F.col("carried")).alias("owner"))
    inside = scratch.stash(owned.join(cut, ["file", "owner"], "left_semi"), "warc-inside")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, place = None, 0
        for batch in batches:
            out = []
            for file, block, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")), strict=True):
                if (file, block) != current:
                    current, place = (file, block), 0
                out.append(place)
                place += len(value) + SEPARATOR
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], ["file", "block", "value", "place"])

    pieces = _pieces(spark, path).mapInArrow(places, "file string, block long, value binary, place long").join(splits.select("file", "block", "base"), ["file", "block"])
    pieces = pieces.select("file", (F.col("base") + F.col("place")).alias("at"), "value").join(broadcast_if_small(inside, 100_000), ["file", "at"])

    def mend(key: tuple, rows):  # noqa: ANN001, ANN202
        import pandas as pd

        rows = rows.sort_values("at")
        value = (END + MAGIC).encode().join(rows["value"].tolist())
        skip = len(MAGIC) if rows["at"].iloc[0] == 0 and value.startswith(MAGIC.encode()) else 0
        header, length, field = _header(value[skip:])
        n, digest = payload_of(value[skip + header : skip + header + length], field["kind"] or "", field["digest"])
        return pd.DataFrame({"page": [field["page"]], "kind": [field["kind"]], "payload_bytes": [n], "digest": [digest], "refers": [field["refers"]]})

    return pieces.groupBy("file", "owner").applyInPandas(mend, "page string, kind string, payload_bytes long, digest string, refers string")


def round_trip(pages: DataFrame, least_bytes: int = 0, compression: str = "none") -> DataFrame:
    """Write ``pages`` as archives into the shared folder, read them back and delete them."""
    with Scratch(pages.sparkSession) as scratch:
        path = scratch.path("warc")
        write_archives(pages, path, least_bytes, compression)
        return read_archives(pages.sparkSession, path)
