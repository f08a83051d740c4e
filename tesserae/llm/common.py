"""What several operators share: words, one-time bindings inside expressions, and tables written to the shared folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the five ASCII controls from tab to carriage return.
SPACE = "\\x20\\x09-\\x0D"
SPACES = " \t\n\x0b\x0c\r"
WORD = f"[^{SPACE}]+"

_LIBC = ctypes.CDLL(None)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body`` (lambda variables are never inlined again)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """Words of a text, in order; an empty array for null, empty or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))


def boxed(docs: DataFrame, **made: Column) -> DataFrame:
    """docs' rows as the struct ``doc`` beside columns made of them, so that no name of docs can clash with those."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *[c.alias(name) for name, c in made.items()])


def unboxed(rows: DataFrame, names: list[str], **changed: Column) -> DataFrame:
    """The columns ``names`` of ``doc``, some of them changed."""
    return rows.select(*[changed[c].alias(c) if c in changed else F.col("doc")[c].alias(c) for c in names], *[v.alias(k) for k, v in changed.items() if k not in names])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session without the setting gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tesserae-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Paths that were made within open ``Passing`` blocks, innermost last.
_open: list[list[str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


class Passing:
    """All tables that operators write within a ``with`` block are deleted at its end, by when what they led to is written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> "Passing":
        _open.append([])
        return self

    def __exit__(self, *_: object) -> None:
        for path in _open.pop():
            drop_path(self.spark, path)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables of the shared folder that are deleted at the end of a ``with`` block, by when what they led to is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            drop_path(self.spark, path)

    def path(self, name: str) -> str:
        self.paths.append(fresh_path(self.spark, name))
        return self.paths[-1]

    def stash(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the tables that ``df``, which must read stashed tables only, comes from."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, path)


def trim() -> None:
    """Give memory that this worker has freed back to the system."""
    pa.default_memory_pool().release_unused()
    if (give := getattr(_LIBC, "malloc_trim", None)) is not None:
        give(0)


def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what one took goes back to the system before the next."""
    for batch in batches:
        yield batch
        trim()


def short_batches(spark: SparkSession) -> None:
    """Texts are long rows: unless the session sets other sizes, workers get 2,000 rows or 16 MB at a time instead of 10,000 or 64.

    The settings stay, as results are lazy and read them only when they run.
    """
    for key, usual, short in (("maxRecordsPerBatch", ("10000",), "2000"), ("maxBytesPerBatch", ("64MB", "67108864b", "67108864"), str(16 << 20))):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") in usual:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", short)


def broadcast_if_small(df: DataFrame, most_rows: int = 10_000) -> DataFrame:
    """Hint a broadcast only after counting: ``df`` must already be materialised and of short rows."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


#: Rows of one key that a task may hold, and keys that are broadcast at most.
HEAVY_ROWS, BROADCAST_KEYS = 20_000, 200_000


def looked_up(rows: DataFrame, table: DataFrame, key: str, weight: str, spread: Column) -> DataFrame:
    """rows left-joined with table(key, weight, ...) on ``key``, without ``weight``.

    ``table`` must be materialised, of short rows and one row a key; ``weight`` is the number of rows of that key. If
    it is small it is broadcast. Else only its heavy keys are, of which there can't be more than all rows divided by the
    least heavy weight; other keys' rows are shuffled, and rows that have met a heavy key go anywhere, by ``spread``.
    """
    n, total = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0))).first()
    others = [c for c in table.columns if c not in (key, weight)]
    if n <= BROADCAST_KEYS:
        return rows.join(F.broadcast(table.drop(weight)), key, "left").select(*rows.columns, *others)
    written = F.concat(F.lit("="), F.hex(key) if rows.schema[key].dataType.simpleString() == "binary" else F.col(key).cast("string"))
    is_heavy = F.col(weight) > max(HEAVY_ROWS, total // BROADCAST_KEYS)
    heavy = table.filter(is_heavy).select(key, F.struct(*others).alias("__heavy"))
    light = table.filter(~is_heavy).select(written.alias("__key"), F.struct(*others).alias("__light"))
    met = rows.join(F.broadcast(heavy), key, "left")
    elsewhere = F.concat(F.lit("elsewhere "), F.xxhash64(spread).cast("string"))
    met = met.withColumn("__at", F.when(F.col("__heavy").isNotNull() | F.col(key).isNull(), elsewhere).otherwise(written))
    both = met.join(light, F.col("__at") == F.col("__key"), "left")
    return both.select(*rows.columns, *[F.coalesce(F.col("__heavy")[c], F.col("__light")[c]).alias(c) for c in others])
