"""Prefix trie of rebuilt conversations: rolling fingerprints, verified groups, rollup along the branches.

1. A turn is its place, its length and the SHA-256 of role and text; no text is shuffled. Places come from one sort of all
   turns by conversation and turn into ranges, numbered range by range, so a conversation of any length is many tasks'
   work (``_running``: sums within batches in numpy, carried from batch to batch and, by a row a range, from range to range).
2. Conversations are rebuilt: at most ``HEADS`` turns of the first of their hundred, then their own others.
3. The same running sums, of digest times a power of a base modulo a prime, fingerprint every prefix. Entries of equal depth
   and fingerprint are a candidate group. Its members are held against the representative, the member of smallest id, in the
   aggregation: it counts them by turn and by the parent's fingerprint, and a group with two such variants is a collision.
   Where none lies on a conversation's way up, equal turns below equal parents make equal prefixes. Conversations that
   pass a collision get, from there on, a further fingerprint of another base, and are grouped and verified again.
4. A node belongs to its smallest member, so each conversation owns the lower end of its way. Sums over subtrees need no
   loop over depths: a conversation brings what its own nodes sum up to to every node that it passes further up, and a running
   sum over its own nodes gives what lies below each of them.

Defined cases: turns of one place (also null ones, which come first) are ordered by the digest of role and text; a repeated row is a
turn of its own; rows without a conv_id take no part; ``%`` takes the sign of the id; null and empty role or text are the same; an
empty table has no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, looked_up, stash
from .modular import PRIME, mix, mulmod, powers

HEADS, EVERY = 6, 100
_random = random.Random(20_250_611)
#: A base for each round of fingerprints; more are needed only if all before have collided.
BASES = [_random.randrange(1 << 40, PRIME) for _ in range(24)]
#: Ids whose digits are joined in one row before a node's are hashed: those that are equal but for so many bits.
CHUNK_BITS = 12
NODE = ["depth", "fp", "split"]
TURN = ["d0", "d1", "d2", "d3"]
MADE = ["run", "term", "part", "edge"]


def _sums(values: np.ndarray, first: np.ndarray, prime: int | None) -> np.ndarray:
    """Running sums of ``values`` since ``first``, a row number for each; modulo ``prime`` if there is one."""

    def since(x: np.ndarray) -> np.ndarray:
        run = np.cumsum(x)
        return run - (run[first] - x[first])

    if prime is None:
        return since(values)
    high, low = since(values >> np.uint64(32)), since(values & np.uint64((1 << 32) - 1))
    p = np.uint64(prime)
    return (mulmod(high % p, np.full(len(high), (1 << 32) % prime, dtype=np.uint64), prime) + low % p) % p


def _running(rows: DataFrame, key: str, order: list[Column], terms: Callable[[pa.RecordBatch], np.ndarray], prime: int | None, scratch: Scratch, name: str) -> DataFrame:
    """rows with ``term`` and ``run``, the sum of ``terms`` over the rows of the same ``key`` (a long) up to this one, in ``order``, which must leave no doubt."""
    names, fields = rows.columns, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last = TaskContext.get().partitionId(), None, None
        for batch in batches:
            n, keys = batch.num_rows, batch.column(key).to_numpy()
            if not n:
                continue
            begins = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
            lengths = np.diff(np.concatenate([begins, [n]]))
            values = terms(batch)
            run = _sums(values, np.repeat(begins, lengths), prime).astype(np.int64)
            if last and last[0] == keys[0]:
                run[: lengths[0]] = _plus(run[: lengths[0]], last[1], prime)
            if first is None or first[0] == keys[0]:
                first = (int(keys[0]), int(run[lengths[0] - 1]))
            last = (int(keys[-1]), int(run[-1]))
            made = [pa.array(run), pa.array(values.astype(np.int64)), pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.zeros(n, dtype=np.int8))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*names, *MADE])
        if first:
            columns = [pa.array([first[0], last[0]]) if c == key else pa.nulls(2, kind) for c, kind in zip(batch.schema.names, batch.schema.types, strict=True)]
            ends = [pa.array([first[1], last[1]]), pa.nulls(2, pa.int64()), pa.array([part, part], pa.int32()), pa.array([1, 2], pa.int8())]
            yield pa.RecordBatch.from_arrays([*columns, *ends], [*names, *MADE])

    done = scratch.stash(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(scan, f"{fields}, run long, term long, part int, edge byte"), name)
    open_key, total, brought = None, 0, []
    for r in done.filter("edge > 0").select("part", "edge", F.col(key).alias("key"), "run").orderBy("part", "edge").collect():  # two rows a range
        if r["edge"] == 1:
            own, before = r, total if open_key == r["key"] else 0
            if before:
                brought.append((r["part"], r["key"], before))
        else:
            alone = own["key"] == r["key"]
            open_key, total = r["key"], int(_plus(np.array([r["run"]]), before, prime)[0]) if alone else r["run"]
    out = done.filter("edge = 0").drop("edge")
    if not brought:
        return out.drop("part")
    before = F.broadcast(out.sparkSession.createDataFrame(brought, "at_part int, at_key long, before long"))
    summed = F.col("run") + F.coalesce("before", F.lit(0))
    if prime:
        summed = summed - F.when(summed >= prime, prime).otherwise(0)
    return out.join(before, (F.col("part") == F.col("at_part")) & (F.col(key) == F.col("at_key")), "left").withColumn("run", summed).select(*rows.columns, "run", "term")


def _plus(run: np.ndarray, more: int, prime: int | None) -> np.ndarray:
    return run + more if prime is None else (run.astype(np.uint64) + np.uint64(more)).astype(np.int64) % prime


def _ones(batch: pa.RecordBatch) -> np.ndarray:
    return np.ones(batch.num_rows, dtype=np.int64)


def _turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, place (from 0), the digest's four parts and the length of the text, for every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256)
    # Fifteen hexadecimal digits a part, as a long has a sign: 240 bits of the digest.
    parts = [F.conv(F.substring(digest, 15 * i + 1, 15), 16, 10).cast("long") for i in range(4)]
    known = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.length(text).cast("long").alias("chars"), *[p.alias(d) for p, d in zip(parts, TURN, strict=True)])
    # Rows that are alike in all this may be of any number: the last column lets a range end between them.
    known = known.withColumn("row", F.monotonically_increasing_id())
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), *[F.col(d).asc() for d in TURN], F.col("row").asc()]
    return _running(known, "conv_id", order, _ones, None, scratch, "trie-turns").select("conv_id", (F.col("run") - 1).alias("place"), "chars", *TURN)


def _rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """conv_id, depth, chars, digest, is_last: the root (depth 0) and the turns of every rebuilt conversation; conversations with their lengths."""
    lengths = scratch.stash(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")), "trie-lengths")
    donor = F.col("conv_id") - F.col("conv_id") % EVERY
    heads_of = lengths.select(F.col("conv_id").alias("donor"), F.col("own").alias("given")).filter(f"donor % {EVERY} = 0")
    least = F.least(F.col("h"), F.coalesce("given", F.lit(0)))
    shape = lengths.withColumn("donor", donor).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % HEADS).join(heads_of, "donor", "left")
    shape = shape.select("conv_id", "own", "donor", "h", least.alias("k"), (least + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    shape = scratch.stash(shape, "trie-shapes")
    own = looked_up(turns, shape.select("conv_id", "own", "h", "k", "length"), "conv_id", "own", F.xxhash64("conv_id", "place")).filter("place >= h")
    own = own.withColumn("depth", F.col("k") + F.col("place") - F.col("h") + 1)
    heads = turns.filter(F.col("conv_id") % EVERY == 0).filter(F.col("place") < HEADS - 1).withColumnRenamed("conv_id", "donor")
    given = shape.filter("k > 0").join(heads, "donor").filter("place < k").withColumn("depth", F.col("place") + 1)
    columns = ["conv_id", "depth", "chars", *TURN, (F.col("depth") == F.col("length")).alias("is_last")]
    roots = shape.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), *[F.lit(0).cast("long").alias(d) for d in TURN], (F.col("length") == 0).alias("is_last"))
    return own.select(*columns).unionByName(given.select(*columns)).unionByName(roots), shape


def _fingerprinted(rows: DataFrame, base: int, prime: int, scratch: Scratch) -> DataFrame:
    """rows(conv_id, depth, d0, ...) with ``run``, the fingerprint of the prefix up to there, and ``above``, that of its parent."""

    def terms(batch: pa.RecordBatch) -> np.ndarray:
        depth = batch.column("depth").to_numpy()
        turn = mix(batch.column(TURN[0]).to_numpy().astype(np.uint64) ^ np.uint64(base)) % np.uint64(prime)
        return np.where(depth == 0, np.uint64(0), mulmod(turn, powers(base, depth, prime), prime))

    done = _running(rows, "conv_id", [F.col("conv_id").asc(), F.col("depth").asc()], terms, prime, scratch, "trie-prints")
    above = F.col("run") - F.col("term")
    return done.withColumn("above", above + F.when(above < 0, prime).otherwise(0)).drop("term")


def _grouped(rows: DataFrame, prime: int, bases: list[int], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Entries (conv_id, depth, fp, split, up_fp, up_split, ...) and nodes of one variant each, with their smallest members."""
    printed = _fingerprinted(rows, bases[0], prime, scratch).withColumnsRenamed({"run": "fp", "above": "up_fp"})
    entries = printed.withColumns({"split": F.lit(""), "up_split": F.lit("")})
    for base in bases[1:]:
        variants = entries.groupBy(*NODE, "up_fp", "up_split", *TURN).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"), F.count_if("is_last").alias("ends"))
        variants = scratch.stash(variants, "trie-variants")
        collided = scratch.stash(variants.groupBy(*NODE).agg(F.count(F.lit(1)).alias("variants")).filter("variants > 1").select(*NODE), "trie-collided")
        if collided.isEmpty():
            return entries, variants.select(*NODE, "up_fp", "up_split", "conv_id", "n_convs", "chars", "ends")
        passed = entries.join(broadcast_if_small(collided), NODE).groupBy("conv_id").agg(F.min("depth").alias("since"))
        passed = scratch.stash(passed, "trie-passed")
        kept = entries.columns
        again = _fingerprinted(entries, base, prime, scratch).join(broadcast_if_small(passed), "conv_id", "left")
        also = lambda split, fp, depth: F.when(depth >= F.col("since"), F.concat_ws(".", F.col(split), F.col(fp).cast("string"))).otherwise(F.col(split))
        split, up_split = also("split", "run", F.col("depth")), also("up_split", "above", F.col("depth") - 1)
        entries = scratch.stash(again.withColumns({"split": split, "up_split": up_split}).select(*kept), "trie-entries")
    raise RuntimeError(f"fingerprints collide under all of {len(bases)} bases")


def _digests(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """The SHA-256 of the joined ids of ends(conv_id, node) for each node, read as a stream of short strings in order."""
    chunks = ends.groupBy(*NODE, F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    chunks = scratch.stash(chunks, "trie-chunks")
    counted = chunks.groupBy(*NODE).agg(F.count(F.lit(1)).alias("chunks"), F.min("ids").alias("ids"))
    short = counted.filter("chunks = 1").select(*NODE, F.sha2("ids", 256).alias("ends_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_node, state = None, None
        make = lambda: pa.RecordBatch.from_pylist([dict(zip(NODE, open_node, strict=True)) | {"ends_sha256": state.hexdigest()}])
        for batch in batches:
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if node == open_node:
                    state.update(b"," + ids.encode())
                    continue
                if open_node:
                    yield make()
                open_node, state = node, hashlib.sha256(ids.encode())
        if open_node:
            yield make()

    many = chunks.join(counted.filter("chunks > 1").select(*NODE), NODE).repartition(*NODE).sortWithinPartitions(*NODE, "chunk")
    long = many.mapInArrow(run, "depth long, fp long, split string, ends_sha256 string")
    return short.unionByName(long)


def trie(conversations: DataFrame, prime: int = PRIME, bases: list[int] | None = None) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for every node of conversations(conv_id, turn, role, text)."""
    with Scratch(conversations.sparkSession) as scratch:
        turns = _turns(conversations, scratch)
        rows, shape = _rebuilt(turns, scratch)
        entries, nodes = _grouped(rows, prime, bases or BASES, scratch)
        nodes = nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars"))
        nodes = _running(nodes, "conv_id", [F.col("conv_id").asc(), F.col("depth").asc()], lambda b: b.column("saved").to_numpy(), None, scratch, "trie-sums")
        owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("since"), F.max("run").alias("brings"), F.count_if(F.col("ends") == F.col("n_convs")).alias("leaf"), F.count(F.lit(1)).alias("owns"))
        owned = scratch.stash(owned, "trie-owned")
        about = shape.select("conv_id", "length").join(owned, "conv_id", "left").withColumn("entries", F.col("length") + 1)
        about = scratch.stash(about.select("conv_id", "entries", "length", "since", F.coalesce("brings", F.lit(0)).alias("brings"), F.coalesce("leaf", F.lit(0)).alias("leaf")), "trie-about")
        met = looked_up(entries.select("conv_id", *NODE, "up_fp", "up_split"), about, "conv_id", "entries", F.xxhash64("conv_id", "depth"))
        owns = lambda depth: F.coalesce(F.col("since") <= depth, F.lit(False))
        sums = met.groupBy(*NODE).agg(
            F.count_if(owns(F.col("depth") + 1) & (F.col("depth") < F.col("length"))).alias("n_children"),
            F.sum("leaf").alias("n_leaves"),
            F.sum(F.when(owns(F.col("depth")), 0).otherwise(F.col("brings"))).alias("brought"),
        )
        sums = scratch.stash(sums, "trie-rollup")
        digests = scratch.stash(_digests(entries.filter("is_last").select("conv_id", *NODE), scratch), "trie-digests")
        below = looked_up(nodes, owned.select("conv_id", "brings", "owns"), "conv_id", "owns", F.xxhash64("conv_id", "depth")).withColumn("below", F.col("brings") - F.col("run") + F.col("saved"))
        written = lambda depth, fp, split: F.concat_ws(":", depth.cast("string"), F.col(fp).cast("string"), F.col(split))
        whole = below.join(sums, NODE).join(digests, NODE, "left").withColumn("up", F.when(F.col("depth") > 0, written(F.col("depth") - 1, "up_fp", "up_split")))
        whole = stash(whole.select("conv_id", "up", *NODE, "n_convs", "n_children", "n_leaves", (F.col("brought") + F.col("below")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")), "trie-nodes")
        parents = whole.filter("n_children > 0").select(written(F.col("depth"), "fp", "split").alias("up"), F.col("conv_id").alias("parent_conv_id"), "n_children")
        parents = stash(parents, "trie-parents")
    out = looked_up(whole, parents.withColumnRenamed("n_children", "weight"), "up", "weight", F.xxhash64("conv_id", "depth"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
