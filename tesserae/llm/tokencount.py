"""Token counts by a two-tier lookup on the map side; no text's pre-tokens ever cross a shuffle.

A byte-level BPE merges within pre-tokens only, and every change from a non-space to a space starts a new one. So a
text is the chain of its pieces, split before single spaces, and its count is the sum over pieces. The first tier is
a broadcast table of the lengths of the corpus's frequent pieces; misses are encoded by the library itself, a batch
at a time, into a cache that lives as long as the worker and is emptied when full. Pieces that could join their
neighbour (empty, or ending in white space) send their text to the library whole, so every count is the library's.

The frequent pieces come from one pass in which every task keeps a bounded summary (its rarest are dropped when it
grows too large) and only the summaries' heads are summed. The more tasks, the shorter a head, so that all heads
together are at most ``HEADS`` rows, or ``LEAST_HEAD`` a task, whatever the corpus. The table affects speed, never counts.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows are counted each; an empty table gives an
empty result; other columns, whatever their names, are ignored; a text of any length is counted whole.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, short_batches, text_of

HEAD_PER_TASK, LEAST_HEAD, HEADS = 1024, 8, 1 << 20
FREQUENT = 32_768
SUMMARY = 100_000
CACHE = 250_000
SLICE = 64

_workers: dict[str, "PieceLengths"] = {}


class PieceLengths(dict):
    """Piece -> tokens; -1 marks a piece that can't stand alone. A key that is not the text's first carries its space."""

    def __init__(self, path: str, frequent: dict[str, int]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.frequent = Tokenizer.from_file(path), frequent
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        super().__init__(frequent)

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def learn(self, pieces: set[str]) -> None:
        good = [p for p in pieces if p and not p[-1].isspace() and p[-1] > " "]
        for p, e in zip(good, self.tokenizer.encode_batch_fast([" " + p for p in good], add_special_tokens=False), strict=True):
            self[p] = len(e.ids)
        for p in pieces.difference(good):
            self[p] = -(1 << 40)

    def count(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for i in range(0, len(texts), SLICE):
            split = [t.split(" ") for t in texts[i : i + SLICE]]
            missing = {p for parts in split for p in parts[1:] if p not in self}
            if len(self) + len(missing) > CACHE + len(self.frequent):
                self.clear()
                self.update(self.frequent)
                missing = {p for parts in split for p in parts[1:] if p not in self}
            if missing:
                self.learn(missing)
            for parts, text in zip(split, texts[i : i + SLICE], strict=True):
                n = sum(map(self.__getitem__, parts[1:]))
                first = parts[0]
                if n < 0 or first and (first[-1].isspace() or first[-1] <= " "):
                    out.append(self.whole(text))
                else:
                    out.append(n + (self.whole(first) if first else 0))
        return out


def frequent_pieces(docs: DataFrame, text: str = "text") -> list[str]:
    """Heads of the tasks' summaries, summed: at most FREQUENT pieces come to the driver."""
    tasks = max(1, docs.select(text).rdd.getNumPartitions())  # of the plan, nothing is run
    longest = max(LEAST_HEAD, min(HEAD_PER_TASK, HEADS // tasks))

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in freed(batches):
            for t in batch.column("text").to_pylist():
                seen.update(t.split(" ")[1:])
                if len(seen) > SUMMARY:
                    seen = Counter(dict(seen.most_common(SUMMARY // 4)))
        head = [(p, n) for p, n in seen.most_common(longest) if len(p) <= 64]
        yield pa.RecordBatch.from_pydict({"piece": pa.array([p for p, _ in head], pa.string()), "n": pa.array([n for _, n in head], pa.int64())})

    heads = docs.select(text_of(text).alias("text")).mapInArrow(summary, "piece string, n long")
    top = heads.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(FREQUENT)
    return [r["piece"] for r in top.select("piece").collect()]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    short_batches(spark)
    table = PieceLengths(tokenizer_path, {})
    table.learn(set(frequent_pieces(docs, text)))
    lengths = spark.sparkContext.broadcast({p: n for p, n in table.items() if n >= 0})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _workers.get(tokenizer_path)
        if worker is None:
            _workers[tokenizer_path] = worker = PieceLengths(tokenizer_path, lengths.value)
        for batch in freed(batches):
            tokens = pa.array(worker.count(batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), tokens], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_of(text).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
