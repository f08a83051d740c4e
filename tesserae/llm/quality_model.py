"""Quality scores by gradient-boosted trees on histograms of document statistics.

Statistics are of whole texts: a histogram of their bytes and a few measures of words and lines. Trees are grown level
by level from histograms of gradients over quantile bins, then laid out as complete binary trees in flat arrays, so a
batch is scored by taking all its rows down all trees at once. Only statistics of the text enter a score.

Training takes at most ``train_rows`` labelled rows, those of lowest hash (a documented bound); scoring covers all.

Defined cases: null and empty texts have statistics of 0 and get a score like any other; null labels are no labels;
repeated labels count once, as their largest, and of rows with one id the least text is learnt from; without labels, or
with one kind only, every score is their share (0.5 without any); repeated rows are scored each; an empty table gives
an empty result; other columns, whatever their names, are ignored; a text of any length is scored whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freed, short_batches, text_of

FEATURES = (
    "words", "mean_word", "distinct_words", "top_word", "repeats", "lines", "mean_line", "distinct_lines", "top_line",
    "upper", "lower", "digits", "space", "high", "bang", "pipe", "symbols", "stops", "commas", "brackets", "quotes", "word_length_spread",
)
TRAIN_ROWS = 20_000


def statistics(text: str) -> list[float]:
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
    n = max(1, int(raw.sum()))
    words, lines = text.split(), text.split("\n")
    w, n_lines = max(1, len(words)), max(1, len(lines))
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    counts, line_counts = Counter(words), Counter(lines)
    of = lambda chars: float(sum(raw[ord(c)] for c in chars))
    return [
        float(np.log1p(len(words))), float(lengths.mean()), len(counts) / w, max(counts.values(), default=0) / w, sum(map(eq, words, words[1:])) / w,
        float(np.log1p(len(lines))), n / n_lines, len(line_counts) / n_lines, max(line_counts.values()) / n_lines,
        float(raw[65:91].sum()) / n, float(raw[97:123].sum()) / n, float(raw[48:58].sum()) / n, float(raw[32] + raw[9:14].sum()) / n, float(raw[128:].sum()) / n,
        of("!") / w, of("|") / w, of("#*$%&<>") / w, of(".?") / w, of(",;:") / w, of("()[]{}") / w, of("\"'") / w, float(lengths.std()),
    ]


def statistics_of(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


@dataclass
class Trees:
    """Complete trees of one depth: feature and threshold of inner nodes, values of leaves, one row per tree."""

    base: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, leaf_l2: float = 2.0) -> Trees:
    """Logistic boosting with Newton steps; deterministic."""
    share = float(y.mean()) if len(y) else 0.5
    inner, leaves = 2**depth - 1, 2**depth
    if len(y) == 0 or share in (0.0, 1.0):
        base = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return Trees(base, depth, np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        f, t, node = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best, where = np.zeros(width), [(0, np.inf, bins)] * width
            for j in range(k):
                key = (node - first) * bins + binned[:, j]
                hg = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(axis=1)
                hh = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(axis=1)
                whole_g, whole_h = hg[:, -1:], hh[:, -1:]
                gain = hg**2 / (hh + leaf_l2) + (whole_g - hg) ** 2 / (whole_h - hh + leaf_l2) - whole_g**2 / (whole_h + leaf_l2)
                gain[:, len(edges[j]) :] = 0
                gain[(hh < 1) | (whole_h - hh < 1)] = 0
                at = gain.argmax(axis=1)
                for i in range(width):
                    if gain[i, at[i]] > best[i] + 1e-9:
                        best[i], where[i] = gain[i, at[i]], (j, float(edges[j][at[i]]), int(at[i]))
            right = np.zeros(n, dtype=bool)
            for i, (j, threshold, cut) in enumerate(where):
                f[first + i], t[first + i] = j, threshold
                mine = node == first + i
                right[mine] = binned[mine, j] > cut
            node = 2 * node + 1 + right
        leaf = node - inner
        v = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + leaf_l2)
        margin += v[leaf]
        features.append(f)
        thresholds.append(t)
        values.append(v)
    return Trees(base, depth, np.array(features), np.array(thresholds), np.array(values))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> Trees:
    """Fit on labelled rows that aren't held out, at most ``train_rows`` of them, chosen by hash of the id."""
    usable = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    chosen = F.broadcast(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows))

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            x = statistics_of(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_of("text").alias("text")).join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    got = rows.mapInArrow(stats, f"doc_id {kind}, y double, x array<double>").orderBy("doc_id", "x").collect()
    return fit(np.array([r["x"] for r in got], dtype=np.float64).reshape(-1, len(FEATURES)), np.array([r["y"] for r in got], dtype=np.float64))


def scores(docs: DataFrame, trees: Trees, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            s = shared.value.score(statistics_of(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", text_of("text").alias("text")).mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))
