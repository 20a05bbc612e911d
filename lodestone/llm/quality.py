"""Document quality by gradient-boosted trees over histograms of document statistics, in numpy."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, in_fold, labelled, one_each, read_table, sample_by_hash
from lodestone.llm.simhash import word_blocks

#: Labelled rows that training uses at most, chosen by a hash of the id. Scoring has no bound.
SAMPLE = 8000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_ROWS = 80, 4, 64, 0.15, 2.0, 10
THRESHOLD = 0.3

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:",
    "shout": b"!?",
    "bars": b"|\\/<>{}[]_=~^",
    "marks": b"#$%&*+@",
    "quotes": b"\"'`()-",
    "space": b" \t",
    "line": b"\n\r",
}
_MASKS = np.array([[b in chars for b in range(256)] for chars in _CLASSES.values()], dtype=np.float64)
FEATURES = (
    "log_bytes", *(f"share_{c}" for c in _CLASSES), "share_beyond_ascii", "entropy", "log_words", "word_bytes", "short_words",
    "long_words", "distinct_words", "top_word", "same_as_before", "log_lines", "line_bytes", "repeated_lines", "ended_words", "capital_words",
)


def statistics(text: bytes | None) -> list[float]:
    """The features of one whole text, in the order of FEATURES; all are finite for any text."""
    text = text or b""
    counts = np.zeros(256)
    for start in range(0, len(text), 1 << 20):
        counts += np.bincount(np.frombuffer(text[start : start + (1 << 20)], np.uint8), minlength=256)
    size = max(1, len(text))
    shares = counts / size
    seen = shares[shares > 0]
    words, repeats, total, letters, short, long_, ended, capital = Counter(), 0, 0, 0, 0, 0, 0, 0
    for block in word_blocks(text):
        words.update(block)
        repeats += sum(map(eq, block[1:], block))
        total += len(block)
        lengths = np.fromiter(map(len, block), np.int64, len(block))
        letters += int(lengths.sum())
        short += int((lengths <= 3).sum())
        long_ += int((lengths >= 15).sum())
        ended += sum(w[-1] in b".,;:" for w in block)
        capital += sum(65 <= w[0] <= 90 for w in block)
    n = max(1, total)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return [
        math.log1p(len(text)), *(_MASKS @ shares), float(shares[128:].sum()), float(-(seen * np.log2(seen)).sum()), math.log1p(total), letters / n, short / n,
        long_ / n, len(words) / n, (words.most_common(1)[0][1] if words else 0) / n, repeats / n, math.log1p(len(lines)), len(text) / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)), ended / n, capital / n,
    ]


@dataclass
class Forest:
    """Complete trees of DEPTH levels, flattened: node k of a tree has the children 2k + 1 and 2k + 2.

    feature, threshold: (trees, inner nodes); value: (trees, leaves). A row goes right if its
    feature is above the threshold.
    """

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1; all trees of all rows go down one level at a time."""
        trees = np.arange(len(self.feature))[None, :]
        rows = np.arange(len(x))[:, None]
        at = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        leaf = self.value[trees, at - (2**DEPTH - 1)] if len(self.feature) else np.zeros((len(x), 0))
        return 1 / (1 + np.exp(-(self.base + leaf.sum(axis=1))))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """Logistic boosting; a level's splits all come from one histogram of gradients."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    share = min(0.99, max(0.01, float(y.mean()))) if len(y) else 0.5
    base = math.log(share / (1 - share))
    empty = Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not 0 < y.sum() < len(y):
        return empty
    width = x.shape[1]
    edges = np.quantile(x, np.arange(1, BINS) / BINS, axis=0)
    binned = np.stack([np.searchsorted(edges[:, f], x[:, f], side="left") for f in range(width)], axis=1)
    flat = binned + BINS * np.arange(width)
    z = np.full(len(y), base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            count = 2**level
            cell = (node[:, None] * width * BINS + flat).ravel()
            hist = [np.bincount(cell, np.repeat(w, width), count * width * BINS).reshape(count, width, BINS) for w in (g, h, np.ones(len(y)))]
            left = [a.cumsum(axis=2)[:, :, :-1] for a in hist]
            whole = [a.sum(axis=2, keepdims=True) for a in hist]
            gain = left[0] ** 2 / (left[1] + RIDGE) + (whole[0] - left[0]) ** 2 / (whole[1] - left[1] + RIDGE) - whole[0] ** 2 / (whole[1] + RIDGE)
            gain[(left[2] < LEAST_ROWS) | (whole[2] - left[2] < LEAST_ROWS)] = -1
            best = gain.reshape(count, -1).argmax(axis=1)
            split = gain.reshape(count, -1).max(axis=1) > 1e-6
            f, b = best // (BINS - 1), best % (BINS - 1)
            at = count - 1 + np.arange(count)
            feature[at], threshold[at] = f, np.where(split, edges[b, f], np.inf)
            node = 2 * node + (x[np.arange(len(y)), f[node]] > threshold[count - 1 + node])
        value = -RATE * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + RIDGE)
        z += value[node]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(base, np.stack(features), np.stack(thresholds), np.stack(values))


def _vectors(column: pa.Array) -> np.ndarray:
    rows = [statistics(t) for t in column.to_pylist()]
    return np.array(rows, dtype=np.float64).reshape(len(rows), len(FEATURES))


def _examples(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(_vectors(batch.column(2)).tolist(), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Forest:
    """Train on documents outside the fold crc32(doc_id) mod 5 = 0.

    Without labelled rows of both classes the forest is empty and scores the share of label 1. Of
    rows that repeat an id one is learned from.
    """
    known = labelled(labels.where(~in_fold("doc_id", 5, 0)), "quality")
    chosen = Scratch(spark).save(sample_by_hash(known, "doc_id", sample, "quality"), "chosen")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    found = sorted(one_each(rows.select("doc_id", "y", "text"), "doc_id").mapInArrow(_examples, "doc_id long, y int, x array<double>").collect())
    x = np.array([r["x"] for r in found]).reshape(len(found), len(FEATURES))
    return train(x, np.array([r["y"] for r in found], dtype=np.float64))


def score(spark: SparkSession, docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Null texts score as empty ones; repeated ids get a row each; a null id is never held out; other
    columns are ignored.
    """
    sent = spark.sparkContext.broadcast(forest)

    def run(batches):
        for batch in batches:
            scores = np.concatenate([sent.value.score(_vectors(batch.column(1).slice(k, 512))) for k in range(0, batch.num_rows, 512)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(spark, docs, fit(spark, docs, read_table(spark, sf_dir, "labels")))
