"""Quality classifier (operator 6): histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed once, in numpy over Arrow batches, and staged as narrow
rows. The trees are fitted on at most about ``TRAIN_ROWS`` labelled rows (a hash sample, the only
bound), with features binned to ``BINS`` quantile bins and level-wise histograms of gradients. Trees
are complete and flattened into arrays (feature, threshold, leaf value); scoring walks all rows of a
batch down one level at a time.

Cases: null text counts as empty and is scored as any other. Several labels of one document count as
0 if any is 0; null labels teach nothing. With no labels the score is 0.5; with labels of one class
it is the smoothed share of label 1. Repeated rows score alike. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

TRAIN_ROWS, BINS, ROUNDS, DEPTH, RATE, L2, MIN_LEAF = 50_000, 64, 80, 4, 0.15, 1.0, 8
FEATURES = ["log_words", "log_chars", "chars_per_word", "long_words", "distinct_share", "top_word_share", "repeat_pair_share", "log_lines",
            "words_per_line", "dup_line_share", "short_line_share", "upper_share", "digit_share", "symbol_share", "bar_share", "stop_share",
            "other_punct_share", "non_ascii_share", "space_share", "upper_word_share", "byte_entropy"]


def statistics(text: bytes) -> list[float]:
    """The features of one text."""
    ws = text.split()
    n, size = len(ws), len(text)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if size else np.zeros(256, np.int64)
    full = max(1, size)
    group = lambda chars: float(count[list(chars)].sum()) / full
    seen = Counter(ws)
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = count[count > 0] / full
    lens = np.fromiter(map(len, ws), np.int64, n)
    k, m = max(1, n), max(1, len(lines))
    return [
        math.log1p(n), math.log1p(size), float(lens.mean()) if n else 0.0, float((lens > 15).sum()) / k, len(seen) / k,
        (max(seen.values()) if seen else 0) / k, 1 - len(set(zip(ws, ws[1:], strict=False))) / max(1, n - 1) if n > 1 else 0.0,
        math.log1p(len(lines)), n / m, 1 - len(set(lines)) / m if lines else 0.0, sum(len(x) < 20 for x in lines) / m,
        group(range(65, 91)), group(range(48, 58)), group(b"#*$%&<>"), group(b"|"), group(b"."), group(b"!?,;:\"'()-"),
        float(count[128:].sum()) / full, group(b" \t\n\r\x0b\x0c"), sum(w.isupper() for w in ws) / k,
        float(-(share * np.log2(share)).sum())]


def _features(batches):
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        rows = [statistics(t or b"") for lo in range(0, batch.num_rows, 256) for t in texts.slice(lo, 256).to_pylist()]
        table = np.array(rows, np.float64).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, table.T)], names=["doc_id", *FEATURES])


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")) \
        .mapInArrow(_features, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


@dataclass
class Trees:
    """Flattened complete trees: per tree 2^depth - 1 inner nodes and 2^depth leaves."""

    start: float
    feature: np.ndarray    # (trees, inner) int
    threshold: np.ndarray  # (trees, inner) float; values above go right
    leaf: np.ndarray       # (trees, leaves) float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - inner]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH) -> Trees:
    """Newton boosting of the logistic loss with level-wise histograms."""
    inner, leaves = 2 ** depth - 1, 2 ** depth
    prior = (y.sum() + 1) / (len(y) + 2)
    trees = Trees(math.log(prior / (1 - prior)), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if len(np.unique(y)) < 2:
        return trees
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # bin b: value <= edges[b]
    margin = np.full(n, trees.start)
    feature, threshold, leaf = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        f, t, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, k = 2 ** level - 1, 2 ** level
            local = at - first
            gain, best_f, best_b = np.full(k, 1e-6), np.zeros(k, np.int64), np.full(k, -1)
            for j in range(d):
                key, cells = local * BINS + binned[:, j], k * BINS
                g, h, c = (np.bincount(key, w, cells).reshape(k, BINS).cumsum(axis=1) for w in (grad, hess, None))
                gt, ht, ct = g[:, -1:], h[:, -1:], c[:, -1:]
                new = g ** 2 / (h + L2) + (gt - g) ** 2 / (ht - h + L2) - gt ** 2 / (ht + L2)
                new[(c < MIN_LEAF) | (ct - c < MIN_LEAF)] = -np.inf
                b = new.argmax(axis=1)
                top = new[np.arange(k), b]
                better = top > gain
                gain[better], best_f[better], best_b[better] = top[better], j, b[better]
            for i in np.flatnonzero(best_b >= 0):
                f[first + i], t[first + i] = best_f[i], edges[best_f[i]][best_b[i]]
            go = (x[np.arange(n), f[at]] > t[at]).astype(np.int64)
            at = 2 * at + 1 + go
        g, h = np.bincount(at - inner, grad, leaves), np.bincount(at - inner, hess, leaves)
        value = -RATE * g / (h + L2)
        margin += value[at - inner]
        feature.append(f)
        threshold.append(t)
        leaf.append(value)
    return Trees(trees.start, np.array(feature), np.array(threshold), np.array(leaf))


def train(stats: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> Trees:
    """Fit on (doc_id, quality) labels. Only the hash sample of at most about ``max_rows`` rows
    reaches the driver, whatever the number of labels."""
    truth = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = truth.count()
    share = min(1.0, max_rows / max(1, rows))
    h = F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 20))
    picked = stats.join(truth.filter(h < int(share * (1 << 20))), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()
    if picked.empty:
        return Trees(0.0, np.zeros((0, 2 ** DEPTH - 1), np.int64), np.zeros((0, 2 ** DEPTH - 1)), np.zeros((0, 2 ** DEPTH)))
    return fit_trees(picked[FEATURES].to_numpy(np.float64), picked["quality"].to_numpy(np.float64))


def score(stats: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, score) of staged statistics. The trees have a fixed size and travel with the task."""
    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(f).to_numpy() for f in FEATURES], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(trees.score(x))], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def staged_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return materialize(document_statistics(docs, doc_id, text))
