"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on the driver from a bounded sample of labelled rows (MAX_TRAIN, in an
order fixed by a hash of doc_id) and flattened into arrays, which the executors traverse with
numpy for all rows and trees at once. Only the text is an input of a score.

Null texts count as empty; empty texts get the score of their statistics (all zero). A doc_id
with several labels trains once, with label 1 if at least half of them are 1. Rows with a null
doc_id or label never train but are scored. With fewer than two classes in the sample every
score is the share of label 1 (0.5 without any label). Repeated rows score alike.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.base import per_text, slices

MAX_TRAIN = 20_000  # labelled rows that a fit may use
THRESHOLD = 0.3
FEATURES = (
    "log_bytes", "upper", "lower", "digit", "space", "newline", "high", "stop", "comma", "mark", "symbol", "other", "entropy",
    "log_words", "word_chars", "longest", "distinct", "top_word", "capital", "all_caps", "marked", "line_words", "line_repeats", "same_next",
)
_CLASS = np.full(256, 10)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r", b"\n", bytes(range(128, 256)), b".", b",", b"!?", b"#$%&*|@~^+=<>[]{}\\")):
    _CLASS[list(_chars)] = _i


def statistics(text: str | None) -> list[float]:
    """The FEATURES of a whole text."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return [0.0] * len(FEATURES)
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = np.bincount(_CLASS, weights=counts, minlength=11) / n
    p = counts[counts > 0] / n
    words = text.split()
    w = len(words)
    lines = text.split("\n")
    out = [math.log1p(n), *share, float(-(p * np.log2(p)).sum()), math.log1p(w)]
    if not w:
        return out + [0.0] * (len(FEATURES) - len(out))
    seen = Counter(words)
    ends = sum(n for x, n in seen.items() if not x[-1].isalnum()) / w
    return out + [
        sum(map(len, words)) / w, math.log1p(max(map(len, words))), len(seen) / w, seen.most_common(1)[0][1] / w,
        sum(n for x, n in seen.items() if x[0].isupper()) / w, sum(n for x, n in seen.items() if x.isupper()) / w, ends,
        w / len(lines), 1 - len(set(lines)) / len(lines), sum(map(str.__eq__, words, words[1:])) / w,
    ]


@dataclass
class Trees:
    """Complete binary trees as arrays [tree, node]; node i has the children 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray  # of the last level's nodes
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        rows, raw = np.arange(len(x)), np.full(len(x), self.base)
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            raw += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss; histograms of gradients over quantile bins."""
    n, width = x.shape if len(x) else (0, len(FEATURES))
    mean = float(y.mean()) if n else 0.5
    if n == 0 or not 0 < mean < 1:
        none = np.zeros((0, 2**depth - 1))
        base = 30.0 if mean == 1 else -30.0 if mean == 0 else 0.0
        return Trees(base, none.astype(int), none, np.zeros((0, 2**depth)), depth)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1)
    flat = binned + np.arange(width) * bins
    base = math.log(mean / (1 - mean))
    raw = np.full(n, base)
    out_f, out_t, out_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, m = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (width * bins) + flat).ravel()
            gs, hs, cs = (np.bincount(cell, weights=np.repeat(v, width), minlength=m * width * bins).reshape(m, width, bins) for v in (g, h, np.ones(n)))
            gl, hl, cl = (v.cumsum(2) for v in (gs, hs, cs))
            gt, ht, ct = (v[:, :, -1:] for v in (gl, hl, cl))
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(cl < least) | (ct - cl < least)] = -np.inf
            best = gain.reshape(m, -1).argmax(1)
            for k in range(m):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9 and b < len(cuts[f]):
                    feature[first + k], threshold[first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - (2**depth - 1)
        gs, hs = (np.bincount(leaf, weights=v, minlength=2**depth) for v in (g, h))
        value = -rate * gs / (hs + ridge)
        raw += value[leaf]
        out_f.append(feature)
        out_t.append(threshold)
        out_v.append(value)
    return Trees(base, np.array(out_f), np.array(out_t), np.array(out_v), depth)


def held_out(key: str):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", max_train: int = MAX_TRAIN) -> Trees:
    chosen = (
        labels.select(key, "quality").where(F.col(key).isNotNull() & F.col("quality").isNotNull() & ~held_out(key))
        .groupBy(key).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
        .orderBy(F.xxhash64(key), key).limit(max_train)
    )
    texts = docs.select(key, "text").join(F.broadcast(chosen.select(key)), key, "left_semi")  # at most max_train keys
    found = per_text(texts, key, "x array<double>", lambda: lambda ts: [[statistics(t) for t in ts]])
    one = found.groupBy(key).agg(F.min("x").alias("x"))  # of several texts of a doc_id the least statistics, whatever the order of rows
    rows = one.join(F.broadcast(chosen), key).orderBy(key).select("x", "y").toPandas()
    return fit(np.array(rows["x"].tolist(), dtype=float), rows["y"].to_numpy(dtype=float))


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", max_train: int = MAX_TRAIN) -> DataFrame:
    """(key, held_out, score, predicted) of each row of docs."""
    trees = docs.sparkSession.sparkContext.broadcast(train(docs, labels, key, max_train))

    def make():
        model = trees.value
        return lambda texts: [model.predict(np.array([statistics(t) for t in texts]).reshape(-1, len(FEATURES)))]

    scored = per_text(docs, key, "score double", make)
    return scored.select(
        key, F.coalesce(held_out(key), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of docs, all columns, that the classifier doesn't reject."""
    trees = docs.sparkSession.sparkContext.broadcast(train(docs, labels, key, max_train))
    at = docs.columns.index("text")

    def keep(batches):
        import pyarrow as pa

        for b in (part for whole in batches for part in slices(whole, at)):
            x = np.array([statistics(t) for t in b.column(at).to_pylist()]).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(trees.value.predict(x) >= THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)
