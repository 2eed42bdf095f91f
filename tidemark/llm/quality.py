"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every text are made once, by numpy over whole Arrow batches, and
written as a narrow table.  The trees are grown on the driver from a bounded sample
of labelled rows outside the held-out fold (TRAIN_ROWS, a documented bound of about
10 MB), flattened into arrays of equal length, and every row is scored by a
vectorised walk down all trees.

Defined results: null and empty texts have all-zero statistics and get a score; a
null doc_id is held out; labels that repeat a doc_id are averaged; without a label
of each class the score is the mean label (0.5 if there is none); repeated rows get
equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out

TRAIN_ROWS, CUTOFF = 60_000, 0.3

CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,;:", "loud": b"!?", "bar": b"|", "sign": b"#*$%&<>=~^@_+", "quote": b"\"'`()[]{}/\\-",
    "newline": b"\n", "lead": bytes(range(0xC0, 256)), "odd": bytes([*range(0, 9), *range(14, 32), 127]),
}
NAMES = ["chars", "words", "word_len", *CLASSES, "line_words", "distinct_words", "distinct_lines", "long_words", "capital_words", "shout_words", "top_share"]


def _class_table() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for i, members in enumerate(CLASSES.values(), 1):
        t[list(members)] = i
    return t


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """One row of NAMES for each text."""
    table, out = _class_table(), np.zeros((len(texts), len(NAMES)), np.float32)
    k = len(CLASSES)
    for i, t in enumerate(texts):
        words = t.split() if t else []
        if not words:
            continue
        n, lens = len(words), np.fromiter(map(len, words), np.int32, len(words))
        chars = max(1, int(lens.sum()))
        counts = np.bincount(table[np.frombuffer(t, np.uint8)], minlength=k + 1)[1:]
        lines = [x for x in t.split(b"\n") if x.strip()]
        seen: dict[bytes, int] = {}
        for w in words:
            seen[w] = seen.get(w, 0) + 1
        caps = sum(w[:1].isupper() for w in words)
        shout = sum(w.isupper() for w in words)
        out[i] = [np.log1p(len(t)), np.log1p(n), chars / n, *(counts / chars), n / len(lines), len(seen) / n, len(set(lines)) / len(lines), (lens > 20).mean(), caps / n, shout / n, max(seen.values()) / n]
    return out


class Trees:
    """Gradient-boosted trees of fixed depth on binned columns; node arrays of all trees have one shape."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 20):
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = rounds, depth, rate, bins, l2, least
        self.base, self.edges = 0.0, []
        self.feature = self.threshold = self.leaf = None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, d = x.shape
        p = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        inner = 2**self.depth - 1
        f, t, leaf = [], [], []
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)] if n else [np.zeros(1)] * d
        rounds = self.rounds if n and 0 < y.sum() < n else 0
        codes = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1).astype(np.int64) if rounds else None
        score = np.full(n, self.base)
        for _ in range(rounds):
            pr = 1 / (1 + np.exp(-score))
            g, h = pr - y, pr * (1 - pr)
            node = np.zeros(n, np.int64)
            feat, thr = np.zeros(inner, np.int32), np.full(inner, np.inf, np.float32)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-6)
                choice = np.full((width, 2), -1)
                for j in range(d):
                    cell = (node - first) * self.bins + codes[:, j]
                    hist = [np.bincount(cell, w, width * self.bins).reshape(width, self.bins).cumsum(1) for w in (g, h, np.ones(n))]
                    gl, hl, nl = (a[:, :-1] for a in hist)
                    gt, ht, nt = (a[:, -1:] for a in hist)
                    gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                    gain[(nl < self.least) | (nt - nl < self.least)] = 0
                    gain = gain[:, : len(self.edges[j])]
                    k = gain.argmax(1)
                    top = gain[np.arange(width), k]
                    better = top > best
                    best[better], choice[better] = top[better], np.stack([np.full(width, j), k], 1)[better]
                for w in range(width):
                    if choice[w, 0] >= 0:
                        feat[first + w], thr[first + w] = choice[w, 0], self.edges[choice[w, 0]][choice[w, 1]]
                node = 2 * node + 1 + (x[np.arange(n), feat[node]] > thr[node])
            last = node - inner
            gs, hs = np.bincount(last, g, 2**self.depth), np.bincount(last, h, 2**self.depth)
            value = -self.rate * gs / (hs + self.l2)
            score += value[last]
            f.append(feat), t.append(thr), leaf.append(value)
        shape = (len(f), inner)
        self.feature, self.threshold = np.array(f, np.int32).reshape(shape), np.array(t, np.float32).reshape(shape)
        self.leaf = np.array(leaf, np.float64).reshape(len(f), 2**self.depth)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows, inner = np.full(len(x), self.base), np.arange(len(x)), 2**self.depth - 1
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the array of statistics of every row, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = statistics(b.column(2).cast(pa.binary()).to_pylist())
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, s.size + 1, s.shape[1], dtype=np.int32)), pa.array(s.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat], names=["doc_id", "held_out", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return cut(rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, x array<float>"), "quality-statistics")


def train(stats: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Trees:
    """Trees from about `most` labelled rows outside the held-out fold, chosen by a hash of the id."""
    known = labels.filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    n = known.count()
    part = F.pmod(F.xxhash64(F.lit(3), F.col("doc_id")), F.lit(1 << 20)) < int(min(1.0, most / max(n, 1)) * (1 << 20))
    # an id that stands on several rows gives one of them, so the bound holds for rows too
    one = stats.filter(~F.col("held_out")).join(known.filter(part), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.first("y").alias("y"))
    rows = one.select("doc_id", "x", "y").toArrow()
    x = np.asarray(rows["x"].combine_chunks().flatten()).reshape(-1, len(NAMES)) if len(rows) else np.zeros((0, len(NAMES)), np.float32)
    order = np.lexsort((*x.T, np.asarray(rows["doc_id"])))
    return Trees().fit(x[order], np.round(np.asarray(rows["y"], np.float64)[order]))


def classify(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    stats = measured(docs)
    trees = train(stats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(2).flatten()).reshape(-1, len(NAMES))
            s = np.round(trees.score(x), 6)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= cutoff).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stats.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
