"""SimHash near-duplicates, found through vantage-point trees.

1. Every text gets a 64-bit fingerprint; only distinct fingerprints go on, each with
   its smallest doc_id, so that copies cost nothing further.
2. A vantage-point tree, fitted on a bounded sample, deals the fingerprints out to
   shards by Hamming distance.  A fingerprint also visits each shard whose region
   lies within the radius by the triangle inequality, so no link is lost at a border.
3. Each shard builds its own tree over its residents and asks it for all residents
   and visitors; branches that the triangle bounds exclude are pruned.  The links of
   a shard leave it as a spanning forest, never as all pairs of a group.
4. Components of the forests' edges, by alternating large-star and small-star steps
   on written tables.

Defined results: a text without words has fingerprint zero and links like any other;
ties and repeated rows share a fingerprint and so a component; a component whose ids
are all null has a null id; texts of any length are read whole; only doc_id and text
are read, other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SHARD_ROWS, SAMPLE_ROWS, LEAF_ROWS = 4096, 50_000, 96


def shingle_hashes(text: bytes | None, k: int, block: int = 1 << 16) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the k-word shingles, repeats included, in blocks."""
    words = text.lower().split() if text else []
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(k, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1]
    ends, h = ends[k - 1 :], xxhash.xxh64_intdigest
    for i in range(0, len(starts), block):
        yield np.array([h(joined[a:b], 42) for a, b in zip(starts[i : i + block].tolist(), ends[i : i + block].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes | None, k: int = 3) -> int:
    """Bit i is 1 if it is set in over half the shingles' hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, k):
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id and fp (64 bits as a signed long) of every row, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, k) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return cut(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long"), "simhash")


class Router:
    """The top of the vantage-point tree: which shards a fingerprint lives in and visits."""

    def __init__(self, sample: np.ndarray, leaves: int, radius: int, seed: int = 4):
        self.radius, self.nodes, rng = radius, [], np.random.default_rng(seed)
        self.shards = 0

        def grow(rows: np.ndarray, want: int) -> int:
            at = len(self.nodes)
            self.nodes.append(None)
            split = None
            if want > 1 and len(rows) > 1:
                trials = [(p, np.bitwise_count(rows ^ p)) for p in rng.choice(rows, min(8, len(rows)), replace=False)]
                vantage, d = max(trials, key=lambda x: float(x[1].std()))
                mu = int(np.median(d))
                mu -= int((d <= mu).all())
                if (d <= mu).any():
                    split = vantage, mu, grow(rows[d <= mu], want // 2), grow(rows[d > mu], want - want // 2)
            if split is None:
                split = (self.shards,)
                self.shards += 1
            self.nodes[at] = split
            return at

        grow(sample, leaves)

    def route(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, positions in fps, whether it is their home)."""
        todo = [(0, np.arange(len(fps)), np.ones(len(fps), bool))]
        while todo:
            at, rows, home = todo.pop()
            if not len(rows):
                continue
            if len(node := self.nodes[at]) == 1:
                yield node[0], rows, home
                continue
            vantage, mu, inside, outside = node
            d = np.bitwise_count(fps[rows] ^ vantage).astype(np.int64)
            a, b = d <= mu + self.radius, d > mu - self.radius
            todo += [(inside, rows[a], home[a] & (d[a] <= mu)), (outside, rows[b], home[b] & (d[b] > mu))]


def tree_pairs(points: np.ndarray, queries: np.ndarray, radius: int, seed: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in queries, positions in points) within the radius, from a vantage-point tree over points that all queries descend together."""
    rng = np.random.default_rng(seed)
    todo = [(np.arange(len(points)), np.arange(len(queries)))]
    while todo:
        p, q = todo.pop()
        if not len(p) or not len(q):
            continue
        if len(p) > LEAF_ROWS:
            vantage = points[rng.choice(p)]
            d, e = np.bitwise_count(points[p] ^ vantage).astype(np.int64), np.bitwise_count(queries[q] ^ vantage).astype(np.int64)
            mu = int(np.median(d))
            mu -= int((d <= mu).all())
            a, b = e <= mu + radius, e > mu - radius
            # where the bounds prune next to nothing, a split only costs; the block is then compared whole
            if (d <= mu).any() and a.sum() * (d <= mu).sum() + b.sum() * (d > mu).sum() < 0.9 * len(p) * len(q):
                todo += [(p[d <= mu], q[a]), (p[d > mu], q[b])]
                continue
        step = max(1, (1 << 20) // len(p))
        for i in range(0, len(q), step):
            x, y = np.nonzero(np.bitwise_count(queries[q[i : i + step], None] ^ points[None, p]) <= radius)
            if len(x):
                yield q[i : i + step][x], p[y]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest position that each of n positions reaches over the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def dealt(distinct: DataFrame, radius: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, fp, home) of distinct fingerprints, once for their home and once for each shard that they visit."""
    n = distinct.count()
    part = F.pmod(F.xxhash64(F.lit(9), F.col("fp")), F.lit(1 << 20)) < int(min(1.0, SAMPLE_ROWS / max(n, 1)) * (1 << 20))
    sample = np.sort(np.array([r.fp for r in distinct.filter(part).select("fp").collect()], np.int64)).view(np.uint64)
    router = Router(sample, max(1, n // shard_rows), radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.asarray(b.column(0), np.int64)
            for shard, rows, home in router.route(fps.view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), shard, np.int32)), pa.array(fps[rows]), pa.array(home)], names=["shard", "fp", "home"])

    return distinct.select("fp").mapInArrow(run, "shard int, fp long, home boolean")


def forest_edges(distinct: DataFrame, radius: int = 2, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (u, v) between fingerprints that hold together whatever links within the radius."""

    def shard(g: pd.DataFrame) -> pd.DataFrame:
        fps = g["fp"].to_numpy(np.int64)
        fps = fps[np.argsort(~g["home"].to_numpy(bool), kind="stable")]
        homes = int(g["home"].sum())
        u = fps.view(np.uint64)
        found = [(q[q != p], p[q != p]) for q, p in tree_pairs(u[:homes], u, radius)]
        if not found:
            return pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
        root = forest(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]), len(fps))
        on = root != np.arange(len(fps))
        return pd.DataFrame({"u": fps[on], "v": fps[root[on]]})

    return dealt(distinct, radius, shard_rows).groupBy("shard").applyInPandas(shard, "u long, v long")


def components(edges: DataFrame, tag: str = "components", most: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of edges (u, v) reaches."""

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    e = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), tag)
    before = state(e)
    for _ in range(most):
        if not before[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), tag)
        after = state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most} steps")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def near_copies(docs: DataFrame, radius: int = 2, k: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    prints = fingerprints(docs, k)
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(forest_edges(distinct, radius))
    joined = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    low = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    names = joined.join(low, "root").select("fp", "component_id")
    return prints.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
