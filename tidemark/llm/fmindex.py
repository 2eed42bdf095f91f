"""Substring dedup with a compressed FM-index per shard.

Whatever two documents share lies in both with the same anchors: the anchor of a
window of WINDOW words is its smallest GRAM-word hash, so equal windows have equal
anchors.  That routes text to shards without any all-against-all streaming:

1. Every document names its anchors; those named by one document only are dropped
   (their windows cannot repeat elsewhere).  Anchors that repeat within a batch are
   known on the spot; the rest travel once, packed, to be compared across batches.
2. Texts with shared anchors move once, to buckets of their ids.  Runs of windows with a
   shared anchor go to the anchor's shard as segments, equal segments once with their
   smallest doc_id; a task writes a segment's words once, however many documents hold it.
   Anchors of more than HOT_DOCUMENTS documents are dealt by whole windows instead, so
   that no shard gathers them.
3. A shard builds an FM-index of its segments (suffix array, BWT, wavelet tree with
   bit-packed levels and rank blocks) and streams the segments through it: backward
   search, all positions at once, gives the matching statistics up to WINDOW words.
   Intervals that reach WINDOW yield the smallest doc_id of their occurrences, reported
   as runs of windows with one owner.
4. A document loses the words of each window whose smallest doc_id is below its own; its
   runs come to the buckets, so its text does not move again.

Defined results: null and short texts lose nothing; rows with the same doc_id never
remove from each other; a null id counts as larger than all others; texts of any
length are read whole; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, new_path, remove_path

WINDOW, GRAM, HOT_DOCUMENTS, SHARD_WORDS, PART_BYTES = 13, 6, 2000, 1_500_000, 50_000_000
#: Files of a table at most, for each PART_BYTES of text.
PART_FILES = 4
#: Segments that a task remembers to have written.
WRITTEN = 500_000
#: Rows without an id stand from here on, above all ids.
NO_ID = 1 << 62


def anchors(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The anchor (a signed hash) of each window of the words."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    g = np.zeros(len(words) - gram + 1, np.uint64)
    for k in range(gram):
        g = (g ^ h[k : k + len(g)]) * np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(32)
    low, span, width = g, window - gram + 1, 1
    while 2 * width <= span:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    return low.view(np.int64)[:n]


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _parts(docs: DataFrame) -> int:
    """PART_BYTES of text that docs have, 8 at least."""
    return max(8, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))


def measured(docs: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """id, row (a hash of the text), doc_id, n_words and whole_sha256 of every row; and (id, anchor) of the anchors that several ids name.

    An anchor that two ids of a batch name is marked there, and only its smallest and
    largest id travel on; so a very common anchor costs its part two rows a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = lambda n: pa.nulls(n, pa.int64())
        names = ["id", "row", "doc_id", "n_words", "sha", "part", "anchors", "ids"]
        lists = pa.list_(pa.int64())
        for b in batches:
            n, sha, found, owner = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            ids = np.asarray(b.column(0), np.int64)
            for k, t in enumerate(b.column(3).cast(pa.binary()).to_pylist()):
                w = t.split() if t else []
                u = np.unique(anchors(w))
                n.append(len(w)), sha.append(_sha(w)), found.append(u), owner.append(np.full(len(u), ids[k]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(sha), none(len(n)), pa.nulls(len(n), lists), pa.nulls(len(n), lists)], names=names)
            a, o = np.concatenate(found), np.concatenate(owner)
            shared, first, last = _compared(a, o)
            order = np.lexsort((o, a))
            a, o, shared = a[order], o[order], shared[order]
            send = ~shared | first | last
            part = (a.view(np.uint64) % np.uint64(parts)).astype(np.int64)
            out = [(-1, a[shared], o[shared])] + [(int(p), a[send & (part == p)], o[send & (part == p)]) for p in np.unique(part)]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x[1]) for x in out])]).astype(np.int32))
            cols = [pa.array([x[0] for x in out], pa.int64()), *[pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[i] for x in out]))) for i in (1, 2)]]
            yield pa.RecordBatch.from_arrays([none(len(out)), none(len(out)), pa.nulls(len(out), b.column(2).type), none(len(out)), pa.nulls(len(out), pa.string()), *cols], names=names)

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        a, o = (np.concatenate([np.asarray(x, np.int64) for x in g[c]]) for c in ("anchors", "ids"))
        shared, _, _ = _compared(a, o)
        order = np.lexsort((o, a))
        return pd.DataFrame({"id": o[order][shared[order]], "anchor": a[order][shared[order]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(*_keys(), "doc_id", "text")
    both = cut(rows.mapInArrow(run, f"id long, row long, doc_id {kind}, n_words long, sha string, part long, anchors array<long>, ids array<long>"), "fm-anchors")
    here = both.filter("part = -1").select(F.explode(F.arrays_zip("ids", "anchors")).alias("x")).select(F.col("x.ids").alias("id"), F.col("x.anchors").alias("anchor"))
    across = both.filter("part >= 0").select("part", "anchors", "ids").groupBy("part").applyInPandas(meet, "id long, anchor long")
    found, marks = cut(both.filter("part is null").select("id", "row", "doc_id", "n_words", "sha"), "fm-found"), cut(here.union(across), "fm-marks")
    discard(both)
    return found, marks


def _compared(a: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether several ids name the anchor, in the given order; and in (anchor, id) order, whether a row is its anchor's first or last."""
    order = np.lexsort((ids, a))
    x, o = a[order], ids[order]
    first = np.ones(len(x), bool)
    first[1:] = x[1:] != x[:-1]
    last = np.append(first[1:], np.ones(min(1, len(x)), bool))
    group = np.cumsum(first) - 1
    differ = o[last] != o[first]
    shared = np.zeros(len(x), bool)
    shared[order] = differ[group]
    return shared, first, last


def _keys() -> list:
    t = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.shiftrightunsigned(t, 2)).alias("id"), t.alias("row")]


class Wavelet:
    """A wavelet matrix over small integers: a bit-packed level for each bit, with the count of ones before each 64-bit word."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.n, self.bits = len(symbols), max(1, int(alphabet - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        s = symbols.astype(np.uint32)
        for k in reversed(range(self.bits)):
            bit = (s >> np.uint32(k)) & np.uint32(1)
            packed = np.packbits(np.concatenate([bit.astype(np.uint8), np.zeros(64 - len(bit) % 64, np.uint8)]), bitorder="little").view("<u8")
            ones = np.bitwise_count(packed).astype(np.uint32)
            self.words.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint32))
            self.zeros.append(int(self.n - bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][w].astype(np.int64) + np.bitwise_count(self.words[level][w] & mask)

    def rank(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often c stands before lo and before hi."""
        start, lo, hi = np.zeros_like(lo), lo.copy(), hi.copy()
        for level in range(self.bits):
            one = ((c >> (self.bits - 1 - level)) & 1).astype(bool)
            for x in (start, lo, hi):
                r = self._ones(level, x)
                x[:] = np.where(one, self.zeros[level] + r, x - r)
        return lo - start, hi - start


class FMIndex:
    """Of a text of integers from 1 up, with 0 after each segment, the last too; suffixes are told apart by their first `order` symbols."""

    def __init__(self, text: np.ndarray, order: int = WINDOW):
        n = len(text)
        rank, width = text.astype(np.int64), 1
        while width < order:
            after = np.concatenate([rank[width:], np.zeros(min(width, n), np.int64)])
            _, rank = np.unique(rank * (int(rank.max()) + 1) + after if n else rank, return_inverse=True)
            width *= 2
        self.sa = np.argsort(rank, kind="stable")
        self.alphabet = int(text.max()) + 1 if n else 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.alphabet))]).astype(np.int64)
        # column of symbols before each suffix, in suffix order; suffixes equal up to `order` symbols keep text order,
        # which is all that searches of at most `order` symbols rely on
        self.tree = Wavelet(text[self.sa - 1] if n else text, self.alphabet)

    def matching(self, text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each start, how much of text[start : start + length] was matched backwards, up to `length`, with its interval; searches stop where only one occurrence is left."""
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.sa), np.int64)
        got, alive = np.zeros(len(starts), np.int64), np.arange(len(starts))
        for k in reversed(range(length)):
            c = text[starts[alive] + k].astype(np.int64)
            a, b = self.tree.rank(c, lo[alive], hi[alive])
            lo[alive], hi[alive] = self.first[c] + a, self.first[c] + b
            got[alive] += 1
            alive = alive[b - a > 1]
        return got, lo, hi


def smallest_owner(segments: list[bytes], owners: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each segment of words, and each of its windows, the smallest owner among the segments that hold the window."""
    words = [s.split(b" ") for s in segments]
    ids: dict[bytes, int] = {}
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((ids.setdefault(x, len(ids) + 1) for w in words for x in (*w, None) if x is not None), np.int64, int(lengths.sum()))
    text = np.zeros(int(lengths.sum()) + len(words), np.int64)
    owner_of = np.repeat(np.arange(len(words)), lengths + 1)
    first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
    text[np.arange(len(flat)) + np.repeat(np.arange(len(words)), lengths)] = flat
    n_windows = np.maximum(lengths - window + 1, 0)
    starts = np.repeat(first, n_windows) + np.arange(int(n_windows.sum())) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    out = owners[np.repeat(np.arange(len(words)), n_windows)].astype(np.int64)
    if len(starts):
        index = FMIndex(text, window)
        got, lo, hi = index.matching(text, starts, window)
        full = np.nonzero((got == window) & (hi - lo > 1))[0]
        if len(full):
            own = owners[owner_of[index.sa]]
            u, back = np.unique(lo[full], return_inverse=True)
            end = np.zeros(len(u), np.int64)
            end[back] = hi[full]
            cuts = np.stack([u, end], 1).ravel()
            low = np.minimum.reduceat(np.concatenate([own, [(1 << 63) - 1]]), cuts)[::2]
            out[full] = np.minimum(out[full], low[back])
    return np.split(out, np.cumsum(n_windows)[:-1])


def _segments(cand: DataFrame) -> DataFrame:
    """(key, seg, id, row, start, segment) of the runs of windows with a shared anchor; hot anchors give one segment a window.

    seg is the segment's hash; segment, its words, is null where the task has written them before.
    """
    kinds = {"key": pa.int64(), "seg": pa.int64(), "id": pa.int64(), "row": pa.int64(), "start": pa.int32(), "segment": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written: set[int] = set()
        for b in batches:
            key, seg, size, start, segment = [], [], [], [], []
            for t, shared, hot in zip(*(b.column(k).to_pylist() for k in ("words", "shared", "hot")), strict=True):
                w = t.split(b" ")
                a = anchors(w)
                ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
                edges = np.append(0, np.nonzero(np.diff(a))[0] + 1)
                named, hot_set, n = a[edges], {x for x, y in zip(shared, hot, strict=True) if y}, len(key)
                on = np.isin(named, np.array(shared, np.int64))
                for i, j, k in zip(edges[on].tolist(), np.append(edges[1:], len(a))[on].tolist(), named[on].tolist(), strict=True):
                    for first, last in ((x, x + 1) for x in range(i, j)) if k in hot_set else ((i, j),):
                        x = t[int(ends[first - 1]) if first else 0 : int(ends[last + WINDOW - 2]) - 1]
                        h = xxhash.xxh64_intdigest(x)
                        key.append(h if k in hot_set else k), seg.append(h), start.append(first), segment.append(None if h in written else x)
                        if len(written) >= WRITTEN:
                            written.clear()
                        written.add(h)
                size.append(len(key) - n)
            ids, rows = (np.repeat(np.asarray(b.column(k), np.int64), size) for k in ("id", "row"))
            whole = lambda x: np.array([v & (1 << 64) - 1 for v in x], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for k, c in zip(kinds, (whole(key), whole(seg), ids, rows, start, segment), strict=True)], names=list(kinds))

    return cand.select("id", "row", "words", "shared", "hot").mapInArrow(run, "key long, seg long, id long, row long, start int, segment binary")


def _candidates(docs: DataFrame, marks: DataFrame, name: str, path: str, parts: int) -> DataFrame:
    """The rows with shared anchors: id, row, their words joined by one space, shared and hot; a table in buckets of their ids."""
    spark = docs.sparkSession
    hot = marks.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_DOCUMENTS).select("anchor", F.lit(True).alias("hot"))
    lists = marks.join(hot, "anchor", "left").groupBy("id").agg(F.collect_set(F.struct("anchor", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("x"))
    lists = lists.select("id", F.col("x.anchor").alias("shared"), F.col("x.hot").alias("hot"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([b" ".join(t.split()) for t in b.column(2).cast(pa.binary()).to_pylist()], pa.binary())], names=["id", "row", "words"])

    text = docs.select(*_keys(), "text").filter(F.col("text").isNotNull()).mapInArrow(joined, "id long, row long, words binary")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a row that repeats an id and a text stands once; such rows lose the same
    rows = text.join(lists, "id").dropDuplicates(["id", "row"])
    rows.coalesce(PART_FILES * parts).write.bucketBy(buckets, "id").option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def removals(cand: DataFrame, parts: int) -> DataFrame:
    """(id, row, runs) of the rows of cand that lose words: runs of windows (start, n) to remove."""
    segs = cut(_segments(cand), "fm-segments")
    distinct = segs.groupBy("key", "seg").agg(F.min("id").alias("owner"), F.max("id").alias("last"), F.first("segment", ignorenulls=True).alias("segment"))
    words = segs.agg(F.sum(F.length("segment"))).first()[0] or 0
    shards = max(1, -(-words // (7 * SHARD_WORDS)))

    def shard(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["key", "seg"], kind="stable")
        own, several = g["owner"].to_numpy(np.int64), (g["last"] > g["owner"]).to_numpy(bool)
        found = smallest_owner(list(g["segment"]), own)
        n = np.array([len(x) for x in found], np.int64)
        at, owner = np.repeat(np.arange(len(n)), n), np.concatenate([*found, np.zeros(0, np.int64)])
        first = np.ones(len(at), bool)
        first[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
        begins = np.nonzero(first)[0]
        runs = np.diff(np.append(begins, len(at)))
        # windows that only one id holds remove nothing
        on = several[at[begins]] | (owner[begins] < own[at[begins]])
        begins, runs = begins[on], runs[on]
        at = at[begins]
        return pd.DataFrame({"key": g["key"].to_numpy()[at], "seg": g["seg"].to_numpy()[at], "owner": owner[begins], "at": (begins - (np.cumsum(n) - n)[at]).astype(np.int32), "n": runs.astype(np.int32)})

    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    owned = cut(dealt.groupBy("shard").applyInPandas(shard, "key long, seg long, owner long, at int, n int"), "fm-owned")
    member = segs.select("key", "seg", "id", "row", "start").join(owned, ["key", "seg"]).filter(F.col("owner") < F.least("id", F.lit(NO_ID)))
    gone = cut(member.groupBy("id", "row").agg(F.collect_list(F.struct((F.col("start") + F.col("at")).alias("start"), "n")).alias("runs")), "fm-runs", PART_FILES * parts)
    discard(segs, owned)
    return gone


def _changed(cand: DataFrame, gone: DataFrame, parts: int) -> DataFrame:
    """(id, row, n_removed, kept) of the rows that lose words; cand stays in its buckets, and rows that share an id find their own runs by their text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, removed, sha = [], [], []
            for k, (row, t, of) in enumerate(zip(*(b.column(c).to_pylist() for c in ("row", "words", "of")), strict=True)):
                for r in of:
                    if r["row"] != row:
                        continue
                    w = t.split(b" ")
                    step = np.zeros(len(w) + 1, np.int64)
                    s, n = (np.array([x[c] for x in r["runs"]], np.int64) for c in ("start", "n"))
                    np.add.at(step, s, 1)
                    np.add.at(step, s + n + WINDOW - 1, -1)
                    keep = np.cumsum(step[:-1]) == 0
                    at.append(k), removed.append(int((~keep).sum())), sha.append(_sha([w[i] for i in np.nonzero(keep)[0].tolist()]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), b.column(1).take(pa.array(at, pa.int64())), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["id", "row", "n_removed", "kept"])

    by_id = gone.groupBy("id").agg(F.collect_list(F.struct("row", "runs")).alias("of"))
    return cut(cand.select("id", "row", "words").join(by_id, "id").select("id", "row", "words", "of").mapInArrow(run, "id long, row long, n_removed long, kept string"), "fm-changed", PART_FILES * parts)


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    parts = _parts(docs)
    found, marks = measured(docs, parts)
    name, path = f"tidemark_{uuid.uuid4().hex}", new_path(spark, "fm-candidates")
    cand = _candidates(docs, marks, name, path, parts)
    discard(marks)
    gone = removals(cand, parts)
    changed = _changed(cand, gone, parts)
    spark.sql(f"DROP TABLE {name}")
    remove_path(spark, path)
    discard(gone)
    out = found.select("id", "row", "doc_id", "n_words", "sha").join(changed, ["id", "row"], "left").coalesce(PART_FILES * parts)
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"))
