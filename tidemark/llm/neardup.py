"""Near-duplicate removal on top of the SimHash vantage-point shards: five-word shingles, similarity 0.8 or more.

Texts with the same shingle set form a class; only classes are compared, and all
candidates are checked by the exact Jaccard similarity of their shingle sets.

1. A class has a fingerprint, an odd sketch and a prefix.  The odd sketch is a bitmap of
   about a bit a shingle that holds the parity of the shingles at each place, so two
   sketches differ in no more bits than the sets in shingles: a pair whose sketches
   differ in more than the similarity allows can be left out, and loses nothing.
2. Vantage-point shards of the fingerprints, within a band of set sizes and the next, find
   the pairs at most RADIUS bits apart.  A shard never emits pairs: it names the classes
   that have a candidate, then gets their shingle sets, checks candidates in place, and
   its links leave it as a spanning forest.  A pair whose classes are linked already is
   not checked again, so a large group of copies costs about one check a member.
3. Similar pairs beyond the radius are found by an exact prefix join: in any one order of
   all shingles, two sets as similar as wanted share one of their first
   n - ceil(similarity * n) + 1 shingles.  Shingles frequent in a sample come last in that
   order.  A shingle that only one group's prefixes hold makes no pairs, nor does one that
   leaves too few after its place in either set.

So no link is lost, whatever RADIUS is.  At 14 bits the triangle bounds prune little:
within a band the search compares blocks of all classes.  A lower RADIUS costs less
there and leaves more to the prefix join.

Defined results: the row with the smallest id of a group stays, one if several have
it; texts without words are one group; a null id counts as a number from a hash of the
text, above the ids that are known.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, free_name
from .simhash import Router, components, tree_pairs

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 14
SHARD_ROWS, SAMPLE_ROWS = 8192, 50_000
#: A task that checks a shard gets so many residents and queries, or so many shingles of each, and compares so many queries at once.
SLICE_ROWS, SLICE_SHINGLES, QUERY_ROWS = 2048, 2_000_000, 512
#: Ids that are broadcast at most (some 100 MB); with more, texts are joined to them by a shuffle.
BROADCAST_IDS = 4_000_000
#: The order of shingles: texts in the sample, texts in it that make a shingle frequent, frequent shingles at most.
ORDER_ROWS, FREQUENT, FREQUENT_SHINGLES = 20_000, 2, 400_000
#: Prefix shingles that one task compares.
PART_POSTS = 2_000_000


def _set(text: bytes | None) -> np.ndarray:
    """The sorted hashes of a text's shingles, A-Z lower-cased; a shorter text is one shingle."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(SHINGLE, len(words))
    g = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        g = (g ^ h[i : i + len(g)]) * np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(32)
    return np.unique(g)


def _majority(h: np.ndarray, block: int = 1 << 16) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), block):
        ones += np.unpackbits(h[i : i + block].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]) if len(h) else 0


def _odd(s: np.ndarray) -> bytes:
    """The odd sketch of a set: a power of two of bits, at least one a shingle."""
    bits = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    places = (s & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all as short as the shortest; halves are added by exclusive or."""
    sizes = np.array([len(s) for s in sketches], np.int64) // 8
    least = int(sizes.min()) if len(sizes) else 1
    out = np.zeros((len(sketches), least), np.uint64)
    for size in np.unique(sizes):
        rows = np.nonzero(sizes == size)[0]
        a = np.frombuffer(b"".join([sketches[i] for i in rows.tolist()]), "<u8").reshape(len(rows), size)
        while a.shape[1] > least:
            a = a[:, : a.shape[1] // 2] ^ a[:, a.shape[1] // 2 :]
        out[rows] = a
    return out


def _may_be_similar(a: np.ndarray, b: np.ndarray, total: np.ndarray, similarity: float) -> np.ndarray:
    """False for the pairs of sketches that differ in more bits than the sets, of `total` shingles together, may in shingles."""
    ok, step = np.zeros(len(total), bool), max(1, (1 << 20) // max(1, a.shape[1]))
    for i in range(0, len(total), step):
        j = slice(i, i + step)
        ok[j] = np.bitwise_count(a[j] ^ b[j]).sum(1, dtype=np.int64) <= (1 - similarity) / (1 + similarity) * total[j] + 1e-6
    return ok


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(s) for s in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)])))


def _node() -> Column:
    unknown = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), 2) + F.lit(1 << 62)
    return F.coalesce(F.col("doc_id").cast("long"), unknown)


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingle hashes, texts of a sample that hold them); they only set the order of shingles, so results do not hang on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [_set(t) for t in b.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))], names=["h"])

    share = int(min(1.0, ORDER_ROWS / max(docs.count(), 1)) * (1 << 20))
    sample = docs.filter(F.pmod(F.xxhash64(F.lit(7), _node()), F.lit(1 << 20)) < share).select("text")
    counts = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT)
    got = counts.orderBy(F.desc("n"), "h").limit(FREQUENT_SHINGLES).toArrow()
    h, n = (np.asarray(got.column(i).combine_chunks(), np.int64) for i in range(2))
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], n[order].astype(np.int32)


def _prefix(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles of a set, rare ones before frequent ones: similar sets share one of them."""
    n, (keys, counts) = len(s), frequent
    size = n - math.ceil(similarity * n - 1e-9) + 1 if n else 0
    if not len(keys) or not n:
        return s[:size]
    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
    return s[np.argsort(np.where(keys[at] == s, counts[at], 0), kind="stable")[:size]]


def sketches(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """id, fp, key (a hash of the shingle set), n (its size), odd and prefix of every row, written once."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, odd, first = [], [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                s = _set(t)
                first.append(_prefix(s, frequent.value, similarity).view(np.int64))
                odd.append(_odd(s))
                out.append((_majority(s), xxhash.xxh64_intdigest(s.tobytes(), 1), len(s)))
            a = np.array(out, np.uint64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.ascontiguousarray(a[:, i]).view(np.int64)) for i in range(3)], pa.array(odd, pa.binary()), _lists(first)], names=["id", "fp", "key", "n", "odd", "prefix"])

    return cut(docs.select(_node().alias("id"), "text").mapInArrow(run, "id long, fp long, key long, n long, odd binary, prefix array<long>"), "dedup-sketches")


def _dealt(classes: DataFrame, radius: int) -> DataFrame:
    """(part, id, fp, n, odd, home) of every class in its own shard and those that it visits in its band of sizes and the next.

    Bands are 1 / SIMILARITY wide, so similar sets are in the same band or neighbours.
    """
    n = classes.count()
    part = F.pmod(F.xxhash64(F.lit(9), F.col("fp")), F.lit(1 << 20)) < int(min(1.0, SAMPLE_ROWS / max(n, 1)) * (1 << 20))
    count = {r.band: r["count"] for r in classes.groupBy("band").count().collect()}
    by_band: dict[int, list[int]] = {}
    for r in classes.filter(part).select("band", "fp").collect():
        by_band.setdefault(r.band, []).append(r.fp)
    routers = {b: Router(np.sort(np.array(by_band.get(b, []), np.int64)).view(np.uint64), max(1, k // SHARD_ROWS), radius) for b, k in count.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fps, sizes, bands = (np.asarray(b.column(i)) for i in (0, 1, 2, 4))
            for to in np.unique(np.concatenate([bands, bands + 1])).tolist():
                if to not in routers:
                    continue
                near = np.nonzero((bands == to) | (bands == to - 1))[0]
                for shard, rows, home in routers[to].route(fps[near].astype(np.int64).view(np.uint64)):
                    at, own = near[rows], bands[near[rows]] == to
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), to * 1_000_000 + shard, np.int64)), *[pa.array(c[at]) for c in (ids, fps, sizes)], b.column(3).take(pa.array(at)), pa.array(home & own)], names=["part", "id", "fp", "n", "odd", "home"])

    return classes.select("id", "fp", "n", "odd", "band").mapInArrow(run, "part long, id long, fp long, n long, odd binary, home boolean")


def _pairs(g: pd.DataFrame, residents: np.ndarray, queries: np.ndarray, radius: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions of queries, positions of residents) of candidates in g: fingerprints near, sizes and sketches that allow the similarity."""
    ids, n, fp, odd = g["id"].to_numpy(np.int64), g["n"].to_numpy(np.int64), g["fp"].to_numpy(np.int64).view(np.uint64), _folded(list(g["odd"]))
    for x, y in tree_pairs(fp[residents], fp[queries], radius):
        x, y = queries[x], residents[y]
        ok = (ids[x] != ids[y]) & (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]))
        x, y = x[ok], y[ok]
        ok = _may_be_similar(odd[x], odd[y], n[x] + n[y], similarity)
        yield x[ok], y[ok]


def _involved(visits: DataFrame, radius: int, similarity: float) -> DataFrame:
    """The visits that have a candidate in their shard: (part, id, fp, n, odd, home)."""

    def shard(g: pd.DataFrame) -> pd.DataFrame:
        g = g.reset_index(drop=True)
        on = np.zeros(len(g), bool)
        for x, y in _pairs(g, np.nonzero(g["home"].to_numpy(bool))[0], np.arange(len(g)), radius, similarity):
            on[x] = True
            on[y] = True
        return g[on]

    return visits.groupBy("part").applyInPandas(shard, "part long, id long, fp long, n long, odd binary, home boolean")


def _matched(docs: DataFrame, ids: DataFrame, n: int, how: str) -> DataFrame:
    """docs joined by `how` (left_semi or left_anti) to n ids of a column `id`: the ids are broadcast if their number is bounded, so texts stay where they are."""
    other = ids.select(F.col("id").alias(free_name(docs, "node")))
    return docs.join(F.broadcast(other) if n <= BROADCAST_IDS else other, _node() == other[other.columns[0]], how)


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, s): the sorted shingle hashes of the classes named by id, from one text of each."""
    wanted = cut(ids.select("id").distinct(), "dedup-wanted")
    rows = _matched(docs.select("doc_id", "text"), wanted, wanted.count(), "left_semi").select(_node().alias("id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [_set(t).view(np.int64) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(sets)], names=["id", "s"])

    # rows that repeat an id have, as members of one class, equal sets; if their texts differ, any of them stands for the id
    return cut(rows.mapInArrow(run, "id long, s array<long>").dropDuplicates(["id"]), "dedup-sets")


def _linked(g: pd.DataFrame, radius: int, similarity: float) -> pd.DataFrame:
    """A spanning forest (u, v) of the links between residents and queries of g, whose sets are in s."""
    g = g.reset_index(drop=True)
    ids, n, sets = g["id"].to_numpy(np.int64), g["n"].to_numpy(np.int64), [np.asarray(s, np.int64).view(np.uint64) for s in g["s"]]  # sets are in the order of unsigned numbers
    residents, queries = (np.nonzero(g[c].to_numpy(bool))[0] for c in ("resident", "query"))
    root, u, v = np.arange(len(g)), [], []
    for i in range(0, len(queries), QUERY_ROWS):  # pairs in memory: at most those of a block of queries
        found = list(_pairs(g, residents, queries[i : i + QUERY_ROWS], radius, similarity))
        x, y = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(2))
        if not len(x):
            continue
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        edges = np.nonzero(np.diff(x, prepend=-1))[0].tolist()
        for a, b in zip(edges, [*edges[1:], len(x)], strict=True):
            q = int(x[a])
            partners = y[a:b][root[y[a:b]] != root[q]]
            for block in range(0, len(partners), QUERY_ROWS):
                p = partners[block : block + QUERY_ROWS]
                p = p[root[p] != root[q]]
                if not len(p):
                    continue
                flat, s = np.concatenate([sets[k] for k in p.tolist()]), sets[q]
                shared = s[np.minimum(np.searchsorted(s, flat), len(s) - 1)] == flat
                common = np.add.reduceat(shared.astype(np.int64), np.cumsum(n[p]) - n[p])
                p = p[common >= similarity * (n[q] + n[p] - common) - 1e-9]
                p = p[np.unique(root[p], return_index=True)[1]]  # one link for each group that q joins
                u += [int(ids[q])] * len(p)
                v += ids[p].tolist()
                root[np.isin(root, root[p])] = root[q]
    return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})


def _checked(involved: DataFrame, sets: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Edges (u, v) that hold together each shard's links: candidates whose exact Jaccard similarity is enough.

    Residents and queries of a large shard are dealt out to slices; each slice of
    queries meets each slice of residents in a task of its own.
    """
    slices = lambda on: F.greatest(F.lit(1), F.ceil(F.count_if(on) / SLICE_ROWS), F.ceil(F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0)) / SLICE_SHINGLES)).cast("int")
    sizes = involved.groupBy("part").agg(slices(F.col("home")).alias("down"), slices(F.lit(True)).alias("across"))
    to = lambda i, j, resident, query: F.struct(i.alias("i"), j.alias("j"), resident.alias("resident"), query.alias("query"))
    no, yes = F.lit(False), F.lit(True)
    d = involved.join(sizes, "part").withColumn("i0", F.pmod(F.xxhash64(F.lit(1), "id"), "down").cast("int")).withColumn("j0", F.pmod(F.xxhash64(F.lit(2), "id"), "across").cast("int"))
    as_resident = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda j: to(F.col("i0"), j, yes, j == F.col("j0")))).otherwise(F.array().cast("array<struct<i:int,j:int,resident:boolean,query:boolean>>"))
    as_query = F.filter(F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda i: to(i, F.col("j0"), no, yes)), lambda c: ~F.col("home") | (c["i"] != F.col("i0")))
    d = d.select("part", "id", "fp", "n", "odd", F.explode(F.concat(as_resident, as_query)).alias("c")).select("part", "id", "fp", "n", "odd", "c.*").join(sets, "id")
    return d.groupBy("part", "i", "j").applyInPandas(lambda g: _linked(g, radius, similarity), "u long, v long")


def _shared_posts(classes: DataFrame) -> DataFrame:
    """(h, id, root, place) of the prefix shingles that classes (id, root, prefix) of several roots hold; they travel packed, a row for each batch and part."""
    total = classes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    parts = max(8, -(-total // PART_POSTS))
    columns = ("h", "id", "root", "place")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = b.column(2)
            size = np.diff(np.asarray(first.offsets, np.int64))
            h = np.asarray(first.flatten(), np.int64)
            ids, roots = (np.repeat(np.asarray(b.column(i), np.int64), size) for i in range(2))
            place = (np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
            part = (h.view(np.uint64) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            there, ends = np.unique(part, return_index=False), np.append(0, np.cumsum(np.bincount(part, minlength=parts)))
            at = pa.array(np.append(ends[there], len(h)).astype(np.int32))
            # a root is sent as its distance from the id, which is mostly none
            yield pa.RecordBatch.from_arrays([pa.array(there), *[pa.ListArray.from_arrays(at, pa.array(x[order])) for x in (h, ids, roots - ids, place)]], names=["part", *columns])

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        h, ids, roots, place = (np.concatenate([np.asarray(x, np.int64) for x in g[c]]) for c in columns)
        roots = roots + ids
        order = np.lexsort((roots, h))
        h, ids, roots, place = h[order], ids[order], roots[order], place[order]
        first = np.append(True, h[1:] != h[:-1])
        last = np.append(first[1:], True)
        on = (roots[first] != roots[last])[np.cumsum(first) - 1]
        return pd.DataFrame({"h": h[on], "id": ids[on], "root": roots[on], "place": place[on]})

    packed = classes.select("id", "root", "prefix").mapInArrow(pack, "part long, h array<long>, id array<long>, root array<long>, place array<int>")
    return packed.groupBy("part").applyInPandas(meet, "h long, id long, root long, place int")


def _met(kept: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(u, v, root_u, root_v) of the classes of several roots that share a shingle of kept early enough to be similar.

    What two sets share comes at or after the first shingle in the common order that they
    share, so after its place each must have enough left.  The smaller set, u, needs
    the more of its own, so fewer of its shingles count.
    """
    share = similarity / (1 + similarity)
    posts = kept.join(classes.select("id", "n"), "id")
    other = posts.select("h", F.col("id").alias("v"), F.col("root").alias("root2"), F.col("n").alias("n2"), F.col("place").alias("place2"))
    smaller = (F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("id") < F.col("v")))
    need = share * (F.col("n") + F.col("n2")) - 1e-6
    enough = (F.col("n") - F.col("place") >= need) & (F.col("n2") - F.col("place2") >= need) & (F.col("n") >= similarity * F.col("n2"))
    early = posts.filter(F.col("n") - F.col("place") >= 2 * share * F.col("n") - 1e-6)
    met = early.join(other, "h").filter((F.col("root") != F.col("root2")) & smaller & enough)
    return met.select(F.col("id").alias("u"), "v", F.col("root").alias("root_u"), F.col("root2").alias("root_v")).distinct()


def _beyond(docs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Edges (u, v) between the roots of classes (id, n, odd, prefix, root) whose exact Jaccard similarity is enough; one for each two roots, however many classes link them."""
    kept = cut(_shared_posts(classes), "dedup-posts")
    pairs = _met(kept, classes, similarity)
    sketch = lambda k: classes.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("odd").alias(f"odd_{k}"))

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows = _folded_pairs(b.column(6).to_pylist(), b.column(7).to_pylist(), np.asarray(b.column(4), np.int64) + np.asarray(b.column(5), np.int64), similarity)
                yield b.select([0, 1, 2, 3]).filter(pa.array(rows))

    tested = pairs.join(sketch("u"), "u").join(sketch("v"), "v").select("u", "v", "root_u", "root_v", "n_u", "n_v", "odd_u", "odd_v").mapInArrow(possible, "u long, v long, root_u long, root_v long")
    tested = cut(tested, "dedup-pairs")
    sets = _sets(docs, tested.select(F.col("u").alias("id")).union(tested.select("v")))
    met = tested.join(sets.select(F.col("id").alias("u"), "s"), "u").join(sets.select(F.col("id").alias("v"), F.col("s").alias("s2")), "v")
    met = met.select("root_u", "root_v", F.size(F.array_intersect("s", "s2")).alias("common"), (F.size("s") + F.size("s2")).alias("total"))
    links = cut(met.filter(F.col("common") >= similarity * (F.col("total") - F.col("common")) - 1e-9).select(F.least("root_u", "root_v").alias("u"), F.greatest("root_u", "root_v").alias("v")).distinct(), "dedup-far")
    discard(kept, tested, sets)
    return links


def _folded_pairs(a: list[bytes], b: list[bytes], total: np.ndarray, similarity: float) -> np.ndarray:
    """_may_be_similar() of pairs of sketches, in groups of one size."""
    ok, least = np.zeros(len(a), bool), np.minimum([len(x) for x in a], [len(x) for x in b])
    for size in np.unique(least):
        rows = np.nonzero(least == size)[0]
        short = b"\0" * int(size)  # makes both sides as short as the shorter of each pair
        x, y = (_folded([*(side[i] for i in rows.tolist()), short])[:-1] for side in (a, b))
        ok[rows] = _may_be_similar(x, y, total[rows], similarity)
    return ok


def groups(docs: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(id, stays): every row's id and the id that stays for its group, written once."""
    rows = sketches(docs, similarity)
    named = cut(rows.groupBy("fp", "key").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "odd", "prefix")]), "dedup-classes")
    band = F.floor(F.log(F.greatest("n", F.lit(1))) / F.lit(-float(np.log(similarity)))).cast("long")
    involved = cut(_involved(_dealt(named.filter("n > 0").withColumn("band", band), radius), radius, similarity), "dedup-involved")
    sets = _sets(docs, involved)
    links = cut(_checked(involved, sets, radius, similarity), "dedup-links")
    discard(involved, sets)
    near = cut(components(links, "dedup-components"), "dedup-near")
    rooted = lambda roots: named.join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    beyond = _beyond(docs, rooted(near).select("id", "n", "odd", "prefix", "root"), similarity)
    far = components(near.select(F.col("node").alias("u"), F.col("root").alias("v")).union(beyond), "dedup-components")
    joined = rooted(far).select("fp", "key", F.col("root").alias("stays"))
    judged = cut(rows.select("id", "fp", "key").join(joined, ["fp", "key"]).select("id", "stays"), "dedup-groups")
    discard(rows, named, links, near, beyond)
    return judged


def deduplicate(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that stay, one of each group, with docs' columns.

    The ids that go are counted first; up to BROADCAST_IDS they are broadcast and texts
    stay where they are.
    """
    judged = groups(docs, **how)
    again = cut(judged.filter("id = stays").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "dedup-again")
    out = cut(judged.filter("id <> stays").select("id").union(again).distinct(), "dedup-out")
    once = _matched(docs, out, out.count(), "left_anti")
    if again.isEmpty():
        return once
    node = free_name(docs, "node_of_row")
    repeated = _matched(docs, again, again.count(), "left_semi").withColumn(node, _node())
    return once.unionByName(repeated.dropDuplicates([node]).drop(node))
