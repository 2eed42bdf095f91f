"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items are turned into templates: numbers, names (capitalised
words inside a sentence) and units after a number become typed placeholders, other
words lose case and outer punctuation.  Windows of WINDOW template words are
hash-joined, and a match counts only if the slots agree: one value on one side
always meets the same value on the other, so a question with other numbers or names
is caught and a chance match of placeholders is not.

Windows are sought in three forms, each against its own: names inside a sentence only;
every capitalised word as a name, so a name that begins a sentence can be another and
a heading without end punctuation does no harm; and plain words, so a copy of a window
or of a short item is always found, whatever it is made of.

The benchmark's windows are joined in blocks of at most BLOCK_WINDOWS (under 64 MB).  Up
to BLOCKS of them are broadcast at once and met in one pass over the documents, which
stay where they are; a larger benchmark takes further passes, each over what the one
before has written.

Defined results: null and empty texts never match; items under WINDOW words are one
window; items under MIN_WORDS words and windows with fewer than half literal words are
sought as plain words alone, and nothing that is all punctuation is sought; null items
and repeated items do no harm, an item without id is listed as null; texts of any
length are read whole; other columns pass through, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name

WINDOW, MIN_WORDS, BLOCK_WINDOWS, BLOCKS = 13, 5, 1_000_000, 4
#: Words that a task remembers, and bytes of texts that it works on at once (one text at least).
CACHE_WORDS, SLICE_BYTES = 400_000, 2_000_000

# Units that count as such after a number.
UNITS = frozenset("mm cm m km inch inches in ft feet foot yard yards mile miles mg g kg t lb lbs oz ounce ounces ml l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent % $ € £ dollar dollars cent cents euro euros pound pounds usd eur degree degrees c f k hz khz mhz ghz w kw v kb mb gb tb kmh mph".split())
NUMBER = re.compile(r"[+\-$€£]?\d[\d.,:/]*(?:st|nd|rd|th|%)?")
EDGE = "\"'`()[]{}<>.,;:!?*_"

_LITERAL, _NUMBER, _CAPITAL = 0, 1, 2
#: The form of plain words, and the hash of a word that is all punctuation.
_PLAIN, _EMPTY = 2, np.uint64(xxhash.xxh64_intdigest(b"", 7))
_MARK = {"num": np.uint64(0x9E3779B97F4A7C15), "name": np.uint64(0xC2B2AE3D27D4EB4F), "unit": np.uint64(0x165667B19E3779F9)}


class Words(dict):
    """Word -> place in arrays of (kind, literal hash, is a unit, ends a sentence); filled as words are met."""

    def __init__(self):
        self.new: list[tuple] = []
        self.columns = [np.zeros(0, t) for t in (np.int8, np.uint64, bool, bool)]

    def __missing__(self, raw: bytes) -> int:
        word = raw.decode()
        core = word.strip(EDGE)
        low = core.lower()
        kind = _NUMBER if NUMBER.fullmatch(core) else _CAPITAL if core[:1].isupper() and len(core) > 1 and not core.isupper() else _LITERAL
        self.new.append((kind, xxhash.xxh64_intdigest(low.encode(), 7), low in UNITS, word[-1] in ".!?:;\""))
        self[raw] = len(self)
        return len(self) - 1

    def table(self) -> list[np.ndarray]:
        if self.new:
            self.columns = [np.concatenate([c, np.array(n, c.dtype)]) for c, n in zip(self.columns, zip(*self.new, strict=True), strict=True)]
            self.new = []
        return self.columns


def forms(texts: list[str | None], words: Words) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """(template hashes and slot values with 0 for literals in each form, first position of each text, lengths) of all texts in one run of arrays."""
    if len(words) > CACHE_WORDS:
        words.clear()
        words.__init__()
    ids, lengths = [], []
    for t in texts:
        w = t.encode().split() if t else []
        lengths.append(len(w))
        ids.extend(map(words.__getitem__, w))
    at = np.array(ids, np.int64)
    lengths = np.array(lengths, np.int64)
    first = np.cumsum(lengths) - lengths
    kind, lit, unit, ends = (c[at] for c in words.table())
    begins, after = np.ones(len(at), bool), np.zeros(len(at), bool)
    begins[1:], after[1:] = ends[:-1], kind[:-1] == _NUMBER
    begins[first[lengths > 0]], after[first[lengths > 0]] = True, False
    num, unit = kind == _NUMBER, unit & after
    got = []
    for name in ((kind == _CAPITAL) & ~begins, kind == _CAPITAL):
        tmpl = np.where(num, _MARK["num"], np.where(unit, _MARK["unit"], np.where(name, _MARK["name"], lit)))
        got.append((tmpl, np.where(num | unit | name, lit, np.uint64(0))))
    return [*got, (lit, np.zeros(len(lit), np.uint64))], first, lengths


def templates(texts: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first form: (template hashes, slot values, first position of each text, lengths)."""
    got, first, lengths = forms(texts, words)
    return *got[0], first, lengths


def windows(tmpl: np.ndarray, first: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every run of `size` words within a text."""
    n = len(tmpl) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x100000001B3) + tmpl[k : k + n]
        h ^= h >> np.uint64(29)
    end = np.repeat(first + lengths, lengths)[:n]
    ok = np.nonzero(np.arange(n) + size <= end)[0]
    return ok, h[ok]


def consistent(a: np.ndarray, b: np.ndarray) -> bool:
    """Slots pair up one to one."""
    there, back = {}, {}
    return all(there.setdefault(x, y) == y and back.setdefault(y, x) == x for x, y in zip(a.tolist(), b.tolist(), strict=True) if x or y)


def _block(rows: list) -> dict:
    """What a broadcast block holds: by form and window size, sorted hashes with their item and start; and the items' forms."""
    words, found = Words(), {}
    rows = [r for r in rows if r.text]
    got, first, lengths = forms([r.text for r in rows], words)
    for form, (tmpl, slot) in enumerate(got):
        for i, (f, n) in enumerate(zip(first.tolist(), lengths.tolist(), strict=True)):
            if n < 1 or (form != _PLAIN and n < MIN_WORDS):
                continue
            size = min(WINDOW, n)
            start, h = windows(tmpl[f : f + n], np.array([0]), np.array([n]), size)
            if form == _PLAIN:
                sought = np.array([(tmpl[f + s : f + s + size] != _EMPTY).any() for s in start.tolist()], bool)
            else:
                sought = np.array([(slot[f + s : f + s + size] == 0).sum() * 2 >= size for s in start.tolist()], bool)
            found.setdefault((form, size), []).append((h[sought], np.full(sought.sum(), i), start[sought] + f))
    joined = {s: [np.concatenate(x) for x in zip(*v, strict=True)] for s, v in found.items()}
    for s, (h, item, start) in joined.items():
        o = np.argsort(h, kind="stable")
        joined[s] = (h[o], item[o], start[o])
    return {"sizes": joined, "forms": got, "ids": [r.item_id for r in rows]}


def matches(texts: list[str | None], blocks: list[dict], words: Words) -> list[tuple[set, int]]:
    """For each text the items that it holds and how many of its windows match."""
    found: list[tuple[set, set]] = [(set(), set()) for _ in texts]
    got, first, lengths = forms(texts, words)
    hashed: dict = {}
    for b, block in enumerate(blocks):
        for (form, size), (keys, items, starts) in block["sizes"].items():
            (tmpl, slot), (its_tmpl, its_slot) = got[form], block["forms"][form]
            if (form, size) not in hashed:
                hashed[form, size] = windows(tmpl, first, lengths, size)
            at, h = hashed[form, size]
            if not len(at) or not len(keys):
                continue
            low = np.searchsorted(keys, h)
            hit = np.nonzero(keys[np.minimum(low, len(keys) - 1)] == h)[0]
            doc = np.searchsorted(first, at[hit], "right") - 1
            for x, d in zip(hit.tolist(), doc.tolist(), strict=True):
                p, j = int(at[x]), int(low[x])
                while j < len(keys) and keys[j] == h[x]:
                    q, item = int(starts[j]), (b, int(items[j]))
                    new = item not in found[d][0] or p not in found[d][1]
                    if new and (tmpl[p : p + size] == its_tmpl[q : q + size]).all() and consistent(its_slot[q : q + size], slot[p : p + size]):
                        found[d][0].add(item)
                        found[d][1].add(p)
                    j += 1
    return [({blocks[b]["ids"][i] for b, i in items}, len(places)) for items, places in found]


def _slices(texts: pa.Array) -> Iterator[list[str | None]]:
    """Whole texts, some SLICE_BYTES at a time."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    part = (np.cumsum(sizes) - sizes) // SLICE_BYTES
    edges = np.append(np.nonzero(np.diff(part, prepend=-1))[0], len(texts))
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield texts.slice(i, j - i).to_pylist()


def _sorted(items: set) -> list:
    return sorted(items, key=lambda x: (x is None, x))


def flagged(docs: DataFrame, benchmark: DataFrame, items: str, hits: str) -> DataFrame:
    """docs with two more columns: the sorted ids of the items that a text holds, and its matching windows; their names must be free."""
    spark = docs.sparkSession
    bench = benchmark.select("item_id", "text")
    kind = bench.schema["item_id"].dataType
    n = bench.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")))).first()[0] or 0
    parts = max(1, -(-n // BLOCK_WINDOWS))
    part = F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(parts))
    out = docs.select("*", F.array().cast(T.ArrayType(kind)).alias(items), F.lit(0).cast("long").alias(hits))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema.fields])
    for first in range(0, parts, BLOCKS):
        # an item that stands several times is sought once
        blocks = [spark.sparkContext.broadcast(_block(bench.filter(part == k).distinct().collect())) for k in range(first, min(parts, first + BLOCKS))]

        def run(batches: Iterator[pa.RecordBatch], blocks=blocks) -> Iterator[pa.RecordBatch]:
            words, held = Words(), [b.value for b in blocks]
            for b in batches:
                names = b.schema.names
                texts = b.column(names.index("text"))
                got = [x for s in _slices(texts) for x in matches(s, held, words)] if b.num_rows else []
                old, before = b.column(names.index(items)), b.column(names.index(hits)).to_pylist()
                new = [pa.array([_sorted(set(o) | g[0]) for o, g in zip(old.to_pylist(), got, strict=True)], old.type), pa.array([o + g[1] for o, g in zip(before, got, strict=True)], pa.int64())]
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], *new], names=names)

        out = out.mapInArrow(run, schema)
        if first + BLOCKS < parts:
            out = cut(out, "leak-pass")
            for b in blocks:
                b.unpersist()
    return out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, items, n_items, n_windows and contaminated of every row."""
    got = flagged(docs.select("doc_id", "text"), benchmark, "items", "n_windows")
    return got.select("doc_id", "items", F.size("items").cast("long").alias("n_items"), "n_windows", (F.col("n_windows") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark window, with docs' columns."""
    items, hits = free_name(docs, "items_held"), free_name(docs, "windows_held")
    return flagged(docs, benchmark, items, hits).filter(F.col(hits) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
