"""Token-id files: an adaptive context-mixing range coder in independently reset, checksummed blocks.

Texts are encoded in ascending doc_id order, END is appended to each, and runs of
whole documents become chunks.  A chunk is one row of a Parquet table, so Spark's
committers write it and any task can read it alone.  Layout of a chunk, all
little-endian:

    magic "TMK2" | documents u32 | blocks u32 | ids u64 | bytes of the index u32
    index (zlib): null flag of each doc_id u8, doc_ids i64, ids of each document u32
    for each block: ids u32, largest id u32, bytes u32, CRC-32 of its ids as u32
    CRC-32 of everything before | the blocks' bytes

A block holds at most BLOCK ids and is coded from a fresh model.  The chance
of an id is a mixture of three predictions,

    p(x) = w2 [x = a] + w1 [x = b] + w0 p0(x)

a is what last followed the two ids before, b what last followed the id before, p0
are adaptive counts of whole ids, each of which has some chance from the start.  The
weights are adaptive too: they are counts of which prediction was right, by how sure
a and b are and whether they agree.

The ids of a block are dealt out to lanes, runs of neighbours.  All lanes take one step
at a time under one model, which then learns from all their ids at once; so the
model is adaptive, shared by the whole block, and worked by numpy.  Each lane has a
range coder of its own, whose digits are 32 bits; a block's bytes are the lanes'
numbers of digits as u16 and their digits as u32.

Defined results: a null or empty text is the END id alone; null ids come first;
repeated ids keep all their rows, ordered by a hash of the text; texts of any length
are encoded whole (a chunk holds at least one document); a damaged chunk raises; a
vocabulary with ids of 65,536 or more is refused.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

END, BLOCK, CHUNK = 2, 1 << 22, 1 << 23
#: Lanes at most, and ids that a lane has if there are enough.
LANES, LANE_IDS = 8192, 256
#: Binary logarithms: sum of the weights, least weight of order 0, slots of order 2, what a range is filled up to, slots of the lookup of counts.
WHOLE, FLOOR, SLOTS, LEAST, LOOKUP = 28, 21, 18, 31, 16
#: How sure a prediction can get, and what one count of order 0 weighs at most against the chance that every id has.
SURE, COUNT = 7, 32
#: By how sure a prediction was, first where it was wrong, then where it was right: how sure its place is now, as the place holds it.
NEXT = np.array([max(1, k >> 1) << 16 for k in range(SURE + 1)] + [min(SURE, k + 1) << 16 for k in range(SURE + 1)], np.int64)
HEAD, BLOCK_HEAD = "<4sIIQI", 4
BROADCAST_CHUNKS = 100_000
I64, U64 = np.int64, np.uint64
LOW31 = U64((1 << LEAST) - 1)


class Mixer:
    """The model of a block, the same for both directions: predict(), then span() of known ids or find() them, then learn()."""

    def __init__(self, alphabet: int, lanes: int):
        self.alphabet = alphabet
        # a prediction is sure << 16 | id; sure 0 is an empty place
        self.tables = np.zeros(1 << SLOTS, I64), np.zeros(1 << 16, I64)
        self.last = np.zeros(lanes, I64), np.zeros(lanes, I64)
        self.right = np.ones((16 * (SURE + 1), 3), I64)
        self.seen, self.fresh = np.zeros(alphabet, I64), []
        self.step, self.due = 0, 1
        self._recount()

    def _recount(self) -> None:
        """Order 0 as of now: sums of counts below each id."""
        if self.fresh:
            self.seen += np.bincount(np.concatenate(self.fresh), minlength=self.alphabet)
            self.fresh = []
        if int(self.seen.sum()) + self.alphabet > 1 << FLOOR:  # old counts fade, so that all of them stay below the least weight
            self.seen >>= 1
        weight = max(1, min(COUNT, ((1 << FLOOR) - self.alphabet) // max(1, int(self.seen.sum()))))
        self.below = np.zeros(self.alphabet + 1, U64)
        np.cumsum((self.seen * weight + 1).astype(U64), out=self.below[1:])
        self.below = (self.below << U64(FLOOR)) // self.below[-1]  # sums to a power of two; still every id has some, as there is no more than that to begin with
        self.lookup = None

    def predict(self, m: int) -> None:
        """What the first m lanes expect: ids a and b, and the weights of a, b and order 0."""
        p1, p2 = self.last[0][:m], self.last[1][:m]
        self.slots = ((p1 * 0x9E3779B1 + p2 * 0x85EBCA77) & 0xFFFFFFFF) >> (32 - SLOTS), p1
        self.held = tuple(t.take(s) for t, s in zip(self.tables, self.slots, strict=True))
        self.a, self.b = self.held[0] & 0xFFFF, self.held[1] & 0xFFFF
        self.sure = self.held[0] >> 16, self.held[1] >> 16
        self.state = (self.sure[0] << 4) | (self.sure[1] << 1) | (self.a == self.b)
        weights = (self.right[:, :2] * ((1 << WHOLE) - (1 << FLOOR)) // self.right.sum(1)[:, None]).astype(U64)
        self.w2, self.w1 = weights[:, 0].take(self.state), weights[:, 1].take(self.state)
        self.w0 = U64(1 << WHOLE) - self.w2 - self.w1

    def _zero(self, x: np.ndarray, w0: np.ndarray) -> np.ndarray:
        """Order 0's weight of all ids below x."""
        return (w0 * self.below.take(x)) >> U64(FLOOR)

    def span(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight of all ids below x, weight of x) in each lane."""
        start = self._zero(x, self.w0)
        size = self._zero(x + 1, self.w0) - start
        start += self.w2 * (self.a < x)
        start += self.w1 * (self.b < x)
        size += self.w2 * (self.a == x)
        size += self.w1 * (self.b == x)
        return start, size

    def find(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids whose spans hold v, and their spans."""
        a, b, w2, w1, w0 = self.a, self.b, self.w2, self.w1, self.w0
        less = a < b
        start, end = self._zero(a, w0) + w1 * (b < a), self._zero(a + 1, w0) + w2 + w1 * ~less
        start_b, end_b = self._zero(b, w0) + w2 * less, self._zero(b + 1, w0) + w1 + w2 * (a <= b)
        in_b = (v >= start_b) & (v < end_b)
        rest = np.flatnonzero(~in_b & ((v < start) | (v >= end)))
        y = v.take(rest)
        beyond = w2.take(rest) * (y >= end.take(rest)) + w1.take(rest) * (y >= end_b.take(rest))
        x, start, end = np.where(in_b, b, a), np.where(in_b, start_b, start), np.where(in_b, end_b, end)
        if len(rest):
            w = w0.take(rest)
            x[rest] = found = self._rank((((y - beyond + U64(1)) << U64(FLOOR)) - U64(1)) // w)
            start[rest], end[rest] = self._zero(found, w) + beyond, self._zero(found + 1, w) + beyond
        return x, start, end - start

    def _rank(self, y: np.ndarray) -> np.ndarray:
        """The id whose counts hold y: a lookup by y's upper bits is right or just below for all but rare ids, which are searched."""
        if self.lookup is None:
            self.shift = U64(FLOOR - LOOKUP)
            edges = (self.below + ((U64(1) << self.shift) - U64(1))) >> self.shift
            self.lookup = np.repeat(np.arange(self.alphabet), np.diff(edges.astype(I64)))
            self.lookup = np.concatenate([[0], self.lookup])  # place k + 1: the last id that begins at or before k's start
        x = self.lookup.take((y >> self.shift).astype(I64) + 1, mode="clip")
        for _ in range(2):
            short = np.nonzero(self.below.take(x + 1) <= y)[0]
            x[short] += 1
        short = np.nonzero(self.below.take(x + 1) <= y)[0]
        if len(short):
            x[short] = np.searchsorted(self.below, y[short], "right") - 1
        return x

    def learn(self, m: int, x: np.ndarray) -> None:
        is_a, is_b = self.a == x, self.b == x
        kind = np.where(is_a, 0, 2 - is_b)
        self.right += np.bincount(self.state * 3 + kind, minlength=self.right.size).reshape(self.right.shape)
        self.fresh.append(x.take(np.flatnonzero(kind == 2)))
        for table, slot, held, sure, hit in zip(self.tables, self.slots, (self.a, self.b), self.sure, (is_a, is_b), strict=True):
            kept = np.where(hit | (sure > 1), held, x)
            table[slot] = kept | NEXT.take(sure + hit * (SURE + 1))  # of lanes with one slot the last one counts
        self.last[1][:m] = self.last[0][:m]
        self.last[0][:m] = x
        self.step += 1
        if self.step >= self.due:
            self._recount()
            self.due = self.step + min(16, 1 + self.step // 4)


def _lanes(n: int) -> tuple[int, np.ndarray]:
    """(steps, ids of each lane) of a block of n ids."""
    lanes = max(1, min(LANES, n // LANE_IDS))
    steps = -(-n // lanes)
    lanes = -(-n // steps)
    return steps, np.minimum(steps, n - steps * np.arange(lanes))


def encode_block(ids: np.ndarray) -> bytes:
    """The coded ids (at least one, each below 65,536)."""
    steps, sizes = _lanes(len(ids))
    lanes = len(sizes)
    grid = np.zeros(lanes * steps, np.uint16)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Mixer(int(grid.max()) + 1, lanes)
    low, span = np.zeros(lanes, U64), np.full(lanes, (1 << 63) - 1, U64)
    digits, used = np.zeros((lanes, steps + 2), U64), np.zeros(lanes, I64)
    for t in range(steps):
        m = lanes if t < sizes[-1] else lanes - 1
        model.predict(m)
        x = grid[t, :m].astype(I64)
        start, size = model.span(x)
        unit = span[:m] >> U64(WHOLE)
        low[:m] += unit * start
        span[:m] = unit * size
        thin = np.nonzero(span[:m] <= LOW31)[0]
        digits[thin, used[thin]] = low[thin] >> U64(LEAST)  # 33 bits: the uppermost is carried below
        used[thin] += 1
        low[thin] = (low[thin] & LOW31) << U64(32)
        span[thin] <<= U64(32)
        model.learn(m, x)
    digits[np.arange(lanes), used] = (low + LOW31) >> U64(LEAST)
    used += 1
    for k in range(int(used.max()) - 1, 0, -1):
        digits[:, k - 1] += digits[:, k] >> U64(32)
    return used.astype("<u2").tobytes() + digits[np.arange(steps + 2) < used[:, None]].astype("<u4").tobytes()


def decode_block(block: bytes, n: int, largest: int) -> np.ndarray:
    """The n ids of encode_block()."""
    steps, sizes = _lanes(n)
    lanes = len(sizes)
    used = np.frombuffer(block, "<u2", lanes).astype(I64)
    digits = np.frombuffer(block, "<u4", offset=2 * lanes)
    if used.sum() != len(digits):
        raise ValueError("a block's digits are damaged")
    # after the digits of each lane one of zero; a lane reads 31 bits of the digit after the one that it has reached
    flat = np.zeros(len(digits) + lanes + 1, U64)
    flat[np.arange(len(digits)) + np.repeat(np.arange(lanes), used)] = digits
    more = ((flat[:-1] & U64(1)) << U64(31)) | (flat[1:] >> U64(1))
    at = np.cumsum(used) - used + np.arange(lanes)
    ahead, span = (flat[at] << U64(31)) | (flat[at + 1] >> U64(1)), np.full(lanes, (1 << 63) - 1, U64)
    model = Mixer(largest + 1, lanes)
    grid, last = np.zeros((steps, lanes), np.uint16), len(more) - 1
    for t in range(steps):
        m = lanes if t < sizes[-1] else lanes - 1
        model.predict(m)
        unit = span[:m] >> U64(WHOLE)
        x, start, size = model.find(np.minimum(ahead[:m] // unit, U64((1 << WHOLE) - 1)))
        ahead[:m] -= unit * start
        span[:m] = unit * size
        thin = np.nonzero(span[:m] <= LOW31)[0]
        at[thin] += 1
        ahead[thin] = (ahead[thin] << U64(32)) | more[np.minimum(at[thin], last)]
        span[thin] <<= U64(32)
        grid[t, :m] = x
        model.learn(m, x)
    return np.ascontiguousarray(grid.T).ravel()[:n]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def write_chunk(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    parts = np.array_split(ids, max(1, -(-len(ids) // BLOCK))) if len(ids) else []
    blocks = [encode_block(p) for p in parts]
    index = zlib.compress(np.array([d is None for d in doc_ids], np.uint8).tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<u4").tobytes())
    head = struct.pack(HEAD, b"TMK2", len(doc_ids), len(blocks), len(ids), len(index)) + index
    head += np.array([(len(p), int(p.max()), len(b), _crc(p)) for p, b in zip(parts, blocks, strict=True)], "<u4").tobytes()
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(blocks)


def read_chunk(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids); raises ValueError if any checksum differs."""
    magic, docs, n_blocks, _, size = struct.unpack_from(HEAD, data)
    if magic != b"TMK2":
        raise ValueError("not a token chunk")
    at = struct.calcsize(HEAD) + size
    table = np.frombuffer(data, "<u4", BLOCK_HEAD * n_blocks, at).reshape(-1, BLOCK_HEAD)
    end = at + table.nbytes
    if struct.unpack_from("<I", data, end)[0] != zlib.crc32(data[:end]):
        raise ValueError("the chunk's head is damaged")
    raw = zlib.decompress(data[struct.calcsize(HEAD) : at])
    null, doc_ids, lengths = np.frombuffer(raw, np.uint8, docs), np.frombuffer(raw, "<i8", docs, docs), np.frombuffer(raw, "<u4", docs, 9 * docs)
    ids, at = [np.zeros(0, np.uint16)], end + 4
    for i, (n, largest, size, crc) in enumerate(table.tolist()):
        ids.append(decode_block(data[at : at + size], n, largest))
        if _crc(ids[-1]) != crc:
            raise ValueError(f"block {i} is damaged")
        at += size
    return [None if x else d for x, d in zip(null.tolist(), doc_ids.tolist(), strict=True)], lengths, np.concatenate(ids)


#: Small letters alone, of ASCII and Latin-1: no normalising changes them.
_small = re.compile(rb"(?:[a-z]|\xC3[\x9F-\xB6\xB8-\xBF])+").fullmatch


def _kinds() -> bytes:
    """What a byte is for parting words: 0 white space, 1 of a letter, 2 digit, 3 punctuation, 4 of anything that leaves its word whole."""
    kinds = np.full(256, 4, np.uint8)
    kinds[list(b" \t\n\v\f\r")] = 0
    kinds[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = 1  # with the following bytes of Latin letters up to U+023F
    kinds[48:58] = 2
    kinds[list(Words.EDGE)] = 3
    return kinds.tobytes()


class Words:
    """Lower-cased words and their ids as bytes.

    The tokenizer drops white space and never joins across it, so words are encoded on
    their own, each once.  Its pattern parts letters, digits and punctuation, so words of
    ASCII and Latin letters are parted before they are looked up; in others letters with
    ASCII punctuation before or after them are encoded as two or three pieces.
    """

    LIMIT = 500_000
    #: Bytes of texts that are worked in one go.
    BYTES = 18_000_000
    #: ASCII punctuation without the apostrophe, which can begin a piece with letters in it.
    EDGE = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.ids, self.older = Tokenizer.from_str(spec), {}, {}
        # runs of small Latin letters need no normalising and are parted by blanks alone; this reads them faster, once it has been seen to read some alike
        bare = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.bare = Tokenizer.from_str(json.dumps(json.loads(spec) | {"normalizer": None, "pre_tokenizer": bare, "added_tokens": []}))
        self.trusted, self.kinds = None, _kinds()
        self.ends = np.zeros(1 << 16, bool)  # ids that end a piece
        for token, i in self.tokenizer.get_vocab().items():
            if i >= 1 << 16:
                raise ValueError(f"the vocabulary has the id {i}, files hold ids below 65536")
            self.ends[i] = token.endswith("</w>")

    def _learn_runs(self, tokenizer, runs: list[bytes]) -> None:
        """Of letters alone or punctuation alone: encoded some hundreds in one go, as the end of each shows."""
        parts = [runs[i : i + 200] for i in range(0, len(runs), 200)]
        for part, e in zip(parts, tokenizer.encode_batch_fast([b" ".join(p).decode() for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u2")
            ends = np.nonzero(self.ends[ids])[0] + 1
            if len(ends) != len(part) or ends[-1] != len(ids):
                self._learn_words(part)
                continue
            raw, at = ids.tobytes(), 0
            for w, e in zip(part, (2 * ends).tolist(), strict=True):
                self.ids[w] = raw[at:e]
                at = e

    def _trusts(self, plain: list[bytes]) -> bool:
        """Whether the bare tokenizer reads runs of small letters as the whole one does, tried on the first that come."""
        if self.trusted is None and plain:
            text = b" ".join(plain[:2000]).decode()
            self.trusted = self.bare.encode(text, add_special_tokens=False).ids == self.tokenizer.encode(text, add_special_tokens=False).ids
        return bool(self.trusted)

    def _learn_words(self, words: list[bytes]) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False), strict=True):
            self.ids[w] = np.array(e.ids, "<u2").tobytes()

    def learn(self, words: set[bytes]) -> None:
        new = words.difference(self.ids)
        if len(self.ids) + len(new) > self.LIMIT:  # the words of before are kept as the older half
            self.ids, self.older, new = {}, self.ids, set(words)
        known, older = self.ids, self.older
        again = [w for w in new if w in older] if older else ()
        for w in again:
            known[w] = older[w]
        new.difference_update(again)
        plain = set(filter(_small, new))
        new -= plain
        runs, others, edged, edges = set(), [], [], []
        for w in new:
            core = w.strip(self.EDGE)
            if not core:
                runs.add(w)
            elif not (core.isalpha() or core.decode().lower().isalpha()) or b"<|" in w:
                others.append(w)
            elif len(core) == len(w):
                runs.add(w)
            else:
                at = w.index(core)
                edged.append(w)
                edges.append((w[:at], core, w[at + len(core) :]))
                runs.update(edges[-1])
        plain.update(filter(_small, runs))
        runs.difference_update(plain, (b"",))
        self._learn_words(others)
        todo = list(plain.difference(known))
        self._learn_runs(self.bare if self._trusts(todo) else self.tokenizer, todo)
        self._learn_runs(self.tokenizer, list(runs.difference(known)))
        known[b""] = b""
        for w, pieces in zip(edged, edges, strict=True):
            known[w] = b"".join(map(known.__getitem__, pieces))

    def _pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The bytes of texts without white space in runs of letters, punctuation, words left whole, and single digits: the runs, and the first run of each text."""
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        starts = ends[:-1] - ends[0]
        data = np.frombuffer(bytearray(raw).lower(), np.uint8)
        angles = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        for i in np.unique(np.searchsorted(starts, angles, "right") - 1).tolist():  # a text that may hold a special token's string keeps its case, on which that token depends
            at = slice(starts[i], ends[i + 1] - ends[0])
            data[at] = raw[at]
        kinds = np.frombuffer(bytearray(data).translate(self.kinds), np.uint8)
        kinds[angles] = 4
        lead = np.flatnonzero((data[:-1] == 0xC3) | (data[:-1] == 0xC4))
        both = data[lead].astype(np.uint16) << 8 | data[lead + 1]
        kinds[lead[(both == 0xC397) | (both == 0xC3B7) | (both == 0xC4B0)]] = 4  # two signs, and a letter whose small form has a mark
        cut = np.empty(len(data) + 1, bool)
        cut[0] = cut[-1] = True
        odd = np.flatnonzero(kinds == 4)
        if len(odd):  # words with such bytes are one run each
            blank = kinds == 0
            np.not_equal(blank[1:], blank[:-1], out=cut[1:-1])
            cut[starts] = True
            edges = np.flatnonzero(cut)
            word = np.unique(np.searchsorted(edges, odd, "right") - 1)
            first, sizes = edges[word], edges[word + 1] - edges[word]
            kinds[np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())] = 4
        np.not_equal(kinds[1:], kinds[:-1], out=cut[1:-1])
        cut[:-1] |= kinds == 2
        cut[starts] = True
        edges = np.flatnonzero(cut).astype(np.int32)
        solid = kinds.take(edges[:-1]) != 0
        first = np.append(0, np.cumsum(solid))[np.searchsorted(edges, starts)]
        edges = np.append(0, np.cumsum(np.diff(edges)[solid])).astype(np.int32)
        runs = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(bytearray(data).translate(None, b" \t\n\v\f\r"))])
        return runs, first

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text (a string array), END included, and the ids of all."""
        if not len(texts) or not texts.buffers()[2] or not texts.buffers()[2].size:
            return np.ones(len(texts), np.int64), np.full(len(texts), END, np.uint16)
        runs, first = self._pieces(texts)
        runs = runs.dictionary_encode()
        at, raw = (np.frombuffer(x, t) for x, t in zip(runs.dictionary.buffers()[1:], (np.int32, np.uint8), strict=True))
        at, raw = at[: len(runs.dictionary) + 1].tolist(), raw.tobytes()
        known = [raw[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
        found = [*map(self.ids.get, known), np.array([END], "<u2").tobytes()]
        new = [k for k, x in enumerate(found) if x is None]
        if new:
            self.learn({known[k] for k in new})
            for k in new:
                found[k] = self.ids[known[k]]
        found = pa.array(found, pa.binary())
        # every text has its runs' places and one of END
        ends = np.append(first[1:], len(runs))
        taken = found.take(pa.array(np.insert(np.asarray(runs.indices), ends, len(known))))
        at = np.frombuffer(taken.buffers()[1], np.int32)[np.append(0, ends + np.arange(1, len(ends) + 1))] >> 1
        return np.diff(at).astype(np.int64), np.frombuffer(taken.buffers()[2], "<u2", at[-1])


def _plain(texts: pa.Array) -> pa.Array:
    """Texts with 32-bit places and without nulls, whatever string type they came in."""
    return pc.fill_null(texts, "").cast(pa.string())


#: The words that this process knows, by the hash of the tokenizer: a Python worker keeps them from task to task.
_known: dict[int, Words] = {}


def _words(spec: str) -> Words:
    key = zlib.crc32(spec.encode())
    if key not in _known:
        _known.clear()
        _known[key] = Words(spec)
    return _known[key]


def write(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The table of chunks of docs: part, chunk, n_ids and payload, in ascending doc_id order."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, part, chunk = _words(spec.value), TaskContext.get().partitionId(), 0
        doc_ids, lengths, ids, n = [], [], [], 0

        def flush() -> pa.RecordBatch:
            payload = write_chunk(doc_ids, lengths, np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([n], pa.int64()), pa.array([payload], pa.binary())], names=["part", "chunk", "n_ids", "payload"])

        for b in batches:
            texts, known = b.column(1), b.column(0)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            i = 0
            while i < b.num_rows:
                till = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + words.BYTES, "right")))
                counts, found = words.encode(_plain(texts.slice(i, till - i)))
                ends, at = np.cumsum(counts), 0
                while at < len(counts):
                    base = ends[at - 1] if at else 0
                    fit = int(np.searchsorted(ends, base + CHUNK - n, "right"))
                    if fit <= at and n:
                        yield flush()
                        doc_ids, lengths, ids, n, chunk = [], [], [], 0, chunk + 1
                        continue
                    fit = max(fit, at + 1)
                    doc_ids += known.slice(i + at, fit - at).to_pylist()
                    lengths += counts[at:fit].tolist()
                    ids.append(found[base : ends[fit - 1]])
                    n += int(ends[fit - 1] - base)
                    at = fit
                i = till
        if n:
            yield flush()

    # rows without an id, or with one id, are told apart by their texts' hash, so they are dealt out like others
    order = [F.col("doc_id").asc_nulls_first(), F.col("mark").asc()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("mark"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return cut(rows.mapInArrow(run, "part int, chunk int, n_ids long, payload binary"), "token-chunks")


def _starts(chunks: DataFrame) -> DataFrame:
    """(part, chunk, start) of every chunk: sums inside groups of 1,024 parts, and of the groups, of which the driver holds one number each."""
    spark = chunks.sparkSession
    sizes = chunks.select("part", "chunk", "n_ids", F.shiftright("part", 10).alias("group"))
    totals, at, base = sizes.groupBy("group").agg(F.sum("n_ids").alias("n")).orderBy("group").collect(), 0, []
    for r in totals:
        base.append((r.group, at))
        at += r.n
    before = F.sum("n_ids").over(Window.partitionBy("group").orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1))
    inside = sizes.withColumn("inside", F.coalesce(before, F.lit(0)))
    of_group = F.broadcast(spark.createDataFrame(base, "group int, base long"))
    return inside.join(of_group, "group").select("part", "chunk", (F.col("base") + F.col("inside")).alias("start"))


def read(chunks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of a table of chunks; places inside a chunk come from it alone, and chunks' starts are joined to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                doc_ids, lengths, ids = read_chunk(b.column(2)[i].as_py())
                ends, n = np.cumsum(lengths.astype(np.int64)), len(doc_ids)
                raw, at = memoryview(ids.astype("<u4").tobytes()), [0, *(4 * ends).tolist()]
                crc = [zlib.crc32(raw[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)]
                place = [pa.array(np.full(n, b.column(k)[i].as_py(), np.int32)) for k in range(2)]
                yield pa.RecordBatch.from_arrays([*place, pa.array(doc_ids, pa.int64()), pa.array(ends - lengths, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "chunk", "doc_id", "inside", "n_tokens", "ids_crc32"])

    rows = chunks.select("part", "chunk", "payload").mapInArrow(run, "part int, chunk int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    starts = _starts(chunks)
    if chunks.count() <= BROADCAST_CHUNKS:
        starts = F.broadcast(starts)
    return rows.join(starts, ["part", "chunk"]).select("doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
