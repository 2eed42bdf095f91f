"""Language ID with hyperdimensional profiles.

Every letter of every script has a random +1/-1 vector, drawn from its code point.  A
trigram binds the letters' vectors, rotated by their place; a document bundles (adds)
its trigrams; a language bundles its documents.  A document gets the language whose
prototype has the largest cosine with its own vector, after the mean prototype is
taken from both.

Training takes a hash-chosen sample of about TRAIN_DOCUMENTS labelled rows outside
the held-out fold (a documented bound); their vectors are summed where they are, so
only languages x DIMENSIONS numbers reach the driver.

Defined results: null text or text without a letter is `und` with score 0; a table
without a usable label predicts `und`; a null lang is not learned; texts of any
length count whole; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

DIMENSIONS, SEED = 512, 20
TRAIN_DOCUMENTS = 30_000
#: Trigrams whose vectors a task remembers (64 MB), and that it adds up at once.
KNOWN, ADDED = 32_768, 8192


class Profiles:
    """Turns texts into bundled trigram vectors; letter and trigram vectors are made as they are met, and do not hang on what was met before."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {0: self._drawn(0)}
        self.place: dict[int, int] = {}
        self.vectors = np.empty((KNOWN, dimensions), np.float32)
        self.known = np.zeros(0x110000, bool)
        self.is_letter = np.zeros(0x110000, bool)

    def _drawn(self, code: int) -> np.ndarray:
        return np.random.default_rng((self.seed, code)).choice(np.array([-1.0, 1.0], np.float32), self.dimensions)

    def _symbols(self, text: str) -> np.ndarray:
        """Code points of the lower-cased text, 0 for what is no letter."""
        code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        for c in np.unique(code[~self.known[code]]).tolist():
            self.known[c] = True
            self.is_letter[c] = chr(c).isalpha()
        return np.where(self.is_letter[code], code, 0).astype(np.int64)

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = self._drawn(code)
        return self.letters[code]

    def _vectors(self, grams: list[int]) -> np.ndarray:
        new = [g for g in grams if g not in self.place]
        if len(self.place) + len(new) > KNOWN:
            self.place.clear()
            new = grams
        for g in new:
            a, b, c = (self._letter(x) for x in (g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF))
            self.place[g] = at = len(self.place)
            self.vectors[at] = np.roll(a, 2) * np.roll(b, 1) * c
        return self.vectors[[self.place[g] for g in grams]]

    def of(self, text: str | None) -> np.ndarray | None:
        """The text's vector of length 1; None without a letter."""
        if not text:
            return None
        s = self._symbols(text)
        if not s.any():
            return None
        s = np.concatenate([[0], s, [0]])
        s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]  # runs of other characters count once
        if len(s) < 3:
            s = np.concatenate([s, [0]])
        grams, n = np.unique(s[:-2] << 42 | s[1:-1] << 21 | s[2:], return_counts=True)
        v = np.zeros(self.dimensions, np.float32)
        for i in range(0, len(grams), ADDED):
            v += n[i : i + ADDED].astype(np.float32) @ self._vectors(grams[i : i + ADDED].tolist())
        return v / max(float(np.linalg.norm(v)), 1e-9)


def train(docs: DataFrame, most: int = TRAIN_DOCUMENTS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, from about `most` labelled rows chosen by a hash of the id."""
    usable = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    n = usable.count()
    part = F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id")), F.lit(1 << 20)) < int(min(1.0, most / max(n, 1)) * (1 << 20))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, total = Profiles(), {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (v := profiles.of(text)) is not None:
                    total[lang] = total.get(lang, 0) + v.astype(np.float64)
        if total:
            yield pa.RecordBatch.from_pydict({"lang": list(total), "v": [x.tolist() for x in total.values()]}, schema=pa.schema([("lang", pa.string()), ("v", pa.list_(pa.float64()))]))

    rows = usable.filter(part).select("text", "lang").mapInArrow(sums, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    got = rows.groupBy("lang", "i").agg(F.sum("x").alias("x")).collect()
    langs = sorted({r.lang for r in got})
    proto = np.zeros((len(langs), DIMENSIONS), np.float64)
    for r in got:
        proto[langs.index(r.lang), r.i] = round(r.x, 6)
    return langs, proto / np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-9)


def predict(docs: DataFrame, langs: list[str], proto: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    mean = proto.mean(axis=0) if len(langs) > 1 else np.zeros(DIMENSIONS)
    apart = proto - mean
    apart = (apart / np.maximum(np.linalg.norm(apart, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    mean = mean.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles()
        for b in batches:
            pred, score = [], []
            for text in b.column(2).to_pylist():
                v = profiles.of(text) if langs else None
                if v is None:
                    pred.append("und")
                    score.append(0.0)
                else:
                    v = v - mean
                    cos = apart @ v / max(float(np.linalg.norm(v)), 1e-9)
                    k = int(np.argmax(cos))
                    pred.append(langs[k])
                    score.append(min(1.0, max(0.0, round(float(cos[k]), 6))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text", "lang")
    return predict(docs, *train(docs))
