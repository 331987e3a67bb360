"""Language identification by prediction by partial matching.

Every language has a tree of byte contexts, up to ORDER bytes long, with counts of what
followed. A byte's code length is taken from the longest context: -log2 c/(n+d) if it was
seen there (c times of n, d different bytes), otherwise the escape's -log2 d/(n+d) and the
code length in the next shorter context; below all contexts a byte costs 8 bits. Contexts
a language has never seen escape for free. Counts are frozen, so each code length is a
constant, worked out once per gram for all languages. A text is in the language that
gives it the shortest code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.columns import drawn

ORDER = 3
#: About so many labelled documents of a language are learned from, drawn by a hash of their id.
SAMPLE = 4000
BLOCK = 1 << 20
_PAD = b"\0" * ORDER
_MASKS = [np.uint32((1 << (8 * (k + 1))) - 1) if k < 3 else np.uint32(0xFFFFFFFF) for k in range(ORDER + 1)]


def _parts(texts: list[str | None]) -> Iterator[list[tuple[int, bytes]]]:
    """Blocks of (row, bytes); the first ORDER bytes of each are context only. A text of
    any length is cut into parts."""
    block, size = [], 0
    for i, t in enumerate(texts):
        data = _PAD + (t or "").lower().encode()
        for at in range(ORDER, len(data), BLOCK):
            part = data[at - ORDER: at + BLOCK]
            block.append((i, part))
            size += len(part)
            if size >= BLOCK:
                yield block
                block, size = [], 0
    if block:
        yield block


def _grams(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ORDER+1 bytes that end at each position, and where each part's own bytes begin and end."""
    raw = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint32)
    grams = raw.copy()
    for k in range(1, ORDER + 1):
        grams[ORDER:] |= raw[ORDER - k: len(raw) - k] << np.uint32(8 * k)
    ends = np.cumsum([len(p) for p in parts])
    return grams, ends - [len(p) for p in parts] + ORDER, ends


class Slots:
    """Rows of distinct 32-bit keys, found by hashing with open addressing."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.last = np.int64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, dtype=np.uint32)
        self.rows = np.full(1 << bits, -1, dtype=np.int32)
        waiting, at = np.arange(len(keys)), self._first(keys)
        while len(waiting):
            free = self.rows[at] < 0
            _, one = np.unique(at[free], return_index=True)
            take = np.flatnonzero(free)[one]
            self.keys[at[take]] = keys[waiting[take]]
            self.rows[at[take]] = waiting[take]
            stay = np.ones(len(waiting), dtype=bool)
            stay[take] = False
            waiting, at = waiting[stay], (at[stay] + 1) & self.last

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 for unknown ones."""
        at = self._first(keys)
        rows = self.rows[at]
        left = np.flatnonzero((rows >= 0) & (self.keys[at] != keys))
        at = at[left]
        while len(left):
            at = (at + 1) & self.last
            r = self.rows[at]
            rows[left] = r
            go = (r >= 0) & (self.keys[at] != keys[left])
            left, at = left[go], at[go]
        return rows


class Model:
    """Code lengths, in bits, of every gram of 1 to ORDER+1 bytes that was seen.

    levels[k]: grams of k+1 bytes with their code lengths (a row per gram, a column per
    language; a row of zeros at the end), and contexts of k bytes with their escapes.
    """

    def __init__(self, langs: list[str], grams: np.ndarray, counts: np.ndarray):
        self.langs, self.levels = langs, []
        for k in range(ORDER + 1):
            keys, at = np.unique(grams & _MASKS[k], return_inverse=True)
            c = np.zeros((len(keys), len(langs)))
            np.add.at(c, at, counts)
            contexts, of = np.unique(keys >> np.uint32(8), return_inverse=True)
            n, d = np.zeros((2, len(contexts), len(langs)))
            np.add.at(n, of, c)
            np.add.at(d, of, (c > 0).astype(float))
            with np.errstate(divide="ignore", invalid="ignore"):
                bits = -np.log2(c / (n + d)[of])
                escape = np.where(n > 0, -np.log2(d / (n + d)), 0.0)
            lower = self._bits(keys, k - 1) if k else np.full(c.shape, 8.0)
            bits = np.where(c > 0, bits, escape[of] + lower).astype(np.float32)
            zero = np.zeros((1, len(langs)), dtype=np.float32)
            self.levels.append((Slots(keys), np.concatenate([bits, zero]),
                                Slots(contexts), np.concatenate([escape.astype(np.float32), zero])))

    def _bits(self, grams: np.ndarray, k: int) -> np.ndarray:
        """Code lengths of each gram's last byte in contexts of up to k bytes."""
        if k < 0:
            return np.full((len(grams), len(self.langs)), 8.0, dtype=np.float32)
        keys = grams & _MASKS[k]
        slots, bits, contexts, escapes = self.levels[k]
        rows = slots.find(keys)
        out = bits[rows]
        if len(new := np.flatnonzero(rows < 0)):
            out[new] = escapes[contexts.find(keys[new] >> np.uint32(8))] + self._bits(keys[new], k - 1)
        return out

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """The code length of each whole text in each language."""
        total = np.zeros((len(texts), len(self.langs)))
        for block in _parts(texts):
            grams, begin, end = _grams([p for _, p in block])
            bits = self._bits(grams, ORDER).astype(np.float64)
            bounds = np.stack([begin, end], 1).ravel()
            sums = np.add.reduceat(np.concatenate([bits, np.zeros((1, bits.shape[1]))]), bounds)[::2]
            np.add.at(total, [i for i, _ in block], sums)
        return total


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for block in _parts(texts):
            for lang in sorted({langs[i] for i, _ in block}):
                grams, begin, end = _grams([p for i, p in block if langs[i] == lang])
                own = np.concatenate([grams[a:b] for a, b in zip(begin, end)])
                keys, n = np.unique(own, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys)), pa.array(keys, pa.int64()), pa.array(n, pa.int64())],
                    names=["lang", "gram", "n"])


def trained(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from rows (key, lang, text), about `sample` of each language, whole texts.
    None if no row has both a language and a text with a byte."""
    labelled = labelled.where("lang is not null and text is not null and key is not null")
    many = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("many"))
    # a row per language, of which the model has a column each
    rows = labelled.join(F.broadcast(many), "lang").where(drawn("key", F.col("many"), sample)).select("lang", "text")
    grams = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = grams.toPandas()  # the grams of a bounded sample
    if not len(found):
        return None
    langs = sorted(found["lang"].unique())
    keys, at = np.unique(found["gram"].to_numpy().astype(np.uint32), return_inverse=True)
    counts = np.zeros((len(keys), len(langs)))
    counts[at, np.searchsorted(langs, found["lang"].to_numpy().astype(str))] = found["n"]
    return Model(langs, keys, counts)


def identified(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, lang_pred, score (0 to 1, its share of 2**-length among the
    model's languages).

    `und` with score 0 if the text is null or has no letter, or if the model is None. Ties go
    to the language that sorts first. Only the text decides, so rows that repeat agree; an
    empty table gives an empty result; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the grams of the sample

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            known = np.array([own is not None and t is not None and any(map(str.isalpha, t)) for t in texts], dtype=bool)
            best, score = ["und"] * len(texts), np.zeros(len(texts))
            if known.any():
                lengths = own.lengths(texts)
                least = lengths.min(1)
                share = 1 / np.exp2(np.clip(least[:, None] - lengths, -1000, 0)).sum(1)
                score = np.where(known, share, 0.0)
                best = [own.langs[k] if y else "und" for k, y in zip(lengths.argmin(1), known)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("t"))
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double")
