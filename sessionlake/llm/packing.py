"""Harmonic packing of tokenized documents into sequences of a fixed capacity.

A length in (C/(k+1), C/k] belongs to class k, and k pieces of that class fill one
sequence. A document is first cut into full sequences; its rest is cut so that all pieces
but one have exactly a class's greatest length. Each worker fills the sequences of a class
by itself, k pieces at a time. What does not fill a sequence is dealt to fewer workers
again and again, until one worker's rest of each class is left: a number of pieces that
the classes bound. These are packed first-fit, longest first.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.llm.tokencount import MARKS, byte_letters, tokenizer
from sessionlake.workspace import written

CAPACITY = 2048
END_ID = 1
#: Tokens of padding that one more cut must save.
CUT_COST = 8
#: Pieces of a class that one worker fills, and sequences at least, so that few are left over.
PER_WORKER, LEAST_FILLED = 2000, 16
#: Words whose ids a Python worker remembers.
REMEMBERED = 700_000


def classes(capacity: int = CAPACITY) -> list[int]:
    """1 to 32, then doubling, so that single tokens have a class too."""
    many = [k for k in range(1, 33) if k <= capacity]
    while many[-1] * 2 <= capacity:
        many.append(many[-1] * 2)
    return many


@cache
def cuts(capacity: int = CAPACITY) -> tuple[list[int], list[tuple[int, ...]]]:
    """For each length below the capacity: its class, and the pieces to cut it into."""
    ks = classes(capacity)
    most = {k: capacity // k for k in ks}
    kind = [0] + [max(k for k in ks if most[k] >= n) for n in range(1, capacity + 1)]
    cost, pieces = [0], [()]
    for n in range(1, capacity):
        best = (most[kind[n]] - n, (n,))
        for k in ks:
            if most[k] < n:
                best = min(best, (CUT_COST + cost[n - most[k]], (most[k], *pieces[n - most[k]])))
        cost.append(best[0])
        pieces.append(best[1])
    return kind, pieces


class Ids:
    """Token ids of whole texts, as little-endian 32-bit bytes.

    The tokenizer's words never hold white space, so a text's ids are those of its runs of
    other characters, one after another. Runs are remembered. A new run of letters is one
    word of the tokenizer's pattern and goes to its model, marks behind it are another; other new runs are encoded together, divided by a special token that no run holds.
    """

    def __init__(self, path: str, remembered: int):
        self.own, self.most, self.known = tokenizer(path), remembered, {}
        self.model, self.normal, self.letters = self.own.model, self.own.normalizer, byte_letters()
        added = self.own.get_added_tokens_decoder()
        self.mark_id = min(added, default=None)
        self.mark = added[self.mark_id].content if added else None
        self.special = [t.content.encode() for t in added.values()]

    def _word(self, run: bytes) -> bytes | None:
        """Ids of a run that is one word, None if it may be more."""
        if run.isalpha():  # ASCII letters
            word = run.lower().decode()
        else:
            text = run.decode()
            if not text.isalpha():
                return None
            # composed letters that change case one by one need no normalizer
            text = text.lower() if max(text) < "\u0250" else self.normal.normalize_str(text)
            if not text.isalpha():
                return None
            word = "".join([self.letters[b] for b in text.encode()])
        ids = [t.id for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, runs: list[bytes]) -> None:
        if len(self.known) + len(runs) > self.most:
            self.known.clear()
        plain = []
        for r in runs:
            word = r.rstrip(MARKS)
            ids = self._word(word) if word else None
            if ids is not None and len(word) < len(r):
                stops = r[len(word):]
                if stops not in self.known:
                    self._encode([stops])
                ids += self.known[stops]
            if ids is not None:
                self.known[r] = ids
            elif self.mark is None or any(s in r for s in self.special):
                found = self.own.encode(r.decode(), add_special_tokens=False).ids
                self.known[r] = np.array(found, dtype="<u4").tobytes()
            else:
                plain.append(r)
        for at in range(0, len(plain), 500):
            self._encode(plain[at:at + 500])

    def _encode(self, part: list[bytes]) -> None:
        if self.mark is None:
            for r in part:
                self.known[r] = np.array(self.own.encode(r.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
            return
        text = self.mark.join(r.decode() for r in part)
        ids = np.array(self.own.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
        data, begin = ids.tobytes(), 0
        for r, end in zip(part, ends.tolist()):
            self.known[r] = data[4 * begin: 4 * end]
            begin = end + 1

    def of(self, texts: list[str | None]) -> Iterator[bytes]:
        runs = [(t or "").encode().split() for t in texts]
        distinct = set()
        for r in runs:
            distinct.update(r)
        if unknown := [r for r in distinct if r not in self.known]:
            if len(self.known) + len(unknown) > self.most:
                unknown = list(distinct)
            self._learn(unknown)
        for r in runs:
            yield b"".join(map(self.known.__getitem__, r))


@cache
def _ids(path: str, remembered: int) -> Ids:
    return Ids(path, remembered)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    kind, rest = cuts(capacity)
    last = np.array([end_id], dtype="<u4").tobytes()
    own = _ids(path, REMEMBERED)
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at in range(0, len(texts), 256):
            out = []
            for doc_id, ids in zip(keys[at:at + 256], own.of(texts[at:at + 256])):
                ids += last
                n = len(ids) // 4
                start = 0
                for length in (*[capacity] * (n // capacity), *rest[n % capacity]):
                    crc = zlib.crc32(ids[4 * start: 4 * (start + length)])
                    out.append((doc_id, start, length, crc, n, kind[length]))
                    start += length
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*out)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "k"])


def _first_fit(pieces: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Into the first sequence with room, longest piece first. At most k - 1 pieces a class."""
    pieces = pieces.sort_values(["length", "uid"], ascending=[False, True], kind="stable")
    used, where, offset = [], [], []
    for n in pieces["length"]:
        i = next((i for i, u in enumerate(used) if u + n <= capacity), len(used))
        if i == len(used):
            used.append(0)
        where.append(i)
        offset.append(used[i])
        used[i] += n
    return pieces.assign(sequence_id=np.array(where, dtype=np.int64), offset=np.array(offset, dtype=np.int64))


OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document of docs, with `end_id` behind its ids, by the tokenizer file at `path`.

    Returns one row per piece: doc_id, start (its document's ids before it), length,
    ids_crc32 (of the ids as unsigned little-endian 32-bit values), doc_tokens (with the end
    id), sequence_id, offset (in the sequence, gapless from 0). The capacity must be a power
    of two. A null text counts as empty and is one piece of one id; a null id is kept. Repeated
    rows are packed once each. An empty table gives an empty result.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("t"))
    pieces = rows.mapInArrow(
        lambda b: _pieces(b, path, capacity, end_id),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, k long")
    left = written(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")

    done, turn = None, 1
    while True:
        counts = left.groupBy("k").count()
        workers = F.ceil(F.col("count") / F.greatest(F.lit(PER_WORKER), LEAST_FILLED * F.col("k")))
        most = counts.agg(F.max(workers)).first()[0]
        if most is None:
            break
        dealt = left.join(F.broadcast(counts.select("k", workers.alias("workers"))), "k")  # a row per class
        dealt = dealt.withColumn("worker", F.pmod(F.xxhash64("uid", F.lit(turn)), F.col("workers")))
        group = Window.partitionBy("k", "worker")
        dealt = dealt.withColumns({
            "place": F.row_number().over(group.orderBy("uid")) - 1, "of": F.count(F.lit(1)).over(group)})
        dealt = dealt.withColumn("bin", F.floor(F.col("place") / F.col("k")))
        before = Window.partitionBy("k", "worker", "bin").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        dealt = dealt.withColumns({
            "offset": F.coalesce(F.sum("length").over(before), F.lit(0)),
            "full": (F.col("bin") + 1) * F.col("k") <= F.col("of"),
            # a turn, a class, a worker and its bin, side by side
            "sequence_id": F.lit(turn << 58) + F.col("k") * (1 << 46) + F.col("worker") * (1 << 16) + F.col("bin")})
        dealt = written(dealt, "dealt")
        full = dealt.where("full").select(*OUT)
        done = full if done is None else done.unionByName(full)
        left = dealt.where("not full").select(*left.columns)
        turn += 1
        if most == 1:
            break
    schema = ", ".join(f"{n} {t}" for n, t in left.dtypes) + ", sequence_id long, offset long"
    rest = left.groupBy(F.col("k") * 0).applyInPandas(lambda p: _first_fit(p, capacity), schema).select(*OUT)
    return rest if done is None else done.unionByName(rest)
