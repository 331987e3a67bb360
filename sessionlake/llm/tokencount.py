"""Token counts of whole texts, huge ones in overlapping chunks.

A document up to CHUNK characters is counted as it is. A longer one is cut into
chunks that overlap. Two neighbours are spliced where both have a token that starts at
the same stable place: white space right behind another character. There a word of the
tokenizer's pattern always ends, whatever stands before it or after it, so the tokens on
either side do not depend on the other. If an overlap has no such place it is widened.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 15
OVERLAP = 256
#: Runs whose counts a Python worker remembers.
REMEMBERED = 700_000

#: ASCII characters that are neither letters, digits nor white space: side by side they are one word.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_MARKS = MARKS.decode()
_UNSTABLE = re.compile(r"\s ")


@cache
def tokenizer(path: str):
    """The tokenizer of a file, loaded once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _starts(encode, text: str, begin: int, end: int) -> list[int]:
    return [begin + a for a, _ in encode(text[begin:end])]


def spliced(text: str, encode, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Where each token of the text begins. encode(part) gives the (start, end) of its tokens."""
    starts, begin, done = [], 0, 0
    current = _starts(encode, text, 0, min(chunk + overlap, len(text)))
    while True:
        ahead = begin + chunk  # where the next chunk begins
        if ahead + overlap >= len(text):
            return starts + [p for p in current if p >= done]
        following = _starts(encode, text, ahead, min(ahead + chunk + overlap, len(text)))
        wide, have = overlap, current
        while True:
            there = set(have)
            until = ahead + wide
            meet = next((p for p in following if ahead < p < until and p in there
                         and text[p].isspace() and not text[p - 1].isspace()), None)
            if meet is not None:
                break
            wide *= 2
            end = min(ahead + wide, len(text))
            have = _starts(encode, text, begin, end)
            if end == len(text):
                return starts + [p for p in have if p >= done]
            if wide > chunk:
                following = _starts(encode, text, ahead, min(ahead + chunk + 2 * wide, len(text)))
        starts += [p for p in have if done <= p < meet]
        done, begin, current = meet, ahead, following


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones
    for themselves, the others by place from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


class Runs:
    """Token counts of texts, from remembered counts of the runs between stable places.

    A space right behind another character than white space is such a place, so a text is
    cut there, and each run is counted with the space before it. A new run of letters goes to
    the tokenizer's model as one word, marks behind it are another; other new runs are encoded. A text with white space before a space is encoded as it is.
    """

    def __init__(self, own, remembered: int):
        self.own, self.model, self.most = own, own.model, remembered
        self.letters = byte_letters()
        self.known: dict[str, int] = {}
        self.marks: dict[str, int] = {"": 0}

    def _word(self, run: str) -> int:
        plain = run if run.isascii() else "".join([self.letters[b] for b in run.encode()])
        return len(self.model.tokenize(self.letters[32] + plain))

    def _whole(self, text: str) -> int:
        return len(self.own.encode(text, add_special_tokens=False))

    def _learn(self, runs: list[str]) -> None:
        if len(self.known) + len(runs) > self.most:
            self.known.clear()
        for r in runs:
            word = r.rstrip(_MARKS)
            if word.isalpha():
                behind = r[len(word):]
                if behind not in self.marks:
                    if len(self.marks) > self.most:
                        self.marks = {"": 0}
                    self.marks[behind] = self._whole(behind)
                self.known[r] = self._word(word) + self.marks[behind]
            else:
                self.known[r] = self._whole(" " + r)

    def of(self, texts: list[str]) -> list[int]:
        cut = [None if t[:1] == " " or _UNSTABLE.search(t) else t.split(" ") for t in texts]
        distinct = set()
        for runs in cut:
            distinct.update(runs[1:] if runs else ())
        unknown = [r for r in distinct if r not in self.known]
        if len(self.known) + len(unknown) > self.most:
            unknown = list(distinct)
        self._learn(unknown)
        count = self.known.__getitem__
        return [self._whole(t) if runs is None else self._whole(runs[0]) + sum(map(count, runs[1:]))
                for t, runs in zip(texts, cut)]


@cache
def _runs(path: str) -> Runs:
    return Runs(tokenizer(path), REMEMBERED)


def _counts(batches: Iterator[pa.RecordBatch], path: str, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    own = tokenizer(path)

    def encode(part: str) -> list[tuple[int, int]]:
        return own.encode(part, add_special_tokens=False).offsets

    runs = _runs(path)
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        n = []
        for at in range(0, len(texts), 256):
            some = texts[at:at + 256]
            short = iter(runs.of([t for t in some if len(t) <= chunk]))
            n += [next(short) if len(t) <= chunk else len(spliced(t, encode, chunk, overlap)) for t in some]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64())],
            names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_bytes (UTF-8), n_tokens as the tokenizer file at `path` gives
    them, without added special tokens, and over_limit (n_tokens > limit).

    A null text counts as empty: no bytes, no tokens. Rows are counted each by itself, a null
    id is kept, an empty table gives an empty result; other columns are not looked at.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("t"))
    counted = rows.mapInArrow(
        lambda b: _counts(b, path, chunk, overlap), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
