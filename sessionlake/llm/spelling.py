"""Spelling variants: words one edit apart, found in k-d trees over letter counts.

1. Words are counted over all texts.
2. One replaced letter changes one letter count by +1 and one by -1; one letter put in
   changes one by +1. So near words lie within L1 distance two, in the same length or the next.
3. Each length has a coarse k-d tree, fitted to a bounded sample of words, that cuts its words into
   cells. A word is stored in its cell and sent as a query to every cell whose
   box its counts can reach: of its own length, and of the next one. Cells with more words
   than a task should hold are cut into blocks, queries likewise.
4. In a cell, a finer tree prunes by boxes again, and the letters of the candidates are
   compared in order. A pair is found from one end only, in one cell.
5. Each task sums its pairs by word before they leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.llm import kdtree
from sessionlake.llm.columns import drawn
from sessionlake.workspace import scratch, written

#: Letters: a to z, and U+00C0 to U+00FF, as they are.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10
#: One in so many occurrences has a letter dropped.
DROP_ONE_IN = 31
#: Words the coarse trees are fitted to, and words of a cell.
SAMPLE, CELL = 200_000, 1 << 16
#: Stored words and queries of one task.
STORED, ASKED = 1 << 17, 1 << 19
LEAF = 8
QUERIES_AT_ONCE, LETTERS_AT_ONCE = 1 << 14, 1 << 24

_CODE = np.zeros(256, dtype=np.uint8)
_CODE[97:123] = np.arange(26)
_CODE[192:256] = np.arange(26, 90)
N_LETTERS = 90
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def occurrences(docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """One row (word) for each long enough run of letters, with A-Z as a-z, and the letter dropped
    where the hash of document and run says so."""
    runs = F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{LEAST_LETTERS},}}"), F.lit(0)))
    named = docs.select(F.coalesce(doc_id.cast("string"), F.lit("")).alias("id"), runs.alias("w"))
    lower = F.when(F.col("w").rlike("[A-Z]"), F.translate("w", _UPPER, _UPPER.lower())).otherwise(F.col("w"))
    hashed = named.select("id", lower.alias("w")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "w")))
    at = (F.col("h") % F.length("w")).cast("int")
    rest = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))
    word = F.when(F.col("h") % DROP_ONE_IN == 0, rest).otherwise(F.col("w"))
    return hashed.select(word.alias("word")).where(F.length("word") >= LEAST_LETTERS)


def letters(words: list[str]) -> np.ndarray:
    """The letters of words of one length, as numbers."""
    return _CODE[np.frombuffer("".join(words).encode("latin-1"), np.uint8)].reshape(len(words), -1)


def counts(codes: np.ndarray) -> np.ndarray:
    """The letter counts of words."""
    n = len(codes)
    at = codes + np.arange(n)[:, None] * N_LETTERS
    return np.bincount(at.ravel(), minlength=n * N_LETTERS).reshape(n, N_LETTERS).astype(np.int32)


def coarse_trees(sample: list[str], of_words: int) -> dict[int, kdtree.Tree]:
    """A tree for each length that has more words than a cell, by its share of the sample."""
    by_length: dict[int, list[str]] = {}
    for w in sample:
        by_length.setdefault(len(w), []).append(w)
    most = max(1, CELL * len(sample) // max(of_words, 1))
    return {n: kdtree.build(counts(letters(own)), most) for n, own in by_length.items() if len(own) > most}


def _cells(batches: Iterator[pa.RecordBatch], trees: dict[int, kdtree.Tree]) -> Iterator[pa.RecordBatch]:
    """Each word in its cell (role 0), and as a query in the cells of its length (1) and the next (2)."""
    for batch in batches:
        words = batch.column(0).to_pylist()
        n = np.array([len(w) for w in words])
        for length in np.unique(n):
            own = np.flatnonzero(n == length)
            v = None
            found = []
            for role, to in ((0, length), (1, length), (2, length + 1)):
                if to not in trees:
                    found.append((role, to, np.arange(len(own)), np.zeros(len(own), np.int64)))
                    continue
                v = counts(letters([words[i] for i in own])) if v is None else v
                at = (np.arange(len(own)), kdtree.home(trees[to], v)) if role == 0 else kdtree.near(trees[to], v, role == 1)
                found.append((role, to, *at))
            rows = pa.array(own[np.concatenate([f[2] for f in found])])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([np.full(len(f[2]), f[1], np.int32) for f in found])),
                pa.array(np.concatenate([f[3] for f in found])),
                pa.array(np.concatenate([np.full(len(f[2]), f[0], np.int8) for f in found])),
                batch.column(0).take(rows), batch.column(1).take(rows)], names=["length", "cell", "role", "word", "n"])


def one_edit(short: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which rows of letters become those of `other` by one edit: a letter put in where `other` is
    longer, else a letter replaced by an earlier one."""
    if short.shape[1] == other.shape[1]:
        differ = short != other
        at = differ.argmax(1)
        rows = np.arange(len(short))
        return (differ.sum(1) == 1) & (other[rows, at] < short[rows, at])
    ahead = np.logical_and.accumulate(short == other[:, :-1], axis=1).sum(1)
    behind = np.logical_and.accumulate((short == other[:, 1:])[:, ::-1], axis=1).sum(1)
    return ahead + behind >= short.shape[1]


def _pairs(stored: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (of asked, of stored) whose words are one edit apart."""
    tree = kdtree.build(counts(stored), LEAF)
    at_once = max(1, min(QUERIES_AT_ONCE, LETTERS_AT_ONCE // asked.shape[1]))
    for begin in range(0, len(asked), at_once):
        own = asked[begin:begin + at_once]
        q, leaf = kdtree.near(tree, counts(own), stored.shape[1] == asked.shape[1])
        n = tree.end[leaf] - tree.begin[leaf]
        upto = np.cumsum(n)
        at, step = 0, max(1, LETTERS_AT_ONCE // stored.shape[1])
        while at < len(n):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + step, "right")))
            k = n[at:stop]
            place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(tree.begin[leaf[at:stop]], k)
            a, b = np.repeat(q[at:stop], k), tree.rows[place]
            good = one_edit(own[a], stored[b])
            yield a[good] + begin, b[good]
            at = stop


def _searched(rows: pd.DataFrame) -> pd.DataFrame:
    """Near words within a unit of one cell, summed by word: their number and the one of largest n."""
    role, word, n = rows["role"].to_numpy(), rows["word"].to_numpy(), rows["n"].to_numpy()
    stored = np.flatnonzero(role == 0)
    found = []
    for asking in (1, 2):
        asked = np.flatnonzero(role == asking)
        if len(stored) and len(asked):
            for a, b in _pairs(letters(word[stored].tolist()), letters(word[asked].tolist())):
                found.append((asked[a], stored[b]))
    a, b = (np.concatenate([np.zeros(0, np.int64), *[f[i] for f in found]]) for i in (0, 1))
    involved = np.unique(np.concatenate([a, b]))
    names, at = np.unique(word[involved].astype(str), return_inverse=True)
    rank = np.zeros(len(rows), np.int64)
    rank[involved] = at
    count = np.zeros(len(names), np.int64)
    count[at] = n[involved]
    own, other = rank[np.concatenate([a, b])], rank[np.concatenate([b, a])]
    order = np.lexsort((other, -count[other], own))
    own, other = own[order], other[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, int)
    return pd.DataFrame({
        "word": names[own[first]].astype(object), "n_near": np.diff(np.append(first, len(own))),
        "best_n": count[other[first]], "best": names[other[first]].astype(object)})


def near_words(words: DataFrame) -> DataFrame:
    """For each word of a table (word, n) of distinct words that has near ones: word, n_near, best_n, best.

    Words are made of `LETTERS` in lower case. Near is one code point put in, taken out or
    replaced. `best` is the near word of largest n, the smallest by code point of several.
    """
    total = words.count()
    kept = words.where(drawn("word", F.lit(max(total, 1)), SAMPLE))
    sample = [r.word for r in kept.select("word").collect()]
    trees = coarse_trees(sample, total)
    placed = written(words.mapInArrow(
        lambda b: _cells(b, trees), "length int, cell long, role byte, word string, n long"), "cells")
    per_cell = placed.groupBy("length", "cell").agg(
        F.ceil(F.count_if(F.col("role") == 0) / STORED).alias("stored"),
        F.ceil(F.count_if(F.col("role") > 0) / ASKED).alias("asked")).where("stored > 0 and asked > 0")
    met = placed.join(per_cell, ["length", "cell"])
    is_stored = F.col("role") == 0
    own = F.pmod(F.xxhash64("word"), F.when(is_stored, F.col("stored")).otherwise(F.col("asked")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.when(is_stored, F.col("asked")).otherwise(F.col("stored")) - 1))
    dealt = met.select("length", "cell", "role", "word", "n", own.alias("own"), every.alias("other"))
    units = dealt.select(
        "length", "cell", F.when(is_stored, F.col("own")).otherwise(F.col("other")).alias("s"),
        F.when(is_stored, F.col("other")).otherwise(F.col("own")).alias("a"), "role", "word", "n")
    found = units.groupBy("length", "cell", "s", "a").applyInPandas(
        _searched, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    summed = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return summed.select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def with_roots(forms: DataFrame, most_n: int) -> DataFrame:
    """Follow forms to the last; forms: (word, form, ...) with a form that is at least `TIMES` times
    as frequent, so a chain has at most as many steps as `most_n`, the largest count, has digits."""
    jumps = written(forms.select("word", F.col("form").alias("root")), "jumps")
    reach = 1
    while TIMES**reach <= most_n:
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumps = written(jumps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "jumps")
        reach *= 2
    return jumps


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The words of all texts with the more frequent spelling they are one edit away from.

    Returns word, n, n_near, form, form_n, root; `root` is where the forms end, the word itself
    without one. Words have at least `LEAST_LETTERS` letters and `LEAST_COUNT` occurrences. Null and
    empty texts have no words; a null id counts as an empty one in the hash that drops letters;
    rows that repeat count each. Ties go to the smallest word by code point. An empty table gives an
    empty result. Other columns of docs are not looked at. The result is a table of its own.
    """
    with scratch(docs.sparkSession):
        seen = occurrences(docs, F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
        words = written(seen.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT), "words")
        near = words.join(near_words(words), "word", "left")
        has_form = F.col("best_n") >= TIMES * F.col("n")
        found = written(near.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has_form, F.col("best")).alias("form"), F.when(has_form, F.col("best_n")).alias("form_n")), "near")
        most = words.agg(F.max("n")).first()[0] or 0
        roots = with_roots(found.where("form is not null"), most)
        named = found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
        return written(named, "variants", lasting=True)
