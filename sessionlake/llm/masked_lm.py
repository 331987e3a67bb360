"""Document scores by masked pseudo-likelihood.

A small network predicts every word from the two words before and the two behind it:
position-wise embeddings are summed, squashed, and give first the class of the word, then
the word in its class. A document's score is the sum of the words' conditional log
probabilities.

The network's words are those that occur often in the whole corpus, and hashed groups of
all others; the number of classes follows from theirs. Within its group a rare word is
charged its own share, its count over the group's. Counts of the more frequent words are
sent to every task; those of all others are joined. The output starts from the words'
frequencies. Each task trains the network on its own share of the
documents, and the tasks' networks are averaged, weighted by the words they learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isqrt, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.shingles import blocks, word_hashes
from sessionlake.workspace import written

#: Classes at least and at most; as many ids as their square.
CLASSES, MOST_CLASSES = 32, 64
VOCABULARY = CLASSES * CLASSES
#: A word that occurs so often asks for an id of its own.
OFTEN = 100
#: Ids at the end that stand for all rarer words, by hash.
RARE = 64
#: Words at most whose counts are sent to every task.
KNOWN = 1 << 19
DIM = 16
OFFSETS = (-2, -1, 1, 2)
#: Words of a step at first and at most; a sixteenth of what was learned from between these.
STEP, LARGEST_STEP, RATE = 1024, 8192, 0.1
WINDOWS = 1 << 15
#: Log counts are added in fractions of this.
UNIT = 1 << 32


def _docs(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of rows a to b: word hashes, and where each row's words begin (b - a + 1 places)."""
    for a, b in blocks(texts):
        encoded = [(t or "").encode("utf-8", "replace") for t in texts[a:b]]
        starts = np.cumsum([0] + [len(e) + 1 for e in encoded])
        words, places = word_hashes(b"\n".join(encoded))
        yield a, b, words, np.searchsorted(places, starts)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(words, return_counts=True) for _, _, words, _ in _docs(batch.column(0).to_pylist())]
        keys, at = np.unique(np.concatenate([k for k, _ in found] or [np.zeros(0, np.uint64)]), return_inverse=True)
        n = np.bincount(at, np.concatenate([c for _, c in found] or [np.zeros(0)]), len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["word", "n"])


def _group(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(RARE)).astype(np.int64)


class Vocabulary:
    """Ids of word hashes: frequent words in order of frequency, then the groups of rare ones.

    words, counts: all words that occur more than some number of times. groups: the count
    of all words by their group, were they rare. rest: the counts (word, n) of other words.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, groups: np.ndarray, rest: DataFrame | None = None):
        self.rest = rest
        often = int((counts >= OFTEN).sum())
        self.classes = min(MOST_CLASSES, max(CLASSES, DIM * ceil(sqrt(often + RARE) / DIM)))
        self.size = self.classes ** 2
        first = np.lexsort((words, -counts))
        own = first[: self.size - RARE]
        groups = groups - np.bincount(_group(words[own]), counts[own], RARE)
        self.frequency = np.full(self.size, 0.5)
        self.frequency[: len(own)] += counts[own]
        self.frequency[self.size - RARE:] += groups
        ids = self.size - RARE + _group(words)
        ids[own] = np.arange(len(own))
        # a word that is not counted is charged like one that occurs once
        self.unseen = -np.log(groups + 1)
        share = np.log(np.maximum(counts, 1)) + self.unseen[_group(words)]
        share[own] = 0
        order = np.argsort(words)
        self.words, self.ids, self.share = words[order], ids[order].astype(np.int32), share[order].astype(np.float32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rest": None}

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Id and log share within the id of each word, and whether its count is known."""
        distinct, back = np.unique(hashes, return_inverse=True)
        group = _group(distinct)
        ids, share = (self.size - RARE + group).astype(np.int32), self.unseen[group]
        known = np.zeros(len(distinct), dtype=bool)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, distinct), len(self.words) - 1)
            known = self.words[at] == distinct
            ids, share = np.where(known, self.ids[at], ids), np.where(known, self.share[at], share)
        return ids[back], share[back], known[back]


class Network:
    """All weights in one array of rows of DIM values, so that networks can be averaged."""

    @staticmethod
    def parts(classes: int) -> tuple[int, ...]:
        """Rows of each part: embeddings by offset, output rows of the classes and of the words, and their biases."""
        size = classes * classes
        return len(OFFSETS) * (size + 1), classes, size, classes // DIM, size // DIM

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.classes = n = next(c for c in range(DIM, len(rows) + DIM, DIM) if sum(self.parts(c)) >= len(rows))
        ends = np.cumsum((0, *self.parts(n)))
        e, c, w, bc, bw = (rows[a:b] for a, b in zip(ends[:-1], ends[1:]))
        self.embed = e.reshape(len(OFFSETS), n * n + 1, DIM)
        self.by_class, self.by_word = c, w.reshape(n, n, DIM)
        self.class_bias, self.word_bias = bc.reshape(n), bw.reshape(n, n)

    @classmethod
    def first(cls, frequency: np.ndarray, seed: int = 1) -> Network:
        n = isqrt(len(frequency))
        rows = np.random.default_rng(seed).normal(0, 0.1, (sum(cls.parts(n)), DIM)).astype(np.float32)
        new = cls(rows)
        by_class = frequency.reshape(n, n)
        new.class_bias[:] = np.log(by_class.sum(1) / frequency.sum())
        new.word_bias[:] = np.log(by_class / by_class.sum(1, keepdims=True))
        return new

    def _hidden(self, context: np.ndarray) -> np.ndarray:
        total = self.embed[0][context[0]]
        for k in range(1, len(OFFSETS)):
            total += self.embed[k][context[k]]
        return np.tanh(total, out=total)

    @staticmethod
    def _powers(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp(logits) in their place, and its sum by row."""
        np.clip(logits, -80, 80, out=logits)
        np.exp(logits, out=logits)
        return logits, logits @ np.ones(logits.shape[1], np.float32)

    def _by_class(self, ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """An order of the ids in which each class is a slice."""
        kind = (ids // self.classes).astype(np.int16)
        order = np.argsort(kind, kind="stable")
        ends = np.searchsorted(kind[order], np.arange(self.classes + 1)).tolist()
        return order, [(c, slice(ends[c], ends[c + 1])) for c in range(self.classes) if ends[c] < ends[c + 1]]

    def log_probability(self, context: np.ndarray, ids: np.ndarray) -> np.ndarray:
        order, classes = self._by_class(ids)
        h, own, every = self._hidden(context[:, order]), ids[order] % self.classes, np.arange(len(ids))
        e, total = self._powers(h @ self.by_class.T + self.class_bias)
        p = np.empty(len(ids), np.float32)
        for c, at in classes:
            q, within = self._powers(h[at] @ self.by_word[c].T + self.word_bias[c])
            p[at] = np.log(e[at, c] / total[at]) + np.log(q[every[:len(q)], own[at]] / within)
        out = np.empty(len(ids))
        out[order] = p
        return out

    def learn(self, context: np.ndarray, ids: np.ndarray, squares: Network) -> None:
        """One step of Adagrad on a batch; `squares` holds the summed squared gradients."""
        order, classes = self._by_class(ids)
        context, own, every = context[:, order], ids[order] % self.classes, np.arange(len(ids))
        rate, ones = np.float32(1 / len(ids)), np.ones(len(ids), np.float32)
        h = self._hidden(context)
        e, total = self._powers(h @ self.by_class.T + self.class_bias)
        e *= (1 / total)[:, None]
        for c, at in classes:
            e[at, c] -= 1
        back = e @ self.by_class
        self._descend(squares, "by_class", slice(None), (e.T @ h) * rate)
        self._descend(squares, "class_bias", slice(None), (ones @ e) * rate)
        for c, at in classes:
            q, within = self._powers(h[at] @ self.by_word[c].T + self.word_bias[c])
            q *= (1 / within)[:, None]
            q[every[:len(q)], own[at]] -= 1
            back[at] += q @ self.by_word[c]
            self._descend(squares, "by_word", c, (q.T @ h[at]) * rate)
            self._descend(squares, "word_bias", c, (ones[:len(q)] @ q) * rate)
        back *= (1 - h * h) * rate
        for k in range(len(OFFSETS)):
            # only rows that stand in the context have a gradient: their positions side by side, summed by word
            order = np.argsort(context[k].astype(np.int16), kind="stable")
            words = context[k][order]
            first = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
            self._descend(squares, "embed", (k, words[first]), np.add.reduceat(back[order], first, axis=0))

    def _descend(self, squares: Network, part: str, at: object, gradient: np.ndarray) -> None:
        sums = getattr(squares, part)
        sums[at] += gradient * gradient
        getattr(self, part)[at] -= RATE * gradient / np.sqrt(sums[at] + np.float32(1e-6))


def _windows(ids: np.ndarray, cut: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with two pads between documents, and where each word now stands."""
    reach = max(OFFSETS)
    doc = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    at = np.arange(len(ids)) + reach * (doc + 1)
    padded = np.full(len(ids) + reach * len(cut), pad, dtype=np.int32)
    padded[at] = ids
    return padded, at


def _trained(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, one_in: int) -> Iterator[pa.RecordBatch]:
    net = Network.first(vocabulary.frequency)
    squares, learned = Network(np.full_like(net.rows, 1e-4)), 0
    left: tuple[list, list] = ([], [])
    held = 0

    def flush():
        nonlocal held
        if held:
            context, ids = np.concatenate(left[0], 1), np.concatenate(left[1])
            net.learn(context, ids, squares)
            left[0].clear()
            left[1].clear()
            held = 0

    for batch in batches:
        for _, _, words, cut in _docs(batch.column(0).to_pylist()):
            sizes = np.diff(cut)
            own = np.add.reduceat(np.append(words, np.uint64(0)), cut[:-1]) if len(sizes) else np.zeros(0, np.uint64)
            take = (sizes > 0) & ((own >> np.uint64(20)) % np.uint64(one_in) == 0)
            words = words[np.repeat(take, sizes)]
            ids = vocabulary.of(words)[0]
            padded, at = _windows(ids, np.append(0, np.cumsum(sizes[take])), vocabulary.size)
            a = 0
            while a < len(at):
                step = min(LARGEST_STEP, max(STEP, learned // 16))
                part = at[a:a + max(1, step - held)]
                a += len(part)
                left[0].append(np.stack([padded[part + o] for o in OFFSETS]))
                left[1].append(padded[part])
                held += len(part)
                learned += len(part)
                if held >= step:
                    flush()
    flush()
    if learned:
        values = pa.array(net.rows.astype(np.float64).ravel())
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(len(net.rows))), pa.array(np.full(len(net.rows), float(learned))),
            pa.ListArray.from_arrays(pa.array(np.arange(0, net.rows.size + 1, DIM), pa.int32()), values),
        ], names=["row", "learned", "v"])


def trained(docs: DataFrame, text_col: str = "text", one_in: int = 1) -> tuple[Vocabulary, Network]:
    """Count the words of all documents, and train a network on all of them. one_in: learn
    from one document in so many only, by the hash of its words. Without words the network only knows that all words are rare."""
    texts = docs.select(F.col(f"`{text_col}`").alias("t"))
    counts = texts.mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts, "words")
    # all words that occur so often that they are KNOWN at most
    rarity = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).toArrow().to_pandas()
    fits = rarity["words"].cumsum().to_numpy() <= KNOWN
    least = int(rarity["n"][fits].min()) if fits.any() else None if len(rarity) else 1
    known = counts.where(F.col("n") >= least) if least else counts.limit(0)
    known = known.toArrow()  # as bytes: KNOWN rows would fill the driver
    words, n = known["word"].to_numpy().view(np.uint64), known["n"].to_numpy().astype(np.float64)
    group = F.pmod(F.shiftrightunsigned("word", 40), F.lit(RARE))
    held = counts.groupBy(group.alias("group")).agg(F.sum("n").alias("n")).toArrow().to_pandas()
    groups = np.zeros(RARE)
    groups[held["group"].to_numpy(np.int64)] = held["n"]
    # a word that occurs once is charged as one that does not
    rest = counts.where((F.col("n") > 1) & (F.col("n") < least)) if least and least > 2 else None
    vocabulary = Vocabulary(words, n, groups, rest if least else counts)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # KNOWN words at most
    rows = texts.mapInArrow(
        lambda b: _trained(b, shared.value, one_in), "row long, learned double, v array<double>")
    mean = [F.sum(F.col("v")[i] * F.col("learned")) / F.sum("learned") for i in range(DIM)]
    averaged = rows.groupBy("row").agg(*[m.alias(f"v{i}") for i, m in enumerate(mean)]).toArrow().to_pandas()
    net = Network.first(vocabulary.frequency)
    if len(averaged):
        net.rows[averaged["row"]] = averaged[[f"v{i}" for i in range(DIM)]].to_numpy(np.float32)
    return vocabulary, net


def scored(docs: DataFrame, model: tuple[Vocabulary, Network], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, log_probability (summed over all words of the whole
    text, each given its neighbours) and per_word (its mean; null without words).

    A null or wordless text has 0 words and log probability 0. Equal texts score equally; an
    empty table gives an empty result; other columns are not looked at.
    """
    rest = model[0].rest
    joins = rest is not None
    shared = docs.sparkSession.sparkContext.broadcast((model[0], model[1].rows))  # KNOWN words and a network

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, net = shared.value[0], Network(shared.value[1])
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            n, sums = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            open_docs, open_words = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for a, b, words, cut in _docs(batch.column(1).to_pylist()):
                ids, share, known = vocabulary.of(words)
                padded, at = _windows(ids, cut, vocabulary.size)
                doc = np.repeat(np.arange(a, b), np.diff(cut))
                n[a:b] = np.diff(cut)
                for i in range(0, len(at), WINDOWS):
                    part = at[i:i + WINDOWS]
                    p = net.log_probability(np.stack([padded[part + o] for o in OFFSETS]), padded[part])
                    sums += np.bincount(doc[i:i + WINDOWS], p + share[i:i + WINDOWS], len(sums))
                if joins:
                    open_docs.append(doc[~known])
                    open_words.append(words[~known])
            held, found = np.concatenate(open_docs), np.concatenate(open_words)
            places = np.append(0, np.cumsum(np.bincount(held, minlength=batch.num_rows)))
            yield pa.RecordBatch.from_arrays([
                pa.array(row + np.arange(batch.num_rows)), batch.column(0), pa.array(n), pa.array(sums),
                pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(found.view(np.int64))),
            ], names=["row", "doc_id", "n_words", "log_probability", "open"])
            row += batch.num_rows

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("t"))
    out = rows.mapInArrow(score, "row long, doc_id long, n_words long, log_probability double, open array<long>")
    if joins:
        out = written(out, "open")
        # in whole numbers, so that the order of adding does not matter
        more = F.sum(F.round(F.log("n") * UNIT).cast("long")) / UNIT
        counted = out.select("row", F.explode("open").alias("word")).join(rest, "word").groupBy("row").agg(more.alias("more"))
        out = out.join(counted, "row", "left").withColumn(
            "log_probability", F.col("log_probability") + F.coalesce("more", F.lit(0.0)))
    return out.select("doc_id", "n_words", "log_probability").withColumn(
        "per_word", F.when(F.col("n_words") > 0, F.col("log_probability") / F.col("n_words")))
