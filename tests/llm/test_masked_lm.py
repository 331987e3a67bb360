"""The masked model against plain loops: ids and shares from counted words, a two-step softmax
over every class and every word of the class, and gradients by finite differences."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlake.llm import masked_lm
from sessionlake.llm.shingles import word_hashes


def hash_of(word):
    return int(word_hashes(word.encode())[0][0])


class PlainVocabulary:
    """Ids by frequency, ties by hash; every rarer word stands in the group of its hash."""

    def __init__(self, texts, classes):
        self.counts = collections.Counter(w for t in texts for w in (t or "").split())
        self.size = classes * classes
        order = sorted(self.counts, key=lambda w: (-self.counts[w], hash_of(w)))
        self.own = {w: i for i, w in enumerate(order[: self.size - masked_lm.RARE])}
        self.groups = collections.Counter()
        for w in order[self.size - masked_lm.RARE:]:
            self.groups[self.group(w)] += self.counts[w]

    def group(self, word):
        return (hash_of(word) >> 40) % masked_lm.RARE

    def id(self, word):
        return self.own.get(word, self.size - masked_lm.RARE + self.group(word))

    def log_share(self, word):
        if word in self.own:
            return 0.0
        return math.log(self.counts.get(word, 1) or 1) - math.log(self.groups[self.group(word)] + 1)


def plain_log_probability(rows, classes, neighbours, target):
    """ln of the class's share of all classes, and of the word's share of its class."""
    net = masked_lm.Network(rows)
    hidden = np.zeros(masked_lm.DIM)
    for k, n in enumerate(neighbours):
        hidden = hidden + net.embed[k][n]
    hidden = np.tanh(hidden)
    kind, own = divmod(target, classes)
    by_class = [math.exp(float(net.by_class[c] @ hidden + net.class_bias[c])) for c in range(classes)]
    by_word = [math.exp(float(net.by_word[kind][w] @ hidden + net.word_bias[kind][w])) for w in range(classes)]
    return math.log(by_class[kind] / sum(by_class)) + math.log(by_word[own] / sum(by_word))


def plain_score(rows, vocabulary, classes, text):
    words = (text or "").split()
    ids = [vocabulary.id(w) for w in words]
    at = lambda i: ids[i] if 0 <= i < len(ids) else vocabulary.size
    return sum(
        plain_log_probability(rows, classes, [at(i + o) for o in masked_lm.OFFSETS], ids[i]) + vocabulary.log_share(w)
        for i, w in enumerate(words))


@pytest.mark.parametrize("known", [None, 2000])
def test_every_score_is_that_of_the_plain_model(spark, monkeypatch, known):
    """With all counts sent to the tasks, and with those of rare words joined. Ids go to words that
    are sent only, so the plain ids are the model's as long as these are more than there are ids."""
    if known:
        monkeypatch.setattr(masked_lm, "KNOWN", known)
    rng = random.Random(7)
    word = lambda: f"f{rng.randrange(2000)}" if rng.random() < 0.6 else f"r{rng.randrange(2500)}"
    texts = [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(500)] + [None, "", "f1", "f1 f2"]
    texts += [texts[0], texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = masked_lm.trained(docs)
    # copies of everything, unseen words and a text without neighbours are scored as well
    asked = texts[350:] + ["never seen these words", "unseen"]
    table = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string").withColumn("n", F.lit(0))
    got = {r["doc_id"]: r for r in masked_lm.scored(table, model).collect()}
    assert set(got) == set(range(len(asked)))

    assert (model[0].rest is not None) == bool(known) and len(model[0].words) > model[0].size
    vocabulary = PlainVocabulary(texts, model[0].classes)
    assert len(vocabulary.groups) == masked_lm.RARE  # rare words do share ids
    rows = model[1].rows.astype(np.float64)
    for i, t in enumerate(asked):
        want = plain_score(rows, vocabulary, model[0].classes, t)
        assert got[i]["n_words"] == len((t or "").split())
        assert got[i]["log_probability"] == pytest.approx(want, rel=1e-4, abs=1e-3), t


def test_gradients_are_those_of_finite_differences():
    rng = np.random.default_rng(3)
    size, classes = masked_lm.VOCABULARY, masked_lm.CLASSES
    net = masked_lm.Network.first(np.ones(size))
    net.rows[:] = rng.normal(0, 0.3, net.rows.shape)
    context, ids = rng.integers(0, size + 1, (4, 6)).astype(np.int32), rng.integers(0, size, 6).astype(np.int32)
    before = net.rows.astype(np.float64)

    def mean(rows):
        return np.mean([plain_log_probability(rows, classes, context[:, i], int(ids[i])) for i in range(6)])

    net.learn(context, ids, masked_lm.Network(np.ones_like(net.rows)))
    # a step is RATE g / sqrt(1 + g^2) where the squares were 1
    step = (net.rows - before) / masked_lm.RATE
    taken = step / np.sqrt(1 - step ** 2)
    moved = np.argwhere(np.abs(taken) > 1e-4)
    parts = np.cumsum((0, *masked_lm.Network.parts(classes)))
    for a, b in zip(parts[:-1], parts[1:]):  # some values of every part of the network
        inside = moved[(moved[:, 0] >= a) & (moved[:, 0] < b)]
        assert len(inside)
        for row, at in inside[:: max(1, len(inside) // 8)]:
            up, down = before.copy(), before.copy()
            up[row, at] += 1e-4
            down[row, at] -= 1e-4
            assert taken[row, at] == pytest.approx((mean(up) - mean(down)) / 2e-4, rel=2e-2, abs=2e-5)
