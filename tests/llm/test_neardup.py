"""Components equal brute force over all pairs."""

import random

import pytest

from sessionlake.llm.components import components
from sessionlake.llm.neardup import near_duplicates
from sessionlake.llm.shingles import PIECE_BYTES, shingle_sets, word_hashes


def brute(texts, width, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts:
        w = (t or "").translate(low)
        for c in "\t\n\x0b\f\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        n = min(width, len(w))
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                x, y = sets[a], sets[b]
                if x and y and 100 * len(x & y) >= percent * len(x | y) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {(i, len(sets[i]), label[i], label[i] == i) for i in sets}


def family(seed, size, words=60):
    rng = random.Random(seed)
    first = [f"w{rng.randrange(400)}" for _ in range(words)]
    for _ in range(size):
        own = list(first)
        for _ in range(rng.randrange(12)):
            own[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        yield " ".join(own)


@pytest.mark.parametrize("width", [2, 5])
def test_equals_brute_force(docs, rows, width):
    texts = [t for s in range(4) for t in family(s, 30)] + ["", None, " \n", "one", "ONE", "a b", "A\tb", "Ä b", "ä b", "a b c"]
    random.Random(5).shuffle(texts)
    table = list(enumerate(texts, 100))
    got = near_duplicates(docs(table), width=width).select("doc_id", "n_shingles", "component_id", "kept")
    assert {tuple(r) for r in got.collect()} == brute(table, width, 80)


def test_a_large_family_of_graded_copies(docs):
    texts = list(enumerate(family(9, 250, words=90)))
    got = near_duplicates(docs(texts), width=2).select("doc_id", "n_shingles", "component_id", "kept")
    assert {tuple(r) for r in got.collect()} == brute(texts, 2, 80)


def test_empty_table_null_ids_and_repeated_rows(docs, rows):
    assert rows(near_duplicates(docs([]))) == []
    table = [(None, "a b c d e f"), (None, None), (3, "a b c d e f"), (3, "a b c d e f"), (4, "x y z u v w"), (4, "q")]
    got = rows(near_duplicates(docs(table)).select("doc_id", "n_shingles", "component_id", "kept"))
    assert got == sorted([(None, 2, None, True), (None, 0, None, True), (3, 2, 3, True), (3, 2, 3, True),
                          (4, 2, 4, True), (4, 1, 4, True)], key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_clashing_columns_are_ignored(docs):
    df = docs([(1, "a b"), (2, "a b")]).selectExpr("*", "'x' AS id", "'y' AS key", "1 AS band", "2 AS label")
    assert {r.component_id for r in near_duplicates(df, width=2).collect()} == {1}


def test_long_texts_are_cut_at_white_space():
    long = "word " * 300_000 + "x" * (PIECE_BYTES + 10) + " end"
    h, at = word_hashes(long.encode())
    assert len(h) == 300_002 and len(set(h.tolist())) == 3 and at[-1] == len(long) - 3
    assert [len(s) for s in shingle_sets([long, "a", None], 2)] == [3, 1, 0]


def test_components_of_paths_stars_and_loops(spark, rows):
    links = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(50)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(rows(components(spark.createDataFrame(links, "u long, v long"))))
    assert got == {i + 1: 0 for i in range(40)} | {101 + i: 100 for i in range(50)} | {201: 200}
    assert rows(components(spark.createDataFrame([], "u long, v long"))) == []
