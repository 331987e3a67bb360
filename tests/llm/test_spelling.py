"""Near words, forms and roots equal brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sessionlake.llm import kdtree, spelling


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words):
    """(word, n, n_near, form, form_n, root) from {word: n}."""
    found = {}
    for w, n in words.items():
        near = sorted((v for v in words if one_apart(w, v)), key=lambda v: (-words[v], v))
        form = near[0] if near and words[near[0]] >= 10 * n else None
        found[w] = (w, n, len(near), form, words[form] if form else None)
    def root(w):
        return root(found[w][3]) if found[w][3] else w
    return {(*r, root(w)) for w, r in found.items()}


def plain_words(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def table(df):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def edited(rng, word, letters):
    at = rng.randrange(len(word))
    kind = rng.randrange(3)
    return word[:at] + (rng.choice(letters) if kind else "") + word[at + (kind < 2):]


@pytest.mark.parametrize("cell, leaf", [(1 << 16, 8), (20, 2)])
def test_equals_brute_force(docs, monkeypatch, cell, leaf):
    for name, value in (("CELL", cell), ("LEAF", leaf), ("QUERIES_AT_ONCE", 50), ("LETTERS_AT_ONCE", 999)):
        monkeypatch.setattr(spelling, name, value)
    if cell == 20:  # blocks of cells as well
        monkeypatch.setattr(spelling, "STORED", 9)
        monkeypatch.setattr(spelling, "ASKED", 11)
    rng = random.Random(11)
    letters = "abcdeé×ÿ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 11))) for _ in range(25)]
    pool = {}
    for w in base:
        pool[w] = rng.choice([2, 40, 400])
        for _ in range(8):
            v = edited(rng, w, letters)
            pool.setdefault(v, rng.choice([2, 3, 25]))
            pool.setdefault(edited(rng, v, letters), 2)
    said = [w for w, n in pool.items() for _ in range(n)]
    rng.shuffle(said)
    rows = [(i, " ".join(said[i * 40:i * 40 + 40])) for i in range(len(said) // 40 + 1)]
    want = brute(plain_words(rows))
    assert table(spelling.variants(docs(rows))) == want
    assert sum(r[3] is not None for r in want) > 20 and any(r[5] != r[3] for r in want if r[3])


def test_odd_texts_nulls_repeats_and_clashing_names(docs):
    rows = [(None, "Strasse STRASSE1strasse"), (None, "Strasse STRASSE1strasse"), (3, None), (4, ""), (5, "ÀÉÎõü÷ß-àéîõü÷ß"), (5, "ÀÉÎõü÷ß"),
            (6, "short words only here"), (7, "x" * 30_000 + " " + "x" * 30_000 + " " + "x" * 29_999 + "y"), (8, "Ωstrasse strasseΩ")]
    df = docs(rows).selectExpr("*", "1 AS word", "2 AS n", "3 AS form", "4 AS role", "5 AS h", "6 AS w", "7 AS id")
    assert table(spelling.variants(df)) == brute(plain_words(rows))
    assert table(spelling.variants(docs([]))) == set()
    assert table(spelling.variants(docs([(1, None)]))) == set()


def test_ties_go_to_the_smallest_word(docs, monkeypatch):
    monkeypatch.setattr(spelling, "DROP_ONE_IN", 10**9)
    rows = [(1, "aaaaaaab " * 20 + "aaaaaaac " * 20 + "aaaaaaad " * 2)]
    got = {r[0]: r for r in table(spelling.variants(docs(rows)))}
    assert got["aaaaaaad"] == ("aaaaaaad", 2, 2, "aaaaaaab", 20, "aaaaaaab") and got["aaaaaaab"][2:4] == (2, None)


def test_searches_reach_all_vectors_one_edit_away():
    rng = np.random.default_rng(4)
    v = rng.integers(0, 4, (400, 7)).astype(np.int32)
    tree = kdtree.build(v, 3)
    assert sorted(tree.rows.tolist()) == list(range(400))
    leaf = kdtree.home(tree, v)
    for i in range(400):
        assert i in tree.rows[tree.begin[leaf[i]]:tree.end[leaf[i]]]
    for down in (True, False):
        q, at = kdtree.near(tree, v, down)
        assert len(set(zip(q.tolist(), at.tolist()))) == len(q) < 400 * (tree.dim < 0).sum()
        reached = {(a, int(b)) for a, l in zip(q.tolist(), at.tolist()) for b in tree.rows[tree.begin[l]:tree.end[l]]}
        for a in range(400):
            for b in range(400):
                d = v[b] - v[a]
                up, less = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
                if abs(d).sum() == 1 + down and len(up) == 1 and (not down or len(less) == 1 and up[0] < less[0]):
                    assert (a, b) in reached
