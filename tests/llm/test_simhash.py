"""Fingerprints and components equal brute force over all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from sessionlake.llm import simhash
from sessionlake.llm.columns import joined_evenly
from sessionlake.llm.queries import QUERIES
from tests.llm.conftest import FOLDER

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    n = min(width, len(words))
    shingles = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] if n else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(pairs):
    """Each (id, fingerprint) with the smallest id reachable, by comparing all with all."""
    fps = sorted({f for _, f in pairs})
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a, b in combinations(fps, 2):
            if (a ^ b).bit_count() <= 3 and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    least = {}
    for i, f in pairs:
        if i is not None:
            least[label[f]] = min(i, least.get(label[f], i))
    return {(i, f, least.get(label[f])) for i, f in pairs}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def flipped(x, bits):
    for b in bits:
        x ^= 1 << b
    return x


def test_query_equals_brute_force(spark):
    given = pd.read_parquet(f"{FOLDER}/documents.parquet")
    want = classes([(i, plain(t)) for i, t in zip(given.doc_id.tolist(), given.text)])
    got = QUERIES["op12_simhash_duplicates"](spark, FOLDER).collect()
    assert {(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got} == want and len(got) == len(given)
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in got)


def test_odd_texts(docs):
    texts = [None, "", " \n\t", "one", "ONE", "a b", "a  B", "a b c", "Ä b c", "ä b c", "x y z " * 70_000, "\x1cq\x85  r s", "A" * 10_000]
    rows = list(enumerate(texts, 5))
    got = simhash.near_duplicates(docs(rows)).collect()
    assert {(r.doc_id, r.fp, r.component_id) for r in got} == {
        (i, signed(f), c) for i, f, c in classes([(i, plain(t)) for i, t in rows])}
    assert {r.component_id for r in got if r.doc_id in (5, 6, 7)} == {5}


def test_any_five_bytes_hold_one_posted_set():
    assert len(simhash.POSITIONS) == 14
    for shared in combinations(range(8), 5):
        assert any(set(p) <= set(shared) for p in simhash.POSITIONS)


def test_shared_bytes_are_tallied():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, (2, 500)).astype(np.uint64)
    b[::2] = a[::2] ^ (rng.integers(0, 255, 250).astype(np.uint64) << np.uint64(16))
    want = (a.view(np.uint8).reshape(-1, 8) == b.view(np.uint8).reshape(-1, 8)).sum(1)
    assert (simhash.shared_bytes(a ^ b) == want).all()


@pytest.mark.parametrize("block", [7, 2048])
def test_links_join_what_all_pairs_join(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 50)
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for f in list(fps):  # chains and dense families around some of them, and pairs at every distance
        for d in range(1, 6):
            fps.add(flipped(f, rng.sample(range(64), d)))
    centre = rng.getrandbits(64)
    fps |= {flipped(centre, rng.sample(range(20), rng.randrange(5))) for _ in range(120)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(3)
    found = [(r.u, r.v) for r in simhash.links(nodes).collect()]
    label = {signed(f): signed(f) for f in fps}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for u, v in found:
        a, b = top(u), top(v)
        label[max(a, b)] = min(a, b)
    got = {}
    for f in fps:
        got.setdefault(top(signed(f)), set()).add(f)
    want = {}
    for f, _, c in classes([(f, f) for f in fps]):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_more_bits_than_the_index_finds_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 4)


def test_nulls_repeats_empty_tables_and_clashing_names(docs):
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (3, "a b c d"), (None, "lonely words stand here"), (9, None)]
    df = docs(rows).selectExpr("*", "1 AS fp", "2 AS key", "3 AS n", "4 AS label", "5 AS component_id", "6 AS _value")
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(None, 3), (7, 3), (7, 3), (3, 3), (None, None), (9, 9)], key=str)
    assert simhash.near_duplicates(docs([])).collect() == []


def test_joined_evenly_is_a_join(spark):
    rows = spark.range(3000).select((F.col("id") % 50).alias("k"), "id").unionByName(
        spark.range(9000).select(F.lit(77).cast("long").alias("k"), "id"))
    values = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), (F.max("id") * 2).alias("v"))
    got = joined_evenly(rows, values, "k", "n", share=20)
    want = rows.join(values.drop("n"), "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("k", "id", "v").collect()))
