"""Trees, proofs and tampering against a plain tree in memory."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from sessionlake.llm import merkle


def digest(text):
    return sha256(text.encode()).hexdigest()


def plain_leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes, fan):
    """The root, and for each leaf what stands before and after its node on every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            begin = a - a % fan
            paths[i].append(("".join(nodes[begin:a]), "".join(nodes[a + 1:begin + fan])))
        nodes, at = [digest("".join(nodes[i:i + fan])) for i in range(0, len(nodes), fan)], [a // fan for a in at]
    return nodes[0], paths


def plain_proofs(rows, fan):
    """rows: (id, tree, leaf)"""
    trees = {}
    for i, t, leaf in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        trees.setdefault(t, []).append((i, leaf))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    subroots = {t: plain_tree([x for _, x in trees[t]], fan) for t in names}
    root, tops = plain_tree([subroots[t][0] for t in names], fan)
    return sorted(((i, leaf, subroots[t][0], root, tuple(subroots[t][1][k] + tops[names.index(t)]))
                   for t in names for k, (i, leaf) in enumerate(trees[t])), key=str)


def found(df, fan, stride):
    carry = {"id": F.col("doc_id")}
    leaf = merkle.leaf(F.col("doc_id"), F.col("text"))
    m = merkle.manifest(df, leaf, F.col("lang"), F.col("doc_id"), carry, fan=fan, stride=stride)
    return merkle.proofs(m, carry)


@pytest.mark.parametrize("fan, stride", [(2, 2), (3, 1), (2, 8)])
def test_equals_a_plain_tree(docs, fan, stride):
    rows = [(i, f"text {i}", lang) for lang, n in (("en", 37), (None, 1), ("", 2), ("é", 9), ("zz", 16)) for i in range(n)]
    rows += [(5, "text 5", "en"), (5, "other", "en"), (None, None, "en")]  # a repeat, a tie, nulls
    got = found(docs(rows), fan, stride)
    told = sorted(((r.id, r.leaf, r.subroot, r.root, tuple((p.left, p.right) for p in r.path)) for r in got.collect()), key=str)
    assert told == plain_proofs([(i, t, plain_leaf([i, x])) for i, x, t in rows], fan)
    folded = got.select((merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("good"),
                        (merkle.folded(F.sha2("leaf", 256), F.col("path")) == F.col("root")).alias("bad")).distinct()
    assert [tuple(r) for r in folded.collect()] == [(True, False)]


def test_only_every_few_levels_are_stored(docs):
    m = merkle.manifest(docs([(i, "x", "en") for i in range(70)]), F.sha2(F.col("text"), 256), F.col("lang"), F.col("doc_id"), stride=3)
    assert [x.count() for x in m.levels] == [70, 9, 2, 1] and len(m.top) == 1


def test_one_leaf_and_an_empty_table(docs):
    leaf = plain_leaf([4, "é" * 100_000])
    got = found(docs([(4, "é" * 100_000, None)]), 2, 8).collect()
    assert [(r.leaf, r.subroot, r.root, r.path) for r in got] == [(leaf, leaf, leaf, [])]
    assert found(docs([]), 2, 8).collect() == []


def test_clashing_names_are_kept_apart(docs):
    df = docs([(i, f"t{i}", "en") for i in range(5)]).selectExpr("*", "'x' AS tree", "1 AS pos", "2 AS total", "'n' AS node", "3 AS block")
    carry = {"tree": F.col("tree"), "path_of": F.col("pos"), "id": F.col("doc_id")}
    m = merkle.manifest(df, merkle.leaf(F.col("doc_id"), F.col("text")), F.col("lang"), F.col("doc_id"), carry)
    got = merkle.proofs(m, carry)
    assert got.columns == ["tree", "path_of", "id", "leaf", "subroot", "root", "path"]
    assert {(r.tree, r.path_of) for r in got.collect()} == {("x", 1)}
    want = plain_proofs([(i, "en", plain_leaf([i, f"t{i}"])) for i in range(5)], 2)
    assert sorted((r.id, r.leaf, r.subroot) for r in got.collect()) == sorted(w[:3] for w in want)
