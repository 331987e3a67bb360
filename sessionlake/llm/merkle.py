"""A Merkle manifest of a table that stores only every few levels of its trees.

1. Every row is a leaf: the SHA-256 of its fields, each with its length. Leaves are placed
   in their tree (one per value of a column) by the order column, through ranges.
2. Every `fan` consecutive nodes become the digest of their concatenated hex texts. The
   `fan ** STRIDE` nodes under one stored node are an aligned subtree: one task climbs it and
   keeps its top only, so a checkpoint is written every STRIDE levels. The roots of the
   trees are the leaves of one tree over them.
3. A proof needs the siblings on every level. From the root down, each aligned subtree is
   climbed again from the stored nodes below it, the siblings of these are emitted after
   those of the subtrees above, and the interior nodes are dropped.

No task holds more than one subtree, whatever share of the rows a tree has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.columns import ranked
from sessionlake.llm.runs import runs
from sessionlake.workspace import written

FAN = 2
#: Levels between two stored ones.
STRIDE = 8

#: What has to be put before and after a node's digest, from its own level upwards.
PATH = "array<struct<`left`: string, `right`: string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


@dataclass(frozen=True)
class Manifest:
    """Stored levels, from the leaves to one row per tree, as (tree, pos, total, node);
    leaves also have `carried`. `top` are those of the tree over the trees' roots, whose
    last one has the root of all as its only row, or none for an empty table."""

    levels: list[DataFrame]
    top: list[DataFrame]
    fan: int
    stride: int


def leaf(*fields: Column) -> Column:
    """The digest of a row: each field is its UTF-8 byte count, `:` and the value, or `-` if null."""
    def told(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(told, fields)), 256)


def _climbed(nodes: list[str], total: int, fan: int, stride: int) -> list[list[str]]:
    """A subtree's levels from its lowest nodes on, in a tree that has `total` of them."""
    levels = [nodes]
    for _ in range(stride):
        if total <= 1:
            break
        nodes = [sha256("".join(nodes[i:i + fan]).encode()).hexdigest() for i in range(0, len(nodes), fan)]
        total = -(-total // fan)
        levels.append(nodes)
    return levels


def _tops(batches: Iterator[pa.RecordBatch], fan: int, stride: int) -> Iterator[pa.RecordBatch]:
    for run in runs(batches, "tree", "block"):
        tree, block, total = (run.column(c)[0].as_py() for c in ("tree", "block", "total"))
        top = _climbed(run.column("node").to_pylist(), total, fan, stride)[-1][0]
        yield pa.RecordBatch.from_pydict(
            {"tree": [tree], "pos": [block], "total": [-(-total // fan**stride)], "node": [top]})


def _subtrees(level: DataFrame, span: int) -> DataFrame:
    """The rows with their subtree's number, each subtree's together and in order."""
    return level.withColumn("block", F.expr(f"pos div {span}")).repartition("tree", "block").sortWithinPartitions(
        "tree", "block", "pos")


def _stored(leaves: DataFrame, fan: int, stride: int) -> list[DataFrame]:
    """The leaves and every stored level over them. A tree that is down to its root keeps it."""
    levels = [leaves]
    most = leaves.agg(F.max("total")).first()[0] or 0
    while most > 1:
        below = _subtrees(levels[-1].select("tree", "pos", "total", "node"), fan**stride)
        above = below.mapInArrow(lambda b: _tops(b, fan, stride), "tree string, pos long, total long, node string")
        levels.append(written(above, "level"))
        most = -(-most // fan**stride)
    return levels


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows (tree, node, ...) with their place from 0 and the number of rows of their tree."""
    found = ranked(rows, "tree", order, "pos", total="total")
    return written(found.withColumn("pos", F.col("pos") - 1), "leaves")


def manifest(
    docs: DataFrame, digest: Column, tree: Column, order: Column, carry: dict[str, Column] | None = None,
    fan: int = FAN, stride: int = STRIDE,
) -> Manifest:
    """The trees over the rows of docs: `digest` is a row's leaf, `tree` tells the trees apart,
    and leaves ascend by `order`, nulls first, then by digest.

    `carry` are columns to be handed on with a proof, under any names. Trees ascend by
    their name as UTF-8 bytes; null is a tree of its own, before all others. Rows that
    repeat are leaves each. A tree with one leaf has it as its root; an empty table has no
    root. Other columns of docs are not looked at.
    """
    carried = F.struct(F.lit(0).alias("none"), *[c.alias(f"c{i}") for i, c in enumerate((carry or {}).values())])
    name = F.when(tree.isNull(), "").otherwise(F.concat(F.lit("="), tree.cast("string")))
    rows = docs.select(name.alias("tree"), order.alias("place"), digest.alias("node"), carried.alias("carried"))
    levels = _stored(_placed(rows, ["place", "node"]).drop("place"), fan, stride)
    roots = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
    return Manifest(levels, _stored(_placed(roots, ["name"]), fan, stride), fan, stride)


def _proved(batches: Iterator[pa.RecordBatch], own: list[str], fan: int, stride: int) -> Iterator[pa.RecordBatch]:
    """Each subtree comes as the row of its stored top, which has the path above it, and the
    stored nodes below, in order."""
    for run in runs(batches, "tree", "block"):
        above = run.slice(0, 1).to_pylist()[0]
        run = run.slice(1)
        rest = above["path"]
        levels = _climbed(run.column("node").to_pylist(), run.column("total")[0].as_py(), fan, stride)
        sides = []
        for nodes in levels[:-1]:
            at = range(len(nodes))
            sides.append([("".join(nodes[i - i % fan:i]), "".join(nodes[i + 1:i - i % fan + fan])) for i in at])
        rest = [(p["left"], p["right"]) for p in rest]
        steps = [s for i in range(len(run)) for s in [p[i // fan**k] for k, p in enumerate(sides)] + rest]
        n = len(sides) + len(rest)
        path = pa.ListArray.from_arrays(
            pa.array(range(0, n * len(run) + 1, n) if n else [0] * (len(run) + 1), pa.int32()),
            pa.StructArray.from_arrays([pa.array([s[k] for s in steps], pa.string()) for k in (0, 1)], ["left", "right"]))
        same = {c: pa.array([above[c]] * len(run), pa.string()) for c in ("subroot", "root")}
        out = pa.table({**{c: run.column(c) for c in own}, "path": path.cast(_PATH), **same})
        yield from out.combine_chunks().to_batches()


def _proofs(levels: list[DataFrame], roots: DataFrame, fan: int, stride: int) -> DataFrame:
    """Every leaf with the path to the root; roots: (tree, path, subroot, root) for each tree."""
    above = levels[-1].join(roots, "tree").select(*levels[-1].columns, "path", "subroot", "root")
    for level in reversed(levels[:-1]):
        span = fan**stride
        tops = above.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "path", "subroot", "root")
        both = level.withColumn("block", F.expr(f"pos div {span}")).unionByName(tops, allowMissingColumns=True)
        together = both.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
        kinds = {f.name: f.dataType.simpleString() for f in level.schema}
        shape = ", ".join(f"`{c}` {k}" for c, k in kinds.items())
        own = list(level.columns)
        above = together.mapInArrow(
            lambda b, own=own: _proved(b, own, fan, stride), f"{shape}, path {PATH}, subroot string, root string")
    return above


def proofs(found: Manifest, carry: dict[str, Column] | None = None) -> DataFrame:
    """Every leaf with its proof: the columns of `carry` (the one given to `manifest`), leaf,
    subroot, root, path. `path` has, from the leaf's level to the root of all, the digests
    that stand before and after the node in its run."""
    none = F.array().cast(PATH).alias("path")
    of_top = found.top[-1].select("tree", none, F.col("node").alias("subroot"), F.col("node").alias("root"))
    trees = _proofs(found.top, of_top, found.fan, found.stride).select(
        F.col("name").alias("tree"), "path", F.col("node").alias("subroot"), "root")
    done = _proofs(found.levels, trees, found.fan, found.stride)
    return done.select(
        *[F.col(f"carried.c{i}").alias(name) for i, name in enumerate(carry or {})],
        F.col("node").alias("leaf"), "subroot", "root", "path")


def proof_digest(path: Column) -> Column:
    """The digest of a path's siblings, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf's digest and a path lead to."""
    return F.aggregate(path, node, lambda at, p: F.sha2(F.concat(p["left"], at, p["right"]), 256))
