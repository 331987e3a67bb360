"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample: a node splits at a hyperplane half way between two
of its sample rows, drawn at random. Every row is then filed in one leaf of each tree. A
query walks all trees through one priority queue, nearest hyperplanes first, until the
leaves it has reached hold `budget` rows. Leaves are compared with the queries that
reached them, exactly and in double precision, in tasks of bounded size: a large leaf is
cut into blocks of rows, and the queries of a much reached one into blocks of queries.
A few queries are first answered from all rows: the budget is raised until it reaches
their nearest.

Largest inner products are nearest neighbours once every row gets one more component,
sqrt(greatest norm^2 - own norm^2), and every query a zero.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.llm.columns import drawn
from sessionlake.workspace import written

TREES = 12
#: Rows that a leaf should hold.
LEAF = 256
#: Rows that the trees are fitted on, at most about.
SAMPLE = 100_000
#: Sample rows that a leaf needs at least; more rows than the sample allows make larger leaves.
LEAST = 8
BLOCK = 1024
#: Leaves of a query that are compared first.
FIRST = 24
SEED = 7
#: Queries answered exactly, and the share of their neighbours that the default budget must reach.
PILOT, RECALL = 32, 0.95


class Tree:
    """Hyperplanes in level order: node i has the children 2i+1 and 2i+2."""

    def __init__(self, sample: np.ndarray, depth: int, rng: np.random.Generator):
        nodes = (1 << depth) - 1
        self.depth = depth
        self.normals = np.zeros((nodes, sample.shape[1]), dtype=np.float32)
        self.cuts = np.zeros(nodes, dtype=np.float32)
        held = [np.arange(len(sample))]
        for i in range(nodes):
            own = held[i]
            if len(own) > 1:
                a, b = sample[rng.choice(own, 2, replace=False)]
                normal = a - b
                size = np.linalg.norm(normal)
                if size > 0:
                    self.normals[i] = normal / size
                    self.cuts[i] = np.median(sample[own] @ self.normals[i])
            right = sample[own] @ self.normals[i] > self.cuts[i]
            held += [own[~right], own[right]]

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), dtype=np.int64)
        for _ in range(self.depth):
            right = np.einsum("ij,ij->i", rows, self.normals[node]) > self.cuts[node]
            node = 2 * node + 1 + right
        return node - ((1 << self.depth) - 1)


def reached(forest: list[Tree], sizes: np.ndarray, query: np.ndarray, budget: int) -> list[int]:
    """Leaves (tree * leaves per tree + leaf) in the order of a priority queue over all
    trees, until they hold `budget` rows, counted once per tree."""
    inner = len(forest[0].cuts)
    per_tree = inner + 1
    queue = [(-np.inf, t, 0) for t in range(len(forest))]
    found, rows = [], 0
    while queue and rows < budget:
        far, t, node = heapq.heappop(queue)
        if node >= inner:
            leaf = t * per_tree + node - inner
            if sizes[leaf]:
                found.append(leaf)
                rows += sizes[leaf]
            continue
        side = float(forest[t].normals[node] @ query - forest[t].cuts[node])
        heapq.heappush(queue, (max(far, -side), t, 2 * node + 2))
        heapq.heappush(queue, (max(far, side), t, 2 * node + 1))
    return found


def _usable(vector: Column) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _matrix(vectors: pa.Array | pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), dtype=np.float64).reshape(-1, dim)


def _compared(rows: pd.DataFrame, queries: pd.DataFrame, dim: int, k: int) -> pd.DataFrame:
    """Each query's k nearest of these rows, as far as they score at least its `least`; ties
    to the smaller id. Products are summed component by component, so equal vectors score
    equally wherever they are."""
    out = {"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)}
    if len(rows) and len(queries):
        rows = rows.sort_values("vec_id", kind="stable")
        ids, r = rows["vec_id"].to_numpy(), np.ascontiguousarray(_matrix(rows["v"], dim).T)
        asked, q = queries["query_id"].to_numpy(), np.ascontiguousarray(_matrix(queries["q"], dim).T)
        score, part = np.zeros((len(asked), len(ids))), np.empty((len(asked), len(ids)))
        for j in range(dim):
            np.multiply(q[j][:, None], r[j][None], out=part)
            score += part
        score[asked[:, None] == ids[None]] = -np.inf
        # an id counts once, with its best score, before any is cut
        begins = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        if len(begins) < len(ids):
            ids, score = ids[begins], np.maximum.reduceat(score, begins, axis=1)
        if len(ids) > k:  # what is below the k-th score is out
            kth = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
            score[score < kth[:, None]] = -np.inf
        at, found = np.nonzero((score > -np.inf) & (score >= queries["least"].to_numpy()[:, None]))
        values = score[at, found]
        order = np.lexsort((found, -values, at))
        at, found, values = at[order], found[order], values[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        few = place < k
        out = {"query_id": asked[at[few]], "vec_id": ids[found[few]], "score": values[few]}
    return pd.DataFrame(out)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, budget: int | None = None, trees: int = TREES,
    leaf: int = LEAF, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """Each query's k nearest rows of `vectors` by inner product, the query's own id left out.

    vectors and queries have an id (long) and an array of numbers. Returns query_id, rank
    (int, from 1), vec_id, score (double), nearest first, ties to the smaller id. budget:
    rows that a query is compared with, counted once per tree; by default a share of all
    rows that falls as they grow, or as many more as a few exactly answered queries need. Arrays that are null, zero, hold null or non-finite
    components, or have another length than most rows (the shorter of tied lengths) take no
    part, nor do null ids. Rows that repeat an id count once, with their best score. Without
    usable rows or queries the result is empty. Other columns are not looked at.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vec_col}`")
        return df.where(_usable(v) & F.col(f"`{id_col}`").isNotNull()).select(
            F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))

    rows, asked = clean(vectors), clean(queries)
    shape = rows.groupBy(F.size("v").alias("dim")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm2"))
    shape = shape.orderBy(F.desc("n"), "dim").first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, norm2 = shape["dim"], shape["n"], shape["norm2"]
    rows, asked = rows.where(F.size("v") == dim), asked.where(F.size("v") == dim)

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [np.array(x).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v, pa.binary())], names=["vec_id", "v"])

    found = rows.where(drawn("vec_id", F.lit(n), SAMPLE)).mapInArrow(compact, "vec_id long, v binary")
    found = found.orderBy("vec_id").toPandas()  # about SAMPLE rows, whatever the table's size
    sample = _lifted(_matrix(found["v"], dim), norm2)
    depth = max(0, min(ceil(log2(max(1, n / leaf))), int(log2(max(1, len(sample) / LEAST)))))
    rng = np.random.default_rng(SEED)
    forest = spark.sparkContext.broadcast([Tree(sample, depth, rng) for _ in range(trees)])  # bounded by the sample
    per_tree = 1 << depth

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                ids, v = batch.column(0).slice(at, BLOCK), np.stack(batch.column(1).slice(at, BLOCK).to_pylist())
                lifted, binary = _lifted(v, norm2), pa.array([x.tobytes() for x in v], pa.binary())
                for t, tree in enumerate(forest.value):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(t * per_tree + tree.leaves(lifted)), ids, binary], names=["leaf", "vec_id", "v"])

    # rows that repeat are filed once, so that a leaf's size is that of its different rows
    index = written(rows.distinct().mapInArrow(filed, "leaf long, vec_id long, v binary"), "index")
    held = index.groupBy("leaf").count().toPandas()  # a row per leaf of the forest
    sizes = np.zeros(trees * per_tree, dtype=np.int64)
    sizes[held["leaf"]] = held["count"]
    shared = spark.sparkContext.broadcast(sizes)
    if not budget:
        budget = default_budget(n, trees)
        if budget < trees * n:
            needed = _needed(rows, asked, forest.value, sizes, k, norm2)
            budget = max(budget, ceil(np.quantile(needed, RECALL)) if len(needed) else 0)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_id, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = np.array(q)
                found = reached(forest.value, shared.value, np.append(v, 0.0).astype(np.float32), budget)
                yield pa.RecordBatch.from_arrays([
                    pa.array(found, pa.int64()), pa.array(range(len(found)), pa.int64()), pa.array([q_id] * len(found), pa.int64()),
                    pa.array([v.tobytes()] * len(found), pa.binary())], names=["leaf", "turn", "query_id", "q"])

    asked = written(asked.mapInArrow(probes, "leaf long, turn long, query_id long, q binary"), "probes")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(near: DataFrame) -> DataFrame:
        once = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    # the first leaves set a score that a row of the others must reach
    first = written(best(_in_cells(
        index, asked.where(F.col("turn") < FIRST).withColumn("least", F.lit(float("-inf"))), dim, k)), "first")
    least = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = asked.where(F.col("turn") >= FIRST).join(least, "query_id", "left").withColumn(
        "least", F.coalesce("least", F.lit(float("-inf"))))
    near = first.drop("rank").unionByName(_in_cells(index, rest, dim, k))
    return best(near).select("query_id", "rank", "vec_id", "score")


def _in_cells(index: DataFrame, asked: DataFrame, dim: int, k: int) -> DataFrame:
    """Compare leaves with the queries that reached them, in cells of at most about BLOCK
    rows and BLOCK queries."""
    grid = written(index.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("row_blocks")).join(
        asked.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("query_blocks")), "leaf"), "grid")

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """One copy of each row in its own block for every block of the other side."""
        blocks = grid.select("leaf", *[F.col(c).alias(c) for c in ("row_blocks", "query_blocks")])  # new columns for each side
        placed = df.join(blocks, "leaf").withColumn(own, F.pmod(F.xxhash64(key), F.col(f"{own}s")))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}s") - 1)))

    cell = ["leaf", "row_block", "query_block"]
    left = dealt(index, "vec_id", "row_block", "query_block").groupBy(*cell)
    right = dealt(asked, "query_id", "query_block", "row_block").groupBy(*cell)
    return left.cogroup(right).applyInPandas(
        lambda r, q: _compared(r, q, dim, k), "query_id long, vec_id long, score double")


def _needed(rows: DataFrame, asked: DataFrame, forest: list[Tree], sizes: np.ndarray, k: int, norm2: float) -> np.ndarray:
    """For each of the true k nearest of PILOT queries, the budget that reaches it."""
    pilot = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PILOT).collect()
    ids, q = np.array([x["vec_id"] for x in pilot]), np.array([x["v"] for x in pilot])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8 * BLOCK):
                part = batch.slice(at, 8 * BLOCK)
                order = np.argsort(part.column(0).to_numpy(), kind="stable")
                own, v = part.column(0).to_numpy()[order], np.stack(part.column(1).to_pylist())[order]
                score = np.where(ids[:, None] == own[None], -np.inf, q @ v.T)
                # different ids: k of them, each with all its rows that score as the k-th one's best does
                of_id = np.maximum.reduceat(score, np.flatnonzero(np.append(True, own[1:] != own[:-1])), axis=1)
                kth = -np.sort(-of_id, axis=1)[:, min(k, of_id.shape[1]) - 1]
                asker, found = np.nonzero((score >= kth[:, None]) & (score > -np.inf))
                yield pa.RecordBatch.from_arrays([
                    pa.array(asker), pa.array(own[found]), pa.array(score[asker, found]),
                    pa.array([v[i].tobytes() for i in found], pa.binary())], names=["asker", "vec_id", "score", "v"])

    near = rows.mapInArrow(exact, "asker long, vec_id long, score double, v binary").where(F.col("score") > float("-inf"))
    near = near.groupBy("asker", "vec_id").agg(F.max_by("v", "score").alias("v"), F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id"))
    near = near.withColumn("rank", place).where(F.col("rank") <= k).select("asker", "v").collect()  # PILOT * k rows
    needed = []
    for i in range(len(pilot)):
        true = [x["v"] for x in near if x["asker"] == i]
        if true:
            lifted = _lifted(_matrix(true, q.shape[1]), norm2)
            leaves = np.stack([t * len(sizes) // len(forest) + tree.leaves(lifted) for t, tree in enumerate(forest)])
            order = np.array(reached(forest, sizes, np.append(q[i], 0.0).astype(np.float32), int(sizes.sum())))
            rows_to = np.full(len(sizes), sizes.sum())
            rows_to[order] = np.cumsum(sizes[order])
            needed.append(rows_to[leaves].min(0))
    return np.concatenate(needed) if needed else np.zeros(0)


def _lifted(v: np.ndarray, norm2: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(norm2 - np.einsum("ij,ij->i", v, v), 0))
    return np.concatenate([v, rest[:, None]], 1).astype(np.float32)


def default_budget(n: int, trees: int) -> int:
    """2,000 rows of each tree or a tenth of all, whichever is more, up to 100,000 rows;
    beyond, the tenth grows with the square root."""
    share = min(1.0, max(2000 / max(n, 1), 0.1 * min(1.0, (100_000 / max(n, 1)) ** 0.5)))
    return ceil(trees * n * share)
