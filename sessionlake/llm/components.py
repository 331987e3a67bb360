"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.workspace import written

MOST_ROUNDS = 64


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]


def components(links: DataFrame) -> DataFrame:
    """Label every linked node with the smallest node it can reach.

    links: columns u, v (long), in any direction, repeats and loops allowed.
    Returns (node, label) for nodes with at least one link to another node;
    without links it is empty. Each round hangs a node's larger neighbours on its
    smallest one, then its smaller ones, which about halves every path. Minima are
    combined before rows move, so a node with very many links is no burden; rounds
    end when nothing changes and are written to the shared folder.
    """
    ends = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = written(ends.distinct(), "links")
    mark = _mark(edges)
    for _ in range(MOST_ROUNDS):
        if not mark[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), "links")
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
