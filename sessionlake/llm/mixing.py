"""Mixing sources to target weights by systematic sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.columns import ranked, words
from sessionlake.workspace import written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
SEED = "mix"


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """Per source (column `src`, '' for null and a leading '=' otherwise, and source_size):
    its target, in words.

    Sources in code point order, null last, take the weights in turn. The level is what
    one weight gets; sources that it would lift over `most` times their size stop there, and
    the level is computed again for the others until none stops anew.
    """
    placed = sizes.withColumns({"one": F.lit(0), "last": (F.col("src") == "").cast("int")})
    placed = ranked(placed, "one", ["last", "src"], "place").drop("one", "last")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    placed = written(placed.withColumn(
        "weight", F.get(cycle, ((F.col("place") - 1) % len(weights)).cast("int"))).drop("place"), "sources")

    level, total = -1.0, None
    while True:
        stops = (most * F.col("source_size") <= F.col("weight") * F.lit(level)) & F.lit(level >= 0)
        r = placed.agg(
            F.sum("source_size"), F.sum(F.when(stops, most * F.col("source_size")).otherwise(0)),
            F.sum(F.when(stops, 0.0).otherwise(F.col("weight")))).first()
        total = float(r[0] or 0)
        if not r[2]:  # all sources stopped, or there is none
            break
        now = (share * total - r[1]) / r[2]
        if now == level:
            break
        level = now
    return placed.select(
        "src", "source_size",
        F.least(most * F.col("source_size").cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def mixed(
    docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: str = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """How often the mix takes each document, so that sources come near their targets.

    Returns per row of docs: doc_id, source, size (words of the text, 0 for null),
    source_size, target (of its source), copies, taken = copies * size. A source's documents
    stand in order of size and id; each adds target / source_size expected copies to a
    running sum that starts at an offset drawn once per source from the seed, and is taken
    once per whole number that the sum passes. Documents alike in size and id (repeated rows)
    share their places among them, so the result as a whole is the same in every run. A
    source without words has target 0 and takes nothing; null is a source of its own. Only
    the three columns are looked at; an empty table gives an empty result.
    """
    source = F.col(f"`{source_col}`")
    sized = written(docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), source.alias("source"),
        F.size(words(F.col(f"`{text_col}`"))).cast("long").alias("size"),
        F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source)).alias("src")), "sizes")
    per_source = targets(sized.groupBy("src").agg(F.sum("size").alias("source_size")), weights, share, most)
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(seed), "src")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = ranked(sized, "src", ["size", "doc_id"], "place").join(per_source, "src")
    rows = rows.withColumns({"_u": drawn, "_e": rate})
    until = F.floor(F.col("_u") + F.col("_e") * F.col("place"))
    so_far = F.floor(F.col("_u") + F.col("_e") * (F.col("place") - 1))
    return rows.withColumn("copies", until - so_far).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
