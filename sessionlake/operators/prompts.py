"""Prompt snapshots, addressed by the hash of their content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_prompts(references: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Look up each referenced hash once: n_refs, and found or not.

    References are counted per hash before the join, so a prompt that most
    events refer to is one row of it. `references`: sha256.
    """
    wanted = references.where(F.coalesce("sha256", F.lit("")) != "").groupBy("sha256").agg(
        F.count(F.lit(1)).alias("n_refs")
    )
    return wanted.join(snapshots, "sha256", "left").withColumn("is_found", F.col("kind").isNotNull())


def mismatched(snapshots: DataFrame) -> DataFrame:
    """Snapshots whose content does not have the hash they are stored under."""
    return snapshots.where(F.sha2("content", 256) != F.col("sha256"))
