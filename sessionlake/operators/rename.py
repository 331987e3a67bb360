"""Set session titles, the one change the log's sessions take."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.text import title_problem, trimmed


def apply_renames(sessions: DataFrame, renames: DataFrame, now: Column | datetime) -> tuple[DataFrame, DataFrame]:
    """(sessions with new titles, refused renames).

    `renames`: id, title, seq; the one with the greatest seq wins, whatever the
    title was before. A refused rename changes nothing and names its reason.
    """
    checked = renames.withColumn("title", trimmed(F.col("title"))).withColumn("reason", title_problem(F.col("title")))
    # combines on the map side: an id renamed very often stays one row per task
    latest = (
        checked.where(F.col("reason").isNull())
        .groupBy("id").agg(F.max_by("title", "seq").alias("_title"))
    )
    updated = sessions.join(latest, "id", "left").withColumns({
        "title": F.coalesce("_title", "title"),
        "updated_at": F.when(F.col("_title").isNotNull(), now if isinstance(now, Column) else F.lit(now))
        .otherwise(F.col("updated_at")),
    }).select(*sessions.columns)
    known = sessions.select("id", F.lit(True).alias("_known"))
    rejects = (
        checked.join(known, "id", "left")
        .withColumn("reason", F.coalesce("reason", F.when(F.col("_known").isNull(), "unknown session")))
        .where(F.col("reason").isNotNull()).select("id", "title", "seq", "reason")
    )
    return updated, rejects
