"""Raw provider traffic, in the order it was written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.operators.ordered import running
from sessionlake.operators.paging import after_key, check_limit, first_of_each
from sessionlake.vocabulary import DEFAULT_REPLAY_LIMIT, MAX_REPLAY_LIMIT


def debug_replay(
    debug_events: DataFrame, n: int | None = DEFAULT_REPLAY_LIMIT, positions: DataFrame | None = None
) -> DataFrame:
    """The first n rows of each session, all of them with n None; the body as it
    is stored. `has_more` tells that a session goes on.

    positions: session_id, after_ts, after_id. Sessions in it go on behind that
    row, others are left out; after_id NULL is a session's beginning.
    """
    if n is not None:
        check_limit(n, DEFAULT_REPLAY_LIMIT, MAX_REPLAY_LIMIT)
    rows = debug_events.select(
        "id", "session_id", F.coalesce("trace_id", F.lit("")).alias("trace_id"), "ts", "direction",
        F.coalesce("status", F.lit(0)).alias("status"), F.coalesce("url", F.lit("")).alias("url"), "body",
    )
    if positions is not None:
        behind = after_key(F.col("ts"), F.col("id"), F.col("after_ts"), F.col("after_id"), "asc")
        rows = rows.join(positions.select("session_id", "after_ts", "after_id"), "session_id").where(
            F.col("after_id").isNull() | behind).drop("after_ts", "after_id")
    return first_of_each(rows, "session_id", ["ts", "id"], n)


def debug_pairs(debug_events: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each response with the request directly before it in its session; NULL
    when another row stands there. Bodies are not moved."""
    rows = running(
        debug_events.select("session_id", "ts", "id", "direction"), ["session_id"], ["ts", "id"],
        previous={"before_id": "id", "before_direction": "direction"}, ranges=ranges,
    )
    return rows.where(F.col("direction") == "response").select(
        "session_id", F.col("id").alias("response_id"),
        F.when(F.col("before_direction") == "request", F.col("before_id")).alias("request_id"),
    )
