"""Events per type, with the sessions that were active last."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.operators.scope import ALL, Scope, of_sessions, sessions_in
from sessionlake.operators.stats import last_activity
from sessionlake.vocabulary import MAX_SAMPLE_SESSIONS


def active(sessions: DataFrame, events: DataFrame, scope: Scope = ALL) -> DataFrame:
    """Events and latest time per type and known session."""
    return of_sessions(last_activity(events, scope), sessions_in(sessions, scope))


def by_event_type(active_sessions: DataFrame) -> DataFrame:
    """Count per type, and its place: most frequent first, then by name."""
    counts = active_sessions.groupBy("event_type").agg(F.sum("event_count").alias("event_count"))
    # one row per event type is left here
    place = Window.orderBy(F.desc("event_count"), F.asc_nulls_first("event_type"))
    return counts.withColumn("pos", F.row_number().over(place))


def sample_sessions(active_sessions: DataFrame, n: int) -> DataFrame:
    """Per type, the n sessions active last; on a tie the smaller id first.

    Ranks sessions, not events, and each task keeps n per type before the
    shuffle, so the most frequent type is not gathered in one place.
    """
    if not 1 <= n <= MAX_SAMPLE_SESSIONS:
        raise ValueError(f"sample_sessions: must be in 1..{MAX_SAMPLE_SESSIONS}")
    latest = Window.partitionBy("event_type").orderBy(F.desc_nulls_last("last_ts"), F.asc("session_id"))
    return (
        active_sessions
        .withColumn("rank", F.row_number().over(latest)).where(F.col("rank") <= n)
        .select("event_type", "rank", "session_id", "last_ts")
    )


def with_samples(by_type: DataFrame, samples: DataFrame) -> DataFrame:
    """The breakdown with its sample ids as an array of at most five."""
    ids = samples.groupBy("event_type").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "session_id"))), lambda s: s["session_id"])
        .alias("sample_session_ids")
    )
    return by_type.join(ids, "event_type", "left")
