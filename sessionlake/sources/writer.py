"""Write the event log in the layout the operators prune by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.operators.ordered import ranges_for

ROWS_PER_FILE = 1 << 19


def write_events(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Partition by day and cluster each day's files by session and sequence.

    The range split uses the whole key, so one session that fills a day is
    spread over many files, and a time window or one session reads few.
    """
    key = ["event_date", "session_id", "seq"]
    (
        events.withColumn("event_date", F.to_date("ts"))
        .repartitionByRange(ranges_for(events.count(), ROWS_PER_FILE), *key)
        .sortWithinPartitions(*key)
        .write.mode(mode).partitionBy("event_date").parquet(path)
    )


def write_messages(messages: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Cluster the messages by session and sequence."""
    key = ["session_id", "seq"]
    messages.repartitionByRange(ranges_for(messages.count(), ROWS_PER_FILE), *key).sortWithinPartitions(*key).write.mode(mode).parquet(path)
