"""The conversation as it is read: messages, and an error row where a call failed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake import vocabulary as V
from sessionlake.functions.text import error_excerpt, error_text, metadata_or_null
from sessionlake.operators.ordered import numbered, running_max_by_seq
from sessionlake.operators.scope import visible
from sessionlake.operators.toolcalls import attribute_tool_calls

COLUMNS = ("session_id", "pos", "seq", "role", "content", "tool_calls", "tool_call_id",
           "metadata", "visibility", "created_at")


#: What a digest has of an error.
SAID, EXCERPT = "error_text", "error_excerpt"


def error_rows(events: DataFrame) -> DataFrame:
    """A message row per failed call, with seq 0, and the whole excerpt of the
    response, of which the content holds a short one only. A call whose time
    cannot be parsed has no place and is left out."""
    failed = events.where((F.col("event_type") == V.LLM_ERROR) & F.col("ts").isNotNull())
    known = SAID in events.columns
    return failed.select(
        "session_id", F.col("seq").alias("event_seq"), F.lit(0).cast("bigint").alias("seq"),
        F.lit("error").alias("role"), (F.col(SAID) if known else error_text(F.col("payload"))).alias("content"),
        F.col("ts").alias("created_at"), (F.col(EXCERPT) if known else error_excerpt(F.col("payload"))).alias("excerpt"),
    )


def positions(messages: DataFrame, events: DataFrame, ranges: int | None = None) -> DataFrame:
    """Place of each message and error row: session_id, is_error, own_seq, pos.

    Messages keep their order; an error stands before the first message that is
    later than it. With each side keyed by its latest time so far, that is a
    sort by (key, errors last, own sequence). Only keys and sequences move.
    """
    own = messages.select("session_id", "seq", F.col("created_at").alias("at"))
    failed = events.where((F.col("event_type") == V.LLM_ERROR) & F.col("ts").isNotNull()).select(
        "session_id", "seq", F.col("ts").alias("at")
    )
    def keyed(df, is_error):
        return running_max_by_seq(df, "at", "key").select(
            "session_id", "key", F.lit(is_error).alias("is_error"), F.col("seq").alias("own_seq")
        )
    both = keyed(own, 0).unionByName(keyed(failed, 1))
    return numbered(both, ["session_id"], ["key", "is_error", "own_seq"], ranges=ranges)


def transcript(
    messages: DataFrame, events: DataFrame, include_hidden: bool = False,
    with_tool_calls: bool = True, ranges: int | None = None, digest: DataFrame | None = None,
) -> DataFrame:
    """All transcripts, one row per message or error, ordered by pos. With a digest of the events,
    payloads are read for the text of calls only."""
    shown = visible(messages, include_hidden)
    narrow = events if digest is None else digest
    place = positions(shown, narrow, ranges)
    rows = shown.withColumn("metadata", metadata_or_null(F.col("metadata"))).drop("tool_calls")
    if with_tool_calls:
        calls = attribute_tool_calls(messages, events, include_hidden, digest).select("session_id", "seq", "tool_calls")
        rows = rows.join(calls, ["session_id", "seq"], "left")
    else:
        rows = rows.withColumn("tool_calls", F.lit(None).cast("string"))
    of_messages = place.where(F.col("is_error") == 0).select("session_id", F.col("own_seq").alias("seq"), "pos")
    of_errors = place.where(F.col("is_error") == 1).select("session_id", F.col("own_seq").alias("event_seq"), "pos")
    told = rows.join(of_messages, ["session_id", "seq"])
    failed = error_rows(narrow).join(of_errors, ["session_id", "event_seq"]).drop("event_seq")
    return told.unionByName(failed, allowMissingColumns=True).select(*COLUMNS)
