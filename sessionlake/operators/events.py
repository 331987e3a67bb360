"""Event listings: newest first, incremental tails, presence, whole logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions.tokens import decode_event_token, event_token
from sessionlake.operators.paging import TIME_TEXT, Page, after_key, check_limit, first_of_each
from sessionlake.operators.scope import Scope, events_scoped
from sessionlake.vocabulary import DEFAULT_LIMIT

EVENT_COLUMNS = ("id", "session_id", "seq", "ts", "event_type", "parent_id", "duration_ms")


def event_rows(events: DataFrame, include_payload: bool = True) -> DataFrame:
    """Rows as they are listed; without the payload its column is not read."""
    rows = events.select(*EVENT_COLUMNS, *(["payload"] if include_payload else []))
    return rows.withColumns({
        "parent_id": F.coalesce("parent_id", F.lit("")),
        "duration_ms": F.coalesce("duration_ms", F.lit(0)),
    })


def session_rows(sessions: DataFrame, *more: Column) -> DataFrame:
    """Session rows as they are listed, with further columns of them; text that
    is absent is empty."""
    text = ("entity_id", "group_id", "title", "summary", "active_model",
            "interaction_kind", "system_source", "opened_by")
    return sessions.select("id", *text, "created_at", "updated_at", *more).withColumns(
        {c: F.coalesce(c, F.lit("")) for c in text}
    )


def newest_events(
    events: DataFrame, sessions: DataFrame, scope: Scope, *, n: int | None = None,
    after: tuple[Column, Column] | None = None, include_payload: bool = True,
) -> DataFrame:
    """The n latest events behind `after`, the columns (ts, id) of a boundary;
    `is_boundary` marks the next one."""
    n = check_limit(n)
    found = events_scoped(events, sessions, scope)
    if after is not None:
        found = found.where(after_key(F.col("ts"), F.col("id"), after[0], after[1], "desc"))
    order = [F.col("ts").desc_nulls_last(), F.desc("id")]
    probe = event_rows(found, include_payload).orderBy(*order).limit(n + 1)
    return (
        probe.withColumns({
            "pos": F.row_number().over(Window.orderBy(*order)),
            "_found": F.count(F.lit(1)).over(Window.partitionBy()),
        })
        .where(F.col("pos") <= n)
        .withColumn("is_boundary", (F.col("pos") == n) & (F.col("_found") > n))
        .drop("_found")
    )


def event_page(
    events: DataFrame, sessions: DataFrame, scope: Scope, token: str = "", n: int | None = None,
    include_payload: bool = True,
) -> Page:
    """One page on the driver: at most 200 events, and the token of the next."""
    behind = decode_event_token(token)
    after = (F.lit(behind[0]).cast("timestamp"), F.lit(behind[1])) if behind else None
    found = newest_events(events, sessions, scope, n=n, after=after, include_payload=include_payload)
    rows = found.withColumn("_token", event_token(F.date_format("ts", TIME_TEXT), F.col("id"))).orderBy("pos").collect()
    return Page(rows, next((r["_token"] for r in rows if r["is_boundary"]), ""))


def after_seq(events: DataFrame, positions: DataFrame) -> DataFrame:
    """Events behind the position each session was read to; a session without
    a position is not asked for. `positions`: session_id, since_seq from 0.

    A session too heavy for one task is split by Spark's skew join, see
    `sessionlake.session`.
    """
    asked = positions.where(F.col("since_seq") >= 0).select("session_id", "since_seq")
    return events.join(asked, "session_id").where(F.col("seq") > F.col("since_seq")).drop("since_seq")


def tail(
    events: DataFrame, positions: DataFrame, n: int | None = DEFAULT_LIMIT, include_payload: bool = True
) -> DataFrame:
    """The next n events of each session, in order, all of them with n None.
    `has_more` tells that a session goes on."""
    if n is not None:
        check_limit(n)
    ahead = after_seq(event_rows(events, include_payload), positions)
    return first_of_each(ahead, "session_id", ["seq"], n)


def presence(positions: DataFrame, sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Whether each asked-for session is unknown, caught up, or has new rows;
    a position below 0 is invalid."""
    new = after_seq(events, positions).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_new"))
    known = sessions.select(F.col("id").alias("session_id"), F.lit(True).alias("_known"))
    return (
        positions.join(known, "session_id", "left").join(new, "session_id", "left")
        .select(
            "session_id", "since_seq",
            F.coalesce("n_new", F.lit(0)).alias("n_new"),
            F.when(F.col("since_seq") < 0, "invalid")
            .when(F.col("_known").isNull(), "unknown")
            .when(F.col("n_new").isNull(), "caught_up").otherwise("has_rows").alias("state"),
        )
    )


def event_log(events: DataFrame) -> DataFrame:
    """The whole log, sorted by session and sequence. The sort is by ranges of
    the full key, so a long session spans several tasks."""
    return event_rows(events).orderBy("session_id", "seq")
