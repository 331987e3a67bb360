"""The reports a reader asks for, composed from the operators."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.payload import metadata_map
from sessionlake.functions.times import check_bucket_window
from sessionlake.operators.breakdown import by_event_type, sample_sessions, with_samples
from sessionlake.operators.budget import budget_balance
from sessionlake.operators.buckets import bucket_report, by_bucket, filled
from sessionlake.operators.currency import activity_by_currency, currency_map, or_empty, with_costs
from sessionlake.operators.digest import digested
from sessionlake.operators.events import event_rows, newest_events, session_rows
from sessionlake.operators.paging import after, page_rows
from sessionlake.operators.scope import ALL, Scope, of_sessions, sessions_in
from sessionlake.operators.stats import cost_total, published, totals, zero_filled
from sessionlake.operators.transcript import transcript
from sessionlake.workspace import written


def _kept(df: DataFrame, keep: bool) -> DataFrame:
    return written(df) if keep else df


def _with_stats(sessions: DataFrame, fine: DataFrame, scope: Scope) -> DataFrame:
    """Sessions in scope with their measures and currency map."""
    how = "inner" if scope.filters_events else "left"
    s = sessions_in(sessions, scope)
    a = with_costs(fine, "session_id")
    out = zero_filled(s.join(a, s["id"] == a["session_id"], how).drop("session_id"))
    return out.withColumn("cost_by_currency", or_empty(F.col("cost_by_currency")))


def _with_total_costs(total: DataFrame, fine: DataFrame, sessions: DataFrame, scope: Scope) -> DataFrame:
    """Add the currency map over all sessions in scope to a one-row table."""
    per_currency = of_sessions(fine, sessions_in(sessions, scope)).groupBy("currency").agg(
        F.sum(cost_total()).alias("cost")
    )
    costs = per_currency.agg(currency_map(F.col("currency"), F.col("cost")).alias("m"))
    return total.withColumn("cost_by_currency", or_empty(costs.scalar()))


@dataclass(frozen=True)
class SessionList:
    rows: DataFrame
    totals: DataFrame


def session_list(
    sessions: DataFrame, events: DataFrame, scope: Scope = ALL, *, sort: str = "created_at",
    direction: str = "desc", after_row: tuple | None = None, n: int | None = None, keep: bool = True,
) -> SessionList:
    """One page of sessions with their statistics, and totals over all of them.

    Both come from one table per session and currency. It is written to the
    shared folder, so that the events are scanned once; without `keep` each of
    the two results scans them for itself.
    """
    fine = _kept(activity_by_currency(events, scope, sessions=sessions), keep)
    stats = _with_stats(sessions, fine, scope)
    listed = after(stats, sort, direction, *after_row) if after_row else stats
    page = page_rows(listed, sort, direction, n)
    total = _with_total_costs(totals(stats), fine, sessions, scope)
    return SessionList(published(page), published(total))


@dataclass(frozen=True)
class SessionDetail:
    """Three tables, each in session order: one session's rows are contiguous
    but never gathered into one value."""

    sessions: DataFrame
    messages: DataFrame
    events: DataFrame

    def lines(self) -> DataFrame:
        """All three as one long table: session_id, part, pos, kind, body, tool_calls."""
        none = F.lit(None).cast("string").alias("tool_calls")
        head = self.sessions.select(
            F.col("id").alias("session_id"), F.lit("session").alias("part"), F.lit(0).cast("bigint").alias("pos"),
            F.col("interaction_kind").alias("kind"), F.col("title").alias("body"), none)
        told = self.messages.select(
            "session_id", F.lit("message").alias("part"), "pos", F.col("role").alias("kind"),
            F.col("content").alias("body"), "tool_calls")
        log = self.events.select(
            "session_id", F.lit("event").alias("part"), F.col("seq").alias("pos"),
            F.col("event_type").alias("kind"), F.col("id").alias("body"), none)
        return head.unionByName(told).unionByName(log)


def session_detail(
    sessions: DataFrame, messages: DataFrame, events: DataFrame, include_hidden: bool = False,
    scope: Scope = ALL, keep: bool = True,
) -> SessionDetail:
    """Every session of a scope in full. Its statistics cover all its events;
    of `scope` only the session filters apply.

    Statistics, errors and attribution come from one digest of the events, written to the
    shared folder, so payloads are read once for it and once for the text of calls;
    without `keep` each part reads them for itself.
    """
    chosen = sessions_in(sessions, scope)
    if scope.filters_sessions:
        messages, events = of_sessions(messages, chosen), of_sessions(events, chosen)
    digest = digested(events) if keep else None
    row = session_rows(chosen, metadata_map(F.col("metadata")).alias("metadata"))
    stats = published(_with_stats(row, activity_by_currency(digest if keep else events), ALL))
    return SessionDetail(stats, transcript(messages, events, include_hidden, digest=digest), event_rows(events))


@dataclass(frozen=True)
class EventStats:
    totals: DataFrame
    by_event_type: DataFrame | None = None
    time_buckets: DataFrame | None = None


def event_stats(
    sessions: DataFrame, events: DataFrame, scope: Scope = ALL, *, by_type: bool = False,
    samples: int = 0, bucket: str = "", keep: bool = True,
) -> EventStats:
    """Totals over events, and one breakdown of them: by type or by time.

    All come from one table per session, currency and type or bucket; `keep` as
    in `session_list`.
    """
    if by_type and scope.event_type:
        raise ValueError("event_type and by_type are mutually exclusive")
    if samples and not by_type:
        raise ValueError("samples requires by_type")
    if by_type and bucket:
        raise ValueError("bucket cannot be combined with by_type")
    if bucket:
        check_bucket_window(scope.since, scope.until, bucket)
    by = {"event_type": F.col("event_type")} if by_type else by_bucket(bucket) if bucket else {}
    fine = _kept(activity_by_currency(events, scope, by, sessions), keep)
    total = published(_with_total_costs(totals(_with_stats(sessions, fine, scope)), fine, sessions, scope))
    known = of_sessions(fine, sessions_in(sessions, scope))
    if bucket:
        series = filled(events.sparkSession, bucket_report(known), scope.since, scope.until, bucket)
        return EventStats(total, time_buckets=published(series))
    if not by_type:
        return EventStats(total)
    types = by_event_type(known)
    if samples:
        latest = known.groupBy("event_type", "session_id").agg(F.max("last_ts").alias("last_ts"))
        types = with_samples(types, sample_sessions(latest, samples))
    return EventStats(total, by_event_type=types)


def event_list(
    events: DataFrame, sessions: DataFrame, scope: Scope = ALL, *, n: int | None = None,
    after: tuple | None = None, include_payload: bool = True,
) -> DataFrame:
    """One page of events, newest first."""
    return newest_events(events, sessions, scope, n=n, after=after, include_payload=include_payload)


def budget_report(
    usage: DataFrame, since: str | datetime, kinds: str | Iterable[str] = (), group_id: str = ""
) -> DataFrame:
    """What each group, and each entity of it, has used since a time."""
    return budget_balance(usage, since, kinds, group_id).withColumn("price_total", F.col("price_total").cast("double"))
