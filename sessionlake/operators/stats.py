"""Token, cost and price statistics.

Events are first summed per session (and bucket, and currency), which combines
on the map side, so a busy session costs no more than a quiet one. Everything
coarser is summed from that table. Money stays decimal until `published`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake import vocabulary as V
from sessionlake.functions.payload import MONEY, is_llm, with_payload
from sessionlake.operators.scope import ALL, Scope, events_in, events_scoped, of_sessions, sessions_in

COUNTS = ("llm_call_count", "tool_call_count")
TOKENS = ("tokens_in_total", "tokens_out_total", "cache_write_tokens_total", "cache_read_tokens_total")
COSTS = ("cost_input_total", "cost_output_total")
MEASURES = (*COUNTS, *TOKENS, *COSTS, "price_total")
MONEY_SUM = "decimal(38,12)"


def count_type(event_type: str) -> Column:
    return F.count_if(F.col("event_type") == event_type)


def token_sum(field: str) -> Column:
    return F.sum(F.when(is_llm(F.col("event_type")), F.col(field)).otherwise(0))


def cost_sum(field: str) -> Column:
    return F.sum(F.when(is_llm(F.col("event_type")), F.col(field)).otherwise(F.lit(0).cast(MONEY)))


def price_sum() -> Column:
    """NULL when no call in scope has a price; never made 0."""
    return F.sum(F.when(is_llm(F.col("event_type")), F.col(V.PRICE)))


def measures() -> list[Column]:
    """The nine measures over rows of `with_payload`, and the events counted."""
    return [
        count_type(V.LLM_RESPONSE).alias("llm_call_count"),
        count_type(V.TOOL_CALL_RESULT).alias("tool_call_count"),
        token_sum(V.TOKENS_IN).alias("tokens_in_total"),
        token_sum(V.TOKENS_OUT).alias("tokens_out_total"),
        token_sum(V.CACHE_WRITE_TOKENS).alias("cache_write_tokens_total"),
        token_sum(V.CACHE_READ_TOKENS).alias("cache_read_tokens_total"),
        cost_sum(V.COST_INPUT).alias("cost_input_total"),
        cost_sum(V.COST_OUTPUT).alias("cost_output_total"),
        price_sum().alias("price_total"),
        F.count("id").alias("event_count"),
    ]


def cost_total() -> Column:
    """Input and output cost together, at the full scale of both: the sum of
    two decimals of 38 digits would lose the last one."""
    part = "decimal(37,12)"
    return F.col("cost_input_total").cast(part) + F.col("cost_output_total").cast(part)


def summed() -> list[Column]:
    """The measures summed again from a finer table."""
    whole = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in (*COUNTS, *TOKENS, "event_count")]
    cost = [F.coalesce(F.sum(c), F.lit(0)).cast(MONEY_SUM).alias(c) for c in COSTS]
    return [*whole, *cost, F.sum("price_total").cast(MONEY_SUM).alias("price_total")]


def zero_filled(df: DataFrame) -> DataFrame:
    """Counters and costs of rows that an outer join found nothing for."""
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in (*COUNTS, *TOKENS, "event_count") if c in df.columns}
    zero |= {c: F.coalesce(F.col(c), F.lit(0).cast(MONEY_SUM)) for c in COSTS}
    return df.withColumns(zero)


def published(df: DataFrame) -> DataFrame:
    """Money as doubles, the form results are read in."""
    return df.withColumns({c: F.col(c).cast("double") for c in (*COSTS, "price_total") if c in df.columns})


def activity(
    events: DataFrame, scope: Scope = ALL, by: dict[str, Column] | None = None, sessions: DataFrame | None = None
) -> DataFrame:
    """The measures per session and, with `by`, per further key; and the
    latest event's time. With the sessions given, events of sessions outside
    the scope's session filters are left out before they are parsed and summed."""
    keys = [c.alias(n) for n, c in (by or {}).items()]
    found = events_in(events, scope) if sessions is None else events_scoped(events, sessions, scope)
    found = with_payload(found)
    return found.groupBy("session_id", *keys).agg(*measures(), F.max("ts").alias("last_ts"))


def session_stats(sessions: DataFrame, events: DataFrame, scope: Scope = ALL) -> DataFrame:
    """The sessions of a scope with their measures over the events in scope.

    A session without events stays, at 0, until a filter on events is set.
    """
    how = "inner" if scope.filters_events else "left"
    s = sessions_in(sessions, scope)
    a = activity(events, scope, sessions=sessions)
    return zero_filled(s.join(a, s["id"] == a["session_id"], how).drop("session_id", "last_ts"))


def totals(stats: DataFrame) -> DataFrame:
    """One row over all sessions of `session_stats`, one row even when none."""
    return stats.agg(F.count(F.lit(1)).alias("session_count"), *summed())


def scoped_activity(
    sessions: DataFrame, events: DataFrame, scope: Scope = ALL, by: dict[str, Column] | None = None
) -> DataFrame:
    """`activity` of known sessions only. A session filter is applied to the
    events; that a session is known at all is asked of its sums."""
    return of_sessions(activity(events, scope, by, sessions), sessions_in(sessions, scope))


def last_activity(events: DataFrame, scope: Scope = ALL) -> DataFrame:
    """Events and the latest time per event type and session."""
    return events_in(events, scope).groupBy("event_type", "session_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.max("ts").alias("last_ts")
    )
