"""Provider cost per currency. Nothing is converted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake import vocabulary as V
from sessionlake.functions.payload import is_llm, with_payload
from sessionlake.operators.scope import ALL, Scope, events_in, events_scoped, of_sessions, sessions_in
from sessionlake.operators.stats import activity, cost_total, summed

NO_COSTS = "map<string,double>"


def session_costs(
    events: DataFrame, scope: Scope = ALL, by: dict[str, Column] | None = None, sessions: DataFrame | None = None
) -> DataFrame:
    """Decimal cost per session, currency and further key, of responses only.
    `sessions` as in `activity`."""
    keys = [c.alias(n) for n, c in (by or {}).items()]
    found = events_in(events, scope) if sessions is None else events_scoped(events, sessions, scope)
    return (
        with_payload(found.where(is_llm(F.col("event_type"))))
        .groupBy("session_id", *keys, F.col(V.COST_CURRENCY).alias("currency"))
        .agg(F.sum(F.col(V.COST_INPUT) + F.col(V.COST_OUTPUT)).alias("cost"))
    )


def cost_by_currency(
    sessions: DataFrame, events: DataFrame, scope: Scope = ALL,
    by: dict[str, Column] | None = None, per_session: bool = False, page: DataFrame | None = None,
) -> DataFrame:
    """Cost per currency over the scope, per session and per `by`.

    `page` limits it to the sessions of a result; an empty page has no rows.
    """
    costs = of_sessions(session_costs(events, scope, by, sessions), sessions_in(sessions, scope))
    if page is not None:
        costs = of_sessions(costs, page)
    if per_session:
        return costs  # already one row per session and currency
    return costs.groupBy(*(by or {}), "currency").agg(F.sum("cost").alias("cost"))


def costs_published(costs: DataFrame) -> DataFrame:
    return costs.withColumn("cost", F.col("cost").cast("double"))


def currency_map(currency: Column, cost: Column) -> Column:
    """Aggregate currency rows of a key into a map, {} when there are none."""
    pairs = F.collect_list(F.when(currency.isNotNull(), F.struct(currency.alias("k"), cost.cast("double").alias("v"))))
    return F.map_from_entries(F.array_sort(pairs))


def or_empty(costs: Column) -> Column:
    return F.coalesce(costs, F.create_map().cast(NO_COSTS))


def with_costs(activity_by_currency: DataFrame, *keys: str) -> DataFrame:
    """Measures and currency map per key, from one table that is already
    summed per key and currency (currency NULL for other events)."""
    return activity_by_currency.groupBy(*keys).agg(
        *summed(),
        currency_map(F.col("currency"), cost_total())
        .alias("cost_by_currency"),
    )


def activity_by_currency(
    events: DataFrame, scope: Scope = ALL, by: dict[str, Column] | None = None, sessions: DataFrame | None = None
) -> DataFrame:
    """`activity` split by currency: statistics and currencies in one scan."""
    return activity(events, scope, {**(by or {}), "currency": F.col(V.COST_CURRENCY)}, sessions)
