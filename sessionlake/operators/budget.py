"""What budgets have used: customer prices of finished runs."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.payload import MONEY, money
from sessionlake.functions.text import trim
from sessionlake.functions.times import instant, instant_literal
from sessionlake.operators.ordered import running
from sessionlake.operators.stats import MONEY_SUM
from sessionlake.sources.schema import require_columns
from sessionlake.vocabulary import DEFAULT_BUDGET_KIND


def kinds_list(kinds: str | Iterable[str]) -> list[str]:
    parts = kinds.split(",") if isinstance(kinds, str) else kinds
    return [t for t in (trim(k) for k in parts) if t] or [DEFAULT_BUDGET_KIND]


def _priced(usage: DataFrame) -> DataFrame:
    require_columns(usage, "profile_usage", ("price",))
    return usage.withColumn("price", F.coalesce(money(F.col("price")), F.lit(0).cast(MONEY)))


def _used(usage: DataFrame, since: str | datetime, kinds, group_id: str) -> DataFrame:
    start = instant(since)
    if start is None:
        raise ValueError("since: required (RFC3339 with offset)")
    used = _priced(usage).where(
        (F.col("created_at") >= instant_literal(start)) & F.col("interaction_kind").isin(*kinds_list(kinds))
    )
    return used.where(F.col("group_id") == group_id) if group_id else used


def budget_balance(
    usage: DataFrame, since: str | datetime, kinds: str | Iterable[str] = (), group_id: str = ""
) -> DataFrame:
    """Price used since a time: per group (level `group`) and per entity of it
    (level `entity`), from one pass. A row without a price counts 0; an entity
    with only such rows is there with 0. `group_id` limits it to one group."""
    return (
        _used(usage, since, kinds, group_id)
        .where(F.col("group_id").isNotNull())
        .groupBy("group_id", "entity_id").agg(F.sum("price").alias("price"))
        .rollup("group_id", "entity_id")
        .agg(F.grouping("group_id").alias("_all"), F.grouping("entity_id").alias("_group"),
             F.sum("price").alias("price_total"))
        .where(F.col("_all") == 0)
        .select(F.when(F.col("_group") == 1, "group").otherwise("entity").alias("level"),
                "group_id", "entity_id", "price_total")
    )


def budget_of(usage: DataFrame, group_id: str, since: str | datetime, kinds: str | Iterable[str] = ()) -> DataFrame:
    """One group's total, one row also when it used nothing."""
    if not group_id:
        raise ValueError("group_id: required")
    return _used(usage, since, kinds, group_id).agg(
        F.coalesce(F.sum("price"), F.lit(0)).alias("price_total")
    )


def usage_by_day(usage: DataFrame, starts: DataFrame) -> DataFrame:
    """Usage (group_id, entity_id, kind, at, price) of the groups and kinds that have a rule, summed by
    day, and by exact time on the days in which a rule of the group and kind starts (`starts`)."""
    day = F.date_trunc("day", F.col("at"))
    exact = starts.select("group_id", "kind", day.alias("day"), F.lit(True).alias("exact")).distinct()
    return (
        usage.join(starts.select("group_id", "kind").distinct(), ["group_id", "kind"], "left_semi")
        .withColumn("day", day).join(exact, ["group_id", "kind", "day"], "left")
        .groupBy("group_id", "entity_id", "kind", F.when(F.col("exact"), F.col("at")).otherwise(F.col("day")).alias("at"))
        .agg(F.sum("price").alias("price"))
    )


def budget_usage(usage: DataFrame, rules: DataFrame, ranges: int | None = None) -> DataFrame:
    """Evaluate many rules at once.

    `rules`: rule_id, group_id, entity_id (NULL for the whole group), kinds
    (array, empty for chat), since, max_price. Usage and rule starts are put on
    one time line per group, entity and kind, and summed from its end: the sum
    at a rule's start is what the rule has used. No rule meets a usage row, so
    many rules on a busy group cost no more than their own rows.

    Usage before the earliest rule is not read, and of the rest only groups and kinds that
    have a rule are summed: by day, and by exact time on the days in which a rule of the group and
    kind starts. So what moves is days, not runs.
    """
    kinds = F.when(F.size("kinds") > 0, F.array_distinct("kinds")).otherwise(F.array(F.lit(DEFAULT_BUDGET_KIND)))
    line = ["group_id", "whole_group", "entity", "kind"]
    starts = rules.select(
        "group_id", F.col("entity_id").isNull().alias("whole_group"), F.coalesce("entity_id", F.lit("")).alias("entity"),
        F.explode(kinds).alias("kind"), F.col("since").alias("at"), F.lit(0).alias("is_usage"), "rule_id",
    )
    # one value; a constant, so that it reaches the scan
    earliest = starts.agg(F.unix_micros(F.min("at"))).first()[0]
    recent = _priced(usage).select(
        "group_id", "entity_id", F.col("interaction_kind").alias("kind"), F.col("created_at").alias("at"), "price")
    if earliest is not None:
        recent = recent.where(F.col("at") >= F.timestamp_micros(F.lit(earliest)))
    by_day = usage_by_day(recent, starts)
    spent = (
        # once for the rules of the entity, once for those of its group
        by_day.withColumn("whole_group", F.explode(F.array(F.lit(False), F.lit(True))))
        .withColumn("entity", F.when(F.col("whole_group"), "").otherwise(F.col("entity_id")))
        .join(starts.select(*line).distinct(), line, "left_semi")
        .groupBy(*line, "at").agg(F.sum("price").cast(MONEY_SUM).alias("price"))
        .withColumn("is_usage", F.lit(1))
    )
    both = spent.unionByName(starts, allowMissingColumns=True)
    # from the latest on; usage at the very time a rule starts is before it here, so it counts
    summed = running(both, line, ["at", "is_usage", "rule_id"], sums={"used": F.coalesce("price", F.lit(0).cast(MONEY_SUM))},
                     descending=True, ranges=ranges)
    used = summed.where(F.col("is_usage") == 0).groupBy("rule_id").agg(F.sum("used").alias("used"))
    return rules.join(used, "rule_id").select(
        "rule_id", "group_id", "entity_id", F.col("used").alias("price_total"), "max_price",
        (F.col("used") >= F.col("max_price")).alias("is_used_up"),
    )
