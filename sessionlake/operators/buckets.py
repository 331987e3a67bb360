"""Time series by UTC day, ISO week, month or year."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.functions.times import bucket_key, bucket_scaffold, check_bucket_window
from sessionlake.operators.currency import currency_map, or_empty
from sessionlake.operators.scope import ALL, Scope
from sessionlake.operators.stats import cost_total, scoped_activity, summed, zero_filled


def by_bucket(granularity: str) -> dict:
    return {"bucket": bucket_key(F.col("ts"), granularity)}


def time_buckets(sessions: DataFrame, events: DataFrame, granularity: str, scope: Scope = ALL) -> DataFrame:
    """Measures per bucket that holds an event of a known session.

    The summed table has one row per session and bucket, so counting its rows
    counts distinct sessions.
    """
    return (
        scoped_activity(sessions, events, scope, by_bucket(granularity))
        .groupBy("bucket").agg(F.count(F.lit(1)).alias("session_count"), *summed())
    )


def rolled_up(sessions: DataFrame, events: DataFrame, granularity: str, scope: Scope = ALL) -> DataFrame:
    """The buckets and, with a NULL bucket, their total, over the same rows."""
    return (
        scoped_activity(sessions, events, scope, by_bucket(granularity))
        .rollup("bucket")
        .agg(F.grouping("bucket").cast("int").alias("is_total"),
             F.count_distinct("session_id").alias("session_count"), *summed())
    )


def bucket_report(fine: DataFrame) -> DataFrame:
    """Buckets with their currency map, from the measures per session, bucket
    and currency."""
    costs = cost_total()
    per_currency = fine.groupBy("bucket", "currency").agg(*summed())
    mapped = per_currency.groupBy("bucket").agg(
        *summed(), currency_map(F.col("currency"), costs).alias("cost_by_currency")
    )
    # a session has one row per currency here, so its buckets are counted apart
    present = (
        fine.select("session_id", "bucket").distinct()
        .groupBy("bucket").agg(F.count(F.lit(1)).alias("session_count"))
    )
    return mapped.join(present, "bucket")


def filled(
    spark: SparkSession, buckets: DataFrame, since: str | datetime, until: str | datetime, granularity: str
) -> DataFrame:
    """Every bucket of the window; the empty ones at 0, price NULL, no costs."""
    check_bucket_window(since, until, granularity)
    out = zero_filled(bucket_scaffold(spark, since, until, granularity).join(buckets, "bucket", "left"))
    out = out.withColumn("session_count", F.coalesce("session_count", F.lit(0)))
    if "cost_by_currency" in out.columns:
        out = out.withColumn("cost_by_currency", or_empty(F.col("cost_by_currency")))
    return out
