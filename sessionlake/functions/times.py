"""Time stamps, time windows and bucket keys. All times are UTC instants; the
session's time zone must be UTC, as `sessionlake.session` sets it."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.vocabulary import MAX_BUCKETS

# RFC 3339: the offset is required.
RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"


def rfc3339(c: Column) -> Column:
    """Parse text to an instant; NULL when it is not RFC 3339 with an offset."""
    return F.when(c.rlike(RFC3339), F.try_to_timestamp(c))


def instant(value: str | datetime | None) -> datetime | None:
    """A window bound as a UTC datetime. Text must be RFC 3339; empty is None."""
    if value is None or value == "":
        return None
    if isinstance(value, str):
        if not re.match(RFC3339, value):
            raise ValueError(f"invalid timestamp {value!r}: expected RFC3339")
        value = datetime.fromisoformat(value)
    if value.tzinfo is None:
        raise ValueError(f"timestamp {value!r} names no offset")
    return value.astimezone(timezone.utc)


def instant_literal(value: datetime) -> Column:
    """A UTC datetime as a timestamp literal, whatever the Python zone is."""
    micros = (value - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
    return F.timestamp_micros(F.lit(micros))


def check_granularity(granularity: str) -> str:
    if granularity not in MAX_BUCKETS:
        raise ValueError(f"bucket: unsupported value {granularity!r} (allowed: {', '.join(MAX_BUCKETS)})")
    return granularity


def bucket_start(ts: Column, granularity: str) -> Column:
    """Start of the UTC day, ISO week (Monday), month or year."""
    return F.date_trunc(check_granularity(granularity), ts)


def bucket_key(ts: Column, granularity: str) -> Column:
    return F.date_format(bucket_start(ts, granularity), "yyyy-MM-dd")


def bucket_count(since: datetime, until: datetime, granularity: str) -> int:
    """How many buckets [since, until) covers, fully or in part."""
    check_granularity(granularity)
    if until <= since:
        return 0
    last = until - timedelta(microseconds=1)
    if granularity == "year":
        return last.year - since.year + 1
    if granularity == "month":
        return (last.year - since.year) * 12 + last.month - since.month + 1
    first_day, last_day = since.date(), last.date()
    if granularity == "week":
        first_day -= timedelta(days=first_day.weekday())
        last_day -= timedelta(days=last_day.weekday())
        return (last_day - first_day).days // 7 + 1
    return (last_day - first_day).days + 1


def check_bucket_window(
    since: str | datetime | None, until: str | datetime | None, granularity: str
) -> tuple[datetime, datetime]:
    """Both bounds, or an error: they are required, in order, and limited."""
    start, end = instant(since), instant(until)
    if start is None or end is None:
        raise ValueError("buckets require both since and until")
    if start >= end:
        raise ValueError("buckets require since < until")
    limit = MAX_BUCKETS[check_granularity(granularity)]
    if bucket_count(start, end, granularity) > limit:
        raise ValueError(f"bucket={granularity}: window exceeds {limit} buckets")
    return start, end


def bucket_scaffold(
    spark: SparkSession, since: str | datetime, until: str | datetime, granularity: str
) -> DataFrame:
    """Every bucket key of [since, until); at most the granularity's limit."""
    start, end = check_bucket_window(since, until, granularity)
    steps = F.sequence(
        bucket_start(instant_literal(start), granularity),
        # until itself is outside: a bucket starting at it is not covered
        instant_literal(end - timedelta(microseconds=1)),
        F.expr(f"interval 1 {granularity}"),
    )
    return spark.range(1).select(F.explode(steps).alias("start")).select(
        F.date_format("start", "yyyy-MM-dd").alias("bucket")
    )
