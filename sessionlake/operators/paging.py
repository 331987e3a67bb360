"""Sorted lists, pages after a boundary, and all page boundaries at once."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from sessionlake.functions.tokens import decode_token, encode_token
from sessionlake.operators.ordered import numbered
from sessionlake.operators.stats import cost_total
from sessionlake.vocabulary import DEFAULT_LIMIT, MAX_LIMIT

TIME_TEXT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
DIRECTIONS = ("asc", "desc")


@dataclass(frozen=True)
class SortKey:
    """A column to list by, its type, and its text in a page token."""

    value: Column
    kind: str

    def text(self) -> Column:
        if self.kind == "timestamp":
            return F.date_format(self.value, TIME_TEXT)
        return self.value.cast("string")

    def parsed(self, text: str) -> Column:
        if self.kind == "timestamp":
            return F.lit(text).cast("timestamp")
        return F.lit(text).cast(self.kind)


def sort_key(name: str) -> SortKey:
    keys = {
        "created_at": SortKey(F.col("created_at"), "timestamp"),
        "updated_at": SortKey(F.col("updated_at"), "timestamp"),
        # a session without a model sorts as the empty name
        "active_model": SortKey(F.coalesce("active_model", F.lit("")), "string"),
        "cost_total": SortKey(cost_total(), "decimal(38,12)"),
        "llm_call_count": SortKey(F.col("llm_call_count"), "bigint"),
        "tool_call_count": SortKey(F.col("tool_call_count"), "bigint"),
        "tokens_in_total": SortKey(F.col("tokens_in_total"), "bigint"),
        "tokens_out_total": SortKey(F.col("tokens_out_total"), "bigint"),
    }
    if name not in keys:
        raise ValueError(f"sort: unsupported key {name!r} (allowed: {', '.join(keys)})")
    return keys[name]


def check_direction(direction: str) -> str:
    if direction not in DIRECTIONS:
        raise ValueError(f"direction: must be 'asc' or 'desc', got {direction!r}")
    return direction


def check_limit(n: int | None, default: int = DEFAULT_LIMIT, most: int = MAX_LIMIT) -> int:
    n = default if n is None else n
    if not 1 <= n <= most:
        raise ValueError(f"limit: must be in 1..{most}, got {n}")
    return n


def after_key(key: Column, row_id: Column, value: Column, last_id: Column, direction: str) -> Column:
    """Rows that come after (value, last_id) in the order. NULL comes first in
    ascending order and last in descending order."""
    same = key.eqNullSafe(value)
    if check_direction(direction) == "asc":
        return (key > value) | (value.isNull() & key.isNotNull()) | (same & (row_id > last_id))
    return (key < value) | (value.isNotNull() & key.isNull()) | (same & (row_id < last_id))


def first_of_each(df: DataFrame, group: str, order: list[str], n: int | None) -> DataFrame:
    """Each group's first n rows, all with n None: `pos`, and `has_more` on every
    row of a group that goes on. Each task keeps n + 1 before the shuffle. Whole
    groups are numbered through ranges of their order, never in one task: only the keys are
    ordered, and the rows meet their places by the whole key, so a long group spreads over the tasks."""
    if n is None:
        key = [group, *order]
        place = numbered(df.select(*key), [group], order).select(*[F.col(c).alias(f"_{c}") for c in key], "pos")
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
        return df.join(place, same).select(*df.columns, F.col("pos").cast("int").alias("pos"), F.lit(False).alias("has_more"))
    place = Window.partitionBy(group).orderBy(*order)
    placed = df.withColumn("pos", F.row_number().over(place))
    some = placed.where(F.col("pos") <= n + 1)
    return some.withColumn("has_more", F.max("pos").over(Window.partitionBy(group)) > n).where(F.col("pos") <= n)


def _order(key: Column, direction: str, row_id: str = "id") -> list[Column]:
    if check_direction(direction) == "asc":
        return [key.asc_nulls_first(), F.asc(row_id)]
    return [key.desc_nulls_last(), F.desc(row_id)]


def after(df: DataFrame, sort: str, direction: str, value: str | datetime | int | None, last_id: str) -> DataFrame:
    """Rows behind a boundary. On a stored column the filter reaches the scan
    side of the aggregation; on a measure it follows it."""
    key = sort_key(sort)
    bound = key.parsed(value) if isinstance(value, str) else F.lit(value).cast(key.kind)
    return df.where(after_key(key.value, F.col("id"), bound, F.lit(last_id), direction))


def top_sessions(stats: DataFrame, sort: str, direction: str = "desc", n: int | None = None) -> DataFrame:
    """The first n rows with their place. Each task keeps n."""
    order = _order(sort_key(sort).value, direction)
    first = stats.orderBy(*order).limit(check_limit(n))
    return first.withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def page_rows(
    stats: DataFrame, sort: str = "created_at", direction: str = "desc", n: int | None = None
) -> DataFrame:
    """The first n rows; `is_boundary` marks the one the next page starts
    behind, and no row when this is the last page."""
    n = check_limit(n)
    order = _order(sort_key(sort).value, direction)
    probe = stats.orderBy(*order).limit(n + 1)
    place = Window.orderBy(*order)
    return (
        probe.withColumns({
            "pos": F.row_number().over(place),
            "_found": F.count(F.lit(1)).over(Window.partitionBy()),
        })
        .where(F.col("pos") <= n)
        .withColumn("is_boundary", (F.col("pos") == n) & (F.col("_found") > n))
        .drop("_found")
    )


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    next_token: str


def page(stats: DataFrame, sort: str = "created_at", direction: str = "desc",
         token: str = "", n: int | None = None) -> Page:
    """One page on the driver: at most 200 rows, and the token of the next."""
    key = sort_key(sort)
    boundary = decode_token(token, sort, check_direction(direction))
    if boundary:
        stats = after(stats, sort, direction, *boundary)
    rows = page_rows(stats.withColumn("_token_value", key.text()), sort, direction, n).orderBy("pos").collect()
    last = next((r for r in rows if r["is_boundary"]), None)
    return Page(rows, encode_token(sort, direction, last["_token_value"], last["id"]) if last else "")


def page_index(stats: DataFrame, sort: str, direction: str, n: int, ranges: int | None = None) -> DataFrame:
    """The last row of every full page: all boundaries of walking the list.

    Numbers the whole list through ranges of its order, never in one task.
    """
    n = check_limit(n)
    key = sort_key(sort)
    listed = stats.select("id", key.value.alias("sort_value"))
    down = check_direction(direction) == "desc"
    out = numbered(listed, [], ["sort_value", "id"], descending=down, ranges=ranges)
    return out.where(F.col("pos") % n == 0).withColumn("page", (F.col("pos") / n).cast("bigint"))
