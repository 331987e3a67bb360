"""Exact running values over a group's order, without one task per group.

A plain window sorts a whole group in one task, and one session may hold a
large part of all rows. Here the rows are cut into contiguous ranges of their
full order, each range is computed alone, and what precedes a range in its
group is added from one small row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.workspace import written

ROWS_PER_RANGE = 1 << 16


def ranges_for(rows: int, rows_per_range: int = ROWS_PER_RANGE) -> int:
    """How many ranges hold so many rows."""
    return max(1, -(-rows // rows_per_range))


def _filler(kind: str) -> Column:
    """Some value of the type, to stand for NULL beside a flag."""
    if kind in ("string", "binary"):
        return F.lit("").cast(kind)
    return F.lit({"boolean": "false", "date": "1970-01-01"}.get(kind, "1970-01-01" if kind.startswith("timestamp") else "0")).cast(kind)


def _twins(df: DataFrame, group: list[str]) -> dict[str, Column]:
    """Columns without NULL that are equal where the group columns are, so that
    they can be joined by plain equality, which keeps a partitioning."""
    kinds = dict(df.dtypes)
    found = {}
    for i, c in enumerate(group):
        found[f"_group{i}"] = F.coalesce(F.col(c), _filler(kinds[c]))
        found[f"_none{i}"] = F.col(c).isNull()
    return found


def running(
    df: DataFrame,
    group: list[str],
    order: list[str],
    *,
    sums: dict[str, Column] | None = None,
    previous: dict[str, str] | None = None,
    descending: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Add running totals and values of the previous row.

    sums: new column -> addend; the total runs to and includes the row, and is
    NULL only as long as nothing was added. previous: new column -> column whose
    value in the row before it takes. `group + order` must identify a row; NULL
    is a group like any other. The number of ranges follows from the number of
    rows; `ranges` overrides it.
    """
    sums, previous = sums or {}, previous or {}
    placed = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in order]
    twins = _twins(df, group)
    same = list(twins)
    rows = written(df.withColumns(twins))
    ranges = ranges or ranges_for(rows.count())
    if ranges == 1:  # nothing to cut, nothing to carry
        cut = rows.withColumn("_range", F.lit(0))
    else:
        cut = rows.repartitionByRange(ranges, *map(F.col, same), *placed)
        cut = written(cut.withColumn("_range", F.spark_partition_id()))

    within = Window.partitionBy(*same, "_range").orderBy(*placed)
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumns({n: F.sum(c).over(so_far) for n, c in sums.items()})
    if previous:
        local = local.withColumn("_before", F.lag(F.struct(*previous.values())).over(within))

    at_end = F.min_by if descending else F.max_by
    last = [at_end(F.struct(*previous.values()), F.struct(*order)).alias("_last")] if previous else []
    totals = cut.groupBy(*same, "_range").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()], *last
    )
    ahead = Window.partitionBy(*same).orderBy("_range")
    earlier = ahead.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *same, "_range",
        F.sum("_n").over(earlier).alias("_n"),
        *[F.sum(f"_sum_{n}").over(earlier).alias(f"_sum_{n}") for n in sums],
        *([F.lag("_last").over(ahead).alias("_last")] if previous else []),
    ).where(F.col("_n") > 0).drop("_n")
    # Ranges are contiguous, so only a range's first group can have begun
    # before it: at most one row per range, whatever the size of the data. Spark
    # broadcasts it while it is small; beyond that the join keeps the window's
    # partitioning and does not move the rows again.
    if ranges == 1:
        kinds = dict(carried.dtypes)
        out = local.withColumns({c: F.lit(None).cast(kinds[c]) for c in carried.columns if c not in (*same, "_range")})
    else:
        out = local.join(carried, [*same, "_range"], "left")

    def total(n: str) -> Column:
        zero = F.lit(0).cast(dict(out.dtypes)[n])
        return F.when(F.col(n).isNotNull() | F.col(f"_sum_{n}").isNotNull(),
                      F.coalesce(F.col(n), zero) + F.coalesce(F.col(f"_sum_{n}"), zero))

    return out.select(
        *df.columns,
        *[total(n).alias(n) for n in sums],
        *[F.when(F.col("_before").isNotNull(), F.col("_before")[c]).otherwise(F.col("_last")[c]).alias(n)
          for n, c in previous.items()],
    )


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "pos",
             descending: bool = False, ranges: int | None = None) -> DataFrame:
    """Add the row's place in its group, from 1."""
    one = F.lit(1).cast("bigint")
    return running(df, group, order, sums={name: one}, descending=descending, ranges=ranges)


def running_max_by_seq(df: DataFrame, value: str, name: str, rows: int = ROWS_PER_RANGE) -> DataFrame:
    """Add the greatest value so far within the session, by seq.

    A sequence number is unique in its session, so a stretch of `rows` numbers
    bounds a task without looking at the data. df is written once, as it is
    read for the stretches' own values and for the running ones.
    """
    cut = written(df.withColumn("_stretch", F.floor(F.col("seq") / rows)))
    to_row = Window.partitionBy("session_id", "_stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("session_id").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        cut.groupBy("session_id", "_stretch").agg(F.max(value).alias("_max"))
        .select("session_id", "_stretch", F.max("_max").over(before).alias("_carried"))
        .where(F.col("_carried").isNotNull())
    )
    return (
        cut.withColumn("_local", F.max(value).over(to_row))
        .join(carried, ["session_id", "_stretch"], "left")
        .select(*df.columns, F.greatest("_local", "_carried").alias(name))
    )
