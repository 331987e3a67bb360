"""Column builders and ranks that several of these operators use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlake.workspace import written

#: The white space of word splitting: space and \t \n \v \f \r.
SPACE = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where the tokenizer file of this name is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once per row however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole_row(df: DataFrame) -> Column:
    """All columns of df in one value, out of the way of columns that are added."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drawn(key: str, rows: Column, sample: int) -> Column:
    """Whether a row is among the about `sample` ones drawn from `rows` rows, by a hash of its key."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30) < F.lit(float(sample)) / rows


def words(text: Column) -> Column:
    """The runs of other characters than white space; none for a null text."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE_CLASS}+"))


def ranked(
    df: DataFrame, group: str, order: list[str], name: str, rows_per_range: int = 1 << 17, total: str | None = None,
) -> DataFrame:
    """Add the row's place, from 1, within its group (a column without nulls), and in a
    column `total`, if named, the group's number of rows.

    Rows are cut into ranges of the whole order, as many as the row count asks for, and
    numbered in each; the counts of earlier ranges are added. So a group may hold any
    share of the rows. Rows that tie in `order` get any of their places.
    """
    df = written(df, "unranked")
    key = [F.col(group), *(F.col(c).asc_nulls_first() for c in order)]
    ranges = max(1, -(-df.count() // rows_per_range))
    cut = written(df.repartitionByRange(ranges, *key).withColumn("_range", F.spark_partition_id()), "ranges")
    ahead = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    all_of = {total: F.sum("_n").over(Window.partitionBy(group))} if total else {}
    before = cut.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n")).select(
        group, "_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"),
        *[n.alias(c) for c, n in all_of.items()])
    here = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*key[1:]))
    return cut.withColumn("_here", here).join(before, [group, "_range"]).select(
        *df.columns, (F.col("_before") + F.col("_here")).alias(name), *all_of)


def joined_evenly(rows: DataFrame, values: DataFrame, key: str, count: str, share: int = 1000) -> DataFrame:
    """rows with the columns of `values`, which has one row per key with the key's number of
    rows in `count` (left out of the result).

    Keys with over a `share`-th of all rows, fewer than `share` in any table, are joined by
    broadcast and their rows stay spread; the others are joined by the key.
    """
    names = [c for c in values.columns if c not in (key, count)]
    known = values.select(key, count, F.struct(*names).alias("_value"))
    total = known.agg(F.sum(count)).first()[0] or 0
    hot = known.where(F.col(count) * share > total).select(key, F.col("_value").alias("_hot"))
    cold = known.where(F.col(count) * share <= total).select(
        F.col(key).alias("_key"), F.lit(0).alias("_salt"), F.col("_value").alias("_cold"))
    spread = F.xxhash64(*rows.columns, F.spark_partition_id())
    keyed = rows.join(F.broadcast(hot), key, "left").withColumns({
        "_key": F.when(F.col("_hot").isNull(), F.col(key)).otherwise(spread),
        "_salt": F.when(F.col("_hot").isNull(), 0).otherwise(1)})
    found = keyed.join(cold, ["_key", "_salt"], "left")
    return found.select(*rows.columns, F.coalesce("_hot", "_cold").alias("_value")).select(*rows.columns, "_value.*")
