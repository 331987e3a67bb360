"""Read the logical tables from files or from a database."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.functions.times import rfc3339
from sessionlake.session import configure
from sessionlake.sources.schema import SESSION_LABELS, TABLES, require_columns, text_schema


@dataclass(frozen=True)
class FileStore:
    """Tables as `<path>/<table>` in any format Spark reads by schema."""

    path: str
    format: str = "parquet"
    text_times: bool = False
    options: dict[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        location = f"{self.path}/{table}"
        reader = spark.read.format(self.format).options(**self.options)
        declared = text_schema(table) if self.text_times else TABLES[table]
        if self.format not in ("parquet", "orc"):
            return reader.schema(declared).load(location)
        # The files carry their own columns: those of all files together tell
        # whether the store has one, and files without it give NULL.
        there = dict(reader.option("mergeSchema", "true").load(location).dtypes)
        stored = [f for f in declared if f.name in there]
        names = {f.name for f in stored}
        return reader.schema(", ".join(
            [f"`{f.name}` {there[f.name]}" for f in stored] + [f"`{n}` {t}" for n, t in there.items() if n not in names]
        )).load(location)


@dataclass(frozen=True)
class JdbcStore:
    """Tables in a relational store, read in parallel.

    `seq_bounds` splits messages and session_events by their sequence number.
    `slices` names disjoint SQL conditions that together cover a table, for
    the tables without a number to split by. Without either, a table would
    come over one connection in one task, so it is refused, but for those named in
    `whole`.
    """

    url: str
    properties: dict[str, str] = field(default_factory=dict)
    seq_bounds: tuple[int, int] | None = None
    partitions: int = 64
    slices: dict[str, list[str]] = field(default_factory=dict)
    whole: tuple[str, ...] = ()

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        if table in self.slices:
            return spark.read.jdbc(self.url, table, predicates=self.slices[table], properties=self.properties)
        if self.seq_bounds and "seq" in TABLES[table].fieldNames():
            low, high = self.seq_bounds
            return spark.read.jdbc(
                self.url, table, column="seq", lowerBound=low, upperBound=high,
                numPartitions=self.partitions, properties=self.properties,
            )
        if table not in self.whole:
            raise ValueError(f"{table}: name slices for it, or seq_bounds, or list it in whole")
        return spark.read.jdbc(self.url, table, properties=self.properties)


def typed(df: DataFrame, table: str) -> DataFrame:
    """Cast to the logical types; a time stamp kept as text is parsed, and the
    text stays beside it as `<column>_text`."""
    found = dict(df.dtypes)
    columns = []
    for f in TABLES[table].fields:
        if f.name not in found:
            continue
        c = F.col(f.name)
        if isinstance(f.dataType, T.TimestampType) and found[f.name] == "string":
            columns += [rfc3339(c).alias(f.name), c.alias(f"{f.name}_text")]
        elif found[f.name] != f.dataType.simpleString():
            columns.append(c.try_cast(f.dataType).alias(f.name))
        else:
            columns.append(c)
    extra = [F.col(c) for c in df.columns if c not in TABLES[table].fieldNames()]
    return df.select(*columns, *extra)


@dataclass(frozen=True)
class Model:
    """The six tables; each is a plan, nothing is read until it is used."""

    sessions: DataFrame
    messages: DataFrame
    session_events: DataFrame
    prompt_snapshots: DataFrame
    ai_debug_events: DataFrame
    profile_usage: DataFrame


def read_model(spark: SparkSession, store: FileStore | JdbcStore) -> Model:
    """Read all tables of a store. Fails when the sessions table lacks a label
    column; a usage table without prices blocks only the budget report."""
    configure(spark)
    tables = {name: typed(store.read(spark, name), name) for name in TABLES}
    require_columns(tables["sessions"], "sessions", SESSION_LABELS)
    return Model(**tables)


def table_counts(model: Model) -> DataFrame:
    """Rows per table."""
    counts = None
    for name in TABLES:
        one = getattr(model, name).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts
