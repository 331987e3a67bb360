"""Streams that keep the event tail, the session statistics and the time
buckets current.

Each batch of a stream writes one folder and commits it to the manifest of its
path (see `sessionlake.manifest`), so a batch makes as many file calls after a
year as at the start. A batch that runs again after a failure finds itself
committed and writes nothing. Sums are written per batch and added up on
reading: they hold no state in the stream, take events in any order of time
and without a time, and never leave one out.

Folders are merged in levels of ten: ten batches become one folder, ten of those
the next, at most one merge in a batch. Readers take some ten folders a level, so
their number grows with the logarithm of the batches, and a row is written again once a level.

Where the delivery may bring an event twice, `repeats` keeps the sums per event
id, sorted by id in merged folders, and copies are removed on merging and on
reading, however late they are.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sessionlake.functions.payload import with_payload
from sessionlake.functions.times import bucket_key
from sessionlake.manifest import RETAINED, Manifest, full_level
from sessionlake.operators.ordered import ranges_for
from sessionlake.operators.scope import of_sessions
from sessionlake.operators.stats import measures, summed

SKETCH = "sessions_sketch"
SKETCH_BITS = 14  # 16,384 registers: a standard error of 0.8%

Step = Callable[[DataFrame], DataFrame]


class Parts:
    """The folders of a stream: which batches each holds, in their order."""

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest | None = None):
        self._spark, self.path = spark, path
        self._manifest = manifest or Manifest(spark, path)
        found = self._manifest.content or {"schema": None, "parts": []}
        self.schema = T.StructType.fromJson(found["schema"]) if found["schema"] else None
        self.parts: list[list[int]] = found["parts"]

    @staticmethod
    def name(part: list[int]) -> str:
        return f"part-{part[0]}-{part[1]}"

    @property
    def latest(self) -> int:
        return self.parts[-1][1] if self.parts else -1

    def _commit(self, replaced: list[list[int]] = (), retained: float = RETAINED) -> None:
        content = {"schema": json.loads(self.schema.json()), "parts": self.parts}
        self._manifest.commit(content, [self.name(p) for p in replaced], retained)

    def begin(self, schema: T.StructType) -> None:
        """Make the table known, without rows; columns that a later version of a stream adds
        are NULL in what was written before."""
        known = {f.name: f for f in (*schema, *(self.schema or []))}
        if self.schema is None or len(known) > len(self.schema):
            self.schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in known.values()])
            self._commit()

    def add(self, batch_id: int) -> None:
        self.parts = [*self.parts, [batch_id, batch_id]]
        self._commit()

    def due(self) -> list[list[int]]:
        """The folders to be merged next."""
        sizes = {self.name(p): p[1] - p[0] + 1 for p in self.parts}
        wanted = set(full_level(sizes))
        return [p for p in self.parts if self.name(p) in wanted]

    def replace(self, old: list[list[int]], retained: float = RETAINED) -> None:
        """One folder takes the place of neighbours."""
        at = self.parts.index(old[0])
        self.parts = [*self.parts[:at], [old[0][0], old[-1][1]], *self.parts[at + len(old):]]
        self._commit(old, retained)

    def read(self, parts: list[list[int]] | None = None) -> DataFrame:
        """The rows of the folders, without opening a file to learn its columns."""
        if self.schema is None:
            raise ValueError(f"no stream has written to {self.path}")
        paths = [f"{self.path}/{self.name(p)}" for p in (self.parts if parts is None else parts)]
        return self._spark.read.schema(self.schema).parquet(*paths) if paths else self._spark.createDataFrame([], self.schema)

    def merge(self, old: list[list[int]], step: Step, retained: float = RETAINED) -> None:
        step(self.read(old)).write.mode("overwrite").parquet(f"{self.path}/{self.name([old[0][0], old[-1][1]])}")
        self.replace(old, retained)


def _start(
    stream: DataFrame, schema: T.StructType, write: Step, merge: Step, path: str, checkpoint: str, trigger: dict
) -> StreamingQuery:
    Parts(stream.sparkSession, path).begin(schema)

    def each(batch: DataFrame, batch_id: int) -> None:
        parts = Parts(batch.sparkSession, path)
        # what is committed holds the same rows: a batch's input is fixed before it first runs
        if batch_id > parts.latest:
            write(batch).write.mode("overwrite").parquet(f"{path}/{parts.name([batch_id, batch_id])}")
            parts.add(batch_id)
        due = parts.due()
        if due:
            parts.merge(due, merge)

    return (
        stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .foreachBatch(each).trigger(**(trigger or {"availableNow": True})).start()
    )


def _first_copies(df: DataFrame) -> DataFrame:
    """One row per id; rows without an id stay."""
    return df.where("id is not null").dropDuplicates(["id"]).unionByName(df.where("id is null"))


def _in_order(df: DataFrame) -> DataFrame:
    ranges = ranges_for(df.count())
    return df.repartitionByRange(ranges, "session_id", "seq").sortWithinPartitions("session_id", "seq")


def _merged_sums(df: DataFrame) -> DataFrame:
    """The sums of several batches, in the columns of one: per day and, where they are there,
    session and id. Rows without an id cannot be copies of each other and are added up."""
    keys = [c for c in ("day", "session_id") if c in df.columns]
    if SKETCH in df.columns:
        out = df.groupBy(*keys).agg(F.hll_union_agg(SKETCH).alias(SKETCH), *summed())
    elif "id" in df.columns:
        without = df.where("id is null").groupBy(*keys).agg(F.lit(None).cast("string").alias("id"), *summed())
        out = df.where("id is not null").dropDuplicates(["id"]).unionByName(without, allowMissingColumns=True)
    else:
        out = df.groupBy(*keys).agg(*summed())
    kinds = {f.name: f.dataType for f in df.schema}
    out = out.select(*[F.col(c).cast(kinds[c]).alias(c) for c in df.columns])
    return out.sortWithinPartitions("id") if "id" in df.columns else out


def _merge_of(columns: list[str]) -> Step:
    return _in_order if "event_type" in columns else _merged_sums


def start_tail(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append new events, each batch in session and sequence order. The
    checkpoint is the read position: what was seen is not read again."""
    return _start(stream, stream.schema, _in_order, _in_order, path, checkpoint, trigger)


def read_tail(spark: SparkSession, path: str, repeats: bool = False) -> DataFrame:
    """All events so far; with `repeats`, one of each that was delivered twice."""
    found = Parts(spark, path).read()
    return _first_copies(found) if repeats else found


def start_activity(
    stream: DataFrame, path: str, checkpoint: str, repeats: bool = False, **trigger
) -> StreamingQuery:
    """Append each batch's sums per day and session. They serve the statistics
    of sessions and, since every bucket is made of days, all granularities.
    With `repeats` the sums are per event id as well."""
    def sums(batch):
        day = F.date_trunc("day", F.col("ts")).alias("day")
        one = [F.col("id")] if repeats else []
        return with_payload(_first_copies(batch) if repeats else batch).groupBy(day, "session_id", *one).agg(*measures())

    return _start(stream, sums(_at_rest(stream)).schema, sums, _merged_sums, path, checkpoint, trigger)


def _at_rest(stream: DataFrame) -> DataFrame:
    """No rows of the stream's columns, to learn what a step makes of them."""
    return stream.sparkSession.createDataFrame([], stream.schema)


def start_sketches(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append each batch's sums per day, with a HyperLogLog sketch of its sessions in place
    of a row for each. The table holds days, not sessions, however many sessions there are;
    `read_sketched_buckets` estimates their number. For deliveries without repeats."""
    def sums(batch):
        day = F.date_trunc("day", F.col("ts")).alias("day")
        return with_payload(batch).groupBy(day).agg(
            F.hll_sketch_agg("session_id", F.lit(SKETCH_BITS)).alias(SKETCH), *measures())

    return _start(stream, sums(_at_rest(stream)).schema, sums, _merged_sums, path, checkpoint, trigger)


def _sums(spark: SparkSession, path: str) -> DataFrame:
    found = Parts(spark, path).read()
    return _first_copies(found) if "id" in found.columns else found


def compact(spark: SparkSession, path: str, retained: float = RETAINED) -> int | None:
    """Merge all batches but the latest into one folder, for a stream that stands still.
    Returns the number up to which they are merged, None when there is nothing to do.

    Readers go on with the folders they have listed: a later commit removes them, when
    `retained` seconds have passed.
    """
    parts = Parts(spark, path)
    old = [p for p in parts.parts if p[1] < parts.latest]
    if len(old) < 2:
        return None
    parts.merge(old, _merge_of(parts.schema.fieldNames()), retained)
    return old[-1][1]


def read_session_stats(spark: SparkSession, path: str) -> DataFrame:
    """Current statistics per session."""
    return _sums(spark, path).groupBy("session_id").agg(*summed())


def read_buckets(spark: SparkSession, path: str, granularity: str, sessions: DataFrame | None = None) -> DataFrame:
    """Current buckets, of all sessions or of the given ones. Their rows are per
    session first, so a count of them is the exact number of sessions, which a
    stream could not count by itself. Events without a time are in the bucket NULL."""
    per_session = _sums(spark, path).groupBy(
        bucket_key(F.col("day"), granularity).alias("bucket"), "session_id"
    ).agg(*summed())
    if sessions is not None:
        per_session = of_sessions(per_session, sessions)
    return per_session.groupBy("bucket").agg(F.count(F.lit(1)).alias("session_count"), *summed())


def read_sketched_buckets(spark: SparkSession, path: str, granularity: str) -> DataFrame:
    """Current buckets of `start_sketches`, with all sums exact and `session_estimate`, the
    number of different sessions within about 1%. Events without a session count in the
    sums only. `read_buckets` is the exact way."""
    return (
        Parts(spark, path).read().groupBy(bucket_key(F.col("day"), granularity).alias("bucket"))
        .agg(F.hll_sketch_estimate(F.hll_union_agg(SKETCH)).alias("session_estimate"), *summed())
    )
