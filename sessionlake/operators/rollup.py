"""Measures per day, session and currency, kept beside the event log.

The log is partitioned by day (`write_events`). A refresh compares the files of every day with
those it has summed and sums the changed days again, so late, replaced and removed events cost
their own days only. Statistics and time buckets of any granularity are sums of the rollup.

Each refresh writes one folder; the manifest says which days of a folder count. Ten folders of
like size are merged, so a reader takes a few folders whatever the number of refreshes.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake import vocabulary as V
from sessionlake.functions.payload import with_payload
from sessionlake.functions.times import bucket_key
from sessionlake.manifest import RETAINED, Manifest, full_level
from sessionlake.operators.scope import of_sessions
from sessionlake.operators.stats import measures, summed

DAY = "event_date"
NO_DAY = ""  # stands for NULL, the events without a time, in the manifest


def _of_days(days: list[str]) -> Column:
    known = F.col(DAY).isin([F.to_date(F.lit(d)) for d in days if d != NO_DAY]) if set(days) - {NO_DAY} else F.lit(False)
    return known | F.col(DAY).isNull() if NO_DAY in days else known


def day_files(events: DataFrame) -> DataFrame:
    """A fingerprint of the files of each day. It reads what files are there, no column of theirs."""
    files = events.select(
        F.coalesce(F.col(DAY).cast("string"), F.lit(NO_DAY)).alias("day"), "_metadata.file_path",
        "_metadata.file_size", "_metadata.file_modification_time").distinct()
    each = F.xxhash64("file_path", "file_size", "file_modification_time")
    return files.groupBy("day").agg(F.concat_ws("-", F.count(F.lit(1)), F.bit_xor(each)).alias("files"))


def day_sums(events: DataFrame, days: list[str]) -> DataFrame:
    """The measures of the days, from the partitions of these days only."""
    return (
        with_payload(events.where(_of_days(days)))
        .groupBy(DAY, "session_id", F.col(V.COST_CURRENCY).alias("currency")).agg(*measures())
        .sortWithinPartitions(DAY)
    )


def _live(folders: dict[str, dict[str, str]]) -> dict[str, list[str]]:
    """Days per folder, from folder and files per day."""
    found: dict[str, list[str]] = {}
    for day, of in folders.items():
        found.setdefault(of["folder"], []).append(day)
    return found


def _read(spark: SparkSession, path: str, live: dict[str, list[str]]) -> DataFrame:
    parts = [spark.read.parquet(f"{path}/{folder}").where(_of_days(days)) for folder, days in live.items()]
    return reduce(DataFrame.unionByName, parts)


def refresh(spark: SparkSession, events_path: str, path: str, retained: float = RETAINED) -> list[str]:
    """Bring the rollup in `path` up to date with the log in `events_path`. Returns the days
    that were summed ("" for events without a time), none when nothing changed. A refresh that
    fails leaves the rollup as it was. The driver holds one short row per day of the log."""
    events = spark.read.parquet(events_path)  # one list of files for all that follows
    manifest = Manifest(spark, path)
    known: dict[str, dict[str, str]] = (manifest.content or {}).get("days", {})
    there = {r["day"]: r["files"] for r in day_files(events).collect()}
    changed = sorted(d for d, files in there.items() if known.get(d, {}).get("files") != files)
    if not changed and set(there) == set(known) and manifest.content is not None:
        return []
    days = {d: of for d, of in known.items() if d in there}
    if changed or not days:
        folder = f"days-{uuid.uuid4().hex}"
        day_sums(events, changed).write.parquet(f"{path}/{folder}")
        days |= {d: {"folder": folder, "files": there[d]} for d in changed}
        empty = folder if not days else None
    else:
        empty = None
    before = {*_live(known), *[f for f in [(manifest.content or {}).get("empty")] if f]}
    manifest.commit({"days": days, "empty": empty}, before - {*_live(days), empty}, retained)
    _merge(spark, path, manifest, retained)
    return changed


def _merge(spark: SparkSession, path: str, manifest: Manifest, retained: float) -> None:
    """Merge folders that hold about as many days as each other, when there are ten."""
    days = manifest.content["days"]
    live = _live(days)
    old = full_level({folder: len(held) for folder, held in live.items()})
    if not old:
        return
    folder = f"days-{uuid.uuid4().hex}"
    rows = _read(spark, path, {f: live[f] for f in old})
    rows.repartitionByRange(DAY, "session_id").sortWithinPartitions(DAY).write.parquet(f"{path}/{folder}")
    moved = {d: {**of, "folder": folder} if of["folder"] in old else of for d, of in days.items()}
    manifest.commit({"days": moved, "empty": None}, old, retained)


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """Measures per day, session and currency (NULL where there was no response)."""
    content = Manifest(spark, path).content
    if content is None:
        raise ValueError(f"no rollup in {path}: refresh it first")
    return _read(spark, path, _live(content["days"]) or {content["empty"]: []})


def _per_session(rollup: DataFrame, granularity: str, sessions: DataFrame) -> DataFrame:
    per_session = rollup.groupBy(bucket_key(F.col(DAY), granularity).alias("bucket"), "session_id").agg(*summed())
    return of_sessions(per_session, sessions)


def rollup_buckets(rollup: DataFrame, sessions: DataFrame, granularity: str) -> DataFrame:
    """What `buckets.time_buckets` gives of the log, for sessions in scope and whole days."""
    return (
        _per_session(rollup, granularity, sessions)
        .groupBy("bucket").agg(F.count(F.lit(1)).alias("session_count"), *summed())
    )


def rollup_totals(rollup: DataFrame, sessions: DataFrame, granularity: str) -> DataFrame:
    """What `buckets.rolled_up` gives of the log: the buckets and their total."""
    return (
        _per_session(rollup, granularity, sessions).rollup("bucket")
        .agg(F.grouping("bucket").cast("int").alias("is_total"),
             F.count_distinct("session_id").alias("session_count"), *summed())
    )
