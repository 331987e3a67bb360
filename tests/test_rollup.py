"""The maintained rollup equals a full run after late, replaced and removed events, and reads changed days only."""

import re

import pytest
from pyspark.sql import functions as F

from sessionlake.manifest import FAN, Manifest
from sessionlake.operators import buckets, rollup, stats
from sessionlake.sources.writer import write_events
from tests.tables import events, response, sessions


@pytest.fixture(scope="module")
def log(spark):
    s = sessions(spark, *[dict(id=f"s{i}") for i in range(6)])
    e = events(spark, *[
        dict(id=f"e{i:03d}", session_id=f"s{i % 7}", seq=i, ts=None if i % 11 == 0 else f"2025-03-{1 + i // 6:02d}T{i % 24:02d}:00:00Z",
             event_type=("llm_response", "tool_call_result", "retry")[i % 3],
             payload=response(tokens_in=i, cost_input=i / 8, cost_currency=("USD", "EUR")[i % 2], price=i / 4))
        for i in range(100)]).drop("ts_text", "created_at_text")
    return s, e.cache()


def rows(df):
    return sorted([[str(r[c]) for c in sorted(df.columns)] for r in stats.published(df).collect()])


def same_as_a_full_run(spark, path, s, e):
    kept = rollup.read_rollup(spark, path)
    assert rows(rollup.rollup_buckets(kept, s, "week")) == rows(buckets.time_buckets(s, e, "week"))
    assert rows(rollup.rollup_totals(kept, s, "day")) == rows(buckets.rolled_up(s, e, "day"))


def test_late_replaced_and_removed_events(spark, log, tmp_path):
    s, e = log
    at, path = str(tmp_path / "log"), str(tmp_path / "rollup")
    early = e.where("seq < 60 and seq % 5 <> 0")
    write_events(early, at)
    assert rollup.refresh(spark, at, path) == sorted({str(r[0]) if r[0] else "" for r in early.select(F.to_date("ts")).collect()})
    assert rollup.refresh(spark, at, path) == []
    same_as_a_full_run(spark, path, s, early)

    late = e.where("seq in (5, 40, 99)")  # none of these days is new but the last; 55 has no time
    write_events(late, at, mode="append")
    assert rollup.refresh(spark, at, path) == ["", "2025-03-01", "2025-03-07"]
    same_as_a_full_run(spark, path, s, early.unionByName(late))

    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        write_events(e.where("seq = 40"), at, mode="overwrite")
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert rollup.refresh(spark, at, path) == ["2025-03-07"]
    left = early.unionByName(late).where("ts is null or to_date(ts) <> '2025-03-07' or seq = 40")
    same_as_a_full_run(spark, path, s, left)

    for file in (tmp_path / "log" / "event_date=2025-03-01").iterdir():
        file.unlink()
    (tmp_path / "log" / "event_date=2025-03-01").rmdir()
    assert rollup.refresh(spark, at, path) == []
    same_as_a_full_run(spark, path, s, left.where("ts is null or to_date(ts) <> '2025-03-01'"))


def test_a_refresh_reads_the_changed_days(spark, log, tmp_path):
    at = str(tmp_path / "log")
    write_events(log[1], at)
    there = spark.read.parquet(at)
    day, none = tmp_path / "log" / "event_date=2025-03-02", tmp_path / "log" / "event_date=__HIVE_DEFAULT_PARTITION__"
    want = rows(rollup.day_sums(there, ["2025-03-02", ""]))
    assert len(want) > 1 and len(want) == rollup.day_sums(there, ["2025-03-02"]).count() + rollup.day_sums(there, [""]).count()
    for file in (tmp_path / "log").glob("event_date=*/part-*"):
        if file.parent not in (day, none):
            file.unlink()
    assert rows(rollup.day_sums(there, ["2025-03-02", ""])) == want  # fails if it opens another day's files


def test_a_fingerprint_reads_no_column(spark, log, tmp_path):
    write_events(log[1], str(tmp_path / "log"))
    plan = rollup.day_files(spark.read.parquet(str(tmp_path / "log")))._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"ReadSchema: (\S+)", plan) == ["struct<>"]


def test_refreshes_are_merged_and_failed_ones_leave_nothing(spark, log, tmp_path):
    s, e = log
    at, path = str(tmp_path / "log"), str(tmp_path / "rollup")
    for d in range(FAN):
        day = e.where(f"ts is not null and seq >= {d * 6} and seq < {d * 6 + 6}")
        write_events(day, at, mode="append")
        rollup.refresh(spark, at, path)
    known = Manifest(spark, path).content["days"]
    assert len(known) == FAN and len({d["folder"] for d in known.values()}) == 1
    same_as_a_full_run(spark, path, s, e.where(f"ts is not null and seq < {FAN * 6}"))
    rollup.day_sums(spark.read.parquet(at), list(known)).write.parquet(f"{path}/days-failed")
    same_as_a_full_run(spark, path, s, e.where(f"ts is not null and seq < {FAN * 6}"))


def test_an_empty_log_has_no_buckets(spark, log, tmp_path):
    s, e = log
    at, path = str(tmp_path / "log"), str(tmp_path / "rollup")
    e.withColumn("event_date", F.to_date("ts")).where("false").write.parquet(at)
    with pytest.raises(ValueError, match="refresh it first"):
        rollup.read_rollup(spark, path)
    assert rollup.refresh(spark, at, path) == []
    assert rollup.rollup_buckets(rollup.read_rollup(spark, path), s, "day").count() == 0
    assert rollup.refresh(spark, at, path) == []
