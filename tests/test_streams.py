"""Streams end where the batch results are: over many batches, with copies, out
of order, and when a stream stops and goes on."""

import pytest
from pyspark.sql import functions as F

from sessionlake.operators import buckets, stats
from sessionlake.streaming import jobs
from tests.tables import column, events, response, sessions


@pytest.fixture(scope="module")
def log(spark):
    s = sessions(spark, *[dict(id=f"s{i}") for i in range(6)])
    e = events(spark, *[
        dict(id=f"e{i:03d}", session_id=f"s{i % 5}", seq=i, ts=f"2025-03-{1 + i // 12:02d}T{i % 24:02d}:00:00Z",
             event_type=("llm_response", "tool_call_result", "retry")[i % 3],
             payload=response(tokens_in=i, cost_input=i / 8, cost_currency="USD", **({"price": i / 4} if i % 2 else {})))
        for i in range(120)]).drop("ts_text", "created_at_text")
    return s, e


def parts(e):
    """The log in three deliveries; each brings some rows of the last again."""
    n = F.substring("id", 2, 3).cast("int")
    return [e.where(n < 50), e.where((n >= 44) & (n < 90)), e.where(n >= 83)]


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def deliver(e, path):
    e.coalesce(1).write.mode("append").parquet(path)


def run(spark, log, start, tmp_path, deliveries=None, **options):
    """Run the stream after each delivery, as a job that stops in between."""
    path, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for part in deliveries or parts(log[1]):
        deliver(part, path)
        start(source(spark, path, log[1].schema), out, checkpoint, **options).awaitTermination()
    return out


def test_the_tail_brings_each_event_once(spark, log, tmp_path):
    out = run(spark, log, jobs.start_tail, tmp_path)
    got = jobs.read_tail(spark, out, repeats=True)
    assert sorted(column(got, "id")) == sorted(column(log[1], "id"))
    before = got.count()
    again = source(spark, str(tmp_path / "in"), log[1].schema)
    jobs.start_tail(again, out, str(tmp_path / "checkpoint")).awaitTermination()
    assert jobs.read_tail(spark, out, repeats=True).count() == before


def rows(df, key):
    return {r[key]: [r[c] for c in (*stats.MEASURES, "event_count")] for r in stats.published(df).collect()}


def test_session_statistics(spark, log, tmp_path):
    out = run(spark, log, jobs.start_activity, tmp_path, repeats=True)
    assert rows(jobs.read_session_stats(spark, out), "session_id") == rows(stats.activity(log[1]), "session_id")


@pytest.mark.parametrize("start", [jobs.start_tail, jobs.start_activity])
def test_late_events_are_kept(spark, log, tmp_path, start):
    """Deliveries from the latest to the earliest, weeks apart."""
    e = log[1].withColumn("ts", F.expr("ts + make_interval(0, 0, 0, 20 * cast(substring(id, 2, 1) as int))"))
    n = F.substring("id", 2, 3).cast("int")
    out = run(spark, log, start, tmp_path, [e.where(n >= 100), e.where((n >= 40) & (n < 100)), e.where(n < 40)])
    if start is jobs.start_tail:
        assert sorted(column(jobs.read_tail(spark, out), "id")) == sorted(column(e, "id"))
    else:
        assert rows(jobs.read_session_stats(spark, out), "session_id") == rows(stats.activity(e), "session_id")


@pytest.mark.parametrize("granularity", ["day", "week", "month"])
def test_time_buckets(spark, log, tmp_path, granularity):
    s, e = log
    out = run(spark, log, jobs.start_activity, tmp_path, repeats=True)
    known = s.where("id <> 's3'")
    got = jobs.read_buckets(spark, out, granularity, known)
    want = buckets.time_buckets(known, e, granularity)
    assert rows(got, "bucket") == rows(want, "bucket")
    count = lambda df: {r["bucket"]: r["session_count"] for r in df.collect()}
    assert count(got) == count(want)


def test_a_batch_that_runs_again_replaces_its_rows(spark, log, tmp_path):
    out = run(spark, log, jobs.start_activity, tmp_path, repeats=True)
    want = rows(jobs.read_session_stats(spark, out), "session_id")
    # as if the last batch had been written but not committed
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    jobs.start_activity(
        source(spark, str(tmp_path / "in"), log[1].schema), out, str(tmp_path / "checkpoint"), repeats=True).awaitTermination()
    assert rows(jobs.read_session_stats(spark, out), "session_id") == want


def test_events_without_a_time_or_an_id_count(spark, log, tmp_path):
    s, e = log
    n = F.substring("id", 2, 3).cast("int")
    odd = e.withColumn("ts", F.when(n % 7 != 0, F.col("ts")))
    again = odd.where(n % 20 == 0)  # copies, long after
    late = odd.withColumn("ts", F.when(n % 2 == 0, F.col("ts") - F.expr("INTERVAL 400 DAYS")).otherwise(F.col("ts")))
    out = run(spark, (s, late), jobs.start_activity, tmp_path, [late.where(n < 60), late.where(n >= 60), late.where(n % 20 == 0)],
              repeats=True)
    assert again.count() > 0
    assert rows(jobs.read_session_stats(spark, out), "session_id") == rows(stats.activity(late), "session_id")
    got = rows(jobs.read_buckets(spark, out, "month", s), "bucket")
    assert None in got and got == rows(buckets.time_buckets(s, late, "month"), "bucket")


@pytest.mark.parametrize("repeats", [False, True])
def test_compaction_changes_nothing(spark, log, tmp_path, repeats):
    n = F.substring("id", 2, 3).cast("int")
    e = log[1]
    want = rows(stats.activity(e), "session_id")
    first = [e.where(n % 4 == i) for i in range(3)]
    out = run(spark, log, jobs.start_activity, tmp_path, first, repeats=repeats)
    before = rows(jobs.read_session_stats(spark, out), "session_id")
    earlier = jobs.read_session_stats(spark, out)
    assert jobs.compact(spark, out) == 1 and jobs.compact(spark, out) is None
    assert rows(jobs.read_session_stats(spark, out), "session_id") == before == rows(earlier, "session_id")
    # the latest batch runs again, then a new one comes
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    run(spark, log, jobs.start_activity, tmp_path, [e.where(n % 4 == 3)], repeats=repeats)
    assert rows(jobs.read_session_stats(spark, out), "session_id") == want
    jobs.compact(spark, out)
    assert rows(jobs.read_session_stats(spark, out), "session_id") == want
