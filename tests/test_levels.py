"""The list of a stream's folders: its file calls, its levels, merges that fail in between, sketches."""

import collections

import pytest
from pyspark.sql import functions as F

from sessionlake.manifest import FAN, KEPT, Files, Manifest, full_level
from sessionlake.operators import stats
from sessionlake.streaming import jobs
from tests.tables import column, events, response
from tests.test_streams import deliver, rows, source


class Counted(Files):
    """Files in memory that count their calls and what they list."""

    def __init__(self):
        self.kept, self.calls, self.listed = {}, 0, 0

    def names(self, folder):
        found = [n.removeprefix(f"{folder}/") for n in self.kept if n.startswith(f"{folder}/")]
        self.calls, self.listed = self.calls + 1, max(self.listed, len(found))
        return found

    def read(self, name):
        self.calls += 1
        return self.kept[name]

    def write(self, name, text):
        self.calls += 1
        assert name not in self.kept
        self.kept[name] = text

    def delete(self, name):
        self.calls += 1
        self.kept.pop(name, None)


def test_a_batch_makes_a_fixed_number_of_file_calls(spark, tmp_path):
    files, path = Counted(), str(tmp_path)
    jobs.Parts(spark, path, Manifest(spark, path, files)).begin(spark.range(0).schema)
    seen = []
    for n in range(2000):
        files.calls = files.listed = 0
        parts = jobs.Parts(spark, path, Manifest(spark, path, files))
        assert parts.latest == n - 1
        parts.add(n)
        due = parts.due()
        if due:
            parts.replace(due, retained=0)
        seen.append((files.calls, files.listed, len(parts.parts)))
    # a commit: one write, one old version; a merge commits again and removes the folders of the last one
    assert max(c for c, _, _ in seen) <= 6 + 2 * FAN
    late, early = [c for c, _, _ in seen[1900:]], [c for c, _, _ in seen[100:200]]
    assert sum(late) <= 1.1 * sum(early)
    assert max(n for _, n, _ in seen) <= KEPT + 2
    # four levels of at most ten, and every batch once
    assert max(p for _, _, p in seen) <= 4 * FAN
    kept = jobs.Parts(spark, path, Manifest(spark, path, files)).parts
    assert [b for first, last in kept for b in range(first, last + 1)] == list(range(2000))
    assert len(files.kept) <= KEPT + 1


def test_levels_fill_from_below():
    assert full_level({}) == [] and full_level({f"p{i}": 1 for i in range(FAN - 1)}) == []
    sizes = {**{f"b{i}": 10 for i in range(FAN)}, **{f"a{i}": 1 for i in range(FAN + 2)}}
    assert full_level(sizes) == [f"a{i}" for i in range(FAN)]
    assert full_level({**{f"b{i}": 10 for i in range(FAN)}, "a": 1}) == [f"b{i}" for i in range(FAN)]


def test_what_no_version_names_is_not_there(spark, tmp_path):
    manifest = Manifest(spark, str(tmp_path))
    assert manifest.content is None
    manifest.commit({"n": 1})
    (tmp_path / "_manifest" / "2.part").write_text("{")  # a writer that failed
    assert Manifest(spark, str(tmp_path)).content == {"n": 1}
    Manifest(spark, str(tmp_path)).commit({"n": 2})
    assert Manifest(spark, str(tmp_path)).content == {"n": 2}


def test_replaced_folders_stay_for_their_readers(spark, tmp_path):
    (tmp_path / "old").mkdir()
    manifest = Manifest(spark, str(tmp_path))
    manifest.commit({}, replaced=["old"])
    manifest.commit({})
    assert (tmp_path / "old").exists()
    manifest.commit({}, retained=0)
    assert not (tmp_path / "old").exists()


@pytest.fixture(scope="module")
def log(spark):
    """23 deliveries, with events that come again, without an id, a time or a session."""
    made = events(spark, *[
        dict(id=None if i % 17 == 0 else f"e{i:03d}", session_id=None if i % 29 == 0 else f"s{i % 7}", seq=i,
             ts=None if i % 13 == 0 else f"2025-03-{1 + i // 12:02d}T{i % 24:02d}:00:00Z",
             event_type=("llm_response", "tool_call_result", "retry")[i % 3],
             payload=response(tokens_in=i, cost_input=i / 8, cost_currency="USD", **({"price": i / 4} if i % 2 else {})))
        for i in range(230)]).drop("ts_text", "created_at_text")
    return made.cache()


def streamed(spark, log, start, tmp_path, again=False, **options):
    """One delivery a batch; with `again`, each brings events of the one before."""
    path = str(tmp_path / "in")
    for d in range(23):
        part = log.where((F.col("seq") >= d * 10) & (F.col("seq") < d * 10 + 10))
        if again:
            part = part.unionByName(log.where((F.col("seq") >= d * 10 - 4) & (F.col("seq") < d * 10) & F.col("id").isNotNull()))
        deliver(part, path)
    out = str(tmp_path / "out")
    start(source(spark, path, log.schema), out, str(tmp_path / "checkpoint"), **options).awaitTermination()
    return out


def half_merged(spark, out):
    """A merge that wrote its folder and failed before the commit."""
    parts = jobs.Parts(spark, out)
    old = parts.parts[-2:]
    merged = jobs._merge_of(parts.schema.fieldNames())(parts.read(old))
    merged.write.parquet(f"{out}/{parts.name([old[0][0], old[-1][1]])}")
    return parts, old


@pytest.mark.parametrize("repeats", [False, True])
def test_statistics_before_during_and_after_merges(spark, log, tmp_path, repeats):
    out = streamed(spark, log, jobs.start_activity, tmp_path, again=repeats, repeats=repeats)
    parts = jobs.Parts(spark, out)
    assert [last - first + 1 for first, last in parts.parts] == [10, 10, 1, 1, 1]
    want = rows(stats.activity(log), "session_id")
    assert rows(jobs.read_session_stats(spark, out), "session_id") == want
    parts, old = half_merged(spark, out)
    assert rows(jobs.read_session_stats(spark, out), "session_id") == want
    parts.merge(old, jobs._merge_of(parts.schema.fieldNames()))
    assert rows(jobs.read_session_stats(spark, out), "session_id") == want
    assert jobs.compact(spark, out) is None or rows(jobs.read_session_stats(spark, out), "session_id") == want


def test_the_tail_is_merged_too(spark, log, tmp_path):
    out = streamed(spark, log, jobs.start_tail, tmp_path, again=True)
    assert len(jobs.Parts(spark, out).parts) == 5
    known = log.where("id is not null")
    assert sorted(column(jobs.read_tail(spark, out, repeats=True).where("id is not null"), "id")) == sorted(column(known, "id"))
    assert jobs.read_tail(spark, out).where("id is null").count() == log.where("id is null").count()
    assert jobs.compact(spark, out) == 21
    assert len(jobs.Parts(spark, out).parts) == 2
    merged = jobs.read_tail(spark, out, repeats=True)
    assert sorted(map(str, merged.select(log.columns).collect())) == sorted(map(str, log.collect()))


def test_a_stream_without_events_has_no_rows(spark, log, tmp_path):
    (tmp_path / "in").mkdir()
    out, empty = str(tmp_path / "out"), source(spark, str(tmp_path / "in"), log.schema)
    jobs.start_activity(empty, out, str(tmp_path / "checkpoint")).awaitTermination()
    assert jobs.read_session_stats(spark, out).count() == 0
    assert jobs.read_buckets(spark, out, "week").count() == 0
    with pytest.raises(ValueError, match="no stream has written"):
        jobs.read_tail(spark, str(tmp_path / "other"))


def test_sketched_sessions_are_near_and_sums_exact(spark, tmp_path):
    """20,000 sessions over ten days and twelve batches: below 3% (almost four standard errors)."""
    log = spark.range(60000).select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit("s"), F.col("id") % 20000).alias("session_id"),
        F.col("id").cast("int").alias("seq"),
        F.expr("timestamp'2025-03-03 00:00:00' + make_interval(0, 0, 0, cast(id % 10 as int))").alias("ts"),
        F.lit("tool_call_result").alias("event_type"), F.lit("{}").alias("payload"))
    for d in range(12):
        deliver(log.where(F.col("seq") % 12 == d), str(tmp_path / "in"))
    out = str(tmp_path / "out")
    start = lambda s: jobs.start_sketches(s, out, str(tmp_path / "checkpoint")).awaitTermination()
    start(source(spark, str(tmp_path / "in"), log.schema))
    assert jobs.Parts(spark, out).read().count() == 10 + 2 * 5  # days of the merged folder; a delivery has every other day
    got = {r["bucket"]: r for r in jobs.read_sketched_buckets(spark, out, "week").collect()}
    want = {r["bucket"]: r for r in log.groupBy(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("bucket"))
            .agg(F.count_distinct("session_id").alias("n"), F.count("id").alias("events")).collect()}
    assert set(got) == set(want)
    for bucket, r in want.items():
        assert abs(got[bucket]["session_estimate"] - r["n"]) <= 0.03 * r["n"]
        assert got[bucket]["event_count"] == got[bucket]["tool_call_count"] == r["events"]
