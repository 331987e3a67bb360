"""Stores in several formats, the column check, and what reaches the scan."""

import pytest
from pyspark.sql import functions as F

from sessionlake.operators import paging, stats
from sessionlake.operators.scope import Scope, events_in, sessions_in
from sessionlake.plans import reports
from sessionlake.sources.reader import FileStore, JdbcStore, read_model, table_counts
from sessionlake.sources.schema import TABLES, MissingColumns, text_schema
from sessionlake.sources.writer import write_events, write_messages
from tests.tables import DEFAULTS, by, events, messages, sessions, table

ROWS = {
    "sessions": [dict(id="s1", entity_id="e", group_id="g", title="T"), dict(id="s2", active_model="m")],
    "messages": [dict(session_id="s1", seq=1, role="user", content='say "hi", please', created_at="2025-03-01T08:00:01Z")],
    "session_events": [dict(id="e1", session_id="s1", seq=1, ts="2025-03-01T08:00:01.000250+01:00", event_type="llm_response",
                            payload='{"tokens_in":5}'),
                       dict(id="e2", session_id="s1", seq=2, ts="broken", event_type="llm_error")],
    "prompt_snapshots": [dict(sha256="aa", kind="system_prompt", content="x")],
    "ai_debug_events": [dict(id="d1", session_id="s1", direction="request", body="{}")],
    "profile_usage": [dict(id="u1", entity_id="e", group_id="g", price=1.5)],
}


def raw(spark, name):
    schema = text_schema(name)
    return spark.createDataFrame([tuple({**DEFAULTS[name], **r}.get(f.name) for f in schema) for r in ROWS[name]], schema)


@pytest.mark.parametrize("fmt,as_text", [("parquet", False), ("parquet", True), ("orc", True), ("json", True), ("csv", True)])
def test_stores_read_alike(spark, tmp_path, fmt, as_text):
    options = {"header": "true", "escape": '"'} if fmt == "csv" else {}
    for name in TABLES:
        df = raw(spark, name) if as_text else table(spark, name, ROWS[name]).select(TABLES[name].fieldNames())
        df.write.format(fmt).options(**options).save(f"{tmp_path}/{name}")
    model = read_model(spark, FileStore(str(tmp_path), fmt, text_times=True, options=options))
    assert {r["table_name"]: r["n_rows"] for r in table_counts(model).collect()} == {n: len(r) for n, r in ROWS.items()}
    for name, schema in TABLES.items():
        found = dict(getattr(model, name).dtypes)
        assert {f.name: f.dataType.simpleString() for f in schema}.items() <= found.items()
    e = by(model.session_events.withColumn("at", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")), "id")
    assert e["e1"]["at"] == "2025-03-01 07:00:01.000250" and e["e2"]["at"] is None
    if as_text:
        assert e["e2"]["ts_text"] == "broken"
    assert model.messages.first()["content"] == 'say "hi", please'
    got = by(stats.session_stats(model.sessions, model.session_events), "id")
    assert got["s1"]["tokens_in_total"] == 5 and got["s2"]["llm_call_count"] == 0


def test_an_old_store_is_named(spark, tmp_path):
    for name in TABLES:
        df = raw(spark, name)
        df = df.drop("opened_by", "system_source") if name == "sessions" else df.drop("price") if name == "profile_usage" else df
        df.write.parquet(f"{tmp_path}/{name}")
    with pytest.raises(MissingColumns, match="sessions lacks system_source, opened_by"):
        read_model(spark, FileStore(str(tmp_path)))
    raw(spark, "sessions").write.mode("overwrite").parquet(f"{tmp_path}/sessions")
    model = read_model(spark, FileStore(str(tmp_path)))  # an unpriced usage table blocks only the budget
    assert reports.session_list(model.sessions, model.session_events, keep=False).rows.count() == 2
    with pytest.raises(MissingColumns, match="profile_usage lacks price"):
        reports.budget_report(model.profile_usage, "2025-01-01T00:00:00Z")


def test_files_of_several_ages_make_one_table(spark, tmp_path):
    for name in TABLES:
        raw(spark, name).write.parquet(f"{tmp_path}/{name}")
    old = raw(spark, "profile_usage").withColumn("id", F.lit("u0")).drop("price")
    for last in ("a", "z"):  # whichever file name sorts first
        old.coalesce(1).write.parquet(f"{tmp_path}/old{last}")
        part = next((tmp_path / f"old{last}").glob("part-*.parquet"))
        (tmp_path / "profile_usage" / f"{'0' if last == 'a' else 'zz'}-{part.name}").write_bytes(part.read_bytes())
    u = read_model(spark, FileStore(str(tmp_path), text_times=True)).profile_usage
    assert sorted((r["id"], r["price"]) for r in u.collect()) == sorted([("u0", None), ("u0", None), ("u1", 1.5)], key=str)


def test_a_database_table_is_read_in_slices():
    store = JdbcStore("jdbc:none", seq_bounds=(0, 9))
    with pytest.raises(ValueError, match="sessions: name slices"):
        store.read(None, "sessions")


def scans(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    e = events(spark, *[dict(id=f"e{i}", session_id=f"s{i % 3}", seq=i, ts=f"2025-03-{1 + i:02d}T08:00:00Z",
                             event_type="llm_response") for i in range(20)])
    write_events(e.select(TABLES["session_events"].fieldNames()), f"{tmp_path}/session_events")
    sessions(spark, *[dict(id=f"s{i}", group_id="g") for i in range(3)]).write.parquet(f"{tmp_path}/sessions")
    stored = spark.read.parquet(f"{tmp_path}/session_events")
    s = spark.read.parquet(f"{tmp_path}/sessions")
    window = Scope(since="2025-03-04T00:00:00Z", until="2025-03-06T00:00:00Z", event_type="llm_response")
    scan, = scans(events_in(stored, window).select("id"))
    assert "PartitionFilters: [isnotnull(event_date" in scan
    assert "GreaterThanOrEqual(ts," in scan and "LessThan(ts," in scan and "EqualTo(event_type,llm_response)" in scan
    assert "payload" not in scan
    assert sorted(r["id"] for r in events_in(stored, window).collect()) == ["e3", "e4"]
    assert len(events_in(stored, window).inputFiles()) <= len(stored.inputFiles())
    scan, = scans(sessions_in(s, Scope(group_id="g", kind="chat")).select("id"))
    assert "EqualTo(group_id,g)" in scan and "EqualTo(interaction_kind,chat)" in scan
    behind = paging.after(stats.session_stats(s, stored), "created_at", "desc", "2025-01-01T00:00:00Z", "x").select("id")
    session_scan = next(x for x in scans(behind) if "created_at" in x)
    assert "Or(LessThan(created_at," in session_scan  # a page's boundary is applied before the join
    full = stats.session_stats(s, stored, window).select("id", "tokens_in_total")
    event_scan = next(x for x in scans(full) if "event_type" in x)
    assert "content" not in event_scan and "duration_ms" not in event_scan and "parent_id" not in event_scan


def test_the_written_log_is_clustered(spark, tmp_path):
    e = events(spark, *[dict(id=f"e{i}", session_id=f"s{i % 7}", seq=i, event_type="retry") for i in range(50)])
    write_events(e, f"{tmp_path}/e")
    assert spark.read.parquet(f"{tmp_path}/e").count() == 50
    m = messages(spark, *[dict(session_id=f"s{i % 7}", seq=i, role="user") for i in range(50)])
    write_messages(m, f"{tmp_path}/m")
    assert spark.read.parquet(f"{tmp_path}/m").count() == 50
