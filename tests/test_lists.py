"""Pages, event lists, tails, replay, prompts, budgets, renames, export."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sessionlake.functions.times import instant, instant_literal
from sessionlake.operators import budget, events as ev, export, paging, prompts, rename, replay, stats
from sessionlake.operators.scope import ALL, Scope, sessions_in
from sessionlake.plans import reports
from sessionlake.sources.schema import MissingColumns
from sessionlake.workspace import written
from tests.tables import by, column, events, response, sessions, table


@pytest.fixture(scope="module")
def listed(spark):
    """37 sessions with ties in every sort key."""
    rng = random.Random(11)
    s = sessions(spark, *[
        dict(id=f"s{i:02d}", active_model=rng.choice([None, "m1", "m2"]), entity_id=f"e{i % 3}",
             created_at=f"2025-03-{1 + i % 5:02d}T08:00:00Z", updated_at=f"2025-04-{1 + i % 4:02d}T08:00:00.25Z")
        for i in range(37)])
    e = events(spark, *[
        dict(id=f"e{i:03d}", session_id=f"s{i % 30:02d}", seq=i + 1, ts=f"2025-03-01T08:00:{i % 20:02d}Z",
             event_type=rng.choice(["llm_response", "tool_call_result"]),
             payload=response(tokens_in=rng.randrange(3), tokens_out=1, cost_input=rng.randrange(3) / 10, cost_output=0.1))
        for i in range(120)])
    return stats.session_stats(s, e), s, e


KEYS = ["created_at", "updated_at", "active_model", "cost_total", "llm_call_count", "tool_call_count",
        "tokens_in_total", "tokens_out_total"]


@pytest.mark.parametrize("key,direction", [(k, d) for k in KEYS for d in ("asc", "desc")])
def test_walking_pages_covers_the_list(listed, key, direction):
    if (key, direction) not in {("created_at", "desc"), ("updated_at", "asc"), ("active_model", "asc"),
                                ("active_model", "desc"), ("cost_total", "desc"), ("tool_call_count", "asc")}:
        rows = paging.top_sessions(listed[0], key, direction, 200).orderBy("pos").collect()
        assert len(rows) == 37
        return
    seen, token, pages = [], "", 0
    while True:
        page = paging.page(listed[0], key, direction, token, n=15)
        seen += [r["id"] for r in page.rows]
        token, pages = page.next_token, pages + 1
        if not token:
            break
    assert pages == 3 and seen == [r["id"] for r in paging.top_sessions(listed[0], key, direction, 200).orderBy("pos").collect()]
    assert len(set(seen)) == 37


def test_a_full_last_page_has_no_next(listed):
    assert paging.page(listed[0], n=37).next_token == ""
    assert paging.page(listed[0], n=36).next_token != ""


def test_an_old_token_means_newest_first(listed):
    import base64
    first = paging.page(listed[0], n=5)
    last = first.rows[-1]
    old = base64.urlsafe_b64encode(f"{last['created_at'].isoformat()}Z|{last['id']}".encode()).decode().rstrip("=")
    assert [r["id"] for r in paging.page(listed[0], token=old, n=5).rows] == \
        [r["id"] for r in paging.page(listed[0], token=first.next_token, n=5).rows]


def test_page_index_is_the_walk(listed):
    for direction in ("asc", "desc"):
        order = column(paging.top_sessions(listed[0], "tokens_in_total", direction, 200).orderBy("pos"), "id")
        index = by(paging.page_index(listed[0], "tokens_in_total", direction, 10, ranges=6), "page")
        assert {p: r["id"] for p, r in index.items()} == {1: order[9], 2: order[19], 3: order[29]}


def test_arguments_are_refused(listed):
    for bad in (dict(sort="price"), dict(direction="up"), dict(n=0), dict(n=201)):
        with pytest.raises(ValueError):
            paging.page_rows(listed[0], **bad)


def test_top_lists_are_taken_without_a_full_sort(listed):
    plan = paging.top_sessions(listed[0], "cost_total", "desc", 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_events_newest_first_page_by_page(listed):
    _, s, e = listed
    seen, token, pages = [], "", 0
    while True:
        page = ev.event_page(e, s, ALL, token, n=50, include_payload=False)
        seen += [(r["ts"], r["id"]) for r in page.rows]
        token, pages = page.next_token, pages + 1
        if not token:
            break
    assert pages == 3 and len(seen) == 120 and seen == sorted(seen, reverse=True)
    assert "payload" not in ev.newest_events(e, s, ALL, include_payload=False).columns
    for bad in ("%%%", "YQ"):
        with pytest.raises(ValueError):
            ev.event_page(e, s, ALL, bad)


def test_event_list_defaults(listed):
    _, s, e = listed
    rows = reports.event_list(e, s, Scope(entity_id="e1", event_type="llm_response"))
    assert all(r["parent_id"] == "" and r["duration_ms"] == 0 for r in rows.collect()) and rows.count() <= 25
    with pytest.raises(ValueError):
        reports.event_list(e, s, n=201)


def test_tails_and_presence(spark):
    rng = random.Random(2)
    e = events(spark, *rng.sample([dict(id=f"x{i}", session_id="s", seq=i, event_type="retry") for i in range(1, 31)], 30))
    s = sessions(spark, dict(id="s"), dict(id="quiet"))
    def positions(*rows):
        return spark.createDataFrame(rows, "session_id string, since_seq long")
    seqs = lambda p: column(ev.tail(e, p).orderBy("pos"), "seq")
    assert seqs(positions(("s", 0))) == list(range(1, 26))
    assert seqs(positions(("s", 25))) == list(range(26, 31))
    assert seqs(positions(("s", 99))) == [] == seqs(positions(("t", 0)))
    asked = positions(("s", 3), ("quiet", 0), ("ghost", 0))
    got = by(ev.presence(asked, s, e), "session_id")
    assert {k: (r["state"], r["n_new"]) for k, r in got.items()} == {
        "s": ("has_rows", 27), "quiet": ("caught_up", 0), "ghost": ("unknown", 0)}
    assert by(ev.presence(positions(("s", 30)), s, e), "session_id")["s"]["state"] == "caught_up"
    assert by(ev.presence(positions(("s", -1)), s, e), "session_id")["s"]["state"] == "invalid"
    assert seqs(positions(("s", -1))) == []


def test_a_limit_per_session_is_taken_before_the_shuffle(spark, listed):
    p = spark.range(3).select(F.concat(F.lit("s0"), "id").alias("session_id"), F.lit(0).alias("since_seq"))
    for df in (ev.tail(listed[2], p), replay.debug_replay(table(spark, "ai_debug_events", [dict(id="d", session_id="s")]))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("WindowGroupLimit") == 2


def test_a_heavy_session_is_split_in_the_join(spark):
    """With positions too many to broadcast, the events of one session that
    outweighs the others are joined by several tasks."""
    heavy = spark.range(60000).select(
        F.lit("heavy").alias("session_id"), F.col("id").alias("seq"), F.col("id").cast("string").alias("id"))
    rest = spark.range(60000).select(
        (F.col("id") % 997).cast("string").alias("session_id"), F.col("id").alias("seq"), F.lit("x").alias("id"))
    e = heavy.unionByName(rest).repartition(16).select("*", *[
        F.lit(None).cast(t).alias(c) for c, t in (("ts", "timestamp"), ("event_type", "string"), ("parent_id", "string"),
                                                   ("duration_ms", "long"))])
    p = spark.range(998).select(
        F.when(F.col("id") == 997, "heavy").otherwise(F.col("id").cast("string")).alias("session_id"), F.lit(10).alias("since_seq"))
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        df = ev.tail(e, p, 5, include_payload=False)
        rows = df.where("session_id = 'heavy'")
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan, plan
        assert plan.count("WindowGroupLimit") >= 2
        assert column(rows.orderBy("pos"), "seq") == [11, 12, 13, 14, 15]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_the_log_is_sorted(listed):
    got = [(r["session_id"], r["seq"]) for r in ev.event_log(listed[2]).collect()]
    assert got == sorted(got)


def test_replay_keeps_bodies_and_pairs(spark):
    body = 'data: {"a": 1.50}\n\ndata: [DONE]\n'
    rows = [
        dict(id="d2", session_id="s", ts="2025-01-01T00:00:00Z", direction="response", status=200, body=body),
        dict(id="d1", session_id="s", ts="2025-01-01T00:00:00Z", direction="request", trace_id="t", url="u", body="{}"),
        dict(id="d3", session_id="s", ts="2025-01-01T00:00:01Z", direction="error", body="Net: expired"),
        dict(id="d4", session_id="s", ts="2025-01-01T00:00:02Z", direction="response", body="{}"),
        dict(id="d0", session_id="r", ts="2025-01-01T00:00:03Z", direction="response", body="{}"),
    ]
    d = table(spark, "ai_debug_events", rows)
    got = replay.debug_replay(d).where("session_id = 's'").orderBy("pos").collect()
    assert [(r["id"], r["trace_id"], r["status"], r["url"]) for r in got] == [
        ("d1", "t", 0, "u"), ("d2", "", 200, ""), ("d3", "", 0, ""), ("d4", "", 0, "")]
    assert got[1]["body"] == body
    assert replay.debug_replay(d, 2).count() == 3
    for bad in (0, 501):
        with pytest.raises(ValueError):
            replay.debug_replay(d, bad)
    assert {r["session_id"]: r["has_more"] for r in replay.debug_replay(d, 2).collect()} == {"s": True, "r": False}
    for ranges in (1, 4):
        pairs = {r["response_id"]: r["request_id"] for r in replay.debug_pairs(d, ranges).collect()}
        assert pairs == {"d2": "d1", "d4": None, "d0": None}


def test_a_long_session_is_replayed_whole(spark):
    d = spark.range(1300).select(
        F.concat(F.lit("d"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("id"), F.lit("s").alias("session_id"),
        F.lit(None).cast("string").alias("trace_id"), F.when(F.col("id") % 3 != 0, F.timestamp_seconds(F.col("id") / 4)).alias("ts"),
        F.lit("request").alias("direction"), F.lit(None).cast("int").alias("status"), F.lit(None).cast("string").alias("url"),
        F.lit("{}").alias("body"))
    whole = [r["id"] for r in replay.debug_replay(d, None).orderBy("pos").collect()]
    assert len(whole) == 1300
    walked, where = [], spark.createDataFrame([("s", None, None)], "session_id string, after_ts timestamp, after_id string")
    for _ in range(3):
        rows = replay.debug_replay(d, 500, where).orderBy("pos").collect()
        walked += [r["id"] for r in rows]
        assert {r["has_more"] for r in rows} == {len(walked) < 1300}
        where = spark.createDataFrame([("s", rows[-1]["ts"], rows[-1]["id"])], where.schema)
    assert walked == whole
    e = spark.range(300).select(F.col("id").cast("string").alias("id"), F.lit("s").alias("session_id"), F.col("id").alias("seq"), *[
        F.lit(None).cast(t).alias(c) for c, t in (("ts", "timestamp"), ("event_type", "string"), ("parent_id", "string"),
                                                   ("duration_ms", "long"))])
    p = spark.createDataFrame([("s", 9)], "session_id string, since_seq long")
    assert ev.tail(e, p, None, include_payload=False).count() == 290
    assert {r["has_more"] for r in ev.tail(e, p, 200, include_payload=False).collect()} == {True}


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_a_walk_with_null_keys_is_complete(spark, direction):
    s = spark.range(17).select(
        F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("id"),
        F.when(F.col("id") % 3 != 0, F.timestamp_seconds(F.col("id") % 4)).alias("created_at"))
    listed = [r["id"] for r in paging.page_rows(s, "created_at", direction, 200).orderBy("pos").collect()]
    assert len(listed) == 17
    walked, token, ends = [], "", []
    while True:
        got = paging.page(s, "created_at", direction, token, 3)
        walked += [r["id"] for r in got.rows]
        if not got.next_token:
            break
        ends.append(got.rows[-1]["id"])
        token = got.next_token
    assert walked == listed
    index = paging.page_index(s, "created_at", direction, 3, ranges=4).orderBy("page").collect()
    assert [r["id"] for r in index][:len(ends)] == ends


def test_session_filters_come_before_the_parse(spark, listed):
    _, s, e = listed
    scope = Scope(group_id="g1")
    for df in (stats.session_stats(s, e, scope), stats.scoped_activity(s, e, scope), reports.session_list(s, e, scope, keep=False).rows):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        semi, parse = plan.rindex("Join LeftSemi"), plan.index("from_json")
        # plans print from the top: a semi join stands below the aggregate and the parse
        assert plan.index("Aggregate") < semi and parse < semi


def test_prompts(spark):
    content = "Be kind."
    import hashlib
    sha = hashlib.sha256(content.encode()).hexdigest()
    snaps = table(spark, "prompt_snapshots", [dict(sha256=sha, kind="system_prompt", content=content),
                                              dict(sha256="beef", kind="tool", content="x")])
    refs = spark.createDataFrame([(sha,), (sha,), ("f00d",), ("",), (None,)], "sha256 string")
    got = by(prompts.resolve_prompts(refs, snaps), "sha256")
    assert {k: (r["n_refs"], r["is_found"], r["content"]) for k, r in got.items()} == {
        sha: (2, True, content), "f00d": (1, False, None)}
    assert column(prompts.mismatched(snaps), "sha256") == ["beef"]


USAGE = [
    dict(id="u1", entity_id="a", group_id="g", price=3.0, created_at="2025-05-31T22:00:00Z"),  # at since
    dict(id="u2", entity_id="a", group_id="g", price=64.0, created_at="2025-05-31T21:59:59Z"),  # before it
    dict(id="u3", entity_id="b", group_id="g", price=None, created_at="2025-06-02T00:00:00Z"),
    dict(id="u4", entity_id="b", group_id="g", price=0.25, created_at="2025-06-03T00:00:00Z"),
    dict(id="u5", entity_id="c", group_id="g", price=None, created_at="2025-06-03T00:00:00Z"),
    dict(id="u6", entity_id="a", group_id="g", price=16.0, created_at="2025-06-04T00:00:00Z", interaction_kind="system"),
    dict(id="u7", entity_id="a", group_id="h", price=32.0, created_at="2025-06-04T00:00:00Z"),
]
SINCE = "2025-06-01T00:00:00+02:00"


@pytest.mark.parametrize("kinds,total,entities", [
    ("", 3.25, {"a": 3.0, "b": 0.25, "c": 0.0}), ("system", 16.0, {"a": 16.0}),
    (["chat", " system "], 19.25, {"a": 19.0, "b": 0.25, "c": 0.0}),
])
def test_budget_balance(spark, kinds, total, entities):
    usage = table(spark, "profile_usage", USAGE)
    rows = reports.budget_report(usage, SINCE, kinds, "g").collect()
    assert {r["entity_id"]: r["price_total"] for r in rows if r["level"] == "entity"} == entities
    assert [r["price_total"] for r in rows if r["level"] == "group"] == [total]
    assert float(budget.budget_of(usage, "g", SINCE, kinds).first()[0]) == total


def test_budget_arguments(spark):
    usage = table(spark, "profile_usage", USAGE)
    assert float(budget.budget_of(usage, "nobody", SINCE).first()[0]) == 0
    assert reports.budget_report(usage, SINCE, group_id="nobody").count() == 0
    for args in (("", SINCE), ("g", ""), ("g", "2025-06-01T00:00:00"), ("g", "june")):
        with pytest.raises(ValueError):
            budget.budget_of(usage, *args)
    with pytest.raises(MissingColumns, match="price"):
        budget.budget_of(usage.drop("price"), "g", SINCE)


@pytest.mark.parametrize("ranges", [1, 5])
def test_budget_rules_match_single_balances(spark, ranges):
    rng = random.Random(4)
    usage = table(spark, "profile_usage", [
        dict(id=f"u{i}", entity_id=rng.choice("abc"), group_id=rng.choice(["g", "g", "h"]),
             price=rng.choice([None, 0.5, 1.25]), interaction_kind=rng.choice(["chat", "system"]),
             created_at=f"2025-06-{rng.randrange(1, 28):02d}T00:00:00Z") for i in range(300)])
    rules = [(i, rng.choice(["g", "h", "x"]), rng.choice([None, "a", "b"]), rng.choice([[], ["chat", "system"]]),
              f"2025-06-{rng.randrange(1, 28):02d}T00:00:00Z", 3.0) for i in range(12)]
    df = spark.createDataFrame(rules, "rule_id long, group_id string, entity_id string, kinds array<string>, "
                               "since string, max_price double").withColumn("since", F.col("since").cast("timestamp"))
    got = by(budget.budget_usage(usage, df, ranges), "rule_id")
    for rule_id, group, entity, kinds, since, limit in rules:
        scoped = usage if entity is None else usage.where(F.col("entity_id") == entity)
        want = float(budget.budget_of(scoped, group, since, kinds).first()[0])
        assert float(got[rule_id]["price_total"]) == want and got[rule_id]["is_used_up"] == (want >= limit)


def test_usage_is_summed_by_day_but_where_a_rule_starts(spark):
    usage = spark.range(20_000).select(
        F.when(F.col("id") % 10 == 0, "other").otherwise("g").alias("group_id"), F.lit("e").alias("entity_id"),
        F.lit("chat").alias("kind"), F.timestamp_seconds(1735689600 + F.col("id") * 300).alias("at"), F.lit(1).alias("price"))
    starts = spark.createDataFrame([("g", "chat", "2025-01-20 12:07:00"), ("h", "chat", "2025-01-02 00:00:00")],
                                   "group_id string, kind string, at string").withColumn("at", F.col("at").cast("timestamp"))
    days = budget.usage_by_day(usage, starts).collect()
    assert sum(r["price"] for r in days) == 18_000 and {r["group_id"] for r in days} == {"g"}
    exact = [r for r in days if r["at"].date().isoformat() == "2025-01-20"]
    assert len(exact) == 288 - 28 or len(exact) == 288 - 29
    assert len(days) - len(exact) == 20_000 * 300 // 86400  # the other days, one row each


def test_tables_of_entity_ids(spark):
    s = sessions(spark, *[dict(id=f"s{i}", entity_id=None if i % 5 == 0 else f"e{i}") for i in range(600)])
    ids = spark.createDataFrame([(f" e{i}\n",) for i in range(0, 600, 2)] * 2 + [(None,), ("",)], "entity_id string")
    none = ids.limit(0)
    kept = lambda **f: set(column(sessions_in(s, Scope(**f)), "id"))
    everything = {f"s{i}" for i in range(600)}
    assert kept(include_entities=ids) == {f"s{i}" for i in range(0, 600, 2) if i % 5}
    assert kept(exclude_entities=ids) == {f"s{i}" for i in range(1, 600, 2) if i % 5}
    assert kept(include_entities=none) == set() and kept(exclude_entities=none) == everything
    assert kept(include_entities=ids, exclude_entities=ids) == set()
    assert sessions_in(s, Scope(include_entities=ids)).columns == s.columns
    log = events(spark, *[dict(id=f"x{i}", session_id=f"s{i}", seq=1) for i in range(600)])
    scope = Scope(exclude_entities=ids)
    assert scope.filters_sessions and len(column(ev.events_scoped(log, s, scope), "id")) == 240
    few = spark.createDataFrame([("e1",), ("e2",), ("e3",)], "entity_id string")
    assert kept(include_entities=few) == kept(include_entity_ids="e1,e2,e3")
    assert kept(exclude_entities=few) == kept(exclude_entity_ids="e1,e2,e3")


def test_only_keys_are_written_to_number_whole_sessions(spark, monkeypatch):
    seen = []
    monkeypatch.setattr("sessionlake.operators.ordered.written", lambda df, *a: (seen.append(df.columns), written(df, *a))[1])
    log = table(spark, "ai_debug_events", [dict(id=f"d{i}", session_id=f"s{i % 3}", body="x" * i) for i in range(50)])
    rows = replay.debug_replay(log.unionByName(log.limit(1).withColumn("session_id", F.lit(None).cast("string"))), None).collect()
    assert len(rows) == 51 and all(len(r["body"]) == int(r["id"][1:]) for r in rows)
    assert seen and not any("body" in c for columns in seen for c in columns)


def test_renames(spark):
    s = sessions(spark, dict(id="a", title="old"), dict(id="b", title="keep"), dict(id="c"))
    renames = spark.createDataFrame(
        [("a", " first ", 1), ("a", "\tsecond\n", 3), ("a", "   ", 4), ("b", "é" * 201, 1), ("c", "é" * 200, 1),
         ("ghost", "x", 1), ("b", None, 2)], "id string, title string, seq long")
    updated, rejects = rename.apply_renames(s, renames, instant_literal(instant("2025-09-09T00:00:00Z")))
    got = by(updated, "id")
    assert [got[i]["title"] for i in "abc"] == ["second", "keep", "é" * 200]
    assert [got[i]["updated_at"].month for i in "abc"] == [9, 3, 9] and updated.columns == s.columns
    assert sorted((r["id"], r["seq"], r["reason"]) for r in rejects.collect()) == [
        ("a", 4, "empty title"), ("b", 1, "title too long"), ("b", 2, "empty title"), ("ghost", 1, "unknown session")]


def test_export_lines(spark):
    df = spark.createDataFrame(
        [("s1", "", 'q"\n', "", 0, None, {}, 1.5), ("s2", "0", None, "job", 7, 0.0, {"USD": 0.5}, 2.0)],
        "id string, title string, summary string, system_source string, duration_ms long, price_total double, "
        "cost_by_currency map<string,double>, cost_input_total double")
    lines = column(export.json_lines(df), "json")
    assert [json.loads(x) for x in lines] == [
        {"id": "s1", "summary": 'q"\n', "system_source": "", "price_total": None, "cost_by_currency": {}, "cost_input_total": 1.5},
        {"id": "s2", "title": "0", "system_source": "job", "duration_ms": 7, "price_total": 0.0,
         "cost_by_currency": {"USD": 0.5}, "cost_input_total": 2.0}]
    assert '"price_total":null' in lines[0] and "title" not in lines[0]


def test_export_of_a_report(spark, listed, tmp_path):
    rows = reports.session_list(listed[1], listed[2], n=5).rows
    export.write_json_lines(rows, str(tmp_path / "out"))
    back = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(back) == 5 and all("price_total" in b and "system_source" in b for b in back)


def test_a_whole_session_is_numbered_through_ranges(spark, monkeypatch):
    monkeypatch.setattr("sessionlake.operators.ordered.ranges_for", lambda rows: 4)
    rows = [dict(id=f"e{i:04d}", session_id="s", seq=i) for i in range(400)] + [dict(id="x", session_id="t", seq=5)]
    at = spark.createDataFrame([("s", 9), ("t", 0)], "session_id string, since_seq long")
    tailed = ev.tail(table(spark, "session_events", rows), at, None, include_payload=False)
    found = tailed.where("session_id = 's'").orderBy("pos").collect()
    assert [(r["pos"], r["seq"]) for r in found] == [(i, i + 9) for i in range(1, 391)]
    assert not any(r["has_more"] for r in found) and dict(tailed.dtypes)["pos"] == "int"
    replayed = replay.debug_replay(table(spark, "ai_debug_events", [dict(id=r["id"], session_id="s") for r in rows[:400]]), None)
    found = replayed.orderBy("pos").collect()
    assert [r["id"] for r in found] == [f"e{i:04d}" for i in range(400)]
    for df in (tailed, replayed):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "_range" in plan and "row_number" not in plan
