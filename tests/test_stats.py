"""Scopes, statistics, currencies, buckets and breakdowns on small tables."""

import pytest
from pyspark.sql import functions as F

from sessionlake.operators import breakdown, buckets, currency, stats
from sessionlake.operators.scope import ALL, Scope, events_scoped, id_list, joined, sessions_in
from sessionlake.plans import reports
from tests.tables import by, column, events, response, sessions


@pytest.fixture(scope="module")
def log(spark):
    """Three groups: plain calls, priced calls in two currencies, and labels."""
    s = sessions(
        spark,
        dict(id="p1", entity_id="e1", group_id="plain", title="Alpha 100%", created_at="2025-01-10T00:00:00Z"),
        dict(id="p2", entity_id="e2", group_id="plain", created_at="2025-02-10T00:00:00Z"),
        dict(id="m_both", entity_id="e3", group_id="money"),
        dict(id="m_free", entity_id="e4", group_id="money"),
        dict(id="m_none", entity_id="e4", group_id="money"),
        dict(id="l_map", entity_id="e1", group_id="label", interaction_kind="system", system_source="import"),
        dict(id="l_job", entity_id=None, group_id="label", interaction_kind="system", system_source="notify",
             opened_by="hello"),
    )
    usd = response(v=3, tokens_in=8, tokens_out=4, cost_input=0.5, cost_output=0.25, cost_currency="USD", price=2.5)
    eur = response(v=3, tokens_in=8, tokens_out=4, cost_input=0.125, cost_output=0.5, cost_currency="EUR", price=0)
    old = response(v=2, tokens_in=8, tokens_out=4, cost_input=0.0625, cost_output=0.03125)
    e = events(
        spark,
        dict(id="a1", session_id="p1", seq=1, ts="2025-01-10T10:00:00Z", event_type="llm_response",
             payload=response(tokens_in=100, tokens_out=50, cache_write_tokens=10, cache_read_tokens=70,
                              cost_input=0.001, cost_output=0.002)),
        dict(id="a2", session_id="p1", seq=2, ts="2025-01-12T10:00:00Z", event_type="llm_response",
             payload=response(tokens_in=200, tokens_out=60, cache_read_tokens=5, cost_input=0.003, cost_output=0.004)),
        dict(id="b1", session_id="p2", seq=1, ts="2025-02-10T10:00:00Z", event_type="llm_response", payload="{broken"),
        dict(id="b2", session_id="p2", seq=2, ts="2025-02-10T10:00:01Z", event_type="tool_call_result", parent_id="b1",
             payload=response(tokens_in=9999, price=77)),
        dict(id="c1", session_id="m_both", seq=1, ts="2025-05-02T10:00:00Z", event_type="llm_response", payload=usd),
        dict(id="c2", session_id="m_both", seq=2, ts="2025-05-02T11:00:00Z", event_type="llm_response", payload=eur),
        dict(id="c3", session_id="m_both", seq=3, ts="2025-05-03T10:00:00Z", event_type="llm_response", payload=old),
        dict(id="d1", session_id="m_free", seq=1, ts="2025-05-04T10:00:00Z", event_type="llm_response", payload=eur),
        dict(id="f1", session_id="m_none", seq=1, ts="2025-05-04T11:00:00Z", event_type="llm_response", payload=old),
        dict(id="g1", session_id="l_map", seq=1, ts="2025-03-01T10:00:00Z", event_type="retry"),
        dict(id="o1", session_id="nobody", seq=1, ts="2025-05-04T12:00:00Z", event_type="retry"),
    )
    return s, e


def ids(df):
    return sorted(column(df, "id"))


def test_sessions_and_their_sums(log):
    got = by(stats.published(stats.session_stats(*log)), "id")
    assert len(got) == 7
    p1 = got["p1"]
    assert [p1[c] for c in (*stats.COUNTS, *stats.TOKENS)] == [2, 0, 300, 110, 10, 75]
    assert (p1["cost_input_total"], p1["cost_output_total"], p1["price_total"]) == (0.004, 0.006, None)
    p2 = got["p2"]  # a broken payload counts 0, and a result's payload is not read
    assert [p2[c] for c in (*stats.COUNTS, *stats.TOKENS)] == [1, 1, 0, 0, 0, 0] and p2["price_total"] is None
    job = got["l_job"]
    assert [job[c] for c in (*stats.COUNTS, *stats.TOKENS, *stats.COSTS)] == [0] * 8 and job["price_total"] is None
    assert [got[i]["price_total"] for i in ("m_both", "m_free", "m_none")] == [2.5, 0.0, None]


def test_a_filter_on_events_drops_eventless_sessions(log):
    label = Scope(kind="system")
    assert ids(stats.session_stats(*log, label)) == ["l_job", "l_map"]
    for scope in (Scope(kind="system", since="2025-01-01T00:00:00Z"), Scope(kind="system", event_type="retry")):
        assert ids(stats.session_stats(*log, scope)) == ["l_map"]
    assert joined(*log, label).count() == 2 and joined(*log, Scope(kind="system", until="2026-01-01T00:00:00Z")).count() == 1


def test_the_window_is_on_events_and_half_open(log):
    assert ids(stats.session_stats(*log, Scope(since="2025-01-12T10:00:00Z", until="2025-02-10T10:00:00Z"))) == ["p1"]
    got = by(stats.session_stats(*log, Scope(group_id="plain", since="2025-01-12T11:00:00+01:00")), "id")
    assert got["p1"]["tokens_in_total"] == 200 and got["p1"]["llm_call_count"] == 1


def test_session_filters(log):
    s = log[0]
    def found(**f):
        return ids(sessions_in(s, Scope(**f)))
    assert found(entity_id="e1") == ["l_map", "p1"]
    assert found(include_entity_ids=" e1 ,, e2", entity_id="e1") == ["l_map", "p1"]
    assert found(exclude_entity_ids=["e1", " "]) == ["m_both", "m_free", "m_none", "p2"]  # l_job has no entity
    assert found(include_entity_ids="e1,e2", exclude_entity_ids="e1") == ["p2"]
    assert found(kind=" system ", system_source="notify") == ["l_job"]
    assert found(opened_by="hello") == ["l_job"] and found(opened_by="HELLO") == []
    assert found(title="ALPHA 100%") == ["p1"] and found(title="alpha_") == [] and len(found(title="  ")) == 7
    assert found(kind="other") == [] and len(found(kind="")) == 7
    with pytest.raises(ValueError, match="at most 200"):
        id_list([str(i) for i in range(201)], "ids")
    with pytest.raises(ValueError, match="RFC3339"):
        Scope(since="2025-01-01")


def test_events_of_unknown_sessions(log):
    s, e = log
    assert "o1" in ids(events_scoped(e, s, Scope(event_type="retry")))
    assert ids(events_scoped(e, s, Scope(event_type="retry", kind="system"))) == ["g1"]


def test_totals_match_the_rows(log):
    for scope in (ALL, Scope(group_id="money"), Scope(since="2025-05-02T10:30:00Z"), Scope(group_id="nobody")):
        listed = stats.session_stats(*log, scope)
        rows, total = listed.collect(), stats.totals(listed).first()
        assert total["session_count"] == len(rows)
        for c in (*stats.COUNTS, *stats.TOKENS, *stats.COSTS):
            assert total[c] == sum(r[c] for r in rows)
        prices = [r["price_total"] for r in rows if r["price_total"] is not None]
        assert total["price_total"] == (sum(prices) if prices else None)


def costs(df):
    return {r["id"]: r["cost_by_currency"] for r in df.collect()}


def test_currencies_per_session_and_in_total(log):
    r = reports.session_list(*log, Scope(group_id="money"), sort="cost_total")
    assert costs(r.rows) == {
        "m_both": {"USD": 0.75, "EUR": 0.625, "none": 0.09375}, "m_free": {"EUR": 0.625}, "m_none": {"none": 0.09375}}
    total = r.totals.first()
    assert total["cost_by_currency"] == {"USD": 0.75, "EUR": 1.25, "none": 0.1875} and total["price_total"] == 2.5
    lazy = reports.session_list(*log, Scope(group_id="money"), sort="cost_total", keep=False)
    assert lazy.totals.first() == total and costs(lazy.rows) == costs(r.rows)
    label = reports.session_list(*log, Scope(group_id="label"))
    assert costs(label.rows) == {"l_map": {}, "l_job": {}} and label.totals.first()["cost_by_currency"] == {}


def test_an_empty_currency_is_none(spark, log):
    e = events(spark, dict(id="x", session_id="p1", seq=9, event_type="llm_response",
                           payload=response(cost_input=1, cost_output=2, cost_currency="")))
    got = currency.costs_published(currency.cost_by_currency(log[0], e)).collect()
    assert [(r["currency"], r["cost"]) for r in got] == [("none", 3.0)]


def test_the_smallest_costs_are_kept(spark, log):
    e = events(spark, dict(id="x", session_id="p1", seq=9, event_type="llm_response",
                           payload=response(cost_input=1e-12, cost_output=2e-12)))
    r = reports.session_list(log[0], e, sort="cost_total", n=1)
    assert r.rows.first()["cost_by_currency"] == {"none": 3e-12} == r.totals.first()["cost_by_currency"]
    assert float(currency.cost_by_currency(log[0], e).first()["cost"]) == 3e-12
    assert r.rows.first()["id"] == "p1"


def test_currencies_of_a_page(log):
    s, e = log
    page = s.where(F.col("id") == "m_free")
    got = currency.cost_by_currency(s, e, per_session=True, page=page).collect()
    assert [(r["session_id"], r["currency"], float(r["cost"])) for r in got] == [("m_free", "EUR", 0.625)]
    assert currency.cost_by_currency(s, e, per_session=True, page=s.limit(0)).count() == 0


def test_event_totals(log):
    total = reports.event_stats(*log).totals.first()
    assert (total["session_count"], total["event_count"], total["llm_call_count"]) == (7, 10, 8)
    one = reports.event_stats(*log, Scope(event_type="tool_call_result")).totals.first()
    assert (one["session_count"], one["event_count"], one["tool_call_count"], one["tokens_in_total"]) == (1, 1, 1, 0)
    assert one["price_total"] is None and one["cost_by_currency"] == {}


def test_buckets_with_gaps(log):
    window = Scope(group_id="money", since="2025-05-02T00:00:00Z", until="2025-05-06T00:00:00Z")
    got = reports.event_stats(*log, window, bucket="day")
    rows = got.time_buckets.orderBy("bucket").collect()
    assert [(r["bucket"], r["session_count"], r["event_count"], r["price_total"], r["cost_by_currency"]) for r in rows] == [
        ("2025-05-02", 1, 2, 2.5, {"USD": 0.75, "EUR": 0.625}), ("2025-05-03", 1, 1, None, {"none": 0.09375}),
        ("2025-05-04", 2, 2, 0.0, {"EUR": 0.625, "none": 0.09375}), ("2025-05-05", 0, 0, None, {})]
    total = got.totals.first()
    assert total["session_count"] == 3 and sum(r["session_count"] for r in rows) == 4
    for c in (*stats.COUNTS, *stats.TOKENS, *stats.COSTS, "event_count"):
        assert total[c] == sum(r[c] for r in rows)


def test_rollup_agrees_with_buckets(log):
    up = buckets.rolled_up(*log, "month")
    plain = by(buckets.time_buckets(*log, "month"), "bucket")
    assert {r["bucket"]: r["event_count"] for r in up.where("is_total = 0").collect()} == {
        k: r["event_count"] for k, r in plain.items()} == {"2025-01-01": 2, "2025-02-01": 2, "2025-03-01": 1, "2025-05-01": 5}
    total = up.where("is_total = 1").first()
    assert (total["session_count"], total["event_count"]) == (6, 10)


def test_an_empty_window_has_empty_buckets(log):
    window = Scope(since="2031-01-01T00:00:00Z", until="2031-01-04T00:00:00Z")
    rows = reports.event_stats(*log, window, bucket="day").time_buckets.collect()
    assert len(rows) == 3 and all(r["event_count"] == 0 and r["price_total"] is None for r in rows)


def test_breakdown_and_samples(spark, log):
    s, e = log
    tied = events(spark, *[dict(id=f"t{i}", session_id=i, seq=9, ts="2025-06-01T00:00:00Z", event_type=t)
                           for i in ("p2", "p1") for t in ("zz", "tool_call_result")])
    r = reports.event_stats(s, e.unionByName(tied), by_type=True, samples=2)
    rows = r.by_event_type.orderBy("pos").collect()
    assert [(x["event_type"], x["event_count"]) for x in rows] == [
        ("llm_response", 8), ("tool_call_result", 3), ("zz", 2), ("retry", 1)]
    assert [x["sample_session_ids"] for x in rows] == [["m_none", "m_free"], ["p1", "p2"], ["p1", "p2"], ["l_map"]]
    assert sum(x["event_count"] for x in rows) == r.totals.first()["event_count"]
    latest = breakdown.sample_sessions(breakdown.active(s, e), 1)
    assert by(latest, "event_type")["llm_response"]["session_id"] == "m_none"


def test_breakdowns_exclude_each_other(log):
    for bad in (dict(samples=2), dict(by_type=True, bucket="day"), dict(bucket="day"), dict(by_type=True, samples=6)):
        with pytest.raises(ValueError):
            reports.event_stats(*log, **bad)
    with pytest.raises(ValueError):
        reports.event_stats(*log, Scope(event_type="retry"), by_type=True)


def test_sums_do_not_depend_on_partitions(spark, log):
    s, e = log
    many = e.where("event_type = 'llm_response'").crossJoin(spark.range(300)).drop("id").withColumn(
        "id", F.monotonically_increasing_id().cast("string"))
    first = None
    for n in (1, 5, 13):
        total = stats.published(stats.totals(stats.session_stats(s, many.repartition(n)))).first()
        first = first or total
        assert total == first


def test_groups_that_share_a_third_of_all_rows_stay_small_in_the_shuffle(log):
    """Every aggregate over events combines before its exchange."""
    plan = stats.session_stats(*log)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate") < plan.index("Exchange hashpartitioning(session_id")
    assert "partial_sum" in plan and "BroadcastNestedLoop" not in plan and "CartesianProduct" not in plan
