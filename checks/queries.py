"""One query per operator, over whole tables. Times are published as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.binding import Bound
from sessionlake.functions import calls, payload, text, times, tokens
from sessionlake.operators import (
    breakdown, budget, buckets, currency, events, export, paging, prompts, rename, replay, rollup, scope, stats,
    toolcalls, transcript,
)
from sessionlake.operators.scope import ALL, Scope
from sessionlake.plans import reports
from sessionlake.sources import reader
from sessionlake.sources.writer import write_events
from sessionlake.streaming import jobs
from sessionlake.workspace import new_folder

SINCE, UNTIL = "2024-01-05T00:00:00Z", "2024-01-20T00:00:00Z"
WINDOW = Scope(since=SINCE, until=UNTIL)
GROUP = Scope(group_id="BUILDING")
GROUP_WINDOW = Scope(group_id="BUILDING", since=SINCE, until=UNTIL)
TIME_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Callable[[Bound], DataFrame], name: str | None = None):
    QUERIES[name or fn.__name__] = lambda spark, sf_dir: shown(fn(Bound(spark, sf_dir)))
    return fn


def shown(df: DataFrame) -> DataFrame:
    """Times as text, decimals as doubles, integers of one width."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = F.date_format(c, TIME_TEXT)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.IntegerType):
            c = c.cast("bigint")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def costs_apart(df: DataFrame, name: str = "cost_by_currency") -> DataFrame:
    """The currency map as columns."""
    return df.withColumns({
        "cost_usd": F.col(name)["USD"], "cost_eur": F.col(name)["EUR"], "cost_none": F.col(name)["none"],
        "n_currencies": F.coalesce(F.size(name), F.lit(-1)),
    }).drop(name)


# --- sources and sinks -------------------------------------------------------

@query
def src_tables(b):
    return reader.table_counts(reader.Model(
        b.sessions, b.messages, b.events, b.snapshots, b.debug_events, b.usage))


@query
def events_no_payload(b):
    return events.event_rows(b.events, include_payload=False)


def _renames(b):
    key = F.col("c_custkey")
    title = (
        F.when(key % 5 == 0, F.concat(F.lit(" \tNew name "), key, F.lit("\n")))
        .when(key % 5 == 1, "  \n").when(key % 5 == 2, F.repeat(F.lit("é"), 200))
        .otherwise(F.repeat(F.lit("é"), 201))
    )
    first = b.table("customer").select((key * 2).cast("string").alias("id"), title.alias("title"), key.alias("seq"))
    again = b.table("customer").where(key % 10 == 0).select(
        (key * 2).cast("string").alias("id"), F.concat(F.lit("Later "), key).alias("title"),
        (key + 1000000000).alias("seq"))
    return first.unionByName(again)


RENAMED_AT = "2024-06-01T00:00:00Z"


@query
def rename_apply(b):
    updated, _ = rename.apply_renames(b.sessions, _renames(b), times.instant_literal(times.instant(RENAMED_AT)))
    return updated.select("id", "title", "updated_at")


@query
def rename_rejects(b):
    _, rejects = rename.apply_renames(b.sessions, _renames(b), times.instant_literal(times.instant(RENAMED_AT)))
    return rejects.select("id", "seq", "reason", F.char_length("title").alias("n_chars"))


@query
def export_sessions(b):
    rows = events.session_rows(b.sessions).select(
        "id", "entity_id", "group_id", "title", "summary", "active_model",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        "interaction_kind", "system_source", "opened_by",
    )
    s = stats.published(currency.with_costs(currency.activity_by_currency(b.events), "session_id")).select(
        F.col("session_id").alias("id"), "llm_call_count", (F.col("price_total") / 8).alias("price_total"), "cost_by_currency")
    return export.json_lines(rows.join(s, "id"))


# --- filters -----------------------------------------------------------------

def _session_filter(name: str, **conditions):
    query(lambda b: scope.sessions_in(b.sessions, Scope(**conditions)).select("id"), name)


_session_filter("f_entity", entity_id="7")
_session_filter("f_group", group_id="BUILDING")
_session_filter("f_include", include_entity_ids=" 1, 2,,3 ,5")
_session_filter("f_exclude", exclude_entity_ids="1,2,3", entity_id="", group_id="BUILDING")


def _entities_by_table(b, sign):
    """Orders as sessions, one in ten without an entity, and a table of customers with a NULL and a repeat."""
    s = b.star_sessions.withColumn("entity_id", F.when(F.col("id").cast("long") % 10 != 0, F.col("entity_id")))
    ids = b.table("customer").where(F.col("c_acctbal") * sign > 0).select(F.col("c_custkey").cast("string").alias("entity_id"))
    none = b.spark.range(1).select(F.lit(None).cast("string").alias("entity_id"))
    return s, ids.unionByName(ids).unionByName(none)


@query
def f_include_table(b):
    s, ids = _entities_by_table(b, 1)
    return scope.sessions_in(s, Scope(include_entities=ids)).select("id")


@query
def f_exclude_table(b):
    s, ids = _entities_by_table(b, -1)
    return scope.sessions_in(s, Scope(exclude_entities=ids)).select("id")


_session_filter("f_kind", kind=" system ")
_session_filter("f_system_source", system_source="csv_mapping")
_session_filter("f_opened_by", opened_by="welcome")
_session_filter("f_title", title=" STOMER#00000001 ", kind="chat")


@query
def f_time_window(b):
    return scope.events_in(b.events, WINDOW).select("id", "ts")


@query
def f_event_type(b):
    return scope.events_in(b.events, Scope(event_type="llm_error")).select("id")


@query
def f_session(b):
    return scope.events_in(b.events, Scope(session_id="7")).select("id", "session_id")


@query
def f_visible_messages(b):
    return scope.visible(b.messages).select("session_id", "seq", "role")


def _positions(b):
    """Each session with events, read up to a time; and ids nobody knows."""
    key = F.col("c_custkey")
    known = b.table("customer").select(key.cast("string").alias("session_id"), (key * 37).alias("since_seq"))
    return known.unionByName(b.table("customer").where(key % 100 == 0).select(
        F.concat(F.lit("nobody-"), key).alias("session_id"), F.lit(0).cast("bigint").alias("since_seq")))


@query
def f_after_seq(b):
    return events.after_seq(b.events, _positions(b)).select("session_id", "seq", "id")


@query
def f_keyset(b):
    return paging.after(b.sessions, "created_at", "desc", "2023-12-20T00:00:00Z", "5").select("id", "created_at")


@query
def f_json_array_has(b):
    key = F.col("c_custkey")
    tags = F.when(key % 7 != 0, F.to_json(F.array(F.concat(F.lit("t"), key % 3), F.concat(F.lit("t"), key % 5))))
    return b.table("customer").select(key.alias("c_custkey"), payload.json_array_has(tags, "t2").alias("has_t2"))


# --- projections -------------------------------------------------------------

@query
def session_rows(b):
    return events.session_rows(b.sessions)


@query
def event_rows(b):
    return events.event_rows(b.events)


@query
def payload_fields(b):
    return payload.with_payload(b.events).select(
        "id", "tokens_in", "tokens_out", "cache_write_tokens", "cache_read_tokens",
        "cost_input", "cost_output", "price", "cost_currency")


@query
def session_metadata(b):
    return b.sessions.select("id", F.explode(payload.metadata_map(F.col("metadata"))).alias("name", "value"))


# --- joins -------------------------------------------------------------------

@query
def join_left_scope(b):
    j = scope.joined(b.sessions, b.events, GROUP)
    return j.select("id", "event_id", "event_type")


@query
def join_inner_scope(b):
    j = scope.joined(b.sessions, b.events, GROUP_WINDOW)
    return j.select("id", "event_id", "event_type")


@query
def events_scoped(b):
    return scope.events_scoped(b.events, b.sessions, GROUP_WINDOW).select("id", "session_id", "ts")


def _some_unknown(b):
    """Sessions with one in three left out, so that their events are orphans."""
    return b.sessions.where(F.col("id").cast("bigint") % 3 != 0)


@query
def events_orphans(b):
    kept = scope.events_scoped(b.events, _some_unknown(b), WINDOW).select("id", F.lit("no filter").alias("scope"))
    some = scope.events_scoped(b.events, _some_unknown(b), Scope(kind="chat", since=SINCE, until=UNTIL))
    return kept.unionByName(some.select("id", F.lit("kind").alias("scope")))


@query
def currency_for_page(b):
    page = paging.top_sessions(stats.session_stats(b.sessions, b.events), "cost_total", "desc", 50)
    return currency.cost_by_currency(b.sessions, b.events, per_session=True, page=page)


@query
def session_presence(b):
    return events.presence(_positions(b), b.sessions, b.events)


@query
def main_loop_responses(b):
    return toolcalls.main_loop_responses(b.events_with_calls).select("session_id", "id")


@query
def tool_call_rows(b):
    return toolcalls.tool_call_sources(b.messages, b.events_with_calls).select(
        "session_id", "seq", "n_ids", "is_whole", F.col("response_ids")[0].alias("response_id"))


@query
def tool_calls_text(b):
    return toolcalls.attribute_tool_calls(b.messages, b.events_with_calls).select("session_id", "seq", "tool_calls")


@query
def tool_result_pairs(b):
    return toolcalls.tool_results_with_events(b.messages, b.events)


@query
def tool_result_events(b):
    return toolcalls.tool_result_events(b.messages, b.events)


@query
def prompt_resolve(b):
    sha = F.sha2("text", 256)
    references = b.table("documents").select(F.when(F.col("doc_id") % 4 == 0, F.sha2(F.concat("text", F.lit("?")), 256))
                                             .otherwise(sha).alias("sha256"))
    return prompts.resolve_prompts(references, b.snapshots).select(
        "sha256", "n_refs", "is_found", "kind", F.char_length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


# --- aggregations ------------------------------------------------------------

@query
def agg_count_type(b):
    return b.events.groupBy("session_id").agg(
        stats.count_type("llm_response").alias("llm_call_count"),
        stats.count_type("tool_call_result").alias("tool_call_count"))


@query
def agg_tokens(b):
    return payload.with_payload(b.events).groupBy("session_id").agg(
        stats.token_sum("tokens_in").alias("tokens_in_total"), stats.token_sum("tokens_out").alias("tokens_out_total"))


@query
def agg_cost(b):
    return payload.with_payload(b.events).groupBy("session_id").agg(
        stats.cost_sum("cost_input").alias("cost_input_total"), stats.cost_sum("cost_output").alias("cost_output_total"))


@query
def agg_price(b):
    return payload.with_payload(b.events).groupBy("session_id").agg(stats.price_sum().alias("price_total"))


def _measures(df, *keys):
    return df.select(*keys, *stats.MEASURES)


@query
def session_stats(b):
    return _measures(stats.session_stats(b.sessions, b.events), "id")


@query
def session_stats_window(b):
    return _measures(stats.session_stats(b.sessions, b.events, GROUP_WINDOW), "id")


@query
def session_stats_star(b):
    return _measures(stats.session_stats(b.star_sessions, b.star_events), "id")


@query
def session_totals(b):
    return _measures(stats.totals(stats.session_stats(b.sessions, b.events, GROUP)), "session_count")


@query
def event_totals(b):
    return _measures(stats.totals(stats.session_stats(b.sessions, b.events, WINDOW)), "session_count", "event_count")


@query
def event_totals_by_filter_type(b):
    scoped = Scope(event_type="tool_call_result", group_id="BUILDING")
    return _measures(stats.totals(stats.session_stats(b.sessions, b.events, scoped)), "session_count", "event_count")


@query
def currency_total(b):
    return currency.cost_by_currency(b.sessions, b.events, GROUP)


@query
def currency_by_session(b):
    return currency.cost_by_currency(b.sessions, b.events, WINDOW, per_session=True)


@query
def currency_by_bucket(b):
    return currency.cost_by_currency(b.sessions, b.events, GROUP, by=buckets.by_bucket("week"))


@query
def currency_map(b):
    costs = currency.with_costs(currency.activity_by_currency(b.events), "session_id")
    return costs_apart(costs.select("session_id", "cost_by_currency"))


@query
def by_event_type(b):
    return breakdown.by_event_type(breakdown.active(b.sessions, b.events, GROUP))


for _g in ("day", "week", "month", "year"):
    query(lambda b, g=_g: _measures(buckets.time_buckets(b.sessions, b.events, g, GROUP),
                                    "bucket", "session_count", "event_count"), f"buckets_{_g}")


@query
def stats_rollup_day(b):
    return _measures(buckets.rolled_up(b.sessions, b.events, "day", WINDOW),
                     "bucket", "is_total", "session_count", "event_count")


def _maintained(b) -> DataFrame:
    """The log arrives in two deliveries, each refreshed into the rollup; the second is late
    for every day and brings the rest of the table."""
    at, path = new_folder(b.spark, "log"), new_folder(b.spark, "rollup")
    late = F.col("seq") % 2 == 1
    for delivery in (b.events.where(~late | late.isNull()), b.events.where(late)):
        write_events(delivery, at, mode="append")
        rollup.refresh(b.spark, at, path)
    return rollup.read_rollup(b.spark, path)


@query
def rollup_buckets_week(b):
    scoped = scope.sessions_in(b.sessions, GROUP)
    return _measures(rollup.rollup_buckets(_maintained(b), scoped, "week"), "bucket", "session_count", "event_count")


@query
def rollup_totals_day(b):
    return _measures(rollup.rollup_totals(_maintained(b), b.sessions, "day"),
                     "bucket", "is_total", "session_count", "event_count")


BUDGET_SINCE = "1997-06-01T02:00:00+02:00"


@query
def budget_total(b):
    spent = budget.budget_balance(b.usage, BUDGET_SINCE)
    return spent.where(F.col("level") == "group").select("group_id", "price_total")


@query
def budget_by_entity(b):
    spent = budget.budget_balance(b.usage, BUDGET_SINCE, " system, job ")
    return spent.where(F.col("level") == "entity").select("group_id", "entity_id", "price_total")


def _rules(b):
    """Rules cut from the orders: some for a group, some for one entity of it."""
    key = F.col("o_orderkey")
    return b.table("orders").where(key % 50 == 0).select(
        key.alias("rule_id"), F.col("o_orderpriority").alias("group_id"),
        F.when(key % 100 == 0, F.col("o_custkey").cast("string")).alias("entity_id"),
        F.when(key % 150 == 0, F.array(F.lit("system"), F.lit("job"))).otherwise(F.array().cast("array<string>"))
        .alias("kinds"),
        F.timestamp_seconds(F.lit(852076800) + key % 8 * 15778800).alias("since"),
        F.lit(1000000.0).alias("max_price"),
    )


@query
def budget_rules(b):
    return budget.budget_usage(b.usage, _rules(b)).drop("max_price")


@query
def last_activity(b):
    return stats.last_activity(b.events, WINDOW)


@query
def stats_after_key(b):
    s = stats.session_stats(b.sessions, b.events)
    return paging.after(s, "cost_total", "desc", "100.5", "3").select(
        "id", stats.cost_total().alias("cost_total"))


# --- windows -----------------------------------------------------------------

@query
def sample_sessions(b):
    return breakdown.sample_sessions(breakdown.active(b.sessions, b.events, GROUP), 5)


@query
def error_rows(b):
    return transcript.error_rows(b.events)


@query
def transcript_rows(b):
    return transcript.transcript(b.messages, b.events, with_tool_calls=False).select(
        "session_id", "pos", "seq", "role", "content", "tool_call_id", "metadata", "visibility", "created_at")


QUERIES["transcript"] = QUERIES.pop("transcript_rows")


@query
def transcript_hidden(b):
    return transcript.transcript(b.messages, b.events, include_hidden=True, with_tool_calls=False).select(
        "session_id", "pos", "seq", "role", "visibility", "created_at")


# --- sorts and pages ---------------------------------------------------------

def _top(name: str, sort: str, direction: str, n: int, scoped: Scope = ALL):
    def run(b):
        top = paging.top_sessions(stats.session_stats(b.sessions, b.events, scoped), sort, direction, n)
        return top.select("pos", "id", paging.sort_key(sort).value.alias("sort_value"))
    query(run, name)


_top("top_created_at", "created_at", "desc", 200)
_top("top_updated_at", "updated_at", "asc", 200)
_top("top_active_model", "active_model", "asc", 200)
_top("top_cost_total", "cost_total", "desc", 200)
_top("top_llm_calls", "llm_call_count", "desc", 200, GROUP)
_top("top_tool_calls", "tool_call_count", "asc", 200, WINDOW)
_top("top_tokens_in", "tokens_in_total", "desc", 200)
_top("top_tokens_out", "tokens_out_total", "desc", 200)


@query
def page_by_model(b):
    s = paging.after(stats.session_stats(b.sessions, b.events), "active_model", "desc", "model-b", "50")
    return paging.page_rows(s, "active_model", "desc", 100).select("pos", "id", "active_model", "is_boundary")


@query
def page_by_cost(b):
    s = paging.after(stats.session_stats(b.sessions, b.events), "cost_total", "asc", "0", "500")
    return paging.page_rows(s, "cost_total", "asc", 100).select(
        "pos", "id", "is_boundary", stats.cost_total().alias("cost_total"))


@query
def page_null_keys(b):
    """Pages that go on behind a session without a time, in both directions."""
    n = F.col("id").cast("bigint")
    s = b.sessions.select("id", F.when(n % 3 != 0, F.col("created_at")).alias("created_at"))
    pages = [paging.page_rows(paging.after(s, "created_at", way, None, "50"), "created_at", way, 100).select(
        F.lit(way).alias("way"), "pos", "id", "created_at", "is_boundary") for way in ("asc", "desc")]
    return pages[0].unionByName(pages[1])


@query
def page_boundary(b):
    s = stats.session_stats(b.sessions, b.events, Scope(kind="system"))
    return paging.page_rows(s, "tokens_in_total", "desc", 25).select("pos", "id", "is_boundary")


@query
def page_index(b):
    s = stats.session_stats(b.sessions, b.events)
    return paging.page_index(s, "tokens_in_total", "desc", 25).select("page", "pos", "id", "sort_value")


@query
def events_page(b):
    bound = times.instant_literal(times.instant(UNTIL))
    return events.newest_events(b.events, b.sessions, GROUP, n=200, after=(bound, F.lit(""))).select(
        "pos", "id", "session_id", "seq", "ts", "event_type", "is_boundary")


@query
def tail_events(b):
    return events.tail(b.events, _positions(b), 20, include_payload=False).select(
        "session_id", "pos", "seq", "id", "has_more")


@query
def debug_replay(b):
    return replay.debug_replay(b.debug_events, 20).select(
        "session_id", "pos", "id", "trace_id", "ts", "direction", "status", "url", F.md5("body").alias("body_md5"), "has_more")


@query
def tail_events_whole(b):
    return events.tail(b.events, _positions(b), None, include_payload=False).select("session_id", "pos", "seq", "id", "has_more")


@query
def debug_replay_whole(b):
    return replay.debug_replay(b.debug_events, None).select(
        "session_id", "pos", "id", "direction", F.md5("body").alias("body_md5"), "has_more")


@query
def debug_pairs(b):
    return replay.debug_pairs(b.debug_events)


@query
def session_event_log(b):
    return events.event_log(b.events).select("session_id", "seq", "id", "ts", "event_type", "duration_ms")


# --- scalar functions --------------------------------------------------------

@query
def fn_json_int(b):
    k = F.get_json_object("props", "$.k").cast("int")
    doc = (F.when(k % 6 == 0, F.concat(F.lit('{"f":'), k, F.lit("}")))
           .when(k % 6 == 1, F.concat(F.lit('{"f":'), k, F.lit(".75}")))
           .when(k % 6 == 2, F.concat(F.lit('{"f":"'), k, F.lit('"}')))
           .when(k % 6 == 3, '{"f":""}').when(k % 6 == 4, '{"g":1}').otherwise('{"f":'))
    return b.table("events").select("event_id", payload.int_or_zero(payload.json_fields(doc, "f")["f"]).alias("n"))


def _number(k):
    return (F.when(k % 5 == 0, F.concat(F.lit('{"f":'), k, F.lit(".25}")))
            .when(k % 5 == 1, F.concat(F.lit('{"f":"'), k, F.lit('.5"}')))
            .when(k % 5 == 2, '{"f":""}').when(k % 5 == 3, '{"f":null}').otherwise("[1"))


@query
def fn_json_double(b):
    k = F.get_json_object("props", "$.k").cast("int")
    return b.table("events").select(
        "event_id", payload.double_or_zero(payload.json_fields(_number(k), "f")["f"]).alias("x"))


@query
def fn_json_double_null(b):
    k = F.get_json_object("props", "$.k").cast("int")
    return b.table("events").select(
        "event_id", payload.double_or_null(payload.json_fields(_number(k), "f")["f"]).alias("x"))


@query
def fn_json_text(b):
    k = F.get_json_object("props", "$.k").cast("int")
    doc = (F.when(k % 4 == 0, F.concat(F.lit('{"f":"v'), k, F.lit('"}')))
           .when(k % 4 == 1, '{"f":""}').when(k % 4 == 2, '{"g":"x"}').otherwise("not json"))
    return b.table("events").select("event_id", payload.text_or_null(payload.json_fields(doc, "f")["f"]).alias("t"))


@query
def fn_date_bucket(b):
    return b.events.select("id", *[times.bucket_key(F.col("ts"), g).alias(g) for g in ("day", "week", "month", "year")])


FILL_SINCE, FILL_UNTIL = "2023-12-28T12:00:00Z", "2024-02-03T00:00:00Z"


@query
def bucket_scaffold(b):
    """The scaffold, each bucket with how many events it holds."""
    held = b.events.groupBy(times.bucket_key(F.col("ts"), "week").alias("bucket")).count()
    keys = times.bucket_scaffold(b.spark, FILL_SINCE, FILL_UNTIL, "week")
    return keys.join(held, "bucket", "left").select("bucket", F.coalesce("count", F.lit(0)).alias("n_events"))


def _filled(b, granularity, since, until):
    scoped = Scope(group_id="BUILDING", since=since, until=until)
    fine = currency.activity_by_currency(b.events, scoped, buckets.by_bucket(granularity))
    found = buckets.bucket_report(scope.of_sessions(fine, scope.sessions_in(b.sessions, scoped)))
    done = buckets.filled(b.spark, found, since, until, granularity)
    return costs_apart(done.select("bucket", "session_count", "event_count", *stats.MEASURES, "cost_by_currency"))


@query
def buckets_filled_day(b):
    return _filled(b, "day", FILL_SINCE, FILL_UNTIL)


@query
def buckets_filled_month(b):
    return _filled(b, "month", "2023-11-15T00:00:00Z", "2024-04-01T00:00:00Z")


@query
def fn_rfc3339_utc(b):
    ts, i = F.col("ts").cast("timestamp"), F.col("event_id")
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    stamp = (F.when(i % 5 == 0, F.concat(base, F.lit("Z"))).when(i % 5 == 1, F.concat(base, F.lit("+02:00")))
             .when(i % 5 == 2, F.concat(base, F.lit(".250-05:30"))).when(i % 5 == 3, base)
             .otherwise(F.concat(F.lit("x"), base)))
    return b.table("events").select("event_id", times.rfc3339(stamp).alias("at"))


@query
def fn_made_up_id(b):
    k = F.get_json_object("props", "$.k").cast("int")
    call_id = (F.when(k % 6 == 0, F.concat(F.lit("call-"), k)).when(k % 6 == 1, F.concat(F.lit("call_"), k))
               .when(k % 6 == 2, F.concat(F.lit("planner-a-"), k)).when(k % 6 == 3, F.concat(F.lit("pipeline-"), k))
               .when(k % 6 == 4, F.concat(F.lit("call-"), k, F.lit("a"))).otherwise("call-"))
    return b.table("events").select("event_id", calls.made_up(call_id).alias("is_made_up"))


@query
def fn_stored_call_ids(b):
    ids = calls.stored_call_ids(F.col("tool_calls"))
    broken = {f"ids_{n}": F.array_join(calls.stored_call_ids(c), " ") for n, c in {
        "junk": F.concat("tool_calls", F.lit(" junk]")), "two": F.concat_ws(",", "tool_calls", "tool_calls")}.items()}
    return b.messages.withColumns(broken | {"ids": F.array_join(ids, " ")}).select(
        "session_id", "seq", "ids", *broken)


@query
def fn_call_entries(b):
    return toolcalls.call_entries(b.events_with_calls)


@query
def fn_error_text(b):
    return b.events.where(F.col("event_type") == "llm_error").select("id", text.error_text(F.col("payload")).alias("content"))


@query
def fn_metadata_gate(b):
    m = F.col("metadata")
    return b.messages.select("session_id", "seq", text.metadata_or_null(m).alias("metadata"), *[
        text.metadata_or_null(c).alias(n) for n, c in {
            "behind": F.concat(m, F.lit("],[1")), "member": F.concat(m, F.lit(',"x":1')), "junk": F.concat(m, F.lit(" x"))}.items()])


@query
def fn_page_token(b):
    key = paging.sort_key("created_at")
    return b.sessions.select("id", tokens.page_token("created_at", "desc", key.text(), F.col("id")).alias("token"))


def _tokens(b):
    n = F.col("id").cast("bigint")
    key = paging.sort_key("created_at")
    legacy = F.rtrim(F.translate(F.base64(F.encode(F.concat_ws("|", key.text(), "id"), "UTF-8")), "+/", "-_"), F.lit("="))
    single = F.rtrim(F.base64(F.encode(F.col("id"), "UTF-8")), F.lit("="))
    return b.sessions.select("id", (
        F.when(n % 5 == 0, tokens.page_token("created_at", "desc", key.text(), F.col("id")))
        .when(n % 5 == 1, legacy).when(n % 5 == 2, tokens.page_token("updated_at", "desc", key.text(), F.col("id")))
        .when(n % 5 == 3, single).otherwise("%%%")
    ).alias("token"))


@query
def fn_page_token_decode(b):
    decoded = _tokens(b).select("id", tokens.decoded_token(F.col("token"), "created_at", "desc").alias("d"))
    return decoded.select("id", "d.status", "d.sort", "d.direction", "d.value", F.col("d.id").alias("token_id"))


# --- streams -----------------------------------------------------------------

def _streamed(b, start: Callable, name: str) -> str:
    """Run a stream over the whole events table; returns where it wrote."""
    given = b.table("events").schema
    stream = b.bind_events(b.spark.readStream.schema(given).parquet(f"{b.sf_dir}/events*.parquet"))
    path = new_folder(b.spark, name)
    start(stream, path, new_folder(b.spark, f"{name}-checkpoint")).awaitTermination()
    return path


@query
def stream_tail(b):
    path = _streamed(b, jobs.start_tail, "tail")
    return jobs.read_tail(b.spark, path).select("session_id", "seq", "id", "ts", "event_type")


@query
def stream_session_stats(b):
    path = _streamed(b, jobs.start_activity, "activity")
    return _measures(jobs.read_session_stats(b.spark, path), "session_id", "event_count")


@query
def stream_buckets_day(b):
    path = _streamed(b, jobs.start_activity, "activity")
    return _measures(jobs.read_buckets(b.spark, path, "day", b.sessions), "bucket", "session_count", "event_count")


@query
def stream_buckets_week(b):
    path = _streamed(b, jobs.start_activity, "activity")
    return _measures(jobs.read_buckets(b.spark, path, "week", b.sessions), "bucket", "session_count", "event_count")


# --- reports -----------------------------------------------------------------

@query
def report_sessions(b):
    r = reports.session_list(b.sessions, b.events, GROUP_WINDOW, sort="cost_total", n=50)
    cols = ["id", *stats.MEASURES, "cost_usd", "cost_eur", "cost_none", "n_currencies"]
    rows = costs_apart(r.rows).select(F.lit("row").alias("part"), "pos", "is_boundary", F.lit(1).cast("bigint").alias("session_count"), *cols)
    total = costs_apart(r.totals).select(
        F.lit("totals").alias("part"), F.lit(0).alias("pos"), F.lit(False).alias("is_boundary"), "session_count",
        F.lit("").alias("id"), *cols[1:])
    return rows.unionByName(total)


@query
def report_session_detail(b):
    d = reports.session_detail(b.sessions, b.messages, b.events_with_calls)
    costs = ["cost_usd", "cost_eur", "cost_none", "n_currencies"]
    head = costs_apart(d.sessions).select(
        F.col("id").alias("session_id"), F.lit("session").alias("part"), F.col("interaction_kind").alias("kind"),
        F.col("title").alias("body"), "event_count", *stats.MEASURES, *costs,
        F.col("metadata")["channel"].alias("channel"), F.size("metadata").cast("bigint").alias("n_metadata"))
    told = d.messages.select(
        "session_id", F.lit("message").alias("part"), "pos", "seq", F.col("role").alias("kind"),
        F.col("content").alias("body"), "tool_calls", "tool_call_id", F.col("metadata").alias("own_metadata"), "visibility",
        F.col("created_at").alias("at"))
    log = d.events.select(
        "session_id", F.lit("event").alias("part"), "seq", F.col("event_type").alias("kind"), F.col("id").alias("body"),
        F.col("ts").alias("at"), "duration_ms", "parent_id", "payload")
    return head.unionByName(told, allowMissingColumns=True).unionByName(log, allowMissingColumns=True)


@query
def report_by_type(b):
    r = reports.event_stats(b.sessions, b.events, GROUP_WINDOW, by_type=True, samples=3)
    types = r.by_event_type.select("event_type", "event_count", "pos", F.array_join("sample_session_ids", " ").alias("samples"))
    cols = ["session_count", *stats.MEASURES, "cost_usd", "cost_eur", "cost_none", "n_currencies"]
    total = costs_apart(r.totals).select(F.lit("all").alias("event_type"), "event_count", F.lit(0).alias("pos"), *cols)
    return total.unionByName(types, allowMissingColumns=True)


@query
def report_buckets(b):
    r = reports.event_stats(b.sessions, b.events, WINDOW, bucket="week")
    cols = ["session_count", "event_count", *stats.MEASURES, "cost_usd", "cost_eur", "cost_none", "n_currencies"]
    total = costs_apart(r.totals).select(F.lit("total").alias("bucket"), *cols)
    return total.unionByName(costs_apart(r.time_buckets).select("bucket", *cols))


@query
def report_events(b):
    scoped = Scope(kind="chat", event_type="llm_response", since=SINCE, until=UNTIL)
    return reports.event_list(b.events, b.sessions, scoped, n=100).select(
        "pos", "id", "session_id", "seq", "ts", "duration_ms", "is_boundary", "payload")


@query
def report_budget(b):
    return reports.budget_report(b.usage, BUDGET_SINCE, "chat,system")
