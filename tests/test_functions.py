import json
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sessionlake.operators import toolcalls
from sessionlake.functions import calls, payload, text, times, tokens


def apply(spark, fn, values, kind="string"):
    """fn over a column of values, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r["o"] for r in df.select("i", fn(F.col("c")).alias("o")).orderBy("i").collect()]


def field(c):
    return payload.json_fields(c, "f")["f"]


def test_numbers_and_text_of_a_payload(spark):
    docs = ['{"f":7}', '{"f":12.9}', '{"f":"8"}', '{"f":""}', '{"f":null}', '{"g":1}', '{"f":', "[]", "", None,
            '{"f":"x"}', '{"f":1e3}', '{"f":-2}']
    assert apply(spark, lambda c: payload.int_or_zero(field(c)), docs) == [7, 12, 8, 0, 0, 0, 0, 0, 0, 0, 0, 1000, -2]
    doubles = [7.0, 12.9, 8.0, None, None, None, None, None, None, None, None, 1000.0, -2.0]
    assert apply(spark, lambda c: payload.double_or_null(field(c)), docs) == doubles
    assert apply(spark, lambda c: payload.double_or_zero(field(c)), docs) == [d or 0.0 for d in doubles]
    assert apply(spark, lambda c: payload.text_or_null(field(c)), ['{"f":"a"}', '{"f":""}', "{}", "no"]) == [
        "a", None, None, None]


def test_an_array_column_has_a_value(spark):
    has = apply(spark, lambda c: payload.json_array_has(c, "b"), ['["a","b"]', '["ab"]', "[]", "b", None])
    assert has == [True, False, False, False, False]


def test_metadata_maps(spark):
    assert apply(spark, payload.metadata_map, ['{"a":"x"}', "{}", None, "{bad"]) == [{"a": "x"}, {}, {}, {}]


@pytest.mark.parametrize("granularity,keys", [
    ("day", ["2025-06-02", "2025-06-08", "2025-06-09", "2024-12-31"]),
    ("week", ["2025-06-02", "2025-06-02", "2025-06-09", "2024-12-30"]),
    ("month", ["2025-06-01", "2025-06-01", "2025-06-01", "2024-12-01"]),
    ("year", ["2025-01-01", "2025-01-01", "2025-01-01", "2024-01-01"]),
])
def test_bucket_keys(spark, granularity, keys):
    stamps = ["2025-06-02T00:00:00Z", "2025-06-08T23:59:59.999999Z", "2025-06-09T01:00:00+01:00", "2024-12-31T12:00:00Z"]
    assert apply(spark, lambda c: times.bucket_key(times.rfc3339(c), granularity), stamps) == keys


def test_rfc3339_needs_an_offset(spark):
    stamps = ["2025-01-02T03:04:05Z", "2025-01-02T03:04:05.25+02:00", "2025-01-02T03:04:05", "2025-01-02", "x", None]
    got = apply(spark, lambda c: F.date_format(times.rfc3339(c), "yyyy-MM-dd HH:mm:ss.SSS"), stamps)
    assert got == ["2025-01-02 03:04:05.000", "2025-01-02 01:04:05.250", None, None, None, None]


def test_instants():
    assert times.instant("2025-01-02T03:00:00+01:00") == datetime(2025, 1, 2, 2, tzinfo=timezone.utc)
    assert times.instant("") is None and times.instant(None) is None
    for bad in ("2025-01-02T03:00:00", "yesterday"):
        with pytest.raises(ValueError):
            times.instant(bad)


@pytest.mark.parametrize("granularity,limit", [("day", 1200), ("week", 520), ("month", 120), ("year", 20)])
def test_bucket_limits(granularity, limit):
    start = datetime(2001, 1, 1, tzinfo=timezone.utc)  # a Monday
    end = {
        "day": start + timedelta(days=limit), "week": start + timedelta(weeks=limit),
        "month": start.replace(year=2001 + limit // 12), "year": start.replace(year=2001 + limit),
    }[granularity]
    times.check_bucket_window(start, end, granularity)
    with pytest.raises(ValueError, match="exceeds"):
        times.check_bucket_window(start, end + timedelta(microseconds=1), granularity)


def test_bucket_windows_are_checked():
    for since, until in ((None, "2025-01-01T00:00:00Z"), ("2025-01-01T00:00:00Z", None),
                         ("2025-01-01T00:00:00Z", "2025-01-01T00:00:00Z")):
        with pytest.raises(ValueError):
            times.check_bucket_window(since, until, "day")
    with pytest.raises(ValueError, match="unsupported"):
        times.check_bucket_window("2025-01-01T00:00:00Z", "2025-01-02T00:00:00Z", "hour")


@pytest.mark.parametrize("granularity,since,until,keys", [
    ("day", "2025-02-27T13:00:00Z", "2025-03-01T00:00:00Z", ["2025-02-27", "2025-02-28"]),
    ("week", "2025-06-04T00:00:00Z", "2025-06-09T00:00:00Z", ["2025-06-02"]),
    ("week", "2025-06-04T00:00:00Z", "2025-06-09T00:00:01Z", ["2025-06-02", "2025-06-09"]),
    ("month", "2025-01-31T00:00:00Z", "2025-03-01T00:00:00Z", ["2025-01-01", "2025-02-01"]),
    ("year", "2023-12-31T23:00:00Z", "2025-01-01T00:00:00Z", ["2023-01-01", "2024-01-01"]),
])
def test_scaffold(spark, granularity, since, until, keys):
    got = [r["bucket"] for r in times.bucket_scaffold(spark, since, until, granularity).orderBy("bucket").collect()]
    assert got == keys
    assert times.bucket_count(times.instant(since), times.instant(until), granularity) == len(keys)


def test_made_up_ids(spark):
    ids = ["call-7", "call-07", "call-", "call-7b", "Call-7", "call_7", "planner-", "planner-x-y", "pipeline-x",
           "a-planner-x", "toolu_9", ""]
    assert apply(spark, calls.made_up, ids) == [True, True, False, False, False, False, True, True, True,
                                                False, False, False]


def test_stored_call_ids(spark):
    cases = {
        '[{"id":"k1","name":"t__a","arguments":{"n":2.50}}]': ["k1"],
        ' \n[{"id":"k1"} , {"name":"x","id":"k2"}] ': ["k1", "k2"],
        '[{"id":"é\\u0041"}]': ["éA"],
        '[{"id":"k1","id":"k2"}]': ["k2"],
        "": None, "   ": None, "null": None, "[]": None, "[ ]": None, "oops": None, '{"id":"k1"}': None,
        '[{"id":"k1"},{"name":"x"}]': None, '[{"id":""}]': None, '[{"id":5}]': None, '[{"id":null}]': None,
        '["k1"]': None, "[null]": None, '[{"id":"k1"}': None, '[{"id":"k1"}] x': None, '[{"id":"a"}] junk]': None,
        '[{"id":"a"}],[{"id":"b"}]': None, '[{"id":"a"}],"x":[{"id":"b"}]': None, '[{"id":"a"}],[]],[[]': None,
        '[{"id":"a"}]],[[{"id":"b"}]': None,
    }
    assert apply(spark, calls.stored_call_ids, [*cases, None]) == [*cases.values(), None]


def test_provider_calls_keep_every_byte(spark):
    raw = '[ {"id":"k1", "n":2.50, "s":"a]\\"}\\u00e9"} ,{"type":"x"},\n {"id":5}, 7, {"id":"k2","deep":[{"id":"no"}]} ]'
    doc = '{"v":1, "x":{"native_tool_calls_raw":[{"id":"inner"}]}, "native_tool_calls_raw" :\t' + raw + ' ,"z":[1]}'
    got = apply(spark, calls.provider_calls, [doc])[0]
    assert got["raw"] == raw
    assert [(e["call_id"], e["entry"]) for e in got["entries"]] == [
        ("k1", '{"id":"k1", "n":2.50, "s":"a]\\"}\\u00e9"}'), (None, '{"type":"x"}'), (None, '{"id":5}'), (None, "7"),
        ("k2", '{"id":"k2","deep":[{"id":"no"}]}'),
    ]
    assert json.loads(got["raw"]) == json.loads(raw)


def test_provider_calls_that_are_none(spark):
    key = "native_tool_calls_raw"
    docs = [f'{{"{key}":null}}', f'{{"{key}":[]}}', f'{{"{key}":[ ]}}', f'{{"{key}":{{"id":"a"}}}}', f'{{"{key}":"[]"}}',
            "{}", "[]", "null", "", None, f'{{"{key}":[{{"id":"a"}}]', f'{{"{key}":[{{"id":"a"}}]}} x',
            f'{{"{key}":[NaN]}}', f'{{"{key}":[1,]}}', f'{{"{key}":[1]}},']
    assert apply(spark, calls.provider_calls, docs) == [None] * len(docs)


def test_call_ids_are_those_of_the_calls(spark):
    """Spark's parser and the cut agree wherever the former reads a response; where it reads none,
    the events get the ids from the cut."""
    key = "native_tool_calls_raw"
    arrays = [
        '[{"id":"x"},{"id":5},{"k":1},{"id":""}]', '[{"id":"x"},"s",null,[{"id":"y"}]]', '[{"id":"x","id":"y"}]', "[]", '"no"',
        '[{"id":"x","n":NaN}]', '[{"id":"x","a":{"b":1,"b":2}}]', '[{"id":"x","n":1e999}]', '{"id":"x"}', '[{"id":"x"},]', "null",
        '[{"id":"é\\u00e9\\n"}]', '[{"ID":"x"}]', '[{"id":"x","t":' + "[" * 600 + "]" * 600 + "}]",
    ]
    docs = [f'{{"a":1,"{key}":{a}}}' for a in arrays] + [
        f'{{"{key}":[{{"id":"x"}}],"{key}":[]}}', f'{{"{key}":[],"{key}":[{{"id":"z"}}]}}', f'{{"{key}":[{{"id":"x"}}]}} junk',
        f' {{"{key}" : [ {{"id":"x"}} ] }} \n', f"{{'{key}':[{{'id':'x'}}]}}", f'{{"a":01,"{key}":[{{"id":"x"}}]}}',
        f'[{{"{key}":[{{"id":"x"}}]}}]', f'{{"{key}":[{{"id":"x"}}],"u":Infinity}}', f'{{"q":{{"b":1,"b":2}},"{key}":[{{"id":"x"}}]}}',
        f'{{"{key}":[{{"id":"x"}}],"\\u006eative_tool_calls_raw":[{{"id":"w"}}]}}', f'{{"{key}":[{{"id":"x"}}]}},{{}}', "", None]
    whole = [None if c is None else [e["call_id"] for e in c["entries"]] for c in apply(spark, calls.provider_calls, docs)]
    plain = apply(spark, calls.plain_call_ids, docs)
    assert sum(p is not None for p in plain) >= 8 and [p for p in plain if p is not None] == [
        w for p, w in zip(plain, whole) if p is not None]
    log = spark.createDataFrame([(i, "llm_response", d) for i, d in enumerate(docs)], "i int, event_type string, payload string")
    got = {r.i: r.call_ids for r in toolcalls.with_call_ids(log).collect()}
    assert got == dict(enumerate(whole))


SPACE = st.sampled_from(["", " ", "\n\t", "  "])
LEAF = st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=6)
VALUE = st.recursive(LEAF, lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(max_size=4), v, max_size=3), max_leaves=8)


@settings(max_examples=300, deadline=None)
@given(st.lists(VALUE, min_size=1, max_size=4), st.dictionaries(st.text(max_size=5), VALUE, max_size=3), SPACE, SPACE, st.booleans())
def test_cutting_out_calls_keeps_their_text(entries, others, before, after, ascii_only):
    """On any JSON, the cut text is the text that was put in."""
    split, reader = calls._splitter()
    dump = lambda v: json.dumps(v, ensure_ascii=ascii_only)
    texts = [dump(x) for x in entries]
    raw = "[" + before + (after + "," + before).join(texts) + after + "]"
    others.pop("native_tool_calls_raw", None)
    members = [f"{before}{dump(k)}{after}:{before}{dump(v)}" for k, v in others.items()]
    members.append(f'"native_tool_calls_raw"{before}:{after}{raw}{before}')
    found = split("{" + ",".join(members) + after + "}" + before, reader())
    assert found["raw"] == raw and [e["entry"] for e in found["entries"]] == texts
    ids = [x.get("id") if isinstance(x, dict) and isinstance(x.get("id"), str) else None for x in entries]
    assert [e["call_id"] for e in found["entries"]] == ids


def test_error_text(spark):
    doc = lambda s: json.dumps({"response_body_excerpt": s}, ensure_ascii=False)
    fallback = "[LLM error] The request could not be completed."
    cases = [doc("gateway timeout"), doc(""), doc("y" * 200), doc("y" * 201), doc("é" * 100), doc("é" * 101),
             '{"v":1}', "{bad", "", None, '{"response_body_excerpt":7}']
    assert apply(spark, text.error_text, cases) == [
        "[LLM error] gateway timeout", fallback, "[LLM error] " + "y" * 200, fallback, "[LLM error] " + "é" * 100,
        fallback, fallback, fallback, fallback, fallback, fallback]


def test_metadata_gate(spark):
    cases = {' {"a": 1.50} ': '{"a": 1.50}', "[1]": "[1]", '"x"': '"x"', "7": "7", "": None, " \t": None, "null": None,
             '{"a":1}],[{"b":2}': None, '{"a":1},"x":2': None, '{"a":1}],["end"': None, '{"a":1}]],[["b"': None,
             "{}": None, "{bad": None, '{"a":1} x': None, '{"a":1},2': None, "a": None}
    assert apply(spark, text.metadata_or_null, [*cases, None]) == [*cases.values(), None]


def test_trimming_is_unicode(spark):
    assert apply(spark, text.trimmed, [" \t a b  \n", "　", "x"]) == ["a b", "", "x"]
    assert text.trim(" \t a b  \n") == "a b"
    assert text.search_term("  " + "ß" * 300) == "ß" * 300


def test_titles_match_literally(spark):
    titles = ["50% off", "50x off", "a_b", "aXb", "c\\d", "ÉTÉ", None, ""]
    def hit(term):
        return [t for t, ok in zip(titles, apply(spark, lambda c: text.title_contains(c, term), titles)) if ok]
    assert hit("50%") == ["50% off"] and hit("A_B") == ["a_b"] and hit("\\") == ["c\\d"] and hit("été") == ["ÉTÉ"]


def test_title_problems(spark):
    got = apply(spark, text.title_problem, ["ok", "", None, "é" * 200, "é" * 201])
    assert got == [None, "empty title", "empty title", None, "title too long"]


def test_tokens_round_trip(spark):
    for value, row_id in (("2025-01-01T00:00:00.000000Z", "s1"), ("", "s2"), ("7", "a|b"), ("é?>~", "ü")):
        made = tokens.encode_token("created_at", "desc", value, row_id)
        assert not set("+/=") & set(made)
        assert tokens.decode_token(made, "created_at", "desc") == (value, row_id)
        df = spark.createDataFrame([(value, row_id)], "v string, i string")
        assert df.select(tokens.page_token("created_at", "desc", F.col("v"), F.col("i"))).first()[0] == made
        got = df.select(tokens.decoded_token(F.lit(made), "created_at", "desc").alias("d")).first()["d"]
        assert (got["status"], got["value"], got["id"]) == ("ok", value, row_id)


def test_tokens_that_are_refused(spark):
    made = tokens.encode_token("cost_total", "asc", "1", "s")
    with pytest.raises(ValueError, match="order"):
        tokens.decode_token(made, "created_at", "desc")
    for bad in ("***", "YQ", tokens.encode_token("a", "b", "c", "d")[:8] + "!"):
        with pytest.raises(ValueError):
            tokens.decode_token(bad, "created_at", "desc")
    assert tokens.decode_token("", "created_at", "desc") is None
    got = apply(spark, lambda c: tokens.decoded_token(c, "created_at", "desc")["status"], [made, "***", "YQ"])
    assert got == ["mismatch", "malformed", "malformed"]
