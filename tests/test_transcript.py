"""Transcripts and tool calls, by scenario and against brute force."""

import json
import random

import pytest

from sessionlake.functions.times import instant
from sessionlake.operators import toolcalls, transcript
from sessionlake.operators.digest import digested
from sessionlake.plans import reports
from tests.tables import by, events, messages, sessions


def told(df):
    return [(r["role"], r["content"], r["seq"]) for r in df.orderBy("session_id", "pos").collect()]


def failed(excerpt):
    return json.dumps({"v": 1, "response_body_excerpt": excerpt})


def test_errors_stand_where_they_happened(spark):
    m = messages(
        spark,
        dict(session_id="s", seq=1, role="user", content="one", created_at="2025-05-01T10:00:00Z"),
        dict(session_id="s", seq=2, role="assistant", content="two", created_at="2025-05-01T10:00:05Z"),
        dict(session_id="s", seq=3, role="user", content="three", created_at="2025-05-01T10:01:00Z"),
    )
    e = events(
        spark,
        # the same second as the second message, but later within it
        dict(id="e1", session_id="s", seq=4, ts="2025-05-01T10:00:05.000250Z", event_type="llm_error", payload=failed("slow")),
        dict(id="e2", session_id="s", seq=6, ts="2025-05-01T10:02:00Z", event_type="llm_error", payload="{}"),
        dict(id="e3", session_id="s", seq=7, ts="not a time", event_type="llm_error", payload=failed("lost")),
        dict(id="e4", session_id="s", seq=2, ts="2025-05-01T10:00:00Z", event_type="llm_response"),
    )
    assert told(transcript.transcript(m, e)) == [
        ("user", "one", 1), ("assistant", "two", 2), ("error", "[LLM error] slow", 0), ("user", "three", 3),
        ("error", "[LLM error] The request could not be completed.", 0)]
    clean = transcript.transcript(m, e.where("event_type = 'llm_response'"))
    assert [r for r, _, _ in told(clean)] == ["user", "assistant", "user"]


def spliced(msgs, errs):
    """What a reader would do by hand: walk both lists once."""
    out, left = [], [x for x in errs if x[1] is not None]
    for name, at in msgs:
        while at is not None and left and left[0][1] < at:
            out.append(left.pop(0)[0])
        out.append(name)
    return out + [name for name, _ in left]


@pytest.mark.parametrize("ranges", [1, 6])
def test_transcripts_match_a_walk(spark, ranges):
    rng = random.Random(17)
    stamp = lambda t: "broken" if t is None else f"2025-05-01T10:00:{t:02d}Z"
    when = lambda: rng.choice([None, *range(12)])
    want, m, e = {}, [], []
    for n in range(60):
        size = 120 if n == 0 else rng.randrange(6)  # one session holds a large part of all rows
        msgs = [(f"m{i}", when()) for i in range(size)]
        errs = [(f"x{i}", when()) for i in range(size // 2 + rng.randrange(3))]
        m += [dict(session_id=f"s{n}", seq=i + 1, role="user", content=name, created_at=stamp(at)) for i, (name, at) in enumerate(msgs)]
        e += [dict(id=f"s{n}-{i}", session_id=f"s{n}", seq=3 * i + 2, event_type="llm_error", ts=stamp(at), payload=failed(name))
              for i, (name, at) in enumerate(errs)]
        if msgs or any(at is not None for _, at in errs):
            want[f"s{n}"] = spliced(msgs, errs)
    rng.shuffle(m)
    rng.shuffle(e)
    got = {}
    for r in transcript.transcript(messages(spark, *m), events(spark, *e), ranges=ranges).orderBy("session_id", "pos").collect():
        got.setdefault(r["session_id"], []).append(r["content"].removeprefix("[LLM error] "))
        assert r["pos"] == len(got[r["session_id"]])
    assert got == want


def test_hidden_rows_and_metadata(spark):
    m = messages(
        spark,
        dict(session_id="s", seq=1, role="user", visibility="hidden", content="injected"),
        dict(session_id="s", seq=2, role="user", metadata=' {"prompt_type": "confirm"} ', visibility="shown"),
        dict(session_id="s", seq=3, role="tool", metadata="{bad", tool_call_id="k1"),
    )
    e = events(spark, dict(id="e", session_id="s", seq=1, event_type="retry"))
    shown = by(transcript.transcript(m, e), "seq")
    assert sorted(shown) == [2, 3] and shown[2]["metadata"] == '{"prompt_type": "confirm"}'
    assert shown[3]["metadata"] is None and shown[3]["tool_call_id"] == "k1"
    everything = by(transcript.transcript(m, e, include_hidden=True), "seq")
    assert sorted(everything) == [1, 2, 3] and everything[1]["visibility"] == "hidden"


# --- tool calls --------------------------------------------------------------

def entry(call_id, **more):
    return json.dumps({"id": call_id, "type": "function", **more})


def calling(*entries, sep=","):
    return '{"v":1,"native_tool_calls_raw":[' + sep.join(entries) + "]}"


def stored(*ids):
    return json.dumps([{"id": i, "name": "tool__run", "arguments": {}} for i in ids])


def served(spark, msgs, evts, **options):
    """{seq: tool_calls} of one session. msgs: (stored ids or text, ...) from
    seq 1; evts: (id, type, parent, payload) in order."""
    m = messages(spark, *[
        dict(session_id="s", seq=i + 1, role=x.get("role", "assistant"), tool_calls=x.get("calls"),
             visibility=x.get("visibility")) for i, x in enumerate(msgs)])
    e = events(spark, *[
        dict(id=i, session_id="s", seq=n + 1, event_type=t, parent_id=p, payload=doc or '{"v":1}')
        for n, (i, t, p, doc) in enumerate(evts)])
    return {r["seq"]: r["tool_calls"] for r in toolcalls.attribute_tool_calls(m, e, **options).collect()}


PLAIN = dict(calls=None)


def row(*ids, **more):
    return dict(calls=stored(*ids), **more)


SCENARIOS = {
    "the row that ran the call gets it, the question before it does not": (
        [PLAIN, row("del")], [("r1", "llm_response", "t", calling(entry("del"))), ("r2", "llm_response", "r1", '{"v":1}')],
        {2: "[" + entry("del") + "]"}),
    "a rejected call has no row, the next round keeps its own": (
        [PLAIN, row("list")],
        [("r1", "llm_response", None, calling(entry("del"))), ("r2", "llm_response", None, calling(entry("list")))],
        {2: "[" + entry("list") + "]"}),
    "one row per call of a response: each its own entry": (
        [row("a"), row("b")], [("r1", "llm_response", None, calling(entry("a"), entry("b")))],
        {1: "[" + entry("a") + "]", 2: "[" + entry("b") + "]"}),
    "a row with all entries in order gets the array as it was sent": (
        [row("a", "b")], [("r1", "llm_response", None, calling(entry("a"), '{"id": "b", "n":2.50}', sep=" ,  "))],
        {1: "[" + entry("a") + ' ,  {"id": "b", "n":2.50}' + "]"}),
    "all entries in another order are put together anew": (
        [row("b", "a")], [("r1", "llm_response", None, calling(entry("a"), '{"id": "b", "n":2.50}', sep=" ,  "))],
        {1: '[{"id": "b", "n":2.50},' + entry("a") + "]"}),
    "entries of two responses": (
        [row("a", "b")], [("r1", "llm_response", None, calling(entry("a"))), ("r2", "llm_response", None, calling(entry("b")))],
        {1: "[" + entry("a") + "," + entry("b") + "]"}),
    "an entry without an id keeps a row from holding all": (
        [row("a")], [("r1", "llm_response", None, calling(entry("a"), '{"type":"x"}'))], {1: "[" + entry("a") + "]"}),
    "rows gone from the front": (
        [row("list")], [("r0", "llm_response", None, calling(entry("old"))), ("r1", "llm_response", None, calling(entry("list")))],
        {1: "[" + entry("list") + "]"}),
    "an id used in two responses serves no row": (
        [row("k"), row("k")], [("r1", "llm_response", None, calling(entry("k"))), ("r2", "llm_response", None, calling(entry("k")))], {}),
    "an id in two rows with one entry left serves none": (
        [row("k"), row("k")], [("r1", "llm_response", None, calling(entry("k")))], {}),
    "an id twice in one row serves none": ([row("k", "k")], [("r1", "llm_response", None, calling(entry("k")))], {}),
    "one reused id does not hurt another": (
        [row("k0"), row("k1")],
        [("r1", "llm_response", None, calling(entry("k0"))), ("r2", "llm_response", None, calling(entry("k0"), entry("k1")))],
        {2: "[" + entry("k1") + "]"}),
    "every id of a row must resolve": ([row("a", "gone")], [("r1", "llm_response", None, calling(entry("a")))], {}),
    "made-up ids name no entry": (
        [row("call-1"), row("planner-x-y"), row("pipeline-x-y")],
        [("r1", "llm_response", None, calling(entry("call-1"), entry("planner-x-y"), entry("pipeline-x-y")))], {}),
    "a repair's response is not the conversation's": (
        [row("k")],
        [("r1", "llm_response", None, calling(entry("k"))), ("q", "tool_call_repair_invoked", None, None),
         ("r2", "llm_response", "q", calling(entry("k", note="repaired")))], {1: "[" + entry("k") + "]"}),
    "nor is a summary's": (
        [row("k")],
        [("q", "summarization_triggered", None, None), ("r2", "llm_response", "q", calling(entry("k", note="again"))),
         ("r1", "llm_response", "", calling(entry("k")))], {1: "[" + entry("k") + "]"}),
    "a parent that opens no side call does not matter": (
        [row("k")], [("q", "turn_start", None, None), ("r1", "llm_response", "q", calling(entry("k")))], {1: "[" + entry("k") + "]"}),
    "rows of other roles are not read": (
        [row("k", role="user"), row("k")], [("r1", "llm_response", None, calling(entry("k")))], {2: "[" + entry("k") + "]"}),
    "a hidden row is not counted": (
        [row("k", visibility="hidden"), row("k")], [("r1", "llm_response", None, calling(entry("k")))],
        {2: "[" + entry("k") + "]"}),
    "broken payloads and broken rows are left out": (
        [dict(calls="[{"), row("k")],
        [("r1", "llm_response", None, '{"native_tool_calls_raw":[{"id":"k"}'), ("r2", "llm_response", None, calling(entry("k")))],
        {2: "[" + entry("k") + "]"}),
}


@pytest.mark.parametrize("name", SCENARIOS)
def test_tool_calls(spark, name):
    msgs, evts, want = SCENARIOS[name]
    assert served(spark, msgs, evts) == want


def test_a_hidden_row_counts_when_it_is_shown(spark):
    msgs = [row("k", visibility="hidden"), row("k")]
    assert served(spark, msgs, [("r1", "llm_response", None, calling(entry("k")))], include_hidden=True) == {}


def test_sessions_do_not_share_ids(spark):
    m = messages(spark, *[dict(session_id=s, seq=1, role="assistant", tool_calls=stored("k")) for s in "ab"])
    e = events(spark, *[dict(id=f"r{s}", session_id=s, seq=1, event_type="llm_response", payload=calling(entry("k", of=s)))
                        for s in "ab"])
    got = by(toolcalls.attribute_tool_calls(m, e), "session_id")
    assert {s: json.loads(r["tool_calls"])[0]["of"] for s, r in got.items()} == {"a": "a", "b": "b"}


def test_a_reused_id_does_not_multiply_results(spark):
    m = messages(spark, *[dict(session_id="s", seq=i, role="tool", tool_call_id="k") for i in range(1, 51)])
    e = events(spark, *[dict(id=f"x{i:02d}", session_id="s", seq=i, payload='{"call_id":"k","status":"ok"}',
                             event_type="tool_call_extracted" if i % 2 else "tool_call_result") for i in range(1, 61)])
    rows = toolcalls.tool_results_with_events(m, e).collect()
    assert len(rows) == 50
    assert {(r["n_extracted"], r["n_results"], r["extracted_id"], r["result_id"], r["result_status"]) for r in rows} == {
        (30, 30, "x01", "x02", "ok")}
    every = toolcalls.tool_result_events(m, e)
    assert every.count() == 50 * 60
    assert sorted(r["event_id"] for r in every.where("message_seq = 7").collect()) == [f"x{i:02d}" for i in range(1, 61)]


def test_an_error_keeps_its_whole_excerpt(spark):
    e = events(spark, dict(id="x", session_id="s", seq=1, event_type="llm_error", payload=failed("y" * 900)))
    row = transcript.error_rows(e).first()
    assert row["excerpt"] == "y" * 900 and row["content"] == "[LLM error] The request could not be completed."


def test_the_detail_report(spark):
    s = sessions(spark, dict(id="s", title="T", metadata='{"lang":"fr"}'), dict(id="t", metadata="{bad"))
    m = messages(spark, dict(session_id="s", seq=1, role="user", content="hi", created_at="2025-01-01T00:00:00Z"),
                 dict(session_id="s", seq=2, role="assistant", tool_calls=stored("k"), created_at="2025-01-01T00:00:01Z"))
    e = events(spark, dict(id="r", session_id="s", seq=1, event_type="llm_response", payload=calling(entry("k"))),
               dict(id="x", session_id="s", seq=2, event_type="llm_error", ts="2025-01-01T00:00:02Z", payload=failed("oops")))
    detail = reports.session_detail(s, m, e)
    head = by(detail.sessions, "id")
    assert head["s"]["metadata"] == {"lang": "fr"} and head["t"]["metadata"] == {}
    assert head["s"]["llm_call_count"] == 1 and head["t"]["cost_by_currency"] == {}
    assert [(r["pos"], r["role"], r["tool_calls"]) for r in detail.messages.orderBy("pos").collect()] == [
        (1, "user", None), (2, "assistant", "[" + entry("k") + "]"), (3, "error", None)]
    assert detail.lines().count() == 2 + 3 + 2
    assert instant("2025-01-01T00:00:02Z").year == 2025


def stored_log(spark, tmp_path):
    """A log in files: one reused id, one served response in three."""
    e = events(spark, *[
        dict(id=f"r{i}", session_id=f"s{i % 7}", seq=i, event_type="llm_response" if i % 5 else "llm_error",
             ts=f"2025-01-01T00:{i % 60:02d}:00Z",
             payload=calling(entry(f"k{i}" if i % 3 else "again"), entry(f"l{i}"))[:-1] + ',"tokens_in":3,"cost_input":0.5}'
             if i % 5 else failed(f"e{i}")) for i in range(1, 90)])
    m = messages(spark, *[
        dict(session_id=f"s{i % 7}", seq=i, role="assistant", created_at=f"2025-01-01T00:{i % 60:02d}:00Z",
             tool_calls=stored(f"l{i}", f"k{i}") if i % 2 else stored(f"k{i}")) for i in range(1, 90)])
    for name, df in (("e", e), ("m", m)):
        df.write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / "m")), spark.read.parquet(str(tmp_path / "e"))


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_only_text_that_serves_a_message_is_cut(spark, tmp_path):
    m, e = stored_log(spark, tmp_path)
    sources = plan(toolcalls.tool_call_sources(m, e))
    assert "SortAggregate" not in sources and sources.count("payload:string") == 1  # the ids
    lines = plan(toolcalls.attribute_tool_calls(m, e)).splitlines()
    cut = next(i for i, x in enumerate(lines) if "ArrowEvalPython" in x)
    assert any("Join" in x and "response_seq" in x for x in lines[cut:])  # the served ones are chosen below it
    assert sum("payload:string" in x for x in lines) == 2
    want = {r["seq"]: r["tool_calls"] for r in toolcalls.attribute_tool_calls(m, e).collect()}
    assert want and all(json.loads(t) for t in want.values())
    assert {r["seq"] for r in toolcalls.tool_call_sources(m, e).collect()} == want.keys()


def test_a_digest_stands_for_the_log(spark, tmp_path):
    m, e = stored_log(spark, tmp_path)
    s = sessions(spark, *[dict(id=f"s{i}", title="T") for i in range(8)])
    one, each = reports.session_detail(s, m, e), reports.session_detail(s, m, e, keep=False)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    for part in ("sessions", "messages", "events"):
        assert rows(getattr(one, part)) == rows(getattr(each, part))
    # one read of payloads made the digest; one more cuts the text of calls
    assert plan(one.sessions).count("payload:string") == 0 and plan(one.messages).count("payload:string") == 1
    assert plan(each.sessions).count("payload:string") == 1 and plan(each.messages).count("payload:string") > 2
    assert not {"payload"} & set(digested(e).columns)
