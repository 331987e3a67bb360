"""Which message ran which tool call, and which events a tool result has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake import vocabulary as V
from sessionlake.functions.calls import made_up, plain_call_ids, provider_calls, stored_call_ids, unread_call_ids
from sessionlake.functions.payload import json_fields
from sessionlake.operators.scope import visible


#: The column of a response's call ids.
CALL_IDS = "call_ids"
RESPONSE_COLUMNS = ("session_id", "seq", "id", "event_type", "parent_id")


def side_calls(events: DataFrame) -> DataFrame:
    """The events that open a side call: session_id, parent."""
    opens = F.col("event_type").endswith(V.SIDE_CALL_SUFFIX) | (F.col("event_type") == V.SUMMARIZATION)
    return events.where(opens).select("session_id", F.col("id").alias("parent"))


def main_loop_responses(events: DataFrame, openers: DataFrame | None = None) -> DataFrame:
    """Responses that belong to the conversation itself: not those nested under
    the event that opens a side call, one of `openers` or of the events themselves."""
    openers = (side_calls(events) if openers is None else openers).withColumnRenamed("parent", "_parent")
    # A response without a parent looks for its own id, which opens nothing, so
    # that such rows spread over the join's tasks.
    responses = events.where(F.col("event_type") == V.LLM_RESPONSE).withColumn(
        "_parent", F.coalesce(F.nullif("parent_id", F.lit("")), "id")
    )
    return responses.join(openers, ["session_id", "_parent"], "left_anti").select(*events.columns)


def call_entries(events: DataFrame) -> DataFrame:
    """One row per entry of a main-loop response's call array, as it is stored.
    `raw`, the whole array, is kept on its first entry only."""
    carrying = main_loop_responses(
        events.select("id", "session_id", "event_type", "parent_id", "payload")
    ).where(F.contains("payload", F.lit(V.NATIVE_TOOL_CALLS)))
    return (
        carrying.select("session_id", F.col("id").alias("response_id"), provider_calls(F.col("payload")).alias("c"))
        .select("session_id", "response_id", "c.raw", F.size("c.entries").alias("n_entries"), F.posexplode("c.entries"))
        .select(
            "session_id", "response_id", F.col("pos").alias("idx"), "n_entries",
            F.nullif("col.call_id", F.lit("")).alias("call_id"), "col.entry",
            F.when(F.col("pos") == 0, F.col("raw")).alias("raw"),
        )
    )


def message_calls(messages: DataFrame) -> DataFrame:
    """One row per call id an assistant message stores."""
    return (
        messages.where((F.col("role") == "assistant") & F.col("tool_calls").isNotNull())
        .select("session_id", "seq", stored_call_ids(F.col("tool_calls")).alias("ids"))
        .select("session_id", "seq", F.size("ids").alias("n_ids"), F.posexplode("ids").alias("ord", "call_id"))
    )


def with_call_ids(events: DataFrame) -> DataFrame:
    """Add the ids of a response's calls, in the order of its array and NULL for an entry without a
    text id; the column is NULL for an event that called nothing.

    Spark's own parser reads the ids. The few responses it cannot hold (repeated keys, numbers or
    arrays beyond what a variant takes) are read as `call_entries` does; no other payload
    goes to Python.
    """
    carries = F.contains("payload", F.lit(V.NATIVE_TOOL_CALLS)) & (F.col("event_type") == V.LLM_RESPONSE)
    plain = events.withColumn(CALL_IDS, F.when(carries, plain_call_ids(F.col("payload"))))
    unread = plain.withColumn("_unread", F.when(carries & F.col(CALL_IDS).isNull(), F.col("payload")))
    return unread.withColumn(CALL_IDS, F.coalesce(CALL_IDS, unread_call_ids(F.col("_unread")))).drop("_unread")


def call_ids(events: DataFrame) -> DataFrame:
    """One row per entry of a main-loop response's call array, without its text: session_id,
    response_seq, idx, n_entries, call_id. `events` may be a digest. No payload moves."""
    known = events
    if CALL_IDS not in events.columns:
        known = with_call_ids(events.where(F.col("event_type") == V.LLM_RESPONSE).select(*RESPONSE_COLUMNS, "payload"))
    known = known.where(F.col(CALL_IDS).isNotNull()).select(*RESPONSE_COLUMNS, CALL_IDS)
    return main_loop_responses(known, side_calls(events)).select(
        "session_id", F.col("seq").alias("response_seq"), F.size(CALL_IDS).alias("n_entries"),
        F.posexplode(CALL_IDS).alias("idx", "call_id"))


def _only(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose (session_id, call_id) occurs once; the columns are numbers. The count combines
    on the map side, so an id that a large part of the rows reuse costs nothing."""
    return (
        df.groupBy("session_id", "call_id")
        .agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(c) for c in columns])
        .where(F.col("_n") == 1).drop("_n")
    )


def attribution(messages: DataFrame, events: DataFrame, include_hidden: bool = False) -> DataFrame:
    """Which entry of which response serves which call of a message, without any text.

    A message is served when every id it stores names exactly one entry and is
    stored by no other message. One row per message and response that serves it: session_id,
    seq, n_ids, response_seq, part and n_parts (its place among the message's responses), places
    (of the response's entries, in the order of the message's ids), is_whole (the
    message stores all entries of one response in order).
    """
    entries = _only(call_ids(events).where(F.nullif("call_id", F.lit("")).isNotNull()), "response_seq", "idx", "n_entries")
    rows = _only(message_calls(visible(messages, include_hidden)), "seq", "ord", "n_ids")
    placed = rows.where(~made_up(F.col("call_id"))).join(entries, ["session_id", "call_id"])
    # the ids of one stored message, which are neighbours in its order where a response is the same
    refs = F.array_sort(F.collect_list(F.struct("ord", "response_seq", "idx")))
    per_message = (
        placed.groupBy("session_id", "seq")
        .agg(F.min("n_ids").alias("n_ids"), F.count(F.lit(1)).alias("_found"), F.min("n_entries").alias("n_entries"),
             F.bool_and(F.col("idx") == F.col("ord")).alias("_in_order"), refs.alias("refs"))
        .where(F.col("_found") == F.col("n_ids"))
    )
    def starts(r, i):  # a part begins where the response changes
        return (i == 0) | (F.get(F.col("refs"), i - 1)["response_seq"] != r["response_seq"])

    begins = F.filter(F.transform("refs", lambda r, i: F.when(starts(r, i), i)), lambda i: i.isNotNull())
    parts = per_message.withColumn("begins", begins).select(
        "*", F.size("begins").alias("n_parts"), F.posexplode("begins").alias("part", "begin"))
    upto = F.coalesce(F.get("begins", F.col("part") + 1), F.size("refs"))
    own = F.slice("refs", F.col("begin") + 1, upto - F.col("begin"))
    return parts.select(
        "session_id", "seq", "n_ids", F.get("refs", F.col("begin"))["response_seq"].alias("response_seq"), "part", "n_parts",
        F.transform(own, lambda r: r["idx"]).alias("places"),
        ((F.col("n_parts") == 1) & F.col("_in_order") & (F.col("n_ids") == F.col("n_entries"))).alias("is_whole"))


def tool_call_sources(messages: DataFrame, events: DataFrame, include_hidden: bool = False) -> DataFrame:
    """Each served message with the responses that serve it (see `attribution`), without their text:
    session_id, seq, n_ids, response_ids, is_whole."""
    served = attribution(messages, events, include_hidden)
    named = events.where(F.col("event_type") == V.LLM_RESPONSE).select(
        "session_id", F.col("seq").alias("response_seq"), F.col("id").alias("response_id"))
    return served.join(named, ["session_id", "response_seq"]).groupBy("session_id", "seq").agg(
        F.min("n_ids").alias("n_ids"), F.bool_and("is_whole").alias("is_whole"),
        F.array_sort(F.collect_list(F.struct("part", "response_id"))).alias("parts")).select(
        "session_id", "seq", "n_ids", F.array_distinct("parts.response_id").alias("response_ids"), "is_whole")


def attribute_tool_calls(
    messages: DataFrame, events: DataFrame, include_hidden: bool = False, digest: DataFrame | None = None,
) -> DataFrame:
    """The tool calls of each assistant message, in the provider's own text.

    A served message (see `attribution`) gets the response's array unchanged when it
    holds all of it in order, else its own entries. Only then are payloads read for their text, those
    of responses that serve a message, and cut. `digest` spares the read before. Returns
    session_id, seq, n_ids, response_ids, is_whole, tool_calls.
    """
    served = attribution(messages, events if digest is None else digest, include_hidden)
    # a response's entries are each stored by one message at most, so this is no larger than the array
    asked = served.groupBy("session_id", "response_seq").agg(
        F.collect_list(F.struct("seq", "n_ids", "part", "places", "is_whole")).alias("asked"))
    texts = events.where(F.contains("payload", F.lit(V.NATIVE_TOOL_CALLS)) & (F.col("event_type") == V.LLM_RESPONSE)).select(
        "session_id", F.col("seq").alias("response_seq"), F.col("id").alias("response_id"), "payload")
    cut = texts.join(asked, ["session_id", "response_seq"]).select(
        "session_id", "response_id", "asked", provider_calls(F.col("payload")).alias("c"))
    parts = cut.select("session_id", "response_id", "c", F.explode("asked").alias("a")).select(
        "session_id", "a.seq", "a.n_ids", "a.part", "a.is_whole", "response_id",
        F.when(F.col("a.is_whole"), F.col("c.raw")).otherwise(
            F.array_join(F.transform("a.places", lambda i: F.get(F.col("c.entries"), i)["entry"]), ",")).alias("text"))
    together = parts.groupBy("session_id", "seq").agg(
        F.min("n_ids").alias("n_ids"), F.bool_and("is_whole").alias("is_whole"),
        F.array_sort(F.collect_list(F.struct("part", "response_id", "text"))).alias("parts"))
    own = F.concat(F.lit("["), F.array_join(F.col("parts.text"), ","), F.lit("]"))
    return together.select(
        "session_id", "seq", "n_ids", F.array_distinct("parts.response_id").alias("response_ids"), "is_whole",
        F.when(F.col("is_whole"), F.col("parts")[0]["text"]).otherwise(own).alias("tool_calls"))


def call_events(events: DataFrame) -> DataFrame:
    """One row per event that reports a tool call: session_id, call_id, event_seq,
    event_id, event_type, status. Events without a call id are left out."""
    of_calls = F.col("event_type").isin(V.TOOL_CALL_EXTRACTED, V.TOOL_CALL_RESULT)
    return (
        events.where(of_calls)
        .select("session_id", "seq", "id", "event_type", json_fields(F.col("payload"), "call_id", "status").alias("p"))
        .select("session_id", F.nullif("p.call_id", F.lit("")).alias("call_id"), F.col("seq").alias("event_seq"),
                F.col("id").alias("event_id"), "event_type", F.col("p.status").alias("status"))
        .where(F.col("call_id").isNotNull())
    )


def _results(messages: DataFrame) -> DataFrame:
    return messages.where(F.coalesce("tool_call_id", F.lit("")) != "").select(
        "session_id", F.col("seq").alias("message_seq"), F.col("tool_call_id").alias("call_id"))


def tool_result_events(messages: DataFrame, events: DataFrame) -> DataFrame:
    """Every tool result with every event that carries its call id, one row each.

    An id that is reused meets all its events in each of its results; use
    `tool_results_with_events` where one row per result is enough.
    """
    return _results(messages).join(call_events(events), ["session_id", "call_id"])


def tool_results_with_events(messages: DataFrame, events: DataFrame) -> DataFrame:
    """Each tool result with the first events that carry its call id, and how many do.

    The events of an id are reduced to one row first, so an id that is reused
    widens no result: it shows in the counts, and `tool_result_events` lists all.
    """
    is_result = F.col("event_type") == V.TOOL_CALL_RESULT
    place = F.struct("event_seq", "event_id", "status")
    per_call = call_events(events).groupBy("session_id", "call_id").agg(
        F.count_if(~is_result).alias("n_extracted"), F.count_if(is_result).alias("n_results"),
        F.min(F.when(~is_result, place)).alias("_extracted"), F.min(F.when(is_result, place)).alias("_result"),
    )
    return _results(messages).join(per_call, ["session_id", "call_id"]).select(
        "session_id", "message_seq", "call_id", "n_extracted", "n_results",
        F.col("_extracted.event_id").alias("extracted_id"), F.col("_result.event_id").alias("result_id"),
        F.col("_result.status").alias("result_status"),
    )
