"""Tool-call ids, as a message stores them and as a provider sends them."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionlake import vocabulary as V
from sessionlake.functions.text import trimmed, whole_json

# JSON as the provider's reader takes it, of any length and depth
STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false",
               "maxNestingDepth": "100000", "maxNumLen": "1000000000", "maxStringLen": "2147483647"}


def made_up(call_id: Column) -> Column:
    """Whether the agent made the id up; such an id names no provider entry."""
    prefixed = F.lit(False)
    for prefix in V.MADE_UP_PREFIXES:
        prefixed = prefixed | call_id.startswith(prefix)
    return prefixed | call_id.rlike(V.MADE_UP_PATTERN)


def stored_call_ids(tool_calls: Column) -> Column:
    """Ids of a message's stored calls, in order. NULL unless the value is an
    array of objects that all carry a text id."""
    text = trimmed(tool_calls)
    array = text.startswith("[") & text.endswith("]")
    # a variant keeps the type of the id apart from its text
    def own_id(call: Column) -> Column:
        return F.when(F.schema_of_variant(call["id"]) == "STRING", F.try_variant_get(call["id"], "$", "string"))

    stored = F.when(array, whole_json(
        text, "array<struct<id:variant>>", lambda own: F.concat(F.lit('[{"id":"'), own, F.lit('"}]')),
        lambda v: own_id(F.get(v, F.lit(0)))))
    ids = F.transform(stored, own_id)

    def all_or_none(found: Column) -> Column:
        good = (F.size(found) > 0) & F.forall(found, lambda i: F.coalesce(i != "", F.lit(False)))
        return F.when(good, found)

    # through an array of one, so that the JSON is parsed once
    return F.transform(F.array(ids), all_or_none)[0]


def _splitter() -> tuple[Callable, Callable]:
    """The helpers of `provider_calls`, self-contained so that they ship by value."""
    field = V.NATIVE_TOOL_CALLS
    blank = " \t\n\r"

    def refuse(name: str):
        raise ValueError(name)

    def reader() -> Callable[[str, int], tuple]:
        # numbers are not needed, only where they end
        return json.JSONDecoder(parse_constant=refuse, parse_int=len, parse_float=len).raw_decode

    def past_blanks(text: str, at: int) -> int:
        while at < len(text) and text[at] in blank:
            at += 1
        return at

    def members(text: str, opening: str, closing: str, read: Callable):
        """(key, value, raw text of the value) of each member of a JSON value."""
        at = past_blanks(text, 0)
        if text[at] != opening:
            raise ValueError(opening)
        at = past_blanks(text, at + 1)
        more = text[at] != closing
        while more:
            key = None
            if opening == "{":
                key, at = read(text, at)
                if not isinstance(key, str):
                    raise ValueError("key")
                at = past_blanks(text, at)
                if text[at] != ":":
                    raise ValueError(":")
                at = past_blanks(text, at + 1)
            value, end = read(text, at)
            yield key, value, text[at:end]
            at = past_blanks(text, end)
            more = text[at] == ","
            if more:
                at = past_blanks(text, at + 1)
        if text[at] != closing or past_blanks(text, at + 1) != len(text):
            raise ValueError(closing)

    def split(payload: str | None, read: Callable) -> dict | None:
        try:
            raw = None
            for key, value, part in members(payload or "", "{", "}", read):
                if key == field:
                    raw = part if isinstance(value, list) and value else None
            if raw is None:
                return None
            entries = [
                {
                    "call_id": value["id"] if isinstance(value, dict) and isinstance(value.get("id"), str) else None,
                    "entry": part,
                }
                for _, value, part in members(raw, "[", "]", read)
            ]
        except (ValueError, IndexError, RecursionError):
            return None
        return {"raw": raw, "entries": entries}

    return split, reader


def plain_call_ids(payload: Column) -> Column:
    """The ids of a response's call array, NULL for an entry without a text id, by Spark's
    own JSON parser. NULL also where that cannot hold the array: see `provider_call_ids`."""
    field = V.NATIVE_TOOL_CALLS

    def calls_of(response: Column) -> Column:
        return F.try_variant_get(response[field], "$", "array<variant>")

    def own_id(entry: Column) -> Column:
        is_text = F.schema_of_variant(F.try_variant_get(entry, "$.id", "variant")) == "STRING"
        return F.when(is_text, F.try_variant_get(entry, "$.id", "string"))

    response = whole_json(
        payload, f"struct<`{field}`: variant>", lambda own: F.concat(F.lit(f'{{"{field}":["'), own, F.lit('"]}')),
        lambda v: F.try_variant_get(v[field], "$[0]", "string"), STRICT_JSON)
    ids = F.transform(calls_of(response), own_id)
    return F.transform(F.array(ids), lambda found: F.when(F.size(found) > 0, found))[0]


def unread_call_ids(payload: Column) -> Column:
    """The same ids through `provider_calls`, for the responses `plain_call_ids` did not read."""
    return F.transform(provider_calls(payload)["entries"], lambda e: e["call_id"])


def provider_calls(payload: Column) -> Column:
    """The provider's call array of a response payload as it is stored.

    struct<raw, entries: array<struct<call_id, entry>>>, NULL when the response
    called nothing. Spark's own JSON functions write the numbers and
    the white space anew, so the raw text is cut out in Python, batch by batch;
    callers filter to the responses that carry calls before this runs.
    """
    split, reader = _splitter()
    entry = pa.struct([("call_id", pa.string()), ("entry", pa.string())])
    calls = pa.struct([("raw", pa.string()), ("entries", pa.list_(entry))])

    def cut(payloads: pa.Array) -> pa.Array:
        read = reader()
        return pa.array([split(p, read) for p in payloads.to_pylist()], calls)

    kind = "raw string, entries array<struct<call_id: string, entry: string>>"
    # declared so that no filter or projection is given a second evaluation
    return F.arrow_udf(cut, kind).asNondeterministic()(payload)
