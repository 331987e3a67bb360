"""Typed fields of an llm_response payload, from one JSON parse per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake import vocabulary as V

MONEY = "decimal(28,12)"

_COUNTERS = (V.TOKENS_IN, V.TOKENS_OUT, V.CACHE_WRITE_TOKENS, V.CACHE_READ_TOKENS)
_FIELDS = (*_COUNTERS, V.COST_INPUT, V.COST_OUTPUT, V.COST_CURRENCY, V.PRICE)


def json_fields(payload: Column, *names: str) -> Column:
    """The named top-level fields as text; NULL fields when it is no object."""
    return F.from_json(payload, ", ".join(f"`{n}` string" for n in names))


def text_or_null(field: Column) -> Column:
    """JSON text; NULL when absent or empty."""
    return F.nullif(field, F.lit(""))


def int_or_zero(field: Column) -> Column:
    """JSON integer; a fraction is cut, anything else counts 0."""
    whole = field.try_cast("bigint")
    return F.coalesce(whole, field.try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def double_or_null(field: Column) -> Column:
    """JSON number; NULL when absent, empty or not a number."""
    return text_or_null(field).try_cast("double")


def double_or_zero(field: Column) -> Column:
    return F.coalesce(double_or_null(field), F.lit(0.0))


def money(amount: Column) -> Column:
    """An addend as a decimal, so that a sum does not depend on row order."""
    return amount.try_cast(MONEY)


def is_llm(event_type: Column) -> Column:
    return event_type == V.LLM_RESPONSE


def with_payload(events: DataFrame) -> DataFrame:
    """Add the typed fields. Other event types are not parsed; their counters
    and costs are 0, their price and currency NULL. A digest has them already."""
    if set(_FIELDS) <= set(events.columns):
        return events
    llm = is_llm(F.col("event_type"))
    # parse only where needed, and only once for all the fields
    parsed = events.withColumn("_p", F.when(llm, json_fields(F.col("payload"), *_FIELDS)))
    p = lambda name: F.col(f"_p.{name}")
    zero = F.lit(0).cast(MONEY)
    return parsed.withColumns({
        **{name: int_or_zero(p(name)) for name in _COUNTERS},
        V.COST_INPUT: F.coalesce(money(double_or_null(p(V.COST_INPUT))), zero),
        V.COST_OUTPUT: F.coalesce(money(double_or_null(p(V.COST_OUTPUT))), zero),
        V.PRICE: money(double_or_null(p(V.PRICE))),
        V.COST_CURRENCY: F.when(llm, F.coalesce(text_or_null(p(V.COST_CURRENCY)), F.lit(V.NO_CURRENCY))),
    }).drop("_p")


def metadata_map(metadata: Column) -> Column:
    """A session's metadata object as a string map; empty when it is none."""
    kind = "map<string,string>"
    return F.coalesce(F.from_json(metadata, kind), F.create_map().cast(kind))


def json_array_has(array: Column, value: str) -> Column:
    """Whether a JSON array column contains the text value."""
    return F.coalesce(F.array_contains(F.from_json(array, "array<string>"), value), F.lit(False))
