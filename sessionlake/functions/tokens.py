"""Page tokens: base64url, without padding, of `sort|direction|value|id`."""

from __future__ import annotations

import base64
import binascii

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a token holds for a NULL sort value; no text of a value begins with NUL.
NULL_VALUE = "\0"

# A token of two fields is from before the sort was a choice: it means this.
DEFAULT_SORT = ("created_at", "desc")


def _encoded(*parts: Column) -> Column:
    raw = F.concat_ws("|", *parts)
    return F.rtrim(F.translate(F.base64(F.encode(raw, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def page_token(sort: str, direction: str, value: Column, row_id: Column) -> Column:
    return _encoded(F.lit(sort), F.lit(direction), F.coalesce(value, F.lit(NULL_VALUE)), row_id)


def event_token(ts_text: Column, row_id: Column) -> Column:
    """An event list has one order, so its token is `ts|id`."""
    return _encoded(F.coalesce(ts_text, F.lit(NULL_VALUE)), row_id)


def decoded_token(token: Column, sort: str, direction: str) -> Column:
    """struct<status, sort, direction, value, id>; status is ok, malformed, or
    mismatch when the token was cut under another order."""
    padded = F.rpad(token, (F.ceil(F.char_length(token) / 4) * 4).cast("int"), F.lit("="))
    plain = F.translate(padded, "-_", "+/")
    parts = F.split(F.try_to_binary(plain, F.lit("base64")).cast("string"), r"\|", 4)
    n = F.size(parts)
    legacy = n == 2
    got = lambda i: F.try_element_at(parts, F.lit(i))
    key = F.when(legacy, DEFAULT_SORT[0]).otherwise(got(1))
    way = F.when(legacy, DEFAULT_SORT[1]).otherwise(got(2))
    status = (
        F.when(~F.coalesce(n, F.lit(0)).isin(2, 4), "malformed")
        .when((key != sort) | (way != direction), "mismatch")
        .otherwise("ok")
    )
    bad = status == "malformed"
    keep = lambda c: F.when(~bad, c)
    return F.struct(
        status.alias("status"), keep(key).alias("sort"), keep(way).alias("direction"),
        keep(F.nullif(F.when(legacy, got(1)).otherwise(got(3)), F.lit(NULL_VALUE))).alias("value"),
        keep(F.when(legacy, got(2)).otherwise(got(4))).alias("id"),
    )


def encode_token(sort: str, direction: str, value: str | None, row_id: str) -> str:
    """The same token on the driver, for the one row a page ends with."""
    raw = "|".join((sort, direction, NULL_VALUE if value is None else value, row_id)).encode()
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def _fields(token: str, most: int) -> list[str]:
    try:
        raw = base64.b64decode(token + "=" * (-len(token) % 4), altchars=b"-_", validate=True).decode()
    except (binascii.Error, UnicodeDecodeError) as e:
        raise ValueError("page token: invalid encoding") from e
    return raw.split("|", most - 1)


def decode_token(token: str, sort: str, direction: str) -> tuple[str | None, str] | None:
    """(value, id) of a token, None for the first page; the value may be None."""
    if not token:
        return None
    parts = _fields(token, 4)
    if len(parts) == 2:
        parts = [*DEFAULT_SORT, *parts]
    if len(parts) != 4:
        raise ValueError("page token: malformed")
    if (parts[0], parts[1]) != (sort, direction):
        raise ValueError(f"page token: order {parts[0]}/{parts[1]} does not match {sort}/{direction}")
    return None if parts[2] == NULL_VALUE else parts[2], parts[3]


def decode_event_token(token: str) -> tuple[str | None, str] | None:
    """(ts, id) of an event list's token, None for the first page."""
    if not token:
        return None
    parts = _fields(token, 2)
    if len(parts) != 2:
        raise ValueError("page token: malformed")
    return None if parts[0] == NULL_VALUE else parts[0], parts[1]
