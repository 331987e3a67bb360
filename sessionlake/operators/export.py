"""Result rows as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# There only when set. Everything else is always there: labels also when empty,
# a price also when null, so that null and absent stay apart.
OPTIONAL = ("entity_id", "group_id", "title", "summary", "active_model", "metadata",
            "tool_calls", "tool_call_id", "visibility", "parent_id", "duration_ms", "payload")


def _is_empty(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.MapType, T.ArrayType)):
        return F.size(c) == 0
    if isinstance(kind, T.StringType):
        return c == ""
    if isinstance(kind, T.NumericType):
        return c == 0
    return F.lit(False)


def _member(name: str, kind: T.DataType, optional: bool) -> Column:
    """`"name":value`, or NULL when the member is left out."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        value = F.to_json(c)
    else:
        # the value part of {"v":...}
        whole = F.to_json(F.struct(c.alias("v")))
        value = F.when(c.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))
    text = F.concat(F.lit(f'"{name}":'), value)
    if optional:
        return F.when(~F.coalesce(_is_empty(c, kind), F.lit(True)), text)
    return F.coalesce(text, F.lit(f'"{name}":null'))


def json_lines(df: DataFrame, optional: tuple[str, ...] = OPTIONAL) -> DataFrame:
    """One JSON text per row, members in column order. An optional member is
    left out when it is empty, 0 or NULL; any other is written, null included."""
    members = [_member(f.name, f.dataType, f.name in optional) for f in df.schema.fields]
    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}")).alias("json"))


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    json_lines(df).write.mode(mode).text(path)
