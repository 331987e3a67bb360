"""Schemas of the six logical tables, and the check that a store carries them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _table(**columns: str) -> T.StructType:
    kinds = {
        "string": T.StringType(),
        "long": T.LongType(),
        "int": T.IntegerType(),
        "double": T.DoubleType(),
        "timestamp": T.TimestampType(),
    }
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in columns.items()])


TABLES: dict[str, T.StructType] = {
    "sessions": _table(
        id="string", summary="string", title="string", active_model="string",
        metadata="string", entity_id="string", group_id="string",
        created_at="timestamp", updated_at="timestamp",
        interaction_kind="string", system_source="string", opened_by="string",
    ),
    "messages": _table(
        session_id="string", seq="long", role="string", content="string",
        tool_calls="string", tool_call_id="string", metadata="string",
        visibility="string", created_at="timestamp",
    ),
    "session_events": _table(
        id="string", session_id="string", seq="long", ts="timestamp",
        event_type="string", parent_id="string", duration_ms="long",
        payload="string", created_at="timestamp",
    ),
    "prompt_snapshots": _table(
        sha256="string", kind="string", content="string", created_at="timestamp",
    ),
    "ai_debug_events": _table(
        id="string", session_id="string", trace_id="string", ts="timestamp",
        direction="string", status="int", url="string", body="string",
    ),
    "profile_usage": _table(
        id="string", entity_id="string", group_id="string",
        interaction_kind="string", price="double", created_at="timestamp",
    ),
}

SESSION_LABELS = ("interaction_kind", "system_source", "opened_by")


def text_schema(table: str) -> T.StructType:
    """The table's schema for a store that keeps its time stamps as text."""
    return T.StructType([
        T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.TimestampType) else f.dataType)
        for f in TABLES[table].fields
    ])


class MissingColumns(ValueError):
    """A store whose tables are older than the columns a report needs."""

    def __init__(self, table: str, columns: list[str]):
        super().__init__(f"{table} lacks {', '.join(columns)}")
        self.table = table
        self.columns = columns


def require_columns(df: DataFrame, table: str, columns: tuple[str, ...]) -> DataFrame:
    """Return df, or fail by name before any job runs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(table, missing)
    return df
