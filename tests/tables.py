"""Small logical tables from rows with defaults; times are RFC 3339 text."""

import json

from sessionlake.sources.reader import typed
from sessionlake.sources.schema import text_schema

DEFAULTS = {
    "sessions": dict(entity_id="", group_id="", interaction_kind="chat", metadata="{}",
                     created_at="2025-03-01T08:00:00Z", updated_at="2025-03-01T09:00:00Z"),
    "messages": dict(content="", created_at="2025-03-01T08:00:00Z"),
    "session_events": dict(ts="2025-03-01T08:00:00Z", payload='{"v":1}', created_at="2025-03-01T08:00:00Z"),
    "prompt_snapshots": dict(created_at="2025-03-01T08:00:00Z"),
    "ai_debug_events": dict(ts="2025-03-01T08:00:00Z", body=""),
    "profile_usage": dict(interaction_kind="chat", created_at="2025-03-01T08:00:00Z"),
}


def table(spark, name, rows):
    schema = text_schema(name)
    data = [tuple({**DEFAULTS[name], **row}.get(f.name) for f in schema.fields) for row in rows]
    return typed(spark.createDataFrame(data, schema), name)


def sessions(spark, *rows):
    return table(spark, "sessions", rows)


def events(spark, *rows):
    return table(spark, "session_events", rows)


def messages(spark, *rows):
    return table(spark, "messages", rows)


def response(**fields):
    return json.dumps(fields)


def by(df, *keys):
    """Rows by key, as dicts."""
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.asDict() for r in df.collect()}


def column(df, name):
    return [r[name] for r in df.collect()]
