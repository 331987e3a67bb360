"""Which sessions and which events a report covers: one definition for all."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.text import search_term, title_contains, trim, trimmed
from sessionlake.functions.times import instant, instant_literal
from sessionlake.vocabulary import MAX_ENTITY_IDS


def id_list(ids: str | Iterable[str], name: str) -> tuple[str, ...]:
    """Trimmed ids without blanks, from a list or comma-separated text."""
    parts = ids.split(",") if isinstance(ids, str) else ids
    kept = tuple(t for t in (trim(p) for p in parts) if t)
    if len(kept) > MAX_ENTITY_IDS:
        raise ValueError(f"{name}: at most {MAX_ENTITY_IDS} values supported, got {len(kept)}")
    return kept


@dataclass(frozen=True)
class Scope:
    """Filters, all joined by AND; an empty value filters nothing.

    A time window [since, until) is always one on events, never on the time a
    session was created.

    A list of entity ids holds up to 200; `include_entities` and `exclude_entities` are tables of
    any number of ids, in a column entity_id. A table filters also when it is empty: then no
    entity is included, or none is excluded.
    """

    entity_id: str = ""
    group_id: str = ""
    include_entity_ids: str | Iterable[str] = ()
    exclude_entity_ids: str | Iterable[str] = ()
    kind: str = ""
    system_source: str = ""
    opened_by: str = ""
    title: str = ""
    since: str | datetime | None = None
    until: str | datetime | None = None
    event_type: str = ""
    session_id: str = ""
    include_entities: DataFrame | None = field(default=None, compare=False)
    exclude_entities: DataFrame | None = field(default=None, compare=False)

    def __post_init__(self):
        def put(name, value):
            object.__setattr__(self, name, value)

        for name in ("include_entity_ids", "exclude_entity_ids"):
            put(name, id_list(getattr(self, name), name))
        for name in ("kind", "system_source", "opened_by"):
            put(name, trim(getattr(self, name)))
        put("title", search_term(self.title))
        put("since", instant(self.since))
        put("until", instant(self.until))

    def session_conditions(self) -> list[Column]:
        same = {
            "entity_id": self.entity_id, "group_id": self.group_id, "interaction_kind": self.kind,
            "system_source": self.system_source, "opened_by": self.opened_by,
        }
        found = [F.col(column) == value for column, value in same.items() if value]
        if self.include_entity_ids:
            found.append(F.col("entity_id").isin(*self.include_entity_ids))
        if self.exclude_entity_ids:
            # a session without an entity is excluded too: NOT IN is unknown
            found.append(~F.col("entity_id").isin(*self.exclude_entity_ids))
        if self.title:
            found.append(title_contains(F.col("title"), self.title))
        return found

    def event_conditions(self, columns: Iterable[str] = ()) -> list[Column]:
        found = []
        if self.session_id:
            found.append(F.col("session_id") == self.session_id)
        if self.event_type:
            found.append(F.col("event_type") == self.event_type)
        if self.since is not None:
            found.append(F.col("ts") >= instant_literal(self.since))
        if self.until is not None:
            found.append(F.col("ts") < instant_literal(self.until))
        if "event_date" in columns:
            # the day is a directory of the store, so this prunes files
            if self.since is not None:
                found.append(F.col("event_date") >= F.to_date(instant_literal(self.since)))
            if self.until is not None:
                found.append(F.col("event_date") <= F.to_date(instant_literal(self.until)))
        return found

    @property
    def filters_sessions(self) -> bool:
        tables = self.include_entities is not None or self.exclude_entities is not None
        return tables or bool(self.session_conditions())

    @property
    def filters_events(self) -> bool:
        return bool(self.event_conditions())


ALL = Scope()


def _where(df: DataFrame, conditions: list[Column]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def _ids(table: DataFrame) -> DataFrame:
    """The distinct ids of a table, trimmed and without blanks, like those of a list."""
    return table.select(trimmed(F.col("entity_id").cast("string")).alias("entity_id")).where("entity_id <> ''").distinct()


def sessions_in(sessions: DataFrame, scope: Scope) -> DataFrame:
    """The sessions under the session filters. Tables of ids are joined, each id once, so that a
    session is not multiplied; Spark broadcasts them while they are small."""
    found = _where(sessions, scope.session_conditions())
    if scope.include_entities is not None:
        found = found.join(_ids(scope.include_entities), "entity_id", "left_semi").select(*sessions.columns)
    if scope.exclude_entities is not None:
        ids = _ids(scope.exclude_entities)
        # NOT IN is unknown for a session without an entity, but nothing is unknown of no ids
        empty = ids.limit(1).agg(F.count(F.lit(1)) == 0).scalar()
        found = found.where(F.col("entity_id").isNotNull() | empty).join(ids, "entity_id", "left_anti").select(*sessions.columns)
    return found


def events_in(events: DataFrame, scope: Scope) -> DataFrame:
    return _where(events, scope.event_conditions(events.columns))


def visible(messages: DataFrame, include_hidden: bool = False) -> DataFrame:
    """Without the hidden rows, unless they are asked for; NULL is visible."""
    return messages if include_hidden else messages.where(~F.col("visibility").eqNullSafe("hidden"))


def of_sessions(df: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows of df whose session_id is among the sessions' ids."""
    return df.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi")


def events_scoped(events: DataFrame, sessions: DataFrame, scope: Scope) -> DataFrame:
    """Events under the event filters and, only when one is set, the session
    filters. Without a session filter the sessions are not read at all, and
    events of unknown sessions stay."""
    found = events_in(events, scope)
    return of_sessions(found, sessions_in(sessions, scope)) if scope.filters_sessions else found


def joined(sessions: DataFrame, events: DataFrame, scope: Scope) -> DataFrame:
    """Each session with its events under the scope. An eventless session stays
    only as long as nothing filters events."""
    how = "inner" if scope.filters_events else "left"
    e = events_in(events, scope)
    e = e.select(*[F.col(c).alias("event_id" if c == "id" else f"event_{c}" if c in sessions.columns else c)
                   for c in e.columns])
    s = sessions_in(sessions, scope)
    return s.join(e, s["id"] == e["session_id"], how)
