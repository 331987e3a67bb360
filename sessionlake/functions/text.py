"""Text shown to a reader: titles, error rows, message metadata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionlake import vocabulary as V


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(V.WHITE_SPACE))


def trim(value: str | None) -> str:
    return (value or "").strip(V.WHITE_SPACE)


def search_term(value: str | None) -> str:
    """A title search, trimmed; the whole of it must be in a title."""
    return trim(value)


def title_contains(title: Column, term: str) -> Column:
    """Literal substring, ignoring case; an absent title never matches."""
    return F.contains(F.lower(title), F.lower(F.lit(term)))


def title_problem(title: Column) -> Column:
    """Why a (trimmed) new title is refused, NULL when it is good."""
    return (
        F.when(F.coalesce(title, F.lit("")) == "", "empty title")
        .when(F.char_length(title) > V.MAX_TITLE_CHARS, "title too long")
    )


def error_excerpt(payload: Column) -> Column:
    """The excerpt of the failed response, whatever its length; NULL when there is none."""
    # a variant keeps text apart from a number, which is no excerpt
    value = F.from_json(payload, f"`{V.ERROR_EXCERPT}` variant")[V.ERROR_EXCERPT]
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def error_text(payload: Column) -> Column:
    """What an error row says: the excerpt when it is short, counted in bytes."""
    excerpt = error_excerpt(payload)
    short = F.octet_length(excerpt).between(1, V.ERROR_EXCERPT_MAX_BYTES)
    return F.when(short, F.concat(F.lit(V.ERROR_PREFIX), excerpt)).otherwise(V.ERROR_FALLBACK)


def whole_json(
    text: Column, kind: str, mark: Callable[[Column], Column], read: Callable[[Column], Column],
    options: dict[str, str] | None = None,
) -> Column:
    """text as JSON of a type, NULL unless the whole text is one value.

    Spark takes a value and leaves what follows it. Here the text stands alone in
    an array, and a mark made of the text's hash in a second one behind it: text
    after the value breaks the arrays, adds an element, or hides the mark.
    mark(hash) is JSON of the type, read(value) gets the hash back.
    """
    own = F.xxhash64(text).cast("string")
    pair = F.from_json(F.concat(F.lit("[["), text, F.lit("],["), mark(own), F.lit("]]")), f"array<array<{kind}>>", options)

    def one(x: Column) -> Column:
        value, end = F.get(x, F.lit(0)), F.get(F.get(x, F.lit(1)), F.lit(0))
        return F.when((F.size(x) == 2) & (F.size(value) == 1) & (read(end) == own), value[0])

    return F.transform(F.array(pair), one)[0]


def _is_json(text: Column) -> Column:
    return whole_json(text, "string", lambda own: F.concat(F.lit('"'), own, F.lit('"')), lambda v: v).isNotNull()


def metadata_or_null(metadata: Column) -> Column:
    """A message's metadata as stored, trimmed; NULL when empty or no JSON."""
    text = trimmed(metadata)
    return F.when(~text.isin("", "null", "{}") & _is_json(text), text)
