"""Quality rules: a table of thresholds compiled into one projection of Spark columns.

The rules are for prose in English, German, French and Spanish: the stop-word rule compares
words as they are written with lists of these four languages, and rejects texts in other
languages and texts in capitals. Leave it out of `rules` for tables that hold such texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.columns import SPACE, fresh, let, words

#: Common function words. A text of connected prose has some of its language's.
STOP_WORDS = (
    "the of and to in a is that for it on with as was be by "
    "der die und das von zu mit den ist im ein nicht "
    "de la le et les des en un une que du pour dans "
    "el los las y se por con para su al como"
).split()

#: (name, measure, of which measure, at least, at most), in thousandths; None is no bound.
RULES = (
    ("word_length", "word_chars", "n_words", 2_000, 20_000),
    ("symbols", "n_symbols", "n_words", None, 100),
    ("exclamations", "n_exclaims", "n_words", None, 200),
    ("stop_words", "n_stop_words", "one", 2_000, None),
    ("repeated_lines", "n_dup_lines", "n_lines", None, 300),
)


def _count(array: Column) -> Column:
    return F.size(array).cast("long")


def _repeated(w: Column, n: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the list w of n words.

    Windows are compared by 64-bit hashes. Sorting (hash, place) puts equal windows side
    by side; of the places of repeated windows, in order, each covers the words up to the
    next such place, three at most.
    """
    def places(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        def again(s: Column) -> Column:
            same = F.transform(s, lambda x, k: F.when(
                (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"]))
            return F.sort_array(F.array_compact(same))
        return let(pairs, again)

    def covered(p: Column) -> Column:
        each = F.transform(p, lambda x, k: F.least(F.get(p, k + 1) - x, F.lit(3)))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

    windows = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), n - 2)
    some = let(windows, lambda h: F.when(
        F.size(F.array_distinct(h)) < F.size(h), let(places(h), covered)).otherwise(F.lit(0).cast("long")))
    return F.when(n > 2, some).otherwise(F.lit(0).cast("long"))


def _measures(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")

    def of(w: Column) -> Column:
        n = F.size(w)
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.regexp_count(text, F.lit("!")).cast("long").alias("n_exclaims"),
            let(lines, lambda x: F.struct(
                _count(x).alias("n_lines"), (_count(x) - _count(F.array_distinct(x))).alias("n_dup_lines"))).alias("lines"),
            _repeated(w, n).alias("n_repeat_words"),
            _count(F.array_intersect(w, F.array(*map(F.lit, STOP_WORDS)))).alias("n_stop_words"),
        )
    return let(words(text), of)


def compiled(rules: tuple) -> Column:
    """One condition: the measures keep to every bound."""
    ok = F.lit(True)
    for _, part, whole, least, most in rules:
        of = F.lit(1).cast("long") if whole == "one" else F.col(whole)
        if least is not None:
            ok = ok & (1000 * F.col(part) >= least * of)
        if most is not None:
            ok = ok & (1000 * F.col(part) <= most * of)
    return ok


def judged(docs: DataFrame, rules: tuple = RULES, text_col: str = "text") -> DataFrame:
    """Add the measures of the whole text, base_failed and kept to every row of docs.

    base_failed: fewer than 50 words, or over half of the words stand in repeated 3-word
    windows. kept: not base_failed and within every rule. A null text counts as empty: all
    measures are 0 and it fails. Rows are judged each by itself, so repeats and ties do not
    matter; a column of docs with a measure's name is replaced.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    names = ("n_words", "word_chars", "n_symbols", "n_exclaims", "n_repeat_words", "n_stop_words")
    of = fresh(docs, "_m")
    m = docs.withColumn(of, _measures(text))
    m = m.withColumns({n: F.col(f"{of}.{n}") for n in names} | {
        n: F.col(f"{of}.lines.{n}") for n in ("n_lines", "n_dup_lines")}).drop(of)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return m.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules))
