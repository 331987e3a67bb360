"""Personal data by weak supervision, with DataFrame functions only.

1. Candidates: the base patterns' matches, and looser ones that do not overlap them.
2. Labelers vote on each candidate: the strict pattern, a check of its digits or ending, a
   gazetteer of known beginnings or endings, cue words before it, and clean edges.
3. Expectation-maximisation over the counts of the vote patterns (at most 2^5 a kind)
   estimates how often each labeler fires on true and on false candidates.
4. A naive Bayes classifier of votes and shape is trained on the resulting
   probabilities. It decides about the looser candidates; base matches always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.columns import let
from sessionlake.workspace import written

KINDS = ("email", "ip", "card", "phone")

#: An attempt from inside a run can only succeed where the one from its start did, or right
#: behind a match; saying so keeps the search linear in long runs.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}

_AT, _DOT = r"(?:\x20?[(\[]at[)\]]\x20?|\x20at\x20)", r"(?:\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)"
LOOSE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,64}}+(?:{_DOT}[A-Za-z0-9-]{{1,64}}+){{1,5}}",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
             r"|(?<![0-9+])00[1-9][\x20().0-9-]{7,16}[0-9](?![0-9])",
}
#: What a text must hold for a pattern to match, found without a pattern.
_NEEDS = {"email": "@", "phone": "+"}, {"email": "dot", "ip": "[.]"}

GAZETTEER = {
    "email": r"(?i)[. ](?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at|us|ca)[)\]]?$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])(?:\.|\[)",
    "card": r"^(?:4|5[\x20-]?[1-5]|3[\x20-]?[47]|6[\x20-]?(?:0[\x20-]?1[\x20-]?1|5)|2[\x20-]?[2-7])",
    "phone": r"^(?:\+|00)?[\x20(]*(?:1|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])",
}
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write to|reach)\b", "ip": r"(?i)\b(?:ip|host|server|address|addr)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|payment|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|fax|mobile|telefon|appel)\b",
}
NEAR = 24
ROUNDS = 30


def found(text: Column, pattern: str) -> Column:
    """The leftmost matches that do not overlap: an array of (start, end, piece), in code points."""
    pieces, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)

    def placed(x: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            piece = F.get(x["pieces"], i)
            start = a["pos"] + F.length(F.get(x["between"], i))
            end = start + F.length(piece)
            return F.struct(end.alias("pos"), F.array_append(
                a["out"], F.struct(start.alias("start"), end.alias("end"), piece.alias("piece"))).alias("out"))
        none = F.array().cast("array<struct<start:int,end:int,piece:string>>")
        zero = F.struct(F.lit(0).alias("pos"), none.alias("out"))
        return F.when(F.size(x["pieces"]) == 0, none).otherwise(
            F.aggregate(F.sequence(F.lit(0), F.size(x["pieces"]) - 1), zero, step, lambda a: a["out"]))
    return let(F.struct(pieces.alias("pieces"), between.alias("between")), placed)


def _digits(piece: Column) -> Column:
    return F.regexp_replace(piece, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _passes(kind: str, piece: Column) -> Column:
    digits = _digits(piece)
    n = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(piece, r"[^0-9]+"), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def _base(text: Column, kind: str) -> Column:
    need = _NEEDS[0].get(kind)
    there = F.contains(text, F.lit(need)) if need else text.rlike("[0-9]")
    none = F.array().cast("array<struct<start:int,end:int,piece:string>>")
    return F.when(there, F.filter(found(text, BASE[kind]), lambda m: _passes(kind, m["piece"]))).otherwise(none)


def _candidates(text: Column, kind: str, base: Column) -> Column:
    """Base matches and looser ones, with their votes and shape."""
    need = _NEEDS[1].get(kind)
    there = F.contains(text, F.lit(need)) if need else text.rlike("[0-9][0-9]")
    none = F.array().cast("array<struct<start:int,end:int,piece:string>>")
    loose = F.when(there, F.filter(found(text, LOOSE[kind]), lambda m: ~F.exists(
        base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))).otherwise(none)

    def judged(m: Column, strict: bool) -> Column:
        before = F.substr(text, F.greatest(m["start"] - NEAR, F.lit(0)) + 1, F.least(m["start"], F.lit(NEAR)))
        behind = F.substr(text, m["end"] + 1, F.lit(2))
        votes = (F.lit(strict), _passes(kind, m["piece"]), m["piece"].rlike(GAZETTEER[kind]), before.rlike(CUES[kind]),
                 ~before.rlike(r"[\p{L}0-9.:/-]$") & ~behind.rlike(r"^(?:[\p{L}0-9_/-]|[.:][0-9])"))
        shape = F.concat(F.least(F.floor((m["end"] - m["start"]) / 5), F.lit(5)).cast("string"),
                         F.when(m["piece"].rlike(r"[\x20()\[\]]"), "s").otherwise("-"))
        return F.struct(
            m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"),
            F.lit(strict).alias("base"), F.concat(*[F.when(v, "1").otherwise("0") for v in votes]).alias("votes"),
            shape.alias("shape"))
    return F.concat(F.transform(base, lambda m: judged(m, True)), F.transform(loose, lambda m: judged(m, False)))


N_VOTES = 5


def reliabilities(patterns: DataFrame) -> DataFrame:
    """From (kind, votes, n): kind, prior, and per labeler how often it fires on true (hit)
    and on false (slip) candidates, by ROUNDS of expectation-maximisation. One small array
    per kind holds all that the iteration looks at."""
    per_kind = patterns.groupBy("kind", "votes").agg(F.sum("n").cast("double").alias("n")).groupBy("kind").agg(
        F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("p"))
    labelers = F.sequence(F.lit(0), F.lit(N_VOTES - 1))

    def again(s: Column, p: Column) -> Column:
        post = F.transform(p, lambda x: F.struct(
            x["votes"].alias("votes"), x["n"].alias("n"), _probability(x["votes"], s).alias("q")))

        def rate(true: bool, i: Column) -> Column:
            def w(x):
                return x["n"] * (x["q"] if true else 1 - x["q"])
            on = F.aggregate(post, F.lit(1.0), lambda a, x: a + F.when(_fires(x["votes"], i), w(x)).otherwise(0.0))
            return on / F.aggregate(post, F.lit(2.0), lambda a, x: a + w(x))
        total = F.aggregate(post, F.lit(2.0), lambda a, x: a + x["n"])
        return F.struct(
            (F.aggregate(post, F.lit(1.0), lambda a, x: a + x["n"] * x["q"]) / total).alias("prior"),
            F.transform(labelers, lambda i: rate(True, i)).alias("hit"),
            F.transform(labelers, lambda i: rate(False, i)).alias("slip"))

    begin = F.struct(F.lit(0.5).alias("prior"), F.array_repeat(F.lit(0.8), N_VOTES).alias("hit"),
                     F.array_repeat(F.lit(0.3), N_VOTES).alias("slip"))
    s = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, lambda a, _: again(a, F.col("p")))
    return per_kind.select("kind", s.alias("s")).select("kind", "s")


def _fires(votes: Column, i: Column) -> Column:
    return F.substr(votes, i + 1, F.lit(1)) == "1"


def _probability(votes: Column, s: Column) -> Column:
    """That a candidate with these votes is true."""
    def side(rates: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(N_VOTES - 1)), F.lit(0.0), lambda a, i: a + F.log(
            F.when(_fires(votes, i), F.get(rates, i)).otherwise(1 - F.get(rates, i))))
    odds = F.log(s["prior"]) - F.log(1 - s["prior"]) + side(s["hit"]) - side(s["slip"])
    return 1 / (1 + F.exp(-odds))


def classifier(patterns: DataFrame) -> DataFrame:
    """From (kind, votes, shape, n): the patterns with accepted, the trained classifier's verdict."""
    true = patterns.join(reliabilities(patterns), "kind").withColumn("q", _probability(F.col("votes"), F.col("s")))
    features = F.array(F.concat(F.lit("s"), "shape"), *[
        F.concat(F.lit(f"v{i}="), F.substr("votes", F.lit(i + 1), F.lit(1))) for i in range(N_VOTES)])
    each = true.select("kind", "votes", "shape", "n", "q", F.explode(features).alias("feature"))
    yes, no = F.sum(F.col("n") * F.col("q")), F.sum(F.col("n") * (1 - F.col("q")))
    all_of = true.groupBy("kind").agg((yes + 1).alias("yes_all"), (no + 1).alias("no_all"))
    weights = each.groupBy("kind", "feature").agg((yes + 0.5).alias("yes"), (no + 0.5).alias("no")).join(all_of, "kind")
    weights = weights.select("kind", "feature", (
        F.log(F.col("yes") / F.col("yes_all")) - F.log(F.col("no") / F.col("no_all"))).alias("weight"))
    sums = each.join(weights, ["kind", "feature"]).groupBy("kind", "votes", "shape").agg(F.sum("weight").alias("odds"))
    return sums.join(all_of, "kind").select("kind", "votes", "shape", (
        F.col("odds") + F.log(F.col("yes_all") / F.col("no_all")) > 0).alias("accepted"))


def personal_data(docs: DataFrame, carry: list[str], text_col: str = "text", keep: bool = True) -> DataFrame:
    """Per row of docs: its columns named in `carry`, and pii_spans, an array of (start, kind,
    end, base) in order of start and kind; kind is an index of KINDS, code points count from
    0, end is exclusive.

    A null text counts as empty and has no spans. Each row is searched by itself, so repeats
    agree; what is learned comes from all rows. An empty table gives an empty result. Columns
    outside `carry` and the text are dropped, so they cannot clash. The candidates are kept
    as a table; with keep=False they are searched a second time instead, which takes no
    room where `carry` holds the texts.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))

    def of_kind(t: Column, kind: str) -> Column:
        return let(_base(t, kind), lambda base: _candidates(t, kind, base))

    def all_kinds(t: Column) -> Column:
        return F.concat(*[of_kind(t, k) for k in KINDS])

    rows = docs.select(*[F.col(f"`{c}`") for c in carry], F.sort_array(let(text, all_kinds)).alias("pii_spans"))
    rows = written(rows, "candidates") if keep else rows
    patterns = rows.select(F.explode("pii_spans").alias("c")).groupBy("c.kind", "c.votes", "c.shape").agg(
        F.count(F.lit(1)).alias("n"))
    patterns = written(patterns, "votes")  # kinds * vote patterns * shapes rows at most
    accepted = classifier(patterns).where("accepted").select(F.concat_ws(" ", "kind", "votes", "shape")).collect()
    codes = F.array(*[F.lit(r[0]) for r in accepted]).cast("array<string>")
    kept = F.filter("pii_spans", lambda c: c["base"] | F.array_contains(
        codes, F.concat_ws(" ", c["kind"].cast("string"), c["votes"], c["shape"])))
    short = F.transform(kept, lambda c: F.struct(*[c[n].alias(n) for n in ("start", "kind", "end", "base")]))
    return rows.withColumn("pii_spans", short)


def joined(spans: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    """Base matches of a kind."""
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == KINDS.index(kind)))).cast("long")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the
    first one names the kind, and the stretch they cover together is replaced."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(a: Column, s: Column) -> Column:
        inside = s["start"] < a["pos"]
        plain = F.substr(text, a["pos"] + 1, F.greatest(s["start"] - a["pos"], F.lit(0)))
        out = F.when(inside, a["out"]).otherwise(F.concat(a["out"], F.array(plain, F.get(names, s["kind"]))))
        return F.struct(F.greatest(a["pos"], s["end"]).alias("pos"), out.alias("out"))

    begin = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    cut = F.aggregate(spans, begin, step, lambda a: F.concat(
        F.array_join(a["out"], ""), F.substr(text, a["pos"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, cut).otherwise(text)
