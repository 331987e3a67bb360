"""The pipeline, each stage against a plain computation on its own input."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sessionlake.llm.columns import vocabulary
from sessionlake.llm.tokencount import tokenizer
from tests.llm.conftest import FOLDER
from tests.llm.test_native import measures, spans
from tests.llm.test_neardup import brute, family
from tests.llm.test_tokens import check_packing


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before and after each stage."""
    docs, seen = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        seen.append(docs)
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), name)
    return [*seen, docs]


def table(df):
    return [tuple(r) for r in df.select("doc_id", "text", "source").collect()]


def test_stages_hand_on_the_columns_of_documents(stages):
    assert [len({tuple(s.dtypes) for s in stages[:5]})] == [1] and stages[5].columns[0] == "doc_id"


def test_rejected_documents_go(stages):
    before, after = {i: t for i, t, _ in table(stages[0])}, {i for i, _, _ in table(stages[1])}
    assert 0 < len(after) < len(before)
    assert all(not measures(before[i])[-1] for i in after)


def test_one_of_each_group_stays(stages):
    before = [(i, t) for i, t, _ in table(stages[1])]
    assert sorted(i for i, _, _ in table(stages[2])) == sorted(i for i, _, _, kept in brute(before, 5, 80) if kept)


def test_personal_data_is_replaced(stages):
    before, after = {i: t for i, t, _ in table(stages[2])}, {r.doc_id: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    for i, t in before.items():
        want = t
        for s in reversed(spans(t)):
            kind, a, b = s.split(":")
            want = want[:int(a)] + f"[{kind.upper()}]" + want[int(b):]
        assert after[i].text == want and after[i].n_chars == len(want)


def test_copies_follow_the_mix(stages):
    before, after = table(stages[3]), Counter(table(stages[4]))
    assert set(after) <= set(before) and max(after.values()) <= 2
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    total = sum(size(t) for _, t, _ in before)
    assert abs(sum(n * size(r[1]) for r, n in after.items()) - 1.5 * total) < 0.1 * total


def test_every_copy_is_packed(stages):
    own = tokenizer(vocabulary("word_bpe_49k.json"))
    copies = Counter(i for i, _, _ in table(stages[4]))
    texts = {i: t for i, t, _ in table(stages[4])}
    got = stages[5].collect()
    ids = {i: own.encode(t, add_special_tokens=False).ids + [1] for i, t in texts.items()}
    assert sum(r.length for r in got) == sum(copies[i] * len(x) for i, x in ids.items())
    once = [i for i in copies if copies[i] == 1]
    bins = {}
    for r in got:
        bins[r.sequence_id] = bins.get(r.sequence_id, 0) + r.length
    assert max(bins.values()) <= 2048 and len(bins) * 2048 < 1.1 * sum(bins.values())
    assert {r.doc_id for r in got} == set(ids) and once


def test_run_is_all_stages(spark, stages):
    key = lambda df: Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, FOLDER)) == key(stages[5])


def test_nulls_repeats_and_empty_tables(spark, docs):
    good = next(family(3, 1, words=90)).replace("w1", "the of")
    rows = [(1, good, None, "a"), (1, good, None, "a"), (2, good, None, None), (None, good, None, "a"), (3, None, None, "a"), (4, "", None, "b")]
    df = docs(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs([]), FOLDER).count() == 0, name
    dedup = corpus_pipeline.drop_near_duplicates(spark, df, FOLDER)
    assert sorted((r.doc_id or 0) for r in dedup.collect()) == [0, 1, 3, 4]
    masked = corpus_pipeline.redact_personal_data(spark, docs([(1, None), (2, "x a@b.c y")]), FOLDER)
    assert {(r.doc_id, r.text, r.n_chars) for r in masked.collect()} == {(1, None, 0), (2, "x [EMAIL] y", 11)}
    mix = corpus_pipeline.mix_sources(spark, df, FOLDER)
    assert mix.columns == df.columns and set(table(mix)) <= set(table(df))
    assert corpus_pipeline.pack_sequences(spark, df, FOLDER).where("doc_id = 1 and start = 0").count() == 2


CLASHES = ("row", "_m", "n_words", "kept", "hash", "_hash", "_n", "n", "key", "_key", "copies", "copy", "pii_spans", "told", "id", "t",
           "component_id", "label", "band", "candidates", "doc id", "size", "place", "src")


@pytest.mark.parametrize("at", range(4))
def test_clashing_columns_pass_through(spark, docs, at):
    """Columns named as any that a stage adds, a tie, a long text and a repeated row."""
    good = "The end of it and that is for you to say, " + next(family(3, 1, words=90))
    rows = [(1, good, None, "a"), (1, good, None, "a"), (2, "der die und " + good[40:] * 300, None, "b"), (3, good + " a@b.cd", None, None)]
    plain = docs(rows)
    wide = plain.select("*", *[F.concat(F.lit(c), F.coalesce("source", F.lit("-"))).alias(c) for c in CLASHES])
    _, stage = corpus_pipeline.STAGES[at]
    got = stage(spark, wide, FOLDER)
    assert got.columns == wide.columns
    out = got.collect()
    assert Counter(tuple(r)[:5] for r in out) == Counter(map(tuple, stage(spark, plain, FOLDER).collect()))
    assert out and all(r[c] == c + (r["source"] or "-") for r in out for c in CLASHES)
