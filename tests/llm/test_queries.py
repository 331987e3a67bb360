"""Every registered query against SQL or brute force over the whole small tables."""

import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from sessionlake.llm.columns import vocabulary
from sessionlake.llm.queries import QUERIES, SQL
from sessionlake.llm.tokencount import tokenizer
from tests.llm.conftest import FOLDER
from tests.llm.test_models import brute
from tests.llm.test_native import spans
from tests.llm.test_neardup import brute as groups
from tests.llm.test_tokens import check_packing


@pytest.fixture(scope="module")
def given():
    return pd.read_parquet(f"{FOLDER}/documents.parquet")


def found(spark, name):
    return QUERIES[name](spark, FOLDER)


def test_all_are_registered():
    assert {re.match(r"op\d+|pipeline", q)[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)} | {"pipeline"}
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    df = found(spark, name)
    assert sorted(df.columns) == sorted(names)
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(r) for r in df.select(*names).collect()) == order(want.fetchall())
    con.close()


def test_near_duplicates(spark, given):
    got = {tuple(r) for r in found(spark, "op1_near_duplicates").collect()}
    assert got == groups(list(zip(given.doc_id.tolist(), given.text.tolist())), 2, 80)


def test_packing(spark, given):
    own = tokenizer(vocabulary("word_bpe_49k.json"))
    ids = {i: own.encode(t, add_special_tokens=False).ids + [1] for i, t in zip(given.doc_id, given.text)}
    assert check_packing(found(spark, "op3_packing").collect(), ids) < 1.05


def test_language(spark, given):
    got = found(spark, "op5_language").toPandas().merge(given[["doc_id", "lang"]], on="doc_id")
    held = got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)
    assert (got.held_out == held).all() and len(got) == len(given)
    assert (got.lang_pred == got.lang)[held].mean() > 0.97 and got.score.between(0, 1).all()


def test_personal_data(spark, given):
    got = {r.doc_id: r for r in found(spark, "op6_personal_data").collect()}
    assert len(got) == len(given)
    import hashlib
    for i, t in zip(given.doc_id, given.text):
        want = spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(got[i].spans.split(","))
        assert got[i].n_email == sum(x.startswith("email") for x in want)


def test_vectors(spark):
    v = pd.read_parquet(f"{FOLDER}/embeddings.parquet")
    vectors = {int(i): np.asarray(x) for i, x in zip(v.vec_id, v.embedding)}
    want = brute(vectors, [i for i in vectors if i % 20 == 0], 20)
    got = defaultdict(set)
    for r in found(spark, "op7_nearest_vectors").collect():
        got[r.query_id].add((r.vec_id, r.score))
    hits = sum(len(got[q] & set(w)) for q, w in want.items())
    assert got.keys() == want.keys() and hits >= 0.9 * sum(map(len, want.values()))


def test_token_counts(spark, given):
    own = tokenizer(vocabulary("byte_bpe_50k.json"))
    got = {tuple(r) for r in found(spark, "op9_token_counts").collect()}
    counts = [len(own.encode(t, add_special_tokens=False).ids) for t in given.text]
    assert got == {(i, len(t.encode()), n, n > 512) for i, t, n in zip(given.doc_id.tolist(), given.text, counts)}


def test_document_scores(spark, given):
    got = {r.doc_id: r for r in found(spark, "op10_masked_lm").collect()}
    for i, t in zip(given.doc_id, given.text):
        assert got[i].n_words == len(re.findall(r"[^\x20\x09-\x0D]+", t)) and got[i].log_probability <= 0
