"""Running values against brute force, with many ranges and a hot group."""

import random

import pytest
from pyspark.sql import functions as F

from sessionlake.operators.ordered import numbered, ranges_for, running, running_max_by_seq


def rows_with_a_hot_group(n=3000, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = "hot" if rng.random() < 0.5 else f"g{rng.randrange(40)}"
        # few times, so that many rows tie and only the id tells them apart
        rows.append((group, rng.randrange(6), f"id{rng.randrange(10**9)}-{i}", rng.randrange(-3, 9)))
    return rows


@pytest.mark.parametrize("ranges", [1, 7, 40])
@pytest.mark.parametrize("descending", [False, True])
def test_running_values(spark, ranges, descending):
    rows = rows_with_a_hot_group()
    df = spark.createDataFrame(rows, "g string, t int, id string, x int").repartition(5)
    got = running(df, ["g"], ["t", "id"], sums={"total": F.col("x"), "place": F.lit(1)},
                  previous={"before": "id", "before_x": "x"}, descending=descending, ranges=ranges)
    got = {r["id"]: (r["total"], r["place"], r["before"], r["before_x"]) for r in got.collect()}
    want, state = {}, {}
    for g, t, i, x in sorted(rows, key=lambda r: (r[0], r[1], r[2]), reverse=descending):
        total, place, before, before_x = state.get(g, (0, 0, None, None))
        want[i] = (total + x, place + 1, before, before_x)
        state[g] = (total + x, place + 1, i, x)
    assert got == want


@pytest.mark.parametrize("ranges", [1, 6, 15])
@pytest.mark.parametrize("kind", ["string", "int", "timestamp", "date", "boolean", "decimal(9,2)"])
def test_null_groups_and_addends(spark, ranges, kind):
    rng = random.Random(ranges)
    rows = [(rng.choice([None, 0, 1]), i, rng.choice([None, None, 1, 2])) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, id int, x int").withColumn("n", F.col("g"))
    value = {"timestamp": F.timestamp_seconds("g"), "date": F.date_from_unix_date("g")}.get(kind, F.col("g").cast(kind))
    got = running(df.withColumn("g", value), ["g"], ["id"], sums={"total": F.col("x")}, previous={"before": "id"}, ranges=ranges)
    want, state = {}, {}
    for g, i, x in rows:
        total, before = state.get(g, (None, None))
        total = total if x is None else (total or 0) + x
        want[i] = (total, before)
        state[g] = (total, i)
    assert {r["id"]: (r["total"], r["before"]) for r in got.collect()} == want


def test_ranges_grow_with_the_rows():
    assert [ranges_for(n) for n in (0, 1, 1 << 16, (1 << 16) + 1, 1 << 26)] == [1, 1, 1, 2, 1024]


@pytest.mark.parametrize("ranges", [1, 9])
def test_numbering_without_a_group(spark, ranges):
    rows = [(i * 7919 % 1000, f"r{i}") for i in range(1500)] + [(None, "z"), (None, "y")]
    got = numbered(spark.createDataFrame(rows, "v int, id string"), [], ["v", "id"], ranges=ranges)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r["v"], r["id"]) for r in got.orderBy("pos").collect()] == want


def test_running_max_across_stretches(spark):
    rng = random.Random(5)
    rows = [(s, q, rng.choice([None, *range(50)])) for s in ("a", "b") for q in rng.sample(range(400), 200)]
    df = spark.createDataFrame(rows, "session_id string, seq long, v int")
    got = {(r["session_id"], r["seq"]): r["m"] for r in running_max_by_seq(df, "v", "m", rows=16).collect()}
    want, top = {}, {}
    for s, q, v in sorted(rows, key=lambda r: (r[0], r[1])):
        if v is not None:
            top[s] = max(top.get(s, v), v)
        want[s, q] = top.get(s)
    assert got == want
