import math
import random

import pytest

from brinewell.operators.grid import to_grid
from brinewell.operators.runs import RunStore

S = 10**9


def cells(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id bigint, m string, t bigint, p double").selectExpr("*", "1 as source", "2 as cell", "'x' as n")
    return {(r.source, r.cell_epoch_s): r for r in to_grid(df, "m", "t", "p", "id", **kw).collect()}


def test_hand_worked(spark):
    rows = [(1, "a", 0, 0.2), (2, "a", 1800 * S, 0.4), (3, "a", 3 * 3600 * S + 900 * S, 0.8), (4, "a", 5, None), (5, "a", 6, float("nan")), (6, "a", 7, 1.5), (7, None, 8, 0.5)]
    got = cells(spark, rows)
    assert {k[1]: (v.n_readings, v.state) for k, v in got.items()} == {0: (2, "measured"), 3600: (0, "carried"), 7200: (0, "missing"), 10800: (1, "measured")}
    assert got["a", 0].value == pytest.approx(0.3) and got["a", 0].coverage == pytest.approx(1)
    assert got["a", 3600].value == 0.4 and got["a", 3600].coverage == pytest.approx(0.5)
    assert got["a", 7200].value == 0.4 and got["a", 7200].coverage == 0
    assert got["a", 10800].value == pytest.approx(0.8) and got["a", 10800].coverage == pytest.approx(0.75)


def test_ties_and_edges(spark):
    got = cells(spark, [(2, "a", 3600 * S, 0.9), (1, "a", 3600 * S, 0.1), (3, "b", 3600 * S - 1, 0.5)])
    assert got["a", 3600].value == pytest.approx(0.9) and got["a", 3600].n_readings == 2
    assert set(got) == {("a", 3600), ("b", 0)}
    assert cells(spark, []) == {}


def test_far_times(spark):
    got = cells(spark, [(1, "a", 0, 0.5), (2, "a", 9000 * 3600 * S, 0.6), (3, "a", 2**63 - 1, 0.7), (4, "a", -(2**63), 0.7)])
    assert len(got) == 9001 and sum(x.n_readings for x in got.values()) == 2


def store(spark, rows, batches=1, **kw):
    s = RunStore(spark, ["k", "x"], ["id", "pos"], required=["k"], buckets=3)
    for b in range(batches):
        part = [r for r in rows if r[0] % batches == b]
        s.upsert(spark.createDataFrame(part, "id bigint, pos int, k string, x double, extra string"), f"b{b}", **kw)
    return s


@pytest.mark.parametrize("block_rows,batches", [(2, 1), (100, 3), (65_536, 2)])
def test_one_copy_of_each(spark, block_rows, batches):
    r = random.Random(block_rows)
    rows = [(i, p, "hot" if r.random() < 0.4 else f"k{r.randrange(40)}" if r.random() < 0.9 else None, r.choice([None, 1.0, math.nan]), "e") for i in range(150) for p in range(2)]
    s = store(spark, rows, batches, block_rows=block_rows)
    first = {}
    key = lambda x: (x[2], "nan" if x[3] is not None and math.isnan(x[3]) else x[3])
    for x in sorted((x for x in rows if x[2] is not None), key=lambda x: x[:2]):
        first.setdefault(key(x), x[:2])
    assert sorted((x.id, x.pos) for x in s.unique().collect()) == sorted(first.values())
    assert sorted((x.id, x.pos) for x in s.copies().collect()) == sorted(x[:2] for x in rows if x[2] is not None and x[:2] not in set(first.values()))
    s.upsert(spark.createDataFrame([x for x in rows if x[0] % batches == 0], "id bigint, pos int, k string, x double, extra string"), "b0")
    assert sorted((x.id, x.pos) for x in s.unique().collect()) == sorted(first.values())  # the same batch again changes nothing
    s.compact()
    assert sorted((x.id, x.pos) for x in s.unique().collect()) == sorted(first.values())
    assert s.copies().count() == 0


def test_two_runs_meet_without_a_shuffle(spark):
    rows = [(i, 0, f"k{i % 7}", None, "e") for i in range(60)]
    s = store(spark, rows, 2)
    s.copies().collect()
    plan = s.copies()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    s.compact()
    assert len(s.runs) == 1 and s.unique().count() == 7
    assert "Exchange" not in s.unique()._jdf.queryExecution().executedPlan().toString()


def test_another_store_goes_on_and_nothing_is_left(spark, tmp_path):
    path = f"{tmp_path}/store"
    kind = "id bigint, pos int, k string, x double, extra string"
    one = RunStore(spark, ["k", "x"], ["id", "pos"], required=["k"], buckets=3, path=path)
    one.upsert(spark.createDataFrame([(1, 0, "a", 0.0, "e"), (2, 0, "b", None, "e")], kind), "first")
    two = RunStore(spark, ["k", "x"], ["id", "pos"], required=["k"], path=path)
    two.upsert(spark.createDataFrame([(3, 0, "a", -0.0, "e"), (4, 0, "c", None, "e")], kind), "second")
    assert sorted(r.id for r in two.unique().collect()) == [1, 2, 4] and [r.id for r in two.copies().collect()] == [3]
    two.compact()
    three = RunStore(spark, ["k", "x"], ["id", "pos"], required=["k"], path=path)
    assert sorted((r.id, r.k, r.extra) for r in three.unique().collect()) == [(1, "a", "e"), (2, "b", "e"), (4, "c", "e")]
    assert sum(p.is_dir() for p in (tmp_path / "store").iterdir()) == 1
    three.close()
    assert not (tmp_path / "store").exists()


def test_nothing_stored(spark):
    s = store(spark, [])
    assert s.unique().count() == 0 and s.copies().count() == 0
