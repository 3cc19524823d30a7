import math
import random

import numpy as np
import pytest

from brinewell.operators import features

S = 10**9
SCHEMA = "id bigint, market_id string, ts_ns bigint, prob_before double, prob_after double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as slot", "2 as own", "3 as counts", "4.0 as diff", "5 as n")


def brute(rows, window, capacity):
    out, by = {}, {}
    for i, m, t, b, a in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        seen = by.setdefault(m, [])
        seen.append((t, b, a))
        inside = [x for x in seen[-capacity:] if x[0] >= t - window]
        vol = math.sqrt(sum((y[2] - x[2]) ** 2 for x, y in zip(inside, inside[1:])))
        out[i] = ((inside[-1][2] - inside[0][1]) / (window / S), len(inside) / (window / S), vol)
    return out


def test_hand_worked(spark):
    got = {r.id: r for r in features.event_time_features(frame(spark, [(1, "m", 0, 0.5, 0.5), (2, "m", S, 0.5, 0.6), (3, "m", 2 * S, 0.6, 0.5)]), 2 * S).collect()}
    assert got[3].prob_velocity == 0 and got[3].bet_arrival_rate == 1.5 and got[3].realized_vol == pytest.approx(math.sqrt(0.02))


@pytest.mark.parametrize("window,capacity,slots", [(60 * S, 512, 8), (5 * S, 7, 1), (3 * S, 1, 2), (10**12, 16, 3)])
def test_ties_and_slots_against_brute_force(spark, window, capacity, slots):
    r = random.Random(capacity)
    rows = [(k, f"m{r.randrange(3)}", r.randrange(300) * S, r.random(), r.random()) for k in range(900)]
    got = {x.id: x for x in features.event_time_features(frame(spark, rows), window, capacity, slots).collect()}
    want = brute(rows, window, capacity)
    assert set(got) == set(want)
    for k, (v, n, vol) in want.items():
        assert got[k].prob_velocity == v and got[k].bet_arrival_rate == n and got[k].realized_vol == pytest.approx(vol, abs=1e-7)


def test_small_batches_give_the_same(spark):
    r = random.Random(1)
    rows = [(k, "m", r.randrange(200) * S, r.random(), r.random()) for k in range(500)]
    whole = sorted(features.event_time_features(frame(spark, rows), 9 * S, 20).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        assert [x[:4] for x in sorted(features.event_time_features(frame(spark, rows), 9 * S, 20).collect())] == [x[:4] for x in whole]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_nulls_and_nothing(spark):
    rows = [(1, None, 0, 0.1, 0.1), (2, "m", None, 0.1, 0.1), (3, "m", 5, None, 0.1)]
    assert features.event_time_features(frame(spark, rows)).count() == 0
    assert features.event_time_features(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        features.event_time_features(frame(spark, []), capacity=0)


def test_count_based(spark):
    rows = [(k, "m", k * S, 0.0, p) for k, p in enumerate([0.5, 0.6, 0.4, 0.4])] + [(9, "x", 0, 0.0, 0.3), (10, "t", 5, 0.0, 0.1), (11, "t", 5, 0.0, 0.9), (12, "t", 5, 0.0, 0.2)]
    got = {r.id: r for r in features.count_features(frame(spark, rows), 3).collect()}
    assert got[0].prob_velocity == 0 and got[9].realized_vol == 0
    assert got[3].prob_velocity == pytest.approx(-0.1) and got[3].bet_arrival_rate == 1.5
    assert got[3].realized_vol == pytest.approx(float(np.std([-0.2, 0.0])))
    assert got[12].prob_velocity == 0 and got[12].realized_vol == pytest.approx(float(np.std([0.8, -0.7])))  # no time between them, two differences


def test_even_places():
    assert features.even_places(0, 6) == [] and features.even_places(1, 6) == [0] and features.even_places(2, 6) == [1] and features.even_places(3, 6) == [2]
    assert features.even_places(9, 6) == [2, 3, 4, 6, 7, 8] and features.even_places(1000, 1) == [2]
    assert features.even_places(1000, 6)[0] == 2 and features.even_places(1000, 6)[-1] == 999


@pytest.mark.parametrize("n", [8, 9, 23, 200])
def test_sampled_like_the_formula(spark, n):
    got = [r.place for r in features.sampled_bets(frame(spark, [(k, "m", k, 0.1, 0.1) for k in range(n)])).collect()]
    assert sorted(got) == features.even_places(n, 6)


def test_last_values(spark):
    df = spark.createDataFrame([(k, "a" if k % 3 else "b", k // 2, float(k)) for k in range(90)], "id bigint, m string, t bigint, v double")
    got = {r.m: r.recent for r in features.last_values(df, "m", ["t", "id"], "v", 5).collect()}
    assert got == {"a": [83.0, 85.0, 86.0, 88.0, 89.0], "b": [75.0, 78.0, 81.0, 84.0, 87.0]}


def test_history(spark):
    got = features.bounded_history(frame(spark, [(k, "m", 0, 0.1, 0.1) for k in range(10)]), 4).collect()
    assert sorted((r.id, r.place) for r in got) == [(6, 0), (7, 1), (8, 2), (9, 3)]
