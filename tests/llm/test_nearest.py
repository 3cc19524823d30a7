import random

import pytest
from pyspark.sql import functions as F

from brinewell.llm.nearest import nearest, records

S = 10**9


def pairs(spark, left, right, tolerance, slot):
    schema = "id bigint, e string, t bigint"
    make = lambda rows: spark.createDataFrame(rows, schema).selectExpr("*", "1 as slot", "2 as is_left")
    shaped = lambda rows: records(make(rows), F.col("e"), F.col("t"), F.col("id"))
    return sorted((r.left_id, r.right_id, r.distance_ns) for r in nearest(shaped(left), shaped(right), tolerance, slot_ns=slot).collect())


@pytest.mark.parametrize("slot,tolerance", [(40, 5), (1000, 20), (7, 3), (50, 25)])
def test_against_brute_force(spark, slot, tolerance):
    r = random.Random(slot)
    side = lambda n, first: [(first + k, r.choice(["a", "a", "a", "b", None]), r.choice([r.randrange(-50, 400), None]) if k % 9 == 0 else r.randrange(-50, 400)) for k in range(n)]
    left, right = side(200, 0), side(150, 1000)
    right += [(2000 + k, e, t) for k, (_, e, t) in enumerate(right[:40])]
    r.shuffle(right)
    want = []
    for i, e, t in left:
        c = [(abs(x - t), x, j) for j, f, x in right if None not in (e, t, x) and e == f and abs(x - t) <= tolerance]
        if c:
            want.append((i, min(c)[2], min(c)[0]))
    assert pairs(spark, left, right, tolerance, slot) == sorted(want)


def test_tolerance_is_inclusive_and_ties_are_ordered(spark):
    assert pairs(spark, [(1, "a", 100)], [(5, "a", 90), (4, "a", 110), (3, "a", 110)], 10, 1000) == [(1, 5, 10)]
    assert pairs(spark, [(1, "a", 100)], [(4, "a", 110), (3, "a", 110)], 10, 1000) == [(1, 3, 10)]
    assert pairs(spark, [(1, "a", 100)], [(4, "a", 111)], 10, 1000) == []


def test_kinds_and_nothing(spark):
    make = lambda rows, kind="": records(spark.createDataFrame(rows, "id bigint, e string, t bigint"), F.col("e"), F.col("t"), F.col("id"), kind)
    right = make([(7, "a", 3)], "x").unionByName(make([(8, "a", 1)], "y"))
    got = nearest(make([(1, "a", 2)]), right, 5, ("x", "y")).collect()
    assert sorted((r.left_id, r.kind, r.right_id) for r in got) == [(1, "x", 7), (1, "y", 8)]
    assert nearest(make([]), right, 5, ("x", "y")).count() == 0 and nearest(make([(1, "a", 2)]), right.where("false"), 5, ("x",)).count() == 0


def test_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        test_against_brute_force(spark, 60, 9)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
