import random

import pytest

from brinewell.operators.positions import chunked, placed


@pytest.mark.parametrize("block", [1, 10, 10**6])
def test_places(spark, block):
    r = random.Random(block)
    rows = [(k, r.choice("aaab"), r.randrange(-40, 60)) for k in range(300)] + [(900, None, 1), (901, "a", None)]
    df = spark.createDataFrame(rows, "id int, m string, t bigint")
    got = {x.id: (x.place, x.n) for x in placed(df, "m", "t", "id", block).collect()}
    want = {}
    for m in "ab":
        mine = sorted((t, i) for i, k, t in rows if k == m and t is not None)
        want |= {i: (p, len(mine)) for p, (_, i) in enumerate(mine)}
    assert got == want


@pytest.mark.parametrize("look_back,size", [(1, 4), (3, 3), (5, 2)])
def test_chunks(spark, look_back, size):
    df = placed(spark.createDataFrame([(k, "a") for k in range(40)], "t bigint, m string"), "m", "t")
    got = chunked(df, look_back, size).collect()
    size = max(size, look_back)
    assert sorted(x.place for x in got if x.own) == list(range(40))
    for c in {x.chunk for x in got}:
        mine = sorted(x.place for x in got if x.chunk == c)
        assert mine == list(range(max(0, c * size - look_back), min(40, c * size + size)))
