import random

import pytest
from pyspark.sql import functions as F

from brinewell.operators import late

HOUR = late.HOUR_NS
SCHEMA = "id bigint, pos int, market string, t bigint, v double, block string, marker int"


def frame(spark, rows):
    """With columns of names that the operator uses itself."""
    return spark.createDataFrame([(i, p, m, t, v, "x", 1) for i, p, m, t, v in rows], SCHEMA)


def shaped(df, origin="o"):
    return late.records(origin, df, F.col("market"), F.col("id"), F.col("pos"), F.col("t"), F.col("v"))


def brute(rows, cutoff=6 * HOUR):
    clock, verdicts, hours = {}, set(), {}
    for i, p, m, t, v in sorted((r for r in rows if None not in (r[0], r[2], r[3])), key=lambda r: r[:2]):
        before = clock.get(m)
        clock[m] = t if before is None else max(before, t)
        h = t // HOUR * HOUR
        n = hours.setdefault((m, h), [0, 0, 0])
        if before is not None and h + HOUR <= before:
            verdict = "dropped" if before - t > cutoff else "late"
            verdicts.add((i, p, verdict))
            n[2] += verdict == "dropped"
            n[1] += verdict == "late"
            n[0] += verdict == "late"
        else:
            n[0] += 1
    return verdicts, hours


@pytest.mark.parametrize("block_rows", [3, 50, 65_536])
def test_against_brute_force(spark, block_rows):
    r = random.Random(block_rows)
    rows = []
    for k in range(1500):
        t = k * HOUR // 6 - (r.randrange(14 * HOUR) if r.random() < 0.25 else 0)
        rows.append((k // 2, k % 2, "hot" if r.random() < 0.5 else f"m{r.randrange(6)}", t + 10**18, float(r.randrange(9)) if r.random() < 0.9 else None))
    rows += [(None, 0, "hot", 5, 1.0), (5, 0, None, 5, 1.0), (6, 0, "hot", None, 1.0)]
    verdicts, hours = brute(rows)
    found = late.late_records(shaped(frame(spark, rows)), block_rows=block_rows).collect()
    assert len(found) == len(verdicts)
    assert {(x.row_id, x.bet_pos, x.verdict) for x in found} == verdicts
    got = late.corrected_periods(shaped(frame(spark, rows)), block_rows=block_rows).collect()
    assert {(x.key, x.period_ns): [x.n, x.n_late, x.n_dropped] for x in got} == hours


def test_bounds(spark):
    t = 10**18 // HOUR * HOUR
    rows = [(1, 0, "a", t + 7 * HOUR, 1.0), (2, 0, "a", t + 7 * HOUR - 1, 1.0), (3, 0, "a", t + HOUR, 1.0), (4, 0, "a", t + HOUR - 1, 1.0), (5, 0, "a", t + 7 * HOUR, 1.0)]
    found = {(x.row_id, x.verdict) for x in late.late_records(shaped(frame(spark, rows))).collect()}
    assert found == {(2, "late"), (3, "late"), (4, "dropped")}  # an hour that ends at the clock has ended; six hours are still taken


def test_empty(spark):
    assert late.late_records(shaped(frame(spark, []))).count() == 0
    assert late.corrected_periods(shaped(frame(spark, []))).count() == 0


def test_great_ids_keep_their_digits(spark):
    big = 2**62 + 1
    rows = [(big, 0, "a", 10 * HOUR, 1.0), (big + 1, 0, "a", 5 * HOUR, 1.0)]
    assert [x.row_id for x in late.late_records(shaped(frame(spark, rows))).collect()] == [big + 1]


def test_the_verdict_is_the_roots_partial():
    t = 10**18 // HOUR * HOUR
    run = late._Run(HOUR, 6 * HOUR)
    for k in range(40):
        run.on_time(t + k * HOUR, (1, 0, 1.0, 1.0, 1.0, t + k * HOUR + 5))
    assert run.ended(t + 38 * HOUR) and not run.ended(t + 39 * HOUR)
    assert run.behind(t + 33 * HOUR + 5, 1.0) == "late" and run.behind(t + 33 * HOUR + 4, 1.0) == "dropped"
    n, n_late, total = run.tree.total()[:3]  # what the cut-off has left, the late one included
    assert (n, n_late, total) == (8, 1, 8.0)
    run.tree.root.cached = (*run.tree.root.cached[:5], t + 50 * HOUR)
    assert run.ended(t + 39 * HOUR) and run.behind(t + 43 * HOUR, 1.0) == "dropped"
