"""Queries that once took a part of their tables."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from brinewell.functions.domain import iso_ns
from brinewell.functions.instants import epoch_ns
from brinewell.plans import reference_queries

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")


def rows(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def test_replay_has_every_event_in_order(spark):
    got = [tuple(r) for r in entry.queries()["r_w9_replay"](spark, SMALL).collect()]
    assert [r[:3] for r in got] == sorted(r[:3] for r in got)
    sizes = {"bet": "bets", "feature": "feature_snapshots", "cross_source": "cross_source_snapshots", "probability": "probability_snapshots"}
    want = {k: rows(spark, t).count() for k, t in sizes.items()}
    want["bet"] -= rows(spark, "bets").where(epoch_ns(F.col("ts_ns")).isNull()).count()
    want["cross_source"] -= rows(spark, "cross_source_snapshots").where(iso_ns(F.col("polled_at")).isNull()).count()  # S21: unreadable times
    assert {k: sum(r[3] == k for r in got) for k in sizes} == want


@pytest.fixture(scope="module")
def filled(spark):
    """Every bet with its price at once and an hour later, one by one."""
    known = {}
    for p in sorted(reference_queries.prices(spark, SMALL).collect(), key=lambda p: (p.ts_ns, p.id)):
        known.setdefault(p.market_id, []).append((p.ts_ns, p.probability))

    def at(market, ns):
        before = [v for t, v in known.get(market, []) if t <= ns]
        return before[-1] if before else None

    return {b.id: (b.market_id, at(b.market_id, b.ts_ns), at(b.market_id, b.ts_ns + 3_600_000_000_000)) for b in reference_queries.bets(spark, SMALL).collect()}


def shares(side, price):
    yes = 200 / (1 + price / (1 - price))
    own, other = (yes, 200 - yes) if side == "YES" else (200 - yes, yes)
    return own + 10 - own * other / (other + 10)


def test_latency_of_every_bet(spark, filled):
    got = {r.id: (r.market_id, r.signal_price, r.fill_price) for r in entry.queries()["r_j5_latency"](spark, SMALL).collect()}
    assert got == filled


def test_execution_and_settlement_of_every_bet(spark, filled):
    side = {k: "YES" if k % 100 == 0 else "NO" for k in filled}
    want = {k: shares(side[k], p) if 0 < p < 1 else None for k, (_, _, p) in filled.items() if p is not None}
    got = {r.id: r.shares_e6 for r in entry.queries()["r_d12_executions"](spark, SMALL).where("error is null").collect()}
    assert got == {k: pytest.approx(v * 1e6, abs=1) for k, v in want.items() if v is not None}
    outcomes = {r.market_id: r.resolved_outcome for r in rows(spark, "markets").where("resolved_outcome is not null").collect()}
    won = lambda k: outcomes[filled[k][0]] == (side[k] == "YES")
    profits = [(v if won(k) else 0) - 10 for k, v in want.items() if v is not None and filled[k][0] in outcomes]
    total = entry.queries()["r_d13_a6_totals"](spark, SMALL).first()
    assert (total.n, total.wins) == (len(profits), sum(x > 0 for x in profits))
    assert total.pnl_e3 == pytest.approx(sum(profits) * 1e3, abs=1)
