from datetime import UTC, datetime

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinewell.functions import domain as d
from brinewell.operators import archive, asof, backtest, calibration, constraints, matches, replay, serving, similarity, sinks
from brinewell.schemas import BETS
from brinewell.sources import configs, frames, markets, pages, synthetic

c = F.col


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()


# as-of joins -----------------------------------------------------------------------------------------------------------------


def facts(spark, rows):
    return spark.createDataFrame(rows, "id bigint, market_id string, ts_ns bigint, probability double")


def test_asof_boundaries(spark):
    probes = spark.createDataFrame([("m", t) for t in (1500, 2000, 5000, 500)] + [("x", 9), (None, 9), ("m", None)], "market_id string, ts_ns bigint")
    got = asof.asof_backward(probes, facts(spark, [(1, "m", 1000, 0.4), (2, "m", 2000, 0.6)]), "market_id", "ts_ns", "ts_ns", "id", "probability", "p").collect()
    assert sorted((str(r.market_id), r.ts_ns or -1, r.p) for r in got) == [("None", 9, None), ("m", -1, None), ("m", 500, None), ("m", 1500, 0.4), ("m", 2000, 0.6), ("m", 5000, 0.6), ("x", 9, None)]


@pytest.mark.parametrize("slot", [1, 7, 1000])
def test_asof_against_brute_force(spark, slot):
    r = random.Random(slot)
    rows = [(k, f"m{r.randrange(2)}", r.randrange(120), r.choice([None, r.random()])) for k in range(80)]
    probes = [(f"m{r.randrange(3)}", r.randrange(140)) for _ in range(150)]
    got = asof.asof_backward(spark.createDataFrame(probes, "market_id string, t bigint"), facts(spark, rows), "market_id", "t", "ts_ns", "id", "probability", "p", slot).collect()
    want = []
    for m, t in probes:
        known = max(((x[2], x[0], x[3]) for x in rows if x[1] == m and x[2] <= t), key=lambda x: x[:2], default=(0, 0, None))
        want.append((m, t, known[2]))
    assert sorted(map(str, want)) == sorted(str(tuple(x)) for x in got)


def test_latency(spark):
    s = spark.createDataFrame([("m", 1000)], "market_id string, ts_ns bigint")
    got = asof.asof_with_latency(s, facts(spark, [(1, "m", 1000, 0.5), (2, "m", 2000, 0.7)]), 1000).first()
    assert (got.signal_price, got.exec_ns, got.fill_price) == (0.5, 2000, 0.7)


# replay ----------------------------------------------------------------------------------------------------------------------


def test_replay_tie_of_all_sources(spark):
    at = lambda n: spark.createDataFrame([(k, "m", 7) for k in (2, 1)], "id bigint, market_id string, ts_ns bigint")
    names = ["cross_source", "model_prediction", "feature", "probability", "bet"]
    got = [(r.source, r.row_id) for r in replay.in_order(replay.replay({n: at(n) for n in names})).collect()]
    assert got == [(n, k) for n in ("bet", "probability", "feature", "model_prediction", "cross_source") for k in (1, 2)]


def test_replay_order_and_bounds(spark):
    at = lambda t, n: spark.createDataFrame([(1, "m", t, n)], "id bigint, market_id string, ts_ns bigint, x string")
    sources = {"bet": at(0, "b"), "model_prediction": at(0, "p"), "feature": at(1, "f"), "cross_source": at(1, "c"), "probability": at(2, "s")}
    got = [(r.source, r.payload["x"]) for r in replay.in_order(replay.replay(sources)).collect()]
    assert got == [("bet", "b"), ("model_prediction", "p"), ("feature", "f"), ("cross_source", "c"), ("probability", "s")]
    assert [r.source for r in replay.in_order(replay.replay(sources, 1, 1)).collect()] == ["feature", "cross_source"]


# constraints -----------------------------------------------------------------------------------------------------------------

GROUPS = {
    "groups": [
        {"id": "g", "markets": [{"key": k, "manifold_market_id": k} for k in ("semi", "final", "title")],
         "constraints": [{"lhs": "title", "rhs": "final"}, {"lhs": "final", "op": "<=", "rhs": "semi"}]},
    ]
}


def test_violations_skip_missing_prices(spark):
    rows = spark.createDataFrame(configs.constraint_rows(GROUPS), configs.CONSTRAINTS)
    prices = spark.createDataFrame([("title", 0.5), ("final", 0.4)], "market_id string, probability double")
    found = constraints.violations(rows, prices).collect()
    assert len(found) == 1 and found[0].gross == pytest.approx(0.1) and found[0].net == pytest.approx(0.06)
    assert (found[0].actionable, found[0].dear_market, found[0].cheap_market) == (True, "title", "final")
    report = {r.pos: (r.holds, r.consistent) for r in constraints.group_report(rows, prices).collect()}
    assert report == {0: (False, False), 1: (True, False)}
    legs = constraints.two_legs(constraints.violations(rows, prices)).collect()
    assert {(r.market_id, r.side) for r in legs} == {("title", "NO"), ("final", "YES")}
    signal = constraints.constraint_signals(constraints.violations(rows, prices), "t").first()
    assert json.loads(signal.market_refs) == ["title", "final"] and json.loads(signal.details_json)["op"] == "<="


@pytest.mark.parametrize("change", [{"op": "<"}, {"rhs": "title"}, {"rhs": "nobody"}])
def test_bad_configs(change):
    g = json.loads(json.dumps(GROUPS))
    g["groups"][0]["constraints"][0].update(change)
    with pytest.raises(ValueError):
        configs.constraint_rows(g)


def test_config_file(spark, tmp_path):
    p = tmp_path / "g.yaml"
    p.write_text(json.dumps(GROUPS))  # JSON is YAML
    assert configs.read_constraints(spark, str(p)).count() == 2


def test_entries_remember_over_satisfied_ticks(spark):
    ticks = [(0.1, 0.06), (0.0, -0.04), (0.1, 0.06), (0.03, -0.01), (0.1, 0.06)]
    df = spark.createDataFrame([("c", k, g, n) for k, (g, n) in enumerate(ticks)], "constraint_id string, ts_ns bigint, gross double, net double")
    assert sorted(r.ts_ns for r in constraints.entries(df).collect()) == [0, 4]
    assert sorted(r.ts_ns for r in constraints.entries(df, strict_edges=True).collect()) == [0, 2, 4]


def test_divergence(spark):
    matches = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "manifold_market_id string, external_market_id string")
    own = spark.createDataFrame([("a", 0.30), ("b", 0.5)], "market_id string, probability double")
    other = spark.createDataFrame([("x", 0.45), ("y", 0.52), ("z", 0.1)], "external_market_id string, community_prediction double")
    got = constraints.divergences(matches, own, other).collect()
    assert [(r.manifold_market_id, r.direction) for r in got] == [("a", "polymarket_higher")] and got[0].edge == pytest.approx(-0.15)


# calibration -----------------------------------------------------------------------------------------------------------------


def pairs(spark, ys, ps):
    return spark.createDataFrame([(f"m{k}", y, p) for k, (y, p) in enumerate(zip(ys, ps))], "market_id string, y int, p double")


def test_scores(spark):
    assert pairs(spark, [1, 0, 1], [0.8, 0.3, 0.6]).agg(calibration.brier()).first()[0] == pytest.approx(0.29 / 3)
    curve = calibration.reliability(pairs(spark, [0, 0, 1, 1], [0.1, 0.2, 0.7, 0.9]), 2)
    assert [(r["count"], r.mean_predicted, r.observed) for r in curve.orderBy("bin").collect()] == [(2, pytest.approx(0.15), 0.0), (2, pytest.approx(0.8), 1.0)]
    assert calibration.calibration_error(curve).first()[0] == pytest.approx(0.175)
    empty = calibration.reliability(pairs(spark, [1, 1], [0.9, 0.95]), 2).orderBy("bin").collect()
    assert (empty[0]["count"], empty[0].mean_predicted) == (0, None)
    assert calibration.reliability(pairs(spark, [1], [1.0]), 10).orderBy("bin").collect()[9]["count"] == 1
    assert calibration.report(pairs(spark, [1, 0], [1.0, 0.0])).first().log_loss == pytest.approx(1e-6, rel=1e-3)
    assert calibration.calibration_error(calibration.reliability(pairs(spark, [], []), 3)).first()[0] is None


def test_guard_and_fan_out(spark):
    f = spark.createDataFrame([("a", t, float(t)) for t in (1, 1, 2, 3)], "market_id string, ts_ns bigint, prob_velocity double")
    m = spark.createDataFrame([("a", "manifold", "", 1), ("b", "manifold", "", None)], "market_id string, platform string, close_time string, resolved_outcome int")
    p = facts(spark, [(1, "a", 1, 0.1), (2, "a", 1, 0.2)])
    rows = calibration.training_rows(f, m, p)
    assert rows.count() == 2 * 2 + 2 and calibration.priced(rows).count() == 4
    assert calibration.not_ahead(rows.withColumn("close_ns", F.lit(3))).where("ts_ns = 3").count() == 0
    assert calibration.not_ahead(rows.withColumn("close_ns", F.lit(None).cast("bigint"))).count() == 6


def test_edges(spark):
    rows = spark.createDataFrame([(0.7, 0.5), (0.3, 0.5), (0.5, 0.5)], "p_model double, p_market double")
    got = calibration.predictions(rows).collect()
    assert [(r.side, round(r.edge, 9), round(r.ev, 9)) for r in got] == [("YES", 0.2, 0.2), ("NO", -0.2, 0.2), ("YES", 0.0, 0.0)]
    assert calibration.predictions(rows, min_ev=0.0).count() == 2


def test_model(spark):
    r = random.Random(2)
    rows = [(x := r.gauss(0, 1), r.gauss(0, 1) if k % 7 else None, None, float("nan") if k % 9 == 0 else 1.0, int(r.random() < 1 / (1 + 2.7 ** (-2 * x)))) for k in range(400)]
    df = spark.createDataFrame(rows, "prob_velocity double, bet_arrival_rate double, realized_vol double, market_prob double, y int")
    with pytest.raises(RuntimeError):
        calibration.BaselineModel().predict(df)
    scored = calibration.BaselineModel().fit(df).predict(df)
    assert scored.agg(F.avg((F.round("p_model") == c("y")).cast("int"))).first()[0] > 0.7
    assert calibration.BaselineModel().fit(df.where("y = 1")).predict(df).select("p_model").distinct().first()[0] == 1.0
    assert calibration.BaselineModel().fit(df.where("false")).predict(df).select("p_model").distinct().first()[0] == 0.5
    a, b = calibration.split_by_market(spark.createDataFrame([(f"m{k % 50}", k) for k in range(500)], "market_id string, k int"))
    assert a.count() + b.count() == 500 and a.join(b, "market_id").count() == 0


# fills -----------------------------------------------------------------------------------------------------------------------


def test_fill_keeps_the_invariant(spark):
    for p, w in ((0.7, 0.5), (0.3, 0.5), (0.7, 0.6), (0.25, 0.4)):
        yes, no = d.pool_yes(F.lit(p), F.lit(100.0), F.lit(w)), d.pool_no(F.lit(p), F.lit(100.0), F.lit(w))
        for side in ("YES", "NO"):
            shares = d.fill_shares(F.lit(side), F.lit(10.0), yes, no, F.lit(w))
            up = side == "YES"
            after = d.pool_invariant(yes + 10 - shares if up else yes + 10, no + 10 if up else no + 10 - shares, F.lit(w))
            r = one(spark, p=d.pool_probability(yes, no, F.lit(w)), total=yes + no, k=d.pool_invariant(yes, no, F.lit(w)), after=after)
            assert (r.p, r.total, r.after) == (pytest.approx(p), pytest.approx(100), pytest.approx(r.k))
    r = one(spark, s=d.fill_shares(F.lit("YES"), F.lit(10.0), F.lit(100.0), F.lit(100.0), F.lit(0.5)))
    assert r.s == pytest.approx(2100 / 110)


def test_executions_and_totals(spark):
    s = spark.createDataFrame([("m", 1000, "YES", 10.0), ("m", 1, "NO", 10.0), ("e", 1000, "YES", 10.0)], "market_id string, ts_ns bigint, side string, stake double")
    got = backtest.executions(s, facts(spark, [(1, "m", 1000, 0.5), (2, "m", 2000, 0.7), (3, "e", 1, 1.0)]), latency_ns=1000).collect()
    assert sorted((r.market_id, r.ts_ns, r.fill_price, r.error) for r in got) == [("e", 1000, 1.0, "price out of range"), ("m", 1, 0.5, None), ("m", 1000, 0.7, None)]
    trades = spark.createDataFrame([("a", "YES", 200.0, 100.0), ("b", "YES", 200.0, 100.0)], "market_id string, side string, shares double, cost double")
    outcomes = spark.createDataFrame([("a", 1), ("b", 0)], "market_id string, resolved_outcome int")
    t = backtest.totals(backtest.settled(trades, outcomes)).first()
    assert (t.n, t.wins, t.hit_rate, t.pnl, t.roi) == (2, 1, 0.5, 0.0, 0.0)
    with pytest.raises(Exception, match="no trades"):
        backtest.require_trades(backtest.totals(backtest.settled(trades.where("false"), outcomes))).collect()
    assert one(spark, x=d.settle(F.lit("NO"), F.lit(0), F.lit(100.0), F.lit(50.0))).x == 50


# similarity ------------------------------------------------------------------------------------------------------------------


def test_top_matches(spark):
    schema = "id bigint, v array<float>, day double"
    left = spark.createDataFrame([(1, [1.0, 0.0], 0.0), (2, [0.0, 0.0], None), (3, None, 1.0)], schema)
    right = spark.createDataFrame([(10, [1.0, 0.0], 0.0), (11, [1.0, 0.0], 15.0), (12, [1.0, 0.0], 60.0), (13, [0.0, 1.0], None), (14, [1.0], 0.0), (15, None, 0.0), (16, [2.0, 0.0], 0.0)], schema)
    got = [(r.left_id, r.right_id, round(r.score, 3), r["rank"]) for r in similarity.top_matches(left, right).orderBy("left_id", "rank").collect()]
    assert got == [(1, 10, 1.0, 1), (1, 16, 1.0, 2), (1, 11, 0.9, 3)]
    assert similarity.top_matches(left.where("false"), right).count() == 0


def test_not_yet_known(spark):
    new = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, n int")
    assert [r.k for r in similarity.not_yet_known(new, new.where("k = 'b'"), ["k"]).collect()] == ["a"]


# sources ---------------------------------------------------------------------------------------------------------------------


def test_frames(spark):
    bet = lambda m, t: {"id": "1", "contractId": m, "createdTime": t, "probBefore": 0.5, "probAfter": 0.6, "amount": 1.0, "shares": 2.0}
    texts = [json.dumps({"type": "broadcast", "topic": "t", "data": {"bets": [bet("m1", 1000), None, bet("m2", -5)]}}), '{"type":"ack","success":true}', "pong", '{"type":"odd"}', None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "line int, text string")
    parsed = frames.parse_frames(df, "text")
    assert [r.line for r in parsed.orderBy("line").collect()] == [0, 1]
    got = frames.domain_bets(frames.flatten(parsed, c("frame.data.bets"), "line"), "line", "bet_pos").collect()
    assert [(r.bet_pos, r.market_id, r.ts_ns, r.is_limit_order) for r in got] == [(0, "m1", 10**9, 0), (2, "m2", 0, 0)]


def test_polymarket(spark):
    row = lambda o, p, **k: {"conditionId": "0x", "id": "i", "question": " q ", "outcomes": o, "outcomePrices": p, "volumeNum": None, "volume": "7", "endDate": None, "active": True, "closed": False} | k  # noqa: E731, E501
    rows = [
        row('["Yes", "No"]', '["0.3", "0.7"]'), row('["No", " YES "]', '["0.3", "0.7"]', conditionId=None), row('["Up", "Down"]', '["0.1", "0.9"]', volume="x"), row("[]", "[]"),
        row('["Yes", "No"]', '["0.3"]'), row('["Yes", "No"]', '["x", "0.7"]'), row('["Yes", "No"]', '["1.3", "0.7"]'), row("oops", None), row('["Yes", "No"]', '["0.3", "0.7"]', closed=True),
        row('["Yes", "No"]', '["0.3", "0.7"]', active=False),
    ]
    schema = "conditionId string, id string, question string, outcomes string, outcomePrices string, volumeNum double, volume string, endDate string, active boolean, closed boolean"
    got = markets.normalize_polymarket(spark.createDataFrame(rows, schema)).collect()
    assert [(r.market_id, r.question_text, r.probability, r.volume) for r in got] == [("0x", "q", 0.3, 7.0), ("i", "q", 0.7, 7.0), ("0x", "q", 0.1, None)]


def test_categories(spark):
    rows = spark.createDataFrame([(["ukraine-war"],), (["us-politics"],), (["Sports", "NBA-finals"],), ([],), (None,)], "s array<string>")
    assert [r[0] for r in rows.select(d.category_of(c("s"))).collect()] == ["Tech", "Politics", "NBA", None, None]


def test_buckets(spark):
    rows = spark.createDataFrame([("x", "a", 3), ("x", "b", 2), ("y", "a", 9), ("y", "c", 1), ("y", "d", 0)], "bucket string, k string, liquidity int")
    got = markets.filled_buckets(rows, "bucket", "k", [c("liquidity").desc(), c("k")], [("x", 1), ("y", 2)])
    assert got == [("x", "a"), ("y", "c"), ("y", "d")]


def test_synthetic(spark):
    rows = list(synthetic.sequence(200, 4, 42))
    assert rows == list(synthetic.sequence(200, 4, 42)) and rows != list(synthetic.sequence(200, 4, 43))
    assert all(0.01 <= r[4] <= 0.99 and 10 <= r[5] < 100 for r in rows) and [r[1] for r in rows[:5]] == [f"synthetic-market-{k}" for k in (0, 1, 2, 3, 0)]
    assert synthetic.load(spark, 30, 5).groupBy("market_id").count().where("count = 30").count() == 5
    made = [synthetic.demo_series(spark, {"a": 0.9, "b": 0.01}, 10).orderBy("id").collect() for _ in range(2)]
    assert made[0] == made[1] and (made[0][9].probability, made[0][19].probability) == (0.9, 0.02) and all(0.02 <= r.probability <= 0.98 for r in made[0])


def test_reports(spark, tmp_path):
    (tmp_path / "latency-v1.md").write_text("# x\n| unpaced throughput | 70,586 ev/s | 110,297 ev/s | 194,444 ev/s |\n")
    (tmp_path / "other.md").write_text("y")
    r = configs.read_reports(spark, str(tmp_path), "latency").select("name", *configs.throughput(c("text"))).collect()
    assert [tuple(x) for x in r] == [("latency-v1.md", 70586.0, 110297.0, 194444.0)]


# scalar functions ------------------------------------------------------------------------------------------------------------


def test_iso_reads_what_the_standard_library_reads(spark):
    days = ["2018-04-21", "20180421", "2018-W16-6", "2018W166", "2018-W16", "2018W53", "2020-W53-7", "2018-02-29", "2020-02-29", "0000-01-01", "2018-W16-8", "201804", "2018-4-21"]
    times = ["", "T12", "T12:30", "x1230", " 12:30:15", "T123015", "T12:30:15.1", "T12:30:15,123456789", "T123015.25", "T25:00", "T12:60", "T12:3", "T"]
    zones = ["", "Z", "+00:00", "-0530", "+05", "+05:30:15", "-23:59", "+24:00", "+05:60", " UTC"]
    texts = [a + b + z for a in days for b in times for z in zones]

    def want(t):
        try:
            at = datetime.fromisoformat(t)
        except ValueError:
            return None
        gap = (at if at.tzinfo else at.replace(tzinfo=UTC)) - datetime(1970, 1, 1, tzinfo=UTC)
        return ((gap.days * 86_400 + gap.seconds) * 10**6 + gap.microseconds) * 1000

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", d.iso_ns(c("t")).alias("ns")).collect()
    assert [(r.t, r.ns, want(r.t)) for r in got if r.ns != want(r.t)] == []


def test_times(spark):
    rows = spark.createDataFrame([("2018-04-21T12:00:00.123000+00:00",), ("2018-04-21T12:00:00Z",), ("2018-04-21 12:00:00",), ("2018-04-21",), ("",), (None,), ("2018-02-30T00:00:00Z",)], "t string")
    assert [r[0] for r in rows.select(d.iso_ns(c("t"))).collect()] == [1524312000123000000, 1524312000000000000, 1524312000000000000, 1524268800000000000, None, None, None]
    ms = spark.createDataFrame([(None,), (0,), (1524312000000,), (1524312000123,)], "ms bigint")
    assert [r[0] for r in ms.select(d.ms_to_iso(c("ms"))).collect()] == ["", "", "2018-04-21T12:00:00+00:00", "2018-04-21T12:00:00.123000+00:00"]
    assert one(spark, a=d.ns_to_date(F.lit(-1)), b=d.ns_to_date(F.lit(86_400 * 10**9))).asDict() == {"a": "1969-12-31", "b": "1970-01-02"}


def test_texts(spark):
    r = one(spark, a=d.percent(F.lit(0.256)), b=d.percent(F.lit(None).cast("double")), e=d.signed_points(F.lit(-0.034)), f=d.ref_label(F.lit(None).cast("string"), F.lit("0xabcdef0123456789")), g=d.date_factor(F.lit(15.0)), h=d.date_factor(F.lit(None).cast("double")))
    assert r.asDict() == {"a": "25.6%", "b": "—", "e": "-3.4 pp", "f": "0xabcd…6789", "g": 0.5, "h": 1.0}


def test_formats(spark):
    rows = spark.createDataFrame([(0.0625, -0.0304, 1521417659999999999, "2026-09-20T23:30:00-02:00"), (None, None, None, None), (float("nan"), float("nan"), 0, ""), (1.0, 0.0, 1, "soon")], "p double, e double, t bigint, i string")
    got = [tuple(r) for r in rows.select(d.percent(c("p")), d.signed_points(c("e")), d.signed_value(c("e")), d.minute_text(c("t")), d.date_text(c("i"))).collect()]
    dash = d.DASH
    assert got == [("6.3%", "-3.0 pp", "-0.030", "2018-03-19 00:00 UTC", "Sep 21, 2026"), (dash,) * 5, (dash, dash, dash, "1970-01-01 00:00 UTC", dash), ("100.0%", "+0.0 pp", "+0.000", "1970-01-01 00:00 UTC", "soon")]
    spans = spark.createDataFrame([(0.4, 1.2), (0.6, 0.2), (None, 0.1), (0.5, 0.5)], "a double, b double")
    assert [tuple(r) for r in spans.select(*d.edge_span(c("a"), c("b"))).collect()] == [(0.4, 1.0, True), (0.2, 0.6, False), (None, None, None), (0.5, 0.5, True)]


# pages, matches, passes ------------------------------------------------------------------------------------------------------


def test_page_files(spark, tmp_path):
    every = [[{"id": f"{p}-{k}", "volume": float(k)} for k in range(n)] for p, n in ((1, pages.PAGE), (2, 3), (3, 9))]
    assert pages.land_pages(iter(every), str(tmp_path / "p")) == 2  # a short page is the last one
    (tmp_path / "p/page-000009.json").write_text("{broken")
    rows = pages.read_pages(spark, str(tmp_path / "p"), "id string, volume double, other int")
    assert rows.count() == pages.PAGE + 3 and rows.where("id is null").count() == 0
    assert [r.id for r in pages.scan(rows, c("id").startswith("2"), [c("volume").desc()], 2).collect()] == ["2-2", "2-1"]
    raw = spark.createDataFrame([("a", "Will X win?", "BINARY", ["t"], False, 5.0), ("b", "will y WIN", "BINARY", ["u"], None, 9.0), ("c", "win", "MULTI", ["t"], False, 99.0), ("d", "win", "BINARY", ["t"], True, 7.0)],
                                "id string, question string, outcomeType string, groupSlugs array<string>, isResolved boolean, totalLiquidity double")
    found = lambda **k: [r.id for r in pages.search(raw, **k).collect()]
    assert found(term="win") == ["b", "a"] and found(term="WIN", topic="t", state="all") == ["d", "a"] and found(state="resolved") == ["d"] and found(limit=1) == ["b"]
    assert [r.id for r in pages.liquid(raw.withColumnRenamed("totalLiquidity", "liquidity"), 7.0).collect()] == ["b", "c", "d"]
    old = spark.createDataFrame([(k, "m", k, 0.5 if k else None) for k in range(2500)], "id bigint, market_id string, ts_ns bigint, prob_after double")
    assert pages.newest_bets(old, 2000).agg(F.min("id"), F.count("*")).first() == (500, 2000) and pages.newest_bets(old, 3000).count() == 2499


def test_known_matches(spark):
    known = spark.createDataFrame([(5, "a", "polymarket", "x", 0.5, "pending"), (3, "a", "polymarket", "x", 0.9, "rejected"), (4, "b", "polymarket", "y", None, "confirmed")], "id bigint, manifold_market_id string, platform string, external_market_id string, confidence double, status string")  # noqa: E501
    assert sorted((r.id, r.status) for r in matches.oldest(known).collect()) == [(3, "rejected"), (4, "confirmed")]
    assert [r.id for r in matches.by_status(known, "pending").collect()] == [5] and matches.by_id(known, 9).count() == 0 and matches.by_id(known, 4).count() == 1
    new = spark.createDataFrame([("a", "x"), ("c", "z"), ("c", "z")], "manifold_market_id string, external_market_id string")
    assert [tuple(r) for r in matches.loaded(new, known).select("manifold_market_id", "status").collect()] == [("c", "confirmed")]


def test_export_in_passes(spark, tmp_path):
    day = 86_400 * 10**9
    rows = lambda *ids: {"t": spark.createDataFrame([(k, k * day // 2) for k in ids], "id bigint, ts_ns bigint")}
    path = str(tmp_path / "x")
    assert archive.export_new(rows(1, 2, 3), path) == {"t": 3} and archive.export_new(rows(1, 2, 3, 4, 5), path) == {"t": 5} and archive.export_new(rows(1, 5), path) == {"t": 5}
    got = archive.exported(spark, path, "t").select("id", c("dt").cast("string").alias("dt")).collect()
    assert sorted(map(tuple, got)) == [(1, "1970-01-01"), (2, "1970-01-02"), (3, "1970-01-02"), (4, "1970-01-03"), (5, "1970-01-03")]


def test_loop_goes_on_after_an_error():
    seen, waits = [], []

    def action():
        seen.append(1)
        if len(seen) == 2:
            raise OSError

    assert archive.repeated(action, 3600.0, most=4, errors=(OSError,), wait=waits.append) == 4 and len(seen) == 4 and waits == [3600.0] * 3


def test_backfill(spark):
    known = {
        "markets": spark.createDataFrame([("a", "x", "old", "", None, None), ("b", "x", "kept", "", 1, None)], "market_id string, platform string, question_text string, close_time string, resolved_outcome int, category string"),
        "bets": spark.createDataFrame([(1, "a", 1, 0.1, 0.2, 1.0, 1.0, 0), (2, "b", 1, 0.1, 0.2, 1.0, 1.0, 0)], BETS),
        "probability_snapshots": spark.createDataFrame([(1, "a", 1, 0.2, None), (2, "b", 1, 0.2, None)], "id bigint, market_id string, ts_ns bigint, probability double, volume_24h double"),
        "feature_snapshots": spark.createDataFrame([(1, "a", 1, 0.0, 0.0, 0.0), (2, "b", 1, 0.0, 0.0, 0.0)], "id bigint, market_id string, ts_ns bigint, prob_velocity double, bet_arrival_rate double, realized_vol double"),
    }
    given = spark.createDataFrame([("a", "new", "", None, "Tech", 0.7), ("b", "bad", "", None, "Tech", 1.7), ("c", "first", "", None, "Tech", 0.5)], "market_id string, question_text string, close_time string, resolved_outcome int, category string, probability double")
    fresh = spark.createDataFrame([(10, "a", 5, 0.3, 0.4, 1.0, 1.0, 0), (11, "a", 5, 0.4, 0.6, 1.0, 1.0, 0), (12, "b", 5, 0.4, 0.6, 1.0, 1.0, 0)], BETS)
    got = archive.backfill(known, given, fresh, now_ns=100, points=2)
    assert sorted((r.market_id, r.question_text, r.category) for r in got["markets"].collect()) == [("a", "new", "Tech"), ("b", "kept", None), ("c", "first", "Tech")]
    assert sorted(r.id for r in got["bets"].collect()) == [2, 10, 11]
    assert sorted((r.market_id, r.ts_ns, r.probability) for r in got["probability_snapshots"].collect()) == [("a", 5, 0.6), ("a", 100, 0.7), ("b", 1, 0.2), ("c", 100, 0.5)]
    assert sorted((r.market_id, r.ts_ns) for r in got["feature_snapshots"].collect()) == [("a", 100), ("b", 1), ("c", 100)]


def test_totals_with_edges(spark):
    trades = spark.createDataFrame([(100.0, 100.0, 50.0, 0.1), (50.0, 52.0, -52.0, 0.2)], "stake double, cost double, pnl double, theoretical_edge double")
    r = backtest.totals(trades).first()
    assert (r.n, r.wins, r.stake, r.payout, r.theoretical_pnl) == (2, 1, 150.0, 150.0, 20.0) and r.realized_edge == pytest.approx(-2 / 150) and r.theoretical_edge == pytest.approx(20 / 150)
    text = serving.backtest_markdown(r.asDict(), "T", "note", "2018")
    assert "| Realized edge (P&L / stake) | -0.0133 |" in text and "| **Realized P&L** | **-2.00** |" in text and "| Hit rate | 50.0% |" in text


def test_reports_of_scores_and_latencies(spark):
    rows = spark.createDataFrame([("m", 1, 0.8), ("n", 0, 0.2), ("n", 1, 0.25)], "market_id string, y int, p double")
    report, curve = calibration.report(rows).first().asDict(), [r.asDict() for r in calibration.reliability(rows).collect()]
    text = serving.calibration_markdown(report, curve, "T", "note")
    assert "| [0.20, 0.30) | 2 | 0.2250 | 0.5000 |" in text and "[0.00" not in text and "Base rate (YES fraction): 0.6667" in text
    assert "**Verdict:** the market price is better calibrated." in serving.live_markdown(report, report, "T")
    r = serving.latency_report(spark.createDataFrame([(1500,), (2500,)], "w bigint"), "w").first().asDict()
    assert "| a | 2 | 1.500 | 2.501 |" in serving.latency_markdown({"a": r}, "T", {"Events": 2})


def test_injected_model_and_encoder(spark):
    class Model:
        def predict_proba(self, frame):
            return np.column_stack([1 - frame["x"], frame["x"]])

    rows = spark.createDataFrame([(0.25, "k"), (0.5, "k")], "x double, p_model string")
    assert [r.score for r in calibration.predicted_by(rows, Model(), ("x",), "score").collect()] == [0.25, 0.5]
    words = ["rain", "snow", "wind"]
    encoder = lambda texts: np.array([[float(w in t) for w in words] for t in texts])
    left = spark.createDataFrame([(1, "rain and wind", 0.0), (2, None, 0.0)], "id bigint, text string, day double")
    right = spark.createDataFrame([(7, "wind and rain", 0.0), (8, "snow", 0.0), (9, "rain", 40.0), (10, None, 0.0)], "id bigint, text string, day double")
    got = [(r.left_id, r.right_id, round(r.score, 4)) for r in similarity.ranked(similarity.match_texts(left, right, encoder, threshold=0.5)).collect()]
    assert got == [(1, 7, 1.0), (1, 9, 0.5657)]


def test_model_against_plain_newton(spark):
    """The ridge of C = 1 on standardized columns: the same probabilities as Newton's method."""
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 2)) * [1.0, 5.0]
    y = (r.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 0.2 * x[:, 1])))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y)], "a double, b double, y double")
    got = [row.p_model for row in calibration.BaselineModel(("a", "b")).fit(df).predict(df).collect()]
    z = np.column_stack([np.ones(400), (x - x.mean(0)) / x.std(0)])
    w, ridge = np.zeros(3), np.diag([0.0, 1.0, 1.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (p - y) + ridge @ w)
    assert np.abs(np.array(got) - 1 / (1 + np.exp(-z @ w))).max() < 1e-4


# serving and sinks -----------------------------------------------------------------------------------------------------------


def test_pages(spark):
    s = spark.createDataFrame([(k, "logical_constraint" if k % 2 else "cross_source_divergence", '["a"]', 0.1, f"2018-0{k}-01", "{}") for k in (1, 2, 3)], "id bigint, type string, market_refs string, edge double, detected_at string, details_json string")
    assert [r.id for r in serving.page(s).collect()] == [3, 2, 1] and [r.id for r in serving.page(s, "logical_constraint", 1, 1).collect()] == [1]
    assert serving.pager(120, 50, 50) == {"start": 51, "end": 100, "has_prev": True, "has_next": True}
    for bad in (0, 201):
        with pytest.raises(ValueError):
            serving.page(s, limit=bad)
    assert serving.mentioning(s, "a").count() == 3 and serving.mentioning(s, "b").count() == 0
    m = spark.createDataFrame([("a", "Why?")], "market_id string, question_text string")
    assert serving.signal_labels(s, m).first().labels == {"a": "Why?"}
    rows = spark.createDataFrame([("a", 0.2), ("b", None), ("z", -0.5)], "market_id string, edge double")
    assert [r.market_id for r in rows.orderBy(*serving.explorer_order("edge")).collect()] == ["b", "z", "a"]
    assert serving.featured(rows).first().market_id == "z"
    assert "| a | 0.2 |" in serving.markdown(rows, "t")


def test_changes(spark, tmp_path):
    known = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "market_id string, x int")
    new = spark.createDataFrame([("b", 9), ("c", 5), ("c", 7)], "market_id string, x int")
    assert sorted(map(tuple, sinks.replaced(known.where("x < 3"), new, "market_id").collect())) == [("a", 1), ("b", 9), ("c", 7)]
    assert sorted(map(tuple, sinks.refilled(known, new, "market_id").collect())) == [("a", 1), ("b", 9), ("c", 5), ("c", 7)]
    day = 86_400 * 10**9
    rows = spark.createDataFrame([(k, k * day // 2) for k in range(8)], "id bigint, ts_ns bigint")
    sinks.write_by_date(rows, str(tmp_path / "d"))
    got = sinks.read_by_date(spark, str(tmp_path / "d"), day, 2 * day)
    assert sorted(r.id for r in got.collect()) == [2, 3, 4]
    assert "PartitionFilters: [isnotnull(dt" in got._jdf.queryExecution().toString()
    kinds = spark.createDataFrame([("x", 1), ("y", 2)], "type string, n int")
    sinks.replace_kind(kinds, str(tmp_path / "k"))
    sinks.replace_kind(kinds.where("type = 'x'").withColumn("n", F.lit(7)), str(tmp_path / "k"))
    assert sorted((r.type, r.n) for r in spark.read.parquet(str(tmp_path / "k")).collect()) == [("x", 7), ("y", 2)]


def test_stage_times(spark):
    rows = spark.createDataFrame([(1, 3, 6), (5, 4, 9), (1, None, 2)], "a bigint, b bigint, z bigint")
    assert [(r.a_b, r.b_z, r.a_z) for r in serving.stage_times(rows, ["a", "b", "z"]).collect()] == [(2, 3, 5), (None, 5, 4), (None, None, 1)]
    r = serving.latency_report(spark.createDataFrame([(k,) for k in range(1, 101)], "w bigint"), "w").first()
    assert (r.n, r.p50, r.p999, r.greatest, r.mean) == (100, 50, 100, 100, 50.5)


def test_histogram_of_three_digits(spark):
    r = random.Random(5)
    values = [r.randrange(1, 10 ** r.randint(1, 13)) for _ in range(3000)]
    got = serving.latency_report(spark.createDataFrame([(v,) for v in values], "w bigint"), "w").first()
    held = sorted(min(v, 60_000_000_000) for v in values)
    for q, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"), (0.999, "p999")):
        exact = held[max(1, math.ceil(q * len(held))) - 1]
        assert exact <= got[name] <= exact * 1.001 + 1
    assert got.n == 3000 and serving.histogram(spark.createDataFrame([(v,) for v in values], "w bigint"), "w").agg(F.sum("n")).first()[0] == 3000
    assert serving.latency_report(spark.createDataFrame([], "w bigint"), "w").first().n == 0


def test_first_mark_wins_and_order_is_checked(spark):
    marks = [(1, "a", 5, 1), (1, "a", 3, 2), (1, "b", 9, 3), (2, "a", 5, 1), (2, "c", 4, 2), (3, "b", 1, 1), (4, "a", 7, 2), (4, "b", 6, 1), (4, "c", 9, 3)]
    rows = serving.first_marks(spark.createDataFrame(marks, "k int, stage string, at bigint, n int"), "k", "stage", "at", "n", ["a", "b", "c"])
    got = {r.k: (r.a, r.b, r.c, r.ok) for r in rows.withColumn("ok", serving.monotonic(["a", "b", "c"])).collect()}
    assert got == {1: (5, 9, None, True), 2: (5, None, 4, False), 3: (None, 1, None, True), 4: (7, 6, 9, False)}


def test_events_by_interval(spark):
    rows = spark.createDataFrame([(0,), (999,), (1000,), (90_000_000,), (None,)], "at bigint")
    assert sorted(map(tuple, serving.rates(rows, "at", 1).collect())) == [(0, 2, 2, 2.0), (1000, 1, 3, 1.0), (90_000_000, 1, 4, 1.0)]


def test_neighbours_over_blocks(spark):
    names = sorted({"".join(random.Random(k).choices("abc", k=5)) for k in range(120)})
    rows = constraints.neighbours(spark.createDataFrame([("g", n) for n in names], "group_id string, market_id string"), prefix=2)
    assert sorted((r.lhs_market, r.rhs_market) for r in rows.collect()) == list(zip(names, names[1:]))


def test_asof_with_latency_keeps_equal_signals(spark):
    s = spark.createDataFrame([("m", 1000), ("m", 1000), ("x", 5), (None, 7), ("m", None)], "market_id string, ts_ns bigint")
    got = sorted(asof.asof_with_latency(s, facts(spark, [(1, "m", 1000, 0.5), (2, "m", 2000, 0.7)]), 1000).collect(), key=str)
    assert [(r.market_id, r.ts_ns, r.signal_price, r.fill_price) for r in got] == sorted([("m", 1000, 0.5, 0.7)] * 2 + [("x", 5, None, None), (None, 7, None, None), ("m", None, None, None)], key=str)


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    r = random.Random(3)
    rows = spark.createDataFrame([(k, [r.gauss(0, 1) for _ in range(4)], float(k % 30)) for k in range(60)], "id bigint, v array<double>, day double")
    whole = sorted(map(tuple, similarity.top_matches(rows.where("id % 5 = 0"), rows, 3, 0.0).select("left_id", "right_id", "rank").collect()))
    monkeypatch.setattr(similarity, "BLOCK_QUERIES", 5)
    assert sorted(map(tuple, similarity.top_matches(rows.where("id % 5 = 0"), rows, 3, 0.0).select("left_id", "right_id", "rank").collect())) == whole
