import json
import random
import time

import pytest
from pyspark.sql import functions as F

from brinewell.operators import features, sinks
from brinewell.schemas import BETS
from brinewell.sources import synthetic
from brinewell.streaming import features as live

S = 10**9

def test_stream_equals_batch_over_several_files(spark, tmp_path):
    r = random.Random(4)
    rows = [(k, f"m{r.randrange(4)}", k * S // 3, r.random(), r.random(), 1.0, 1.0, 0) for k in range(400)]
    for n in range(4):
        spark.createDataFrame(rows[n * 100 : n * 100 + 100], BETS).repartition(3).write.parquet(str(tmp_path / f"in/part{n}"))
    stream = spark.readStream.schema(BETS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    q = live.collect(stream, str(tmp_path / "out"), str(tmp_path / "cp"), window_ns=20 * S, capacity=16)
    q.awaitTermination(240)
    assert q.exception() is None
    got = {x.id: x for x in spark.read.parquet(str(tmp_path / "out/feature_snapshots")).collect()}
    want = {x.id: x for x in features.event_time_features(spark.createDataFrame(rows, BETS), 20 * S, 16).collect()}
    assert set(got) == set(want)
    assert spark.read.parquet(str(tmp_path / "out/bets")).count() == 400
    ordered = all(abs(got[k].prob_velocity - want[k].prob_velocity) < 1e-9 for k in want)
    assert ordered


def test_late_bets(spark, tmp_path):
    r = random.Random(9)
    rows = [(k, "hot" if r.random() < 0.6 else f"m{r.randrange(3)}", (k - (r.randrange(60) if r.random() < 0.3 else 0)) * S // 3 + 10**12, r.random(), r.random(), 1.0, 1.0, 0) for k in range(300)]
    for n in range(3):
        spark.createDataFrame(rows[n * 100 : n * 100 + 100], BETS).repartition(3).write.parquet(str(tmp_path / f"in/part{n}"))
    stream = spark.readStream.schema(BETS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    q = live.collect(stream, str(tmp_path / "out"), str(tmp_path / "cp"), window_ns=20 * S, capacity=16)
    q.awaitTermination(240)
    got = {x.id: x for x in spark.read.parquet(str(tmp_path / "out/feature_snapshots")).collect()}
    held = {}
    for k, m, t, before, after, *_ in rows:
        seen = held.setdefault(m, [])
        seen.append((t, before, after))
        own = [x for x in seen[-16:] if t - 20 * S <= x[0] <= t]
        want = ((after - own[0][1]) / 20, len(own) / 20, sum((y[2] - x[2]) ** 2 for x, y in zip(own, own[1:])) ** 0.5)
        assert (got[k].prob_velocity, got[k].bet_arrival_rate, got[k].realized_vol) == pytest.approx(want)
    assert len(got) == 300


def test_lander(spark, tmp_path):
    bet = {"id": "1", "contractId": "m", "createdTime": 1000, "probBefore": 0.5, "probAfter": 0.6, "amount": 1.0, "shares": 2.0}
    frames = [json.dumps({"type": "broadcast", "data": {"bets": [bet] * n}}) for n in (1, 2)] + ["pong", "[]"]
    assert live.land(iter(frames), str(tmp_path / "in"), per_file=1) == 4 and live.land(iter(frames), str(tmp_path / "in"), first_line=4) == 8
    q = live.read_frames(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("landed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(r.id - live.PLACES * (r.id // live.PLACES) + 10 * (r.id // live.PLACES) for r in spark.table("landed").collect()) == [0, 10, 11, 40, 50, 51]


def test_frames_from_files(spark, tmp_path):
    bet = {"id": "1", "contractId": "m", "createdTime": 1000, "probBefore": 0.5, "probAfter": 0.6, "amount": 1.0, "shares": 2.0}
    lines = [{"line_no": 1, "type": "broadcast", "data": {"bets": [bet, None, bet]}}, {"line_no": 2, "type": "ack"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, lines)))
    q = live.read_frames(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("frames_in").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(r.id for r in spark.table("frames_in").collect()) == [live.PLACES, live.PLACES + 2]


def test_backoff():
    waits, w = [], 0.5
    for _ in range(8):
        w = live.backoff(w, 1.0)
        waits.append(w)
    assert waits == [1, 2, 4, 8, 16, 30, 30, 30] and live.backoff(30, 31) == 0.5


def test_hourly_needs_no_batch_operator(spark):
    stream = spark.readStream.format("rate").load().selectExpr("value as id", "'m' as market_id", "value * 1000000000 as ts_ns", "0.5 as prob_after")
    assert live.hourly(stream).isStreaming and "window" in live.hourly(stream).columns and F is not None


def test_a_batch_counts_when_its_four_tables_are_whole(spark, tmp_path):
    batch = spark.createDataFrame([(1, "m", 5, 0.1, 0.2, 1.0, 1.0, 0, 0.0, 0.0, 0.0)], BETS + ", prob_velocity double, bet_arrival_rate double, realized_vol double")
    path = str(tmp_path / "four")
    with pytest.raises(ValueError):
        sinks.committed(spark, path, "bets")
    for n in (1, 1, 2):
        sinks.write_four(batch, n, path)
    (tmp_path / "four/_batches/batch=2").unlink()  # as if the pass had broken off before the mark
    assert [sinks.committed(spark, path, t).count() for t in ("markets", "bets", "probability_snapshots", "feature_snapshots")] == [1, 1, 1, 1]


def test_paced_rows(spark):
    q = synthetic.paced(spark, 50).writeStream.format("memory").queryName("paced").start()
    deadline = time.time() + 60
    while time.time() < deadline and (not spark.catalog.tableExists("paced") or spark.table("paced").count() < 50):
        time.sleep(0.5)
    q.stop()
    ids = sorted(r.id for r in spark.table("paced").collect())
    assert len(ids) >= 50 and ids == list(range(len(ids)))
