"""The live path: a stream of frames or bets to per-bet features with keyed state.

State per market: its current probability and time, and the last `capacity` bets. A batch's bets of a market are put in order of arrival (id)
before they are applied, since files do not keep it. Results equal those of the batch operator on bets whose ids and times agree; of a late bet the
window is what had arrived by then, up to its own time. A trigger is bounded by per_trigger files; a task holds one market's share of it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brinewell.operators.features import SECOND, arrival_features
from brinewell.operators.sinks import write_four
from brinewell.schemas import BETS, FRAME
from brinewell.sources.frames import domain_bets, flatten

OUT = BETS + ", prob_velocity double, bet_arrival_rate double, realized_vol double, n_window int, current_prob double"
PLACES = 1 << 24  # of bets in a frame; ids stay in order of arrival
STATE = "ts array<bigint>, before array<double>, after array<double>"


def live_features(bets: DataFrame, window_ns: int = 60 * SECOND, capacity: int = 512) -> DataFrame:
    """One row per bet, as it arrives; late bets are applied when they come and none is dropped."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(parts), ignore_index=True).sort_values("id", kind="stable", ignore_index=True)
        held = state.get if state.exists else ([], [], [])
        ts = np.concatenate([np.array(held[0], np.int64), new["ts_ns"].to_numpy(np.int64)])
        before, after = (np.concatenate([np.array(h, float), new[c].to_numpy(float)]) for h, c in zip(held[1:], ("prob_before", "prob_after")))
        first = len(held[0])
        velocity, rate, vol, n = arrival_features(ts, before, after, window_ns, capacity, first)
        state.update((ts[-capacity:].tolist(), before[-capacity:].tolist(), after[-capacity:].tolist()))
        yield new.assign(
            prob_velocity=velocity, bet_arrival_rate=rate, realized_vol=vol, n_window=n.astype(np.int32), current_prob=after[first:]
        )

    keyed = bets.where("market_id is not null and ts_ns is not null").select(*[c.split()[0] for c in BETS.split(", ")]).groupBy("market_id")
    return keyed.applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def read_frames(spark: SparkSession, directory: str, per_trigger: int = 16) -> DataFrame:
    """Landed JSON lines (line_no, then the frame's fields) as a stream of bets. The lander outside keeps the connection."""
    raw = spark.readStream.schema(f"line_no bigint, {FRAME}").option("maxFilesPerTrigger", per_trigger).json(directory)
    bets = domain_bets(flatten(raw.where("type = 'broadcast'"), F.col("data.bets"), "line_no"), "line_no", "bet_pos")
    fits = F.when(F.col("bet_pos") < PLACES, F.col("line_no") * PLACES + F.col("bet_pos"))
    return bets.withColumn("id", F.coalesce(fits, F.raise_error(F.lit("a frame with more bets than places")).cast("bigint")))


def backoff(previous_s: float, stable_s: float, first: float = 0.5, most: float = 30.0) -> float:
    """S3: seconds to wait before the next connection: twice as long each time, the shortest after a stable one."""
    return first if stable_s >= 30.0 else min(max(previous_s, first) * 2, most)


def collect(bets: DataFrame, path: str, checkpoint: str, every: str | None = None, dry_run: bool = False, **features):
    """K1 to K5: starts the query that writes features and their bets; exactly once a table by batch id. every: processing time, else all that is there."""
    out = live_features(bets, **features)
    writer = out.writeStream.foreachBatch(lambda df, n: write_four(df, n, path, dry_run)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def land(lines: Iterator[str], directory: str, per_file: int = 1000, first_line: int = 0) -> int:
    """Writes received frames to numbered files of JSON lines, each moved in place when whole; gives the next line number.

    What keeps the connection calls it with what it receives; a frame that is no JSON object is numbered and left out.
    """
    at = Path(directory)
    at.mkdir(parents=True, exist_ok=True)
    n, held = first_line, []

    def put() -> None:
        if held:
            hidden = at / f".{n:020d}.part"
            hidden.write_text("\n".join(held) + "\n")
            hidden.rename(at / f"frames-{n:020d}.json")
            held.clear()

    for line in lines:
        try:
            frame = json.loads(line)
        except ValueError:
            frame = None
        if isinstance(frame, dict):
            held.append(json.dumps({"line_no": n, **frame}))
        n += 1
        if len(held) >= per_file:
            put()
    put()
    return n


def hourly(bets: DataFrame, lateness: str = "6 hours") -> DataFrame:
    """The streaming form of late.py: hours close once the watermark has passed them, later bets are dropped."""
    timed = bets.withColumn("at", F.timestamp_micros(F.expr("ts_ns div 1000"))).withWatermark("at", lateness)
    return timed.groupBy("market_id", F.window("at", "1 hour")).agg(F.count("*").alias("n"), F.min("prob_after").alias("least"), F.max("prob_after").alias("most"))
