"""Incremental export of growing tables by date, with a stored watermark, and the loops around such passes."""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewell.functions.domain import ns_to_date
from brinewell.operators.features import count_features
from brinewell.operators.positions import placed
from brinewell.operators.sinks import replaced
from brinewell.session import file_system

MARKS = "watermarks.json"
log = logging.getLogger(__name__)


def watermarks(spark: SparkSession, path: str) -> dict[str, int]:
    fs, at = file_system(spark, f"{path}/{MARKS}")
    return json.loads("".join(r[0] for r in spark.read.text(f"{path}/{MARKS}").collect())) if fs.exists(at) else {}


def _store(spark: SparkSession, path: str, marks: dict[str, int]) -> None:
    fs, new = file_system(spark, f"{path}/{MARKS}.{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(marks).encode()))
    out.close()
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MARKS}")
    fs.delete(at, False)
    fs.rename(new, at)


def export_new(tables: dict[str, DataFrame], path: str, time_column: str = "ts_ns") -> dict[str, int]:
    """K4: rows with an id above each table's watermark, to path/<table>/run=<watermark>/dt=<date>; gives the new watermarks.

    The watermark is stored after the rows, and a run that is repeated for it overwrites its own folder, so a broken pass leaves nothing twice.
    """
    spark = next(iter(tables.values())).sparkSession
    marks = watermarks(spark, path)
    for name, df in tables.items():
        mark = marks.get(name, -(2**63))
        newer = df.where(F.col("id") > mark)
        most = newer.agg(F.max("id")).first()[0]
        if most is None:
            continue
        newer = newer.where(F.col("id") <= most).withColumn("dt", ns_to_date(F.col(time_column)))
        newer.hint("rebalance", "dt").write.mode("overwrite").partitionBy("dt").parquet(f"{path}/{name}/run={mark}")
        marks[name] = most
        _store(spark, path, marks)
    return marks


def exported(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").drop("run")


def repeated(action: Callable[[], object], every_s: float, most: int | None = None, errors: tuple = (Exception,), wait: Callable[[float], None] = time.sleep) -> int:
    """K5, K11 and the detection loop: runs action at an interval; an error is logged and the next run tries again. Gives the number of runs."""
    runs = 0
    while most is None or runs < most:
        try:
            action()
        except errors:
            log.exception("run %d failed, the next one tries again", runs)
        runs += 1
        if most is not None and runs >= most:
            break
        wait(every_s)
    return runs


def backfill(known: dict[str, DataFrame], markets: DataFrame, bets: DataFrame, now_ns: int, usable: Column | None = None, points: int = 120) -> dict[str, DataFrame]:
    """K9: the four tables with the given markets filled anew, in one pass: old rows of these markets go, new ones come.

    markets: market_id, question_text, close_time, resolved_outcome, category, probability (now). A market that usable rules out, by default one without an id or a
    probability within 0..1, is skipped whole and keeps its old rows. The price series is one point a bet and one at now_ns, the last `points` of them; there is one
    feature row, at now_ns, over the last bets.
    """
    fine = F.col("market_id").isNotNull() & F.col("probability").between(0, 1) if usable is None else usable
    good = markets.where(F.coalesce(fine, F.lit(False))).dropDuplicates(["market_id"])
    own = bets.join(good.select("market_id"), "market_id", "left_semi").where("ts_ns is not null and prob_after is not null")
    rows = good.select("market_id", F.lit("manifold").alias("platform"), "question_text", "close_time", "resolved_outcome", "category")
    now = good.select("market_id", F.lit(now_ns).cast("bigint").alias("ts_ns"), "probability")
    both = own.select("id", "market_id", "ts_ns", F.col("prob_after").alias("probability")).unionByName(now.withColumn("id", F.lit(2**62)))
    series = placed(both, "market_id", "ts_ns", "id").where(F.col("place") >= F.col("n") - points).drop("place", "n")
    series = series.withColumn("volume_24h", F.lit(None).cast("double"))
    made = count_features(own)
    last = made.groupBy("market_id").agg(F.max_by(F.struct("prob_velocity", "bet_arrival_rate", "realized_vol"), F.struct("ts_ns", "id")).alias("f"))
    zero = lambda n: F.coalesce(F.col(f"f.{n}"), F.lit(0.0)).alias(n)
    features = good.select("market_id").join(last, "market_id", "left").select(
        F.xxhash64("market_id").alias("id"), "market_id", F.lit(now_ns).cast("bigint").alias("ts_ns"), zero("prob_velocity"), zero("bet_arrival_rate"), zero("realized_vol")
    )
    ids = good.select("market_id")

    def shaped(new: DataFrame, old: DataFrame) -> DataFrame:
        """Further columns of the old rows are null in the new ones."""
        return new.select(*[c for c in old.columns if c in new.columns])

    def filled(name: str, new: DataFrame) -> DataFrame:
        old = known[name]
        return old.join(ids, "market_id", "left_anti").unionByName(shaped(new, old), allowMissingColumns=True)

    return {
        "markets": replaced(known["markets"], shaped(rows, known["markets"]), "market_id"), "bets": filled("bets", own),
        "probability_snapshots": filled("probability_snapshots", series), "feature_snapshots": filled("feature_snapshots", features),
    }
