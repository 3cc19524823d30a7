"""Sinks and table changes (K1 to K14), without a table format: whole files are written, versions replace each other by a rename."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewell.functions.domain import ns_to_date
from brinewell.operators.similarity import not_yet_known
from brinewell.session import file_system

MARKS = "_batches"


def placeholders(known: DataFrame, ids: DataFrame) -> DataFrame:
    """K6: rows for markets that are not known yet; a known row wins."""
    new = ids.select("market_id").distinct().select(
        "market_id", F.lit("manifold").alias("platform"), F.col("market_id").alias("question_text"), F.lit("").alias("close_time"),
        F.lit(None).cast("int").alias("resolved_outcome"), F.lit(None).cast("string").alias("category"),
    )
    return not_yet_known(new, known, ["market_id"])


def replaced(known: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """K7: known with the rows of new in place of those with the same key; of several new ones the last by all columns."""
    both = known.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in known.columns if c != key]
    newest = both.groupBy(key).agg(F.max(F.struct("__v", *rest)).alias("__newest"))
    return newest.select(key, *[F.col(f"__newest.{c}").alias(c) for c in rest]).select(*known.columns)


def refilled(known: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """K8: all rows of the keys in new are dropped and new's rows take their place."""
    return known.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def write_by_date(df: DataFrame, path: str, ts: str = "ts_ns", mode: str = "append") -> None:
    """K3: one directory dt=YYYY-MM-DD per UTC date of the rows; a date's rows meet in few files, a hot date in several."""
    dated = df.withColumn("dt", ns_to_date(F.col(ts)))
    dated.hint("rebalance", "dt").write.mode(mode).partitionBy("dt").parquet(path)


def read_by_date(spark: SparkSession, path: str, start_ns: int, end_ns: int) -> DataFrame:
    """Rows within inclusive bounds; only the directories of their dates are read."""
    low, high = (ns_to_date(F.lit(x)) for x in (start_ns, end_ns))
    return spark.read.parquet(path).where((F.col("dt").cast("string") >= low) & (F.col("dt").cast("string") <= high) & F.col("ts_ns").between(start_ns, end_ns))


def replace_kind(df: DataFrame, path: str, column: str = "type") -> None:
    """Rewrites the partitions of the kinds that df has, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def write_four(batch: DataFrame, batch_id: int, path: str, dry_run: bool = False) -> None:
    """K1, K2: a batch of feature-bearing bets to its four tables, each under its batch id, so that a repeated batch replaces itself.

    The batch counts once its mark is there, which is made after all four are whole; committed() reads no other batches.
    """
    if dry_run:
        batch.write.format("noop").mode("overwrite").save()
        return
    batch.persist()
    parts = {
        "markets": batch.select("market_id").distinct(),
        "bets": batch.select("id", "market_id", "ts_ns", "prob_before", "prob_after", "amount", "shares", "is_limit_order"),
        "probability_snapshots": batch.select("id", "market_id", "ts_ns", F.col("prob_after").alias("probability"), F.lit(None).cast("double").alias("volume_24h")),
        "feature_snapshots": batch.select("id", "market_id", "ts_ns", "prob_velocity", "bet_arrival_rate", "realized_vol"),
    }
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
    batch.unpersist()
    fs, mark = file_system(batch.sparkSession, f"{path}/{MARKS}/batch={batch_id}")
    fs.create(mark, True).close()


def committed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the four tables: the rows of the batches whose four tables are whole."""
    fs, marks = file_system(spark, f"{path}/{MARKS}")
    done = [f.getPath().getName() for f in fs.listStatus(marks)] if fs.exists(marks) else []
    if not done:
        raise ValueError("no batch is whole")
    return spark.read.option("basePath", f"{path}/{name}").parquet(*[f"{path}/{name}/{b}" for b in sorted(done)]).drop("batch")


def poll(prices: DataFrame, polled_at: str) -> DataFrame:
    """One row per market under one shared stamp."""
    return prices.select("market_id", F.lit(polled_at).alias("polled_at"), F.col("probability").alias("community_prediction"))
