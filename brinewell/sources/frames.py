"""Frames of the bet stream: parsing, flattening, and the projection onto domain bets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewell.schemas import FRAME


def parse_frames(df: DataFrame, text: str) -> DataFrame:
    """The rows of df whose text is a known frame, with the column frame; unknown shapes give no row."""
    parsed = df.withColumn("frame", F.from_json(F.col(text), FRAME, {"mode": "PERMISSIVE"}))
    return parsed.where("frame.type in ('ack', 'broadcast')")


def flatten(df: DataFrame, bets: Column, *keep: str) -> DataFrame:
    """One row per bet of a frame, with its place; empty, absent and null lists give none, null members are passed over."""
    return df.select(*keep, F.posexplode(bets).alias("bet_pos", "bet")).where("bet is not null")


def domain_bets(df: DataFrame, *keep: str) -> DataFrame:
    """Wire bets to domain bets: milliseconds, not below 0, to nanoseconds; a limit order is one with a limit."""
    b = F.col("bet")
    return df.select(
        *keep, b.contractId.alias("market_id"), (F.greatest(b.createdTime, F.lit(0)) * 1_000_000).alias("ts_ns"), b.probBefore.alias("prob_before"),
        b.probAfter.alias("prob_after"), b.amount.alias("amount"), b.shares.alias("shares"), b.limitProb.isNotNull().cast("int").alias("is_limit_order"),
    )


def complete_bets(df: DataFrame) -> DataFrame:
    """Rows with time and both probabilities; a null amount or number of shares is 0."""
    zero = F.lit(0.0)
    some = df.where("ts_ns is not null and prob_before is not null and prob_after is not null")
    return some.withColumn("amount", F.coalesce("amount", zero)).withColumn("shares", F.coalesce("shares", zero))


def in_time_order(df: DataFrame, *arrival: str) -> DataFrame:
    """By time, bets of one time in order of arrival."""
    return df.orderBy("ts_ns", *arrival)
