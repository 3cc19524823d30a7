"""Executions, settlement and their totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewell.functions import domain as d
from brinewell.operators.asof import asof_with_latency
from brinewell.operators.positions import placed

LATENCY_NS = 94_207


def executions(signals: DataFrame, prices: DataFrame, liquidity: float = 200.0, fee: float = 0.0, latency_ns: int = LATENCY_NS, strict: bool = False) -> DataFrame:
    """Signals of (market_id, ts_ns, side, stake) filled at the price known after the latency, against a pool of that price.

    A signal without a price gives no row. A price of 0 or 1 can't be filled: its row has error 'price out of range', or stops the query if
    strict.
    """
    rows = asof_with_latency(signals, prices, latency_ns).where("fill_price is not null")
    half, pool = F.lit(0.5), F.lit(float(liquidity))
    yes, no = d.pool_yes(F.col("fill_price"), pool, half), d.pool_no(F.col("fill_price"), pool, half)
    shares = d.fill_shares(F.col("side"), F.col("stake"), yes, no, half)
    bad = ~((F.col("fill_price") > 0) & (F.col("fill_price") < 1))
    error = F.when(bad, F.raise_error(F.lit("price out of range")) if strict else F.lit("price out of range"))
    cost = F.col("stake") * (1 + fee)
    return rows.select("*", shares.alias("shares"), cost.alias("cost"), (cost / shares).alias("effective_price"), error.alias("error"))


def settled(trades: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Trades of resolved markets with their profit. outcomes: (market_id, resolved_outcome)."""
    rows = trades.join(outcomes.where("resolved_outcome is not null"), "market_id")
    pnl = d.settle(F.col("side"), F.col("resolved_outcome"), F.col("shares"), F.col("cost"))
    return rows.withColumn("pnl", pnl)


def totals(trades: DataFrame) -> DataFrame:
    """One row; every figure but the count is null or 0 where there is no trade, so callers check n first.

    Edges are per unit staked: the realized one of the profit, the theoretical one of what each trade's theoretical_edge, where the trades have it, promised.
    """
    won = F.sum((F.col("pnl") > 0).cast("int"))
    per_stake = lambda x: F.coalesce(x / F.nullif(F.sum("stake"), F.lit(0.0)), F.lit(0.0))
    promised = F.sum(F.col("theoretical_edge") * F.col("stake")) if "theoretical_edge" in trades.columns else F.lit(None).cast("double")
    more = [
        F.sum("stake").alias("stake"), F.sum(F.col("pnl") + F.col("cost")).alias("payout"), promised.alias("theoretical_pnl"), per_stake(F.sum("pnl")).alias("realized_edge"),
        per_stake(promised).alias("theoretical_edge"),
    ] if "stake" in trades.columns else []
    return trades.agg(
        F.count("*").alias("n"), F.coalesce(won, F.lit(0)).alias("wins"), (won / F.nullif(F.count("*"), F.lit(0))).alias("hit_rate"),
        F.sum("pnl").alias("pnl"), F.sum("cost").alias("cost"), F.coalesce(F.sum("pnl") / F.nullif(F.sum("cost"), F.lit(0.0)), F.lit(0.0)).alias("roi"), *more,
    )


def require_trades(total: DataFrame) -> DataFrame:
    """A6's error on an empty set."""
    return total.withColumn("n", F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("no trades"))))


def spread_picks(bets: DataFrame, most: int = 5) -> DataFrame:
    """Of the first half of each market's bets every n-th, at most `most`."""
    rows = placed(bets, "market_id", "ts_ns", "id")
    half = F.expr("n div 2")
    step = F.greatest(F.lit(1).cast("bigint"), F.expr(f"(n div 2) div {most}"))
    return rows.where((F.col("place") < half) & (F.col("place") % step == 0) & (F.col("place") / step < most))
