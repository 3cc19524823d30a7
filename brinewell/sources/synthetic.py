"""Synthetic load (S24 to S26): bounded random walks of probabilities, in event order."""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import accumulate, islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewell.schemas import BETS

# Fixed values of the load: start time, step of time and of the walk, bounds, range of amounts.
START_MS, STEP, LOW, HIGH, LEAST_AMOUNT, AMOUNT_RANGE = 1_700_000_000_000, 0.1, 0.01, 0.99, 10.0, 90.0
_MASK = (1 << 64) - 1


def uniform(seed: int) -> Iterator[float]:
    """xorshift64 numbers in [0, 1); a seed of 0 counts as 1."""
    x = max(seed, 1) & _MASK
    while True:
        x ^= x << 13 & _MASK
        x ^= x >> 7
        x ^= x << 17 & _MASK
        yield (x >> 11) / (1 << 53)


def sequence(count: int, markets: int = 16, seed: int = 42) -> Iterator[tuple]:
    """The one sequence that a seed stands for: markets take turns, time moves on by a millisecond an event."""
    numbers, probs = uniform(seed), [0.5] * max(markets, 1)
    for k in range(count):
        m = k % len(probs)
        before = probs[m]
        probs[m] = min(max(before + (next(numbers) - 0.5) * STEP, LOW), HIGH)
        amount = LEAST_AMOUNT + next(numbers) * AMOUNT_RANGE
        yield (k, f"synthetic-market-{m}", (START_MS + k) * 1_000_000, before, probs[m], amount, amount / probs[m], 0)


def load(spark: SparkSession, per_market: int, markets: int = 16, seed: int = 42) -> DataFrame:
    """A load of any size: each market walks by its own seed, in parallel; the same shape, not the same numbers, as sequence()."""

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for m in part["id"]:
                numbers, p, rows = uniform(seed * 1_000_003 + int(m) + 1), 0.5, []
                for k in range(per_market):
                    before, p = p, min(max(p + (next(numbers) - 0.5) * STEP, LOW), HIGH)
                    amount = LEAST_AMOUNT + next(numbers) * AMOUNT_RANGE
                    n = k * markets + int(m)
                    rows.append((n, f"synthetic-market-{m}", (START_MS + n) * 1_000_000, before, p, amount, amount / p, 0))
                    if len(rows) == 50_000:
                        yield pd.DataFrame(rows, columns=[c.split()[0] for c in BETS.split(", ")])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in BETS.split(", ")])

    return spark.range(markets).repartition(markets, "id").mapInPandas(walk, BETS)


def bulk(spark: SparkSession, count: int, markets: int = 16, seed: int = 42) -> DataFrame:
    """A load as large as wished without Python: probabilities are hashed instead of walked; times and turns are those of sequence()."""
    p = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(980_000)) / 1e6 + LOW
    return spark.range(count).select(
        "id", F.concat(F.lit("synthetic-market-"), F.col("id") % markets).alias("market_id"), ((F.col("id") + START_MS) * 1_000_000).alias("ts_ns"),
        p(seed).alias("prob_before"), p(seed + 1).alias("prob_after"), F.lit(10.0).alias("amount"), F.lit(20.0).alias("shares"), F.lit(0).alias("is_limit_order"),
    )


def paced(spark: SparkSession, per_second: int) -> DataFrame:
    """An endless stream of numbered rows at a rate; the source keeps absolute deadlines."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(F.col("value").alias("id"), F.col("timestamp").alias("due"))


# Fixed values of the demonstration: bounds of its prices, spread of the start and of a step, share of the gap to the target that a step closes.
DEMO_LOW, DEMO_HIGH, DEMO_START, DEMO_STEP, DEMO_PULL = 0.02, 0.98, 0.08, 0.03, 0.12


def demo_walk(numbers: random.Random, target: float, n: int) -> list[float]:
    """N prices that start near the target, are drawn to it and end on it, all in bounds and of four digits."""
    held = lambda p: sorted((DEMO_LOW, p, DEMO_HIGH))[1]
    steps = [numbers.gauss(0.0, DEMO_START), *(numbers.gauss(0.0, DEMO_STEP) for _ in range(n - 1))]
    walk = accumulate(steps[1:], lambda p, noise: held(p + DEMO_PULL * (target - p) + noise), initial=held(target + steps[0]))
    return [round(p, 4) for p in islice(walk, 1, n)] + [round(held(target), 4)]


def demo_series(spark: SparkSession, targets: dict[str, float], points: int = 48, seed: int = 7) -> DataFrame:
    """Hourly series for a demonstration of a few markets, the same ones for the same seed; all markets share one sequence of numbers."""
    numbers, rows = random.Random(seed), []
    for n, (market, target) in enumerate(targets.items()):
        for k, p in enumerate(demo_walk(numbers, target, points)):
            rows.append((n * points + k, market, (START_MS + k * 3_600_000) * 1_000_000, p, None))
    return spark.createDataFrame(rows, "id bigint, market_id string, ts_ns bigint, probability double, volume_24h double")
