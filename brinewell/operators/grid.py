"""Irregular readings onto a regular grid by interval representation.

A usable reading holds from its time to the next one of its source, for hold_s seconds at most. These validity intervals are cut
by the grid's cells; a cell's value is the mean over its valid time, its coverage the valid share of it.

Readings are ordered only inside their own cell, so that a hot source is spread over its cells; the cells of a source are then
chained by what each hands on: its last reading. Gaps become rows of their own.

Defined results: a reading without source, time or a value within low..high is unusable; of readings at one instant the one with
the greatest id holds; times within a week of the ends of 64 bits are none; sources without a usable reading and empty tables give no
rows; extra columns are ignored. A gap of any length is unfolded in stretches of STRETCH cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinewell.functions.instants import roomy

SECOND = 1_000_000_000
STRETCH = 4096


def usable(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (value >= low) & (value <= high)


def to_grid(
    df: DataFrame, source: str, time_ns: str, value: str, row_id: str, cell_s: int = 3600, hold_s: int = 3600, low: float = 0.0, high: float = 1.0
) -> DataFrame:
    """One row per source and cell from the source's first to its last usable reading.

    Columns: source, cell_epoch_s, n_readings, value (time-weighted mean over the valid time; where nothing is valid the last
    known reading), coverage (0..1), state ('measured', 'carried' for a cell without a reading but partly valid, 'missing').
    """
    size, hold = cell_s * SECOND, hold_s * SECOND
    rows = df.select(F.col(source).alias("source"), F.col(time_ns).alias("t"), F.col(value).alias("v"), F.col(row_id).alias("id"))
    rows = rows.where(F.col("source").isNotNull() & roomy(F.col("t")) & usable(F.col("v"), low, high))
    rows = rows.withColumn("cell", F.expr(f"(t - pmod(t, {size})) div {size}"))
    inside = Window.partitionBy("source", "cell").orderBy("t", "id")
    upto = F.least(F.coalesce(F.lead("t").over(inside), (F.col("cell") + 1) * size), F.col("t") + hold)
    cells = (
        rows.withColumn("valid", (upto - F.col("t")).cast("double"))
        .groupBy("source", "cell")
        .agg(
            F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.max_by("v", F.struct("t", "id")).alias("last_v"),
            F.sum(F.col("v") * F.col("valid")).alias("area"), F.sum("valid").alias("valid"),
        )
    )
    chain = Window.partitionBy("source").orderBy("cell")
    cells = cells.select(
        "*", F.lag("last_t").over(chain).alias("prev_t"), F.lag("last_v").over(chain).alias("prev_v"), F.lead("cell").over(chain).alias("next_cell")
    )
    carried = F.greatest(F.lit(0.0), (F.least(F.col("first_t"), F.col("prev_t") + hold) - F.col("cell") * size).cast("double"))
    carried = F.when(F.col("prev_t").isNotNull(), carried).otherwise(0.0)
    until = F.coalesce(F.col("next_cell") - 1, F.col("cell"))
    parts = cells.select("*", carried.alias("carried"), F.explode(F.sequence("cell", until, F.lit(STRETCH).cast("bigint"))).alias("from_cell"))
    spread = parts.select("*", F.explode(F.sequence("from_cell", F.least(F.col("from_cell") + STRETCH - 1, until))).alias("at"))
    hole, own = F.col("at") > F.col("cell"), F.col("valid") + F.col("carried")
    held = F.greatest(F.lit(0.0), (F.least((F.col("at") + 1) * size, F.col("last_t") + hold) - F.col("at") * size).cast("double"))
    mean = (F.col("area") + F.coalesce(F.col("prev_v"), F.lit(0.0)) * F.col("carried")) / F.nullif(own, F.lit(0.0))
    every = spread.select(
        "source", F.col("at").alias("cell"), F.when(hole, 0).otherwise(F.col("n")).cast("bigint").alias("n"), F.when(~hole, mean).alias("mean"),
        F.col("last_v").alias("known"), F.when(hole, held).otherwise(own).alias("valid"),
    )
    return every.select(
        "source", (F.col("cell") * cell_s).alias("cell_epoch_s"), F.col("n").alias("n_readings"),
        F.coalesce("mean", "known").alias("value"), (F.col("valid") / size).alias("coverage"),
        F.when(F.col("n") > 0, "measured").when(F.col("valid") > 0, "carried").otherwise("missing").alias("state"),
    )
