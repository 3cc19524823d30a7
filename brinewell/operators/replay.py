"""Scans over time and the merged replay of all event sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewell.functions.domain import iso_ns

# The sources in the order in which they come at equal times.
SOURCES = ("bet", "probability", "feature", "model_prediction", "cross_source")


def time_range(df: DataFrame, start_ns: int | None = None, end_ns: int | None = None, column: str = "ts_ns") -> DataFrame:
    """Rows within inclusive bounds; the filter reaches the scan."""
    if start_ns is not None:
        df = df.where(F.col(column) >= start_ns)
    if end_ns is not None:
        df = df.where(F.col(column) <= end_ns)
    return df


def iso_range(df: DataFrame, column: str, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """The same over ISO text; rows that can't be read are dropped."""
    return time_range(df.withColumn("ts_ns", iso_ns(F.col(column))).where("ts_ns is not null"), start_ns, end_ns)


def newer_than(df: DataFrame, watermark: int) -> DataFrame:
    """Rows with an id above the watermark."""
    return df.where(F.col("id") > watermark)


def replay(sources: dict[str, DataFrame], start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """One stream of (ts_ns, source_rank, row_id, source, market_id, payload), to be ordered by its first three columns.

    sources maps names of SOURCES to frames with id, market_id, ts_ns; all other columns go into the payload map.
    """
    out = None
    for rank, name in enumerate(SOURCES):
        if name not in sources:
            continue
        df = time_range(sources[name], start_ns, end_ns)
        rest = [c for c in df.columns if c not in ("id", "market_id", "ts_ns")]
        payload = F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]) if rest else F.create_map().cast("map<string,string>")
        part = df.select("ts_ns", F.lit(rank).alias("source_rank"), F.col("id").alias("row_id"), F.lit(name).alias("source"), "market_id", payload.alias("payload"))
        out = part if out is None else out.unionByName(part)
    return out


def in_order(df: DataFrame) -> DataFrame:
    """The global order, by range partitions."""
    return df.orderBy("ts_ns", "source_rank", "row_id")
