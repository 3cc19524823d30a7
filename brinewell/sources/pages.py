"""Landed page files of the venues' REST data (S7, S10, S17, S18): JSON lists of records, a file a page, and scans over them.

What fetches writes pages; a scan takes its conditions, order and limit as options, and the conditions run where the files are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewell.operators.positions import placed

PAGE = 1000
# The most bets that a scan of one market takes, for a validation and for a constraint backtest.
VALIDATION_CAP, CONSTRAINT_CAP = 3000, 6000


def land_pages(pages: Iterable[list[dict]], directory: str) -> int:
    """Writes each fetched page to a numbered file, moved in place when whole; gives the number of pages. A short page is the last one."""
    at, n = Path(directory), 0
    at.mkdir(parents=True, exist_ok=True)
    for n, page in enumerate(pages, 1):
        hidden = at / f".page-{n:06d}.part"
        hidden.write_text(json.dumps(page))
        hidden.rename(at / f"page-{n:06d}.json")
        if len(page) < PAGE:
            break
    return n


def read_pages(spark: SparkSession, directory: str, schema: str) -> DataFrame:
    """The records of all pages. A page is a list of records or one record a line; broken pages give none."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(directory).dropna("all")


def scan(records: DataFrame, where: Column | None = None, order: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """The records that meet a condition, the first of an order where a limit is given."""
    out = records if where is None else records.where(where)
    if order:
        out = out.orderBy(*order)
    return out if limit is None else out.limit(limit)


def open_by_volume(polymarket: DataFrame, limit: int | None = None) -> DataFrame:
    """Active and open markets, the highest volume first."""
    return scan(polymarket, F.col("active") & ~F.col("closed"), [F.col("volumeNum").desc_nulls_last(), F.col("conditionId")], limit)


def search(markets: DataFrame, term: str = "", topic: str | None = None, state: str = "open", sort: str = "liquidity", limit: int = 20) -> DataFrame:
    """Raw binary markets by text, topic and state; state: open, resolved or all. Ties by id."""
    wanted = (F.col("outcomeType") == "BINARY") & F.contains(F.lower("question"), F.lit(term.lower()))
    if topic is not None:
        wanted &= F.array_contains("groupSlugs", topic)
    if state != "all":
        wanted &= F.coalesce("isResolved", F.lit(False)) == F.lit(state == "resolved")
    by = {"liquidity": F.col("totalLiquidity"), "volume": F.col("volume"), "newest": F.col("closeTime")}[sort]
    return scan(markets, wanted, [by.desc_nulls_last(), F.col("id")], limit)


def liquid(markets: DataFrame, least: float = 100.0, column: str = "liquidity") -> DataFrame:
    """A missing liquidity counts as 0."""
    return markets.where(F.coalesce(F.col(column), F.lit(0.0)) >= least)


def newest_bets(bets: DataFrame, cap: int = VALIDATION_CAP) -> DataFrame:
    """What paging back from the newest bet brings: of each market the last bets, in whole pages up to the cap, those without a price left out after."""
    rows = placed(bets, "market_id", "ts_ns", "id")
    pages = -(-cap // PAGE) * PAGE
    return rows.where((F.col("place") >= F.col("n") - pages) & F.col("prob_after").isNotNull()).drop("place", "n")
