"""Known matches between venues and what signals read of them (P5, P6, O5, S19's loader)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewell.operators.asof import latest
from brinewell.operators.similarity import not_yet_known

TRIPLE = ["manifold_market_id", "external_market_id", "platform"]


def by_status(matches: DataFrame, status: str) -> DataFrame:
    """In order of id."""
    return matches.where(F.col("status") == status).orderBy("id")


def confirmed(matches: DataFrame) -> DataFrame:
    """P5: the only way to matches for signals."""
    return matches.where("status = 'confirmed'")


def by_id(matches: DataFrame, match_id: int) -> DataFrame:
    """An empty frame stands for not found."""
    return matches.where(F.col("id") == match_id)


def oldest(matches: DataFrame) -> DataFrame:
    """Of each triple of ids and platform the match with the least id."""
    rest = [c for c in matches.columns if c not in TRIPLE]
    first = matches.groupBy(*TRIPLE).agg(F.min_by(F.struct(*rest), "id").alias("__first"))
    return first.select(*[c if c in TRIPLE else F.col(f"__first.{c}").alias(c) for c in matches.columns])


def loaded(mappings: DataFrame, known: DataFrame, platform: str = "polymarket") -> DataFrame:
    """The pairs of a mapping file that are not known yet, as confirmed matches."""
    rows = mappings.select("manifold_market_id", "external_market_id", F.lit(platform).alias("platform"), F.lit(1.0).alias("confidence"), F.lit("confirmed").alias("status"))
    return not_yet_known(rows, known, TRIPLE)


def newest_external(polls: DataFrame) -> DataFrame:
    """The external price with the greatest id, whatever its time says."""
    return latest(polls.withColumnRenamed("market_id", "external_market_id"), "external_market_id", ["id"], "community_prediction")
