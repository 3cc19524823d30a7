"""Queries of this subpackage over the whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewell.functions.instants import instant_columns
from brinewell.llm import nearest as near
from brinewell.llm.encode import encode_texts
from brinewell.llm.leaks import find_leaks
from brinewell.llm.linkage import link
from brinewell.llm.personal import find_personal, mask_personal
from brinewell.plans.ingest_queries import _texts_sql
from brinewell.sources.tables import table

TOLERANCE_NS = 600_000_000_000


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """The pairs with the confidence of each, in thousandths."""
    c = F.col
    other = table(spark, d, "polymarket_markets").select(F.lit("1").alias("side"), c("conditionId").alias("key"), "question", c("endDate").alias("written"))
    own = table(spark, d, "markets").select(F.lit("2").alias("side"), c("market_id").alias("key"), c("question_text").alias("question"), c("close_time").alias("written"))
    pairs = link(instant_columns(other.distinct().unionByName(own), "written", "instant_ns"))
    return pairs.select(c("left_key").alias("condition_id"), c("right_key").alias("market_id"), F.floor(c("confidence") * 1000).cast("int").alias("confidence_e3"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_links(spark, d).select("condition_id", "market_id")


def p6_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The pairs with their distance in time."""
    c = F.col
    matches = table(spark, d, "market_matches").where("status = 'confirmed'").select("external_market_id", "manifold_market_id").distinct()
    polls = table(spark, d, "cross_source_snapshots").join(matches.withColumnRenamed("external_market_id", "market_id"), "market_id")
    polls = instant_columns(polls, "polled_at", "instant")
    lefts = near.records(polls, c("manifold_market_id"), c("instant"), c("id"))
    matched = matches.select(c("manifold_market_id").alias("market_id")).distinct()
    origins, rights = ("probability_snapshots", "feature_snapshots"), None
    for origin in origins:
        readings = table(spark, d, origin).select("id", "market_id", "ts_ns").join(matched, "market_id", "left_semi")
        part = near.records(readings, c("market_id"), c("ts_ns"), c("id"), origin)
        rights = part if rights is None else rights.unionByName(part)
    pairs = near.nearest(lefts, rights, TOLERANCE_NS, origins)
    return pairs.select(c("left_id").alias("cross_id"), c("right_id").alias("snapshot_id"), c("kind").alias("origin"), "distance_ns")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_nearest(spark, d).drop("distance_ns")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"), "doc_id", "text")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every leak with its extent."""
    return find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return find_personal(table(spark, d, "documents"), "doc_id", "text")


def p10_masked(spark: SparkSession, d: str) -> DataFrame:
    """Every text with placeholders for what p10_found finds."""
    return mask_personal(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {
    "p1_found": p1_found, "p1_links": p1_links, "p6_found": p6_found, "p6_nearest": p6_nearest, "p8_ids": p8_ids, "p9_found": p9_found, "p9_leaks": p9_leaks, "p10_found": p10_found,
    "p10_masked": p10_masked,
}
_NEAREST = f"""with {_texts_sql()},
polls as (select cast(t.row_key as bigint) as cross_id, t.epoch_ns as polled, m.manifold_market_id as market_id from t join cross_source_snapshots c on cast(c.id as varchar) = t.row_key
  join (select distinct external_market_id, manifold_market_id from market_matches where status = 'confirmed') m on m.external_market_id = c.market_id where t.origin = 'cross_source_snapshots'),
readings as (select 'probability_snapshots' as origin, id, market_id, ts_ns from probability_snapshots union all select 'feature_snapshots', id, market_id, ts_ns from feature_snapshots),
near as (select cross_id, id as snapshot_id, origin, abs(ts_ns - polled) as distance_ns,
  row_number() over (partition by cross_id, polls.market_id, origin order by abs(ts_ns - polled), ts_ns, id) as k
  from polls join readings on readings.market_id = polls.market_id and ts_ns between polled - {TOLERANCE_NS} and polled + {TOLERANCE_NS})"""
SQL = {
    "p6_nearest": f"{_NEAREST} select cross_id, snapshot_id, origin, distance_ns from near where k = 1",
    "p6_found": f"{_NEAREST} select cross_id, snapshot_id, origin from near where k = 1",
}
