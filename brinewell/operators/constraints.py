"""Logical constraints between probabilities, divergence between venues, and their signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinewell.functions.domain import divergence_direction, gross_violation
from brinewell.operators.positions import chunked, placed

LEG_COST = 0.02


def evaluated(df: DataFrame, leg_cost: float = LEG_COST) -> DataFrame:
    """Rows of (op, lhs_prob, rhs_prob, ..) that break their constraint, with gross and net and the leg that is too dear."""
    gross = gross_violation(F.col("op"), F.col("lhs_prob"), F.col("rhs_prob"))
    rows = df.withColumn("gross", gross).where("gross > 0").withColumn("net", F.col("gross") - 2 * leg_cost)
    return rows.select(
        "*", (F.col("net") > 0).alias("actionable"), F.when(F.col("op") == "<=", F.col("lhs_market")).otherwise(F.col("rhs_market")).alias("dear_market"),
        F.when(F.col("op") == "<=", F.col("rhs_market")).otherwise(F.col("lhs_market")).alias("cheap_market"),
    )


def _sides(constraints: DataFrame, prices: DataFrame, how: str) -> DataFrame:
    left = prices.select(F.col("market_id").alias("lhs_market"), F.col("probability").alias("lhs_prob"))
    right = prices.select(F.col("market_id").alias("rhs_market"), F.col("probability").alias("rhs_prob"))
    return constraints.join(left, "lhs_market", how).join(right, "rhs_market", how)


def violations(constraints: DataFrame, prices: DataFrame, leg_cost: float = LEG_COST) -> DataFrame:
    """Constraints broken at the latest prices; one with a missing price is passed over."""
    return evaluated(_sides(constraints, prices, "inner"), leg_cost)


def group_report(constraints: DataFrame, prices: DataFrame, leg_cost: float = LEG_COST) -> DataFrame:
    """Every constraint; a missing price counts as holding; and whether its whole group holds."""
    rows = _sides(constraints, prices, "left")
    gross = F.coalesce(gross_violation(F.col("op"), F.col("lhs_prob"), F.col("rhs_prob")), F.lit(0.0))
    rows = rows.withColumn("gross", gross).withColumn("net", F.col("gross") - 2 * leg_cost).withColumn("holds", F.col("gross") <= 0)
    return rows.join(rows.groupBy("group_id").agg(F.min("holds").alias("consistent")), "group_id")


def divergences(matches: DataFrame, own: DataFrame, other: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Matched pairs whose prices differ by the threshold or more; a pair without a price on either side is passed over.

    own: (market_id, probability), other: (external_market_id, community_prediction), one row a market.
    """
    pairs = matches.join(own, matches["manifold_market_id"] == own["market_id"]).join(other, "external_market_id")
    edge = F.col("probability") - F.col("community_prediction")
    rows = pairs.withColumn("edge", edge).where(F.abs(F.col("edge")) >= threshold)
    return rows.select("manifold_market_id", "external_market_id", "probability", "community_prediction", "edge", divergence_direction(F.col("edge")).alias("direction"))


def entries(ticks: DataFrame, strict_edges: bool = False) -> DataFrame:
    """Ticks at which a constraint becomes actionable.

    ticks: (constraint_id, ts_ns, gross, net). The memory is over breached ticks alone, so that a satisfied tick in between does not allow a
    second entry; strict_edges lets it.
    """
    rows = ticks.withColumn("actionable", (F.col("gross") > 0) & (F.col("net") > 0))
    if not strict_edges:
        rows = rows.where("gross > 0")
    rows = chunked(placed(rows, "constraint_id", "ts_ns"), 1)
    before = F.lag("actionable", 1, False).over(Window.partitionBy("constraint_id", "chunk").orderBy("place"))
    return rows.withColumn("before", before).where("own and actionable and not before").drop("before", "actionable", "own", "chunk", "place", "n")


def neighbours(members: DataFrame, group: str = "group_id", member: str = "market_id", prefix: int = 3) -> DataFrame:
    """Each member of a group with the next one by name: group_id, lhs_market, rhs_market. Names are ordered inside blocks of equal beginnings."""
    rows = members.select(F.col(group).alias("group_id"), F.col(member).alias("lhs_market"), F.substring(member, 1, prefix).alias("__block"))
    firsts = rows.groupBy("group_id", "__block").agg(F.min("lhs_market").alias("first"))
    after = firsts.select("group_id", "__block", F.lead("first").over(Window.partitionBy("group_id").orderBy("__block")).alias("following"))
    inside = F.lead("lhs_market").over(Window.partitionBy("group_id", "__block").orderBy("lhs_market"))
    joined = rows.withColumn("rhs_market", inside).join(after, ["group_id", "__block"])
    return joined.select("group_id", "lhs_market", F.coalesce("rhs_market", "following").alias("rhs_market")).where("rhs_market is not null")


def ticks(pairs: DataFrame, timeline: DataFrame, leg_cost: float = LEG_COST) -> DataFrame:
    """W10's input: constraint_id, ts_ns, gross, net at every time of a pair's timeline at which both prices are known.

    pairs: (group_id, lhs_market, rhs_market, op), a group for each pair; timeline: (group_id, ts_ns, market_id, probability), pivoted in one pass.
    """
    marked = timeline.where("probability is not null").join(pairs.select("group_id", "lhs_market", "op"), "group_id")
    side = lambda left: F.max(F.when((F.col("market_id") == F.col("lhs_market")) == left, F.col("probability")))
    both = marked.groupBy("group_id", "ts_ns", "op").agg(side(True).alias("l"), side(False).alias("r")).where("l is not null and r is not null")
    gross = gross_violation(F.col("op"), F.col("l"), F.col("r"))
    return both.select(F.col("group_id").alias("constraint_id"), "ts_ns", gross.alias("gross"), (gross - 2 * leg_cost).alias("net"))


def two_legs(entered: DataFrame) -> DataFrame:
    """An entry as two trades: NO on the dear market, YES on the cheap one, half of the net on each."""
    leg = lambda m, s: F.struct(F.col(m).alias("market_id"), F.lit(s).alias("side"))
    rows = entered.withColumn("leg", F.explode(F.array(leg("dear_market", "NO"), leg("cheap_market", "YES"))))
    return rows.select("*", "leg.market_id", "leg.side", (F.col("net") / 2).alias("theoretical")).drop("leg")


def constraint_signals(found: DataFrame, detected_at: str) -> DataFrame:
    """Actionable violations as signal rows; the edge is the net."""
    details = F.to_json(F.struct("op", "lhs_prob", "rhs_prob", "gross", "net"))
    return found.where("actionable").select(
        F.lit("logical_constraint").alias("type"), F.to_json(F.array("lhs_market", "rhs_market")).alias("market_refs"), F.col("net").alias("edge"),
        F.lit(detected_at).alias("detected_at"), details.alias("details_json"),
    )


def divergence_signals(found: DataFrame, detected_at: str) -> DataFrame:
    """Divergences as signal rows; the edge is the signed gap."""
    details = F.to_json(F.struct("probability", "community_prediction", "direction"))
    return found.select(
        F.lit("cross_source_divergence").alias("type"), F.to_json(F.array("manifold_market_id", "external_market_id")).alias("market_refs"), "edge",
        F.lit(detected_at).alias("detected_at"), details.alias("details_json"),
    )


def detection(constraints: DataFrame | None, matches: DataFrame, prices: DataFrame, polls: DataFrame, detected_at: str, threshold: float = 0.05) -> DataFrame:
    """One detection pass: the signals of divergences of confirmed matches and, where constraints are given, of their actionable violations.

    Appended as they are they accumulate; sinks.replace_kind() writes them in place of the earlier ones of their kinds.
    """
    out = divergence_signals(divergences(matches, prices, polls, threshold), detected_at)
    return out if constraints is None else out.unionByName(constraint_signals(violations(constraints, prices), detected_at))


def entry_counts(entered: DataFrame) -> DataFrame:
    """A11."""
    return entered.groupBy("constraint_id").agg(F.count("*").alias("n"))
