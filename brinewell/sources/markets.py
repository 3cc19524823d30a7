"""Markets of either venue in one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewell.functions.domain import category_of, clamp, resolution_label


def normalize_manifold(raw: DataFrame) -> DataFrame:
    """Binary markets with a probability; the question is trimmed, the probability kept within 0..1."""
    usable = raw.where("id is not null and question is not null and outcomeType = 'BINARY' and probability is not null")
    return usable.select(
        F.col("id").alias("market_id"), F.trim("question").alias("question_text"), clamp(F.col("probability")).alias("probability"),
        F.col("closeTime").cast("bigint").alias("close_time_ms"), F.coalesce("isResolved", F.lit(False)).alias("is_resolved"),
        resolution_label(F.col("isResolved"), F.col("resolution")).alias("resolved_outcome"), category_of(F.col("groupSlugs")).alias("category"),
        F.col("volume").cast("double").alias("volume"), F.col("totalLiquidity").cast("double").alias("liquidity"),
    )


def market_by_id(raw: DataFrame, market_id: str) -> DataFrame:
    """One usable binary market of raw records; an empty frame stands for none. The id is asked of the source."""
    return normalize_manifold(raw.where(F.col("id") == market_id))


def binary_probability(outcomes: Column, prices: Column) -> Column:
    """Of JSON lists of two outcomes and two prices the price of the first 'yes', else of the first outcome; null otherwise."""
    names, values = F.from_json(outcomes, "array<string>"), F.from_json(prices, "array<string>")
    yes = F.array_position(F.transform(names, lambda x: F.lower(F.trim(x))), "yes").cast("int")
    price = F.get(values, F.when(yes > 0, yes - 1).otherwise(0)).try_cast("double")
    return F.when((F.size(names) == 2) & (F.size(values) == 2), price)


def normalize_polymarket(raw: DataFrame) -> DataFrame:
    """Open and active binary markets; the id is conditionId, else id; invalid probability or volume drops the row."""
    named = raw.where("(closed is null or not closed) and (active is null or active)").select(
        F.coalesce(F.nullif(F.col("conditionId"), F.lit("")), F.col("id")).alias("market_id"), F.trim("question").alias("question_text"),
        binary_probability(F.col("outcomes"), F.col("outcomePrices")).alias("probability"),
        F.coalesce(F.col("volumeNum"), F.col("volume").try_cast("double")).alias("volume"), F.col("endDate").alias("close_time"),
    )
    fine = (F.col("market_id") != "") & (F.col("question_text") != "") & F.col("probability").between(0, 1)
    return named.where(fine & (F.col("volume").isNull() | (F.col("volume") >= 0)))


def first_seen(parts: list[DataFrame], key: str, rank: str) -> DataFrame:
    """S11, J13's dedupe: the union of parts with the first row of each key, by part and then by rank."""
    whole = None
    for k, p in enumerate(parts):
        p = p.withColumn("part", F.lit(k))
        whole = p if whole is None else whole.unionByName(p)
    rest = [x for x in whole.columns if x != key]
    return whole.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("part", rank)).alias("first")).select(key, "first.*")


def filled_buckets(df: DataFrame, bucket: str, key: str, rank: list, quotas: list[tuple[str, int]]) -> list[tuple]:
    """Per bucket in order the best rows up to its quota that no earlier bucket has taken: (bucket, key) pairs.

    Each bucket's quota depends on what the earlier ones took, so this folds over the few buckets; each brings at most the sum of
    all quotas to the driver, whatever the size of df. Of repeated rows of a key one counts.
    """
    most = sum(q for _, q in quotas)
    taken: list[tuple] = []
    for name, quota in quotas:
        best = [r[0] for r in df.where(F.col(bucket) == name).dropDuplicates([key]).orderBy(*rank).select(key).limit(most).collect()]
        seen = {k for _, k in taken}
        taken += [(name, k) for k in best if k not in seen][:quota]
    return taken
