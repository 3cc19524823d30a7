"""Places of rows in the order of their key, without ever ordering a whole key in one task.

Rows are numbered inside blocks of their order column; the blocks' counts are added up per key. A key may so hold any share of all rows:
a task sees a block of it. Sequence operators then work on chunks of consecutive places, each with the few rows before it that
they look back on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR_NS = 3_600_000_000_000
CHUNK = 8192


def placed(df: DataFrame, key: str, order: str, tie: str | None = None, block: int = HOUR_NS) -> DataFrame:
    """df with place (from 0, by order and then tie) and n, the number of rows of the key. Columns of these names are replaced.

    Rows with a null key or order are left out.
    """
    rows = df.drop("place", "n").where(F.col(key).isNotNull() & F.col(order).isNotNull()).withColumn("__block", F.expr(f"(`{order}` - pmod(`{order}`, {block})) div {block}"))
    inside = Window.partitionBy(key, "__block").orderBy(*[c for c in (order, tie) if c])
    sums = Window.partitionBy(key)
    counts = rows.groupBy(key, "__block").agg(F.count("*").alias("__count"))
    before = F.sum("__count").over(sums.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(key, "__block", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__count").over(sums).alias("n"))
    numbered = rows.withColumn("__at", F.row_number().over(inside) - 1).join(counts, [key, "__block"])
    return numbered.withColumn("place", F.col("__before") + F.col("__at")).drop("__block", "__at", "__before")


def chunked(rows: DataFrame, look_back: int, size: int = CHUNK) -> DataFrame:
    """Placed rows with their chunk; the last look_back rows of a chunk are in the next one too, there with own = false."""
    size = max(size, look_back)
    own = F.floor(F.col("place") / size)
    following = F.floor((F.col("place") + look_back) / size)
    spread = rows.withColumn("__own", own).withColumn("chunk", F.explode(F.array_distinct(F.array(own, following))))
    return spread.withColumn("own", F.col("chunk") == F.col("__own")).drop("__own")
