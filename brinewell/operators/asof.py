"""As-of joins (J4 to J6) and latest rows.

An as-of join is a union of probes and facts, in order, with the last fact carried on. A hot key is spread over time slots: only each slot's
last fact travels on to the slots behind it, so no task sees a key's whole history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR_NS = 3_600_000_000_000


def latest(df: DataFrame, key: str, order: list[str], *values: str) -> DataFrame:
    """The row of each key that comes last in order; pre-aggregated before the shuffle."""
    return df.groupBy(key).agg(*[F.max_by(v, F.struct(*order)).alias(v) for v in values])


def market_state(bets: DataFrame) -> DataFrame:
    """Probability and time of the bet that arrived last, per market."""
    return latest(bets, "market_id", ["id"], "prob_after", "ts_ns").withColumnsRenamed({"prob_after": "current_prob", "ts_ns": "last_updated_ns"})


def asof_backward(probes: DataFrame, facts: DataFrame, key: str, probe_time: str, fact_time: str, tie: str, value: str, out: str, slot_ns: int = HOUR_NS) -> DataFrame:
    """probes with the column out: value of the fact of the same key that is the latest at or before the probe, null if there is none.

    Of facts with one time the greatest tie counts, a null value included. Probes with a null key or time get null.
    """
    asked = probes.select(F.col(key).alias("k"), F.col(probe_time).alias("t"), F.struct(*probes.columns).alias("row"))
    answered = _answered(asked, facts, key, fact_time, tie, value, slot_ns)
    missed = asked.where("k is null or t is null").select("row", F.lit(None).cast(facts.schema[value].dataType).alias("v"))
    return answered.unionByName(missed).select("row.*", F.col("v").alias(out))


def _answered(asked: DataFrame, facts: DataFrame, key: str, fact_time: str, tie: str, value: str, slot_ns: int) -> DataFrame:
    """row and v, the value known at t, of each of asked (k, t, row) with a key and a time."""
    slot = lambda c: F.expr(f"({c} - pmod({c}, {slot_ns})) div {slot_ns}")
    asked = asked.where("k is not null and t is not null").withColumn("s", slot("t"))
    known = facts.select(F.col(key).alias("k"), F.col(fact_time).alias("t"), F.struct(F.col(fact_time).alias("t"), F.col(tie).alias("i"), F.col(value).alias("v")).alias("f"))
    known = known.where("k is not null and t is not null").withColumn("s", slot("t"))
    ends = known.groupBy("k", "s").agg(F.max_by("f", F.struct("f.t", "f.i")).alias("f"))
    wanted = asked.select("k", "s").distinct()
    chain = ends.select("k", "s", "f").unionByName(wanted.withColumn("f", F.lit(None).cast(ends.schema["f"].dataType)))
    earlier = Window.partitionBy("k").orderBy("s").rangeBetween(Window.unboundedPreceding, -1)
    handed = chain.withColumn("h", F.last("f", ignorenulls=True).over(earlier)).where("f is null and h is not null").select("k", "s", F.col("h").alias("f"))
    no_row = F.lit(None).cast(asked.schema["row"].dataType)
    facts_in = known.select("k", "s", "t", "f").unionByName(handed.select("k", "s", F.col("f.t").alias("t"), "f")).withColumn("row", no_row)
    both = facts_in.withColumn("p", F.lit(0)).unionByName(
        asked.withColumn("f", F.lit(None).cast(ends.schema["f"].dataType)).withColumn("p", F.lit(1)).select("k", "s", "t", "f", "row", "p")
    )
    order = Window.partitionBy("k", "s").orderBy("t", "p", F.col("f.i")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("last", F.last("f", ignorenulls=True).over(order)).where("p = 1").select("row", F.col("last.v").alias("v"))


def asof_with_latency(signals: DataFrame, facts: DataFrame, latency_ns: int, key: str = "market_id", time: str = "ts_ns", value: str = "probability") -> DataFrame:
    """The value at the signal and at the signal plus the latency, with one pass over the facts: both times of a signal ask in it.

    Equal signals get equal values; they travel as one row with their number.
    """
    names = signals.columns
    one = signals.groupBy(*names).agg(F.count("*").alias("__times")) if names else signals
    row = F.struct(*names, "__times")
    ask = F.explode(F.array(F.struct(F.col(time).alias("t"), F.lit(True).alias("now")), F.struct((F.col(time) + latency_ns).alias("t"), F.lit(False).alias("now"))))
    asked = one.select(F.col(key).alias("k"), row.alias("signal"), ask.alias("a")).select("k", F.col("a.t").alias("t"), F.struct("signal", "a.now").alias("row"))
    answered = _answered(asked, facts, key, "ts_ns", "id", value, HOUR_NS).select("row.signal.*", F.when(F.col("row.now"), F.col("v")).alias("now"), F.when(~F.col("row.now"), F.col("v")).alias("later"))
    met = answered.groupBy(*names, "__times").agg(F.max("now").alias("signal_price"), F.max("later").alias("fill_price"))
    nothing = F.lit(None).cast(facts.schema[value].dataType)
    missed = one.where(F.col(key).isNull() | F.col(time).isNull()).withColumn("signal_price", nothing).withColumn("fill_price", nothing)
    whole = met.unionByName(missed).withColumn("exec_ns", F.col(time) + latency_ns)
    return whole.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times"))).select(*names, "signal_price", "exec_ns", "fill_price")


def merged_timeline(members: DataFrame, facts: DataFrame) -> DataFrame:
    """At every distinct time of a group's facts the latest value of every member: group_id, ts_ns, market_id, probability.

    members: (group_id, market_id); facts: (id, market_id, ts_ns, probability).
    """
    times = facts.join(members, "market_id").select("group_id", "ts_ns").distinct()
    probes = times.join(members, "group_id")
    return asof_backward(probes, facts, "market_id", "ts_ns", "ts_ns", "id", "probability", "probability")
