"""Pairing records with the record nearest in time of the same entity, within a tolerance.

Both tables are repartitioned by entity and time slot and sorted within partitions; one pass then merges the two orders with a pointer on
either side. It holds the neighbouring right records and the left records that may still find a nearer one, which are those of the
last tolerance.

A hot entity is spread over its time slots. A right record goes to its own slot; a left record goes to each slot its tolerance
reaches into, and the nearer of its finds is kept.

Defined results: of equally near right records the earlier counts, then the one with the smaller id; the tolerance is inclusive; records
with a null entity or time, or a time within a week of the ends of 64 bits, pair with nothing; left records without a partner are left out; repeated left rows with one id give one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewell.functions.instants import roomy

SLOT_NS = 3_600_000_000_000
PAIRS = "left_id bigint, kind string, right_id bigint, distance_ns bigint, right_time bigint"


def _work(tolerance: int):
    def better(t: int, a: tuple[int, int] | None, b: tuple[int, int] | None) -> tuple[int, int] | None:
        """The nearer of the record before and the one behind; the earlier where they are equally near."""
        if a is None or (b is not None and b[0] - t < t - a[0]):
            return b
        return a

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, before = None, None  # the slot, and the first record of the latest right time
        waiting: list[tuple[int, int, tuple[int, int] | None]] = []  # left: time, id, record before
        out: list[tuple[int, str, int, int, int]] = []

        def settle(behind: tuple[int, int] | None) -> None:
            for t, i, a in waiting:
                r = better(t, a, behind)
                if r is not None and abs(r[0] - t) <= tolerance:
                    out.append((i, at[1], r[1], abs(r[0] - t), r[0]))
            waiting.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("entity", "kind", "slot", "t", "is_left", "id")]
            for entity, kind, slot, t, is_left, i in zip(*columns):
                if at is None or slot != at[2] or entity != at[0] or kind != at[1]:
                    settle(None)
                    at, before = (entity, kind, slot), None
                if is_left:
                    if before is not None and before[0] == t:
                        out.append((i, kind, before[1], 0, t))
                        continue
                    if waiting and t - waiting[0][0] > tolerance:
                        late = [w for w in waiting if t - w[0] <= tolerance]
                        waiting[:] = [w for w in waiting if t - w[0] > tolerance]
                        settle(None)
                        waiting.extend(late)
                    waiting.append((t, i, before))
                elif before is None or t > before[0]:
                    settle((t, i))
                    before = (t, i)
            if len(out) > 1000:
                yield _packed(out)
                out.clear()
        settle(None)
        if out:
            yield _packed(out)

    return merge


def _packed(rows: list[tuple[int, str, int, int, int]]) -> pa.RecordBatch:
    fields = [x.split() for x in PAIRS.split(", ")]
    arrays = [pa.array(c, pa.string() if t == "string" else pa.int64()) for c, (_, t) in zip(zip(*rows), fields)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])


def records(df: DataFrame, entity: Column, time_ns: Column, row_id: Column, kind: str = "") -> DataFrame:
    """df in the form that nearest() reads; kind names the table where several are searched at once."""
    out = df.select(entity.cast("string").alias("entity"), F.lit(kind).alias("kind"), time_ns.cast("bigint").alias("t"), row_id.cast("bigint").alias("id"))
    return out.where(F.col("entity").isNotNull() & roomy(F.col("t")) & F.col("id").isNotNull())


def nearest(left: DataFrame, right: DataFrame, tolerance_ns: int, kinds: tuple[str, ...] = ("",), slot_ns: int = SLOT_NS) -> DataFrame:
    """left_id, kind, right_id and distance_ns of each pair; left and right as records() gives them.

    A left record is paired with one right record of each of kinds; all of them are searched in one shuffle.
    """
    slot_ns = max(slot_ns, 2 * tolerance_ns)
    slot = lambda shift: F.expr(f"(t + {shift} - pmod(t + {shift}, {slot_ns})) div {slot_ns}")
    reach = F.array_distinct(F.array(slot(-tolerance_ns), slot(tolerance_ns)))
    lefts = left.withColumn("kind", F.explode(F.array(*map(F.lit, kinds)))).withColumn("slot", F.explode(reach)).withColumn("is_left", F.lit(True))
    rights = right.withColumn("slot", slot(0)).withColumn("is_left", F.lit(False))
    both = lefts.unionByName(rights).repartition("entity", "kind", "slot").sortWithinPartitions("entity", "kind", "slot", "t", "is_left", "id")
    found = both.mapInArrow(_work(tolerance_ns), PAIRS)
    best = found.groupBy("left_id", "kind").agg(F.min(F.struct("distance_ns", "right_time", "right_id")).alias("best"))
    return best.select("left_id", "kind", "best.right_id", "best.distance_ns")
