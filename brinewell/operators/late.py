"""Per-period aggregates by event time of records that arrive late and out of order.

Records of one key are read in arrival order. The greatest event time seen so far is the key's clock. A record whose period had
ended by the clock is late; one that lies more than the cut-off behind it is dropped. Late records correct their period's
aggregate, dropped ones are counted beside it.

A key may hold a third of all rows, so arrival order is cut into blocks of consecutive ids and each (key, block) is worked on by
itself. The clock at a block's start is the running maximum of block maxima, which are pre-aggregated before the shuffle; it
travels as one marker row a block, so that the records are shuffled once. Inside a block a finger B-tree of partial aggregates
takes the records, a stretch of one period at once; the partial of its root holds the clock, by which records are judged late or dropped.
The tree is bounded by the cut-off, because whole subtrees leave it as the clock moves on. Partials of a period from several blocks add up
in a last aggregation.

Defined results: rows with a null key, row id or event time, or a time within a week of the ends of 64 bits, take no part; copies count as often as they occur; records of equal
time are taken in arrival order; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinewell.functions.instants import roomy
from brinewell.operators.fingertree import FingerTree

HOUR_NS = 3_600_000_000_000
BLOCK_ROWS = 65_536
VERDICTS = "origin string, row_id bigint, bet_pos int, verdict string"
PERIODS = "origin string, key string, period_ns bigint, n bigint, n_late bigint, total double, least double, most double"


def records(origin: str, df: DataFrame, key: Column, row_id: Column, bet_pos: Column, time_ns: Column, value: Column) -> DataFrame:
    """df in the form that the operator reads."""
    out = df.select(
        F.lit(origin).alias("origin"), key.cast("string").alias("key"), row_id.cast("bigint").alias("row_id"),
        bet_pos.cast("int").alias("bet_pos"), time_ns.cast("bigint").alias("t"), value.cast("double").alias("value"),
    )
    return out.where(F.col("key").isNotNull() & F.col("row_id").isNotNull() & roomy(F.col("t")))


def _merge(a: tuple, b: tuple) -> tuple:
    """Partials: records, late ones, sum, least and most of the values, newest event time."""
    return (a[0] + b[0], a[1] + b[1], a[2] + b[2], min(a[3], b[3]), max(a[4], b[4]), max(a[5], b[5]))


class _Run:
    """The tree of one (origin, key, block). The clock is the newest event time in its root's partial."""

    def __init__(self, period: int, cutoff: int):
        self.period, self.cutoff = period, cutoff
        self.tree = FingerTree(_merge)
        self.closed: list[tuple[int, tuple]] = []

    def start(self, clock: int) -> None:
        """The clock that earlier blocks hand on: a partial of no record."""
        self.tree.insert(clock - clock % self.period, (0, 0, 0.0, float("inf"), float("-inf"), clock))

    def ended(self, slot: int) -> bool:
        """Whether a period is over by the clock."""
        root = self.tree.total()
        return root is not None and slot + self.period <= root[5]

    def on_time(self, slot: int, partial: tuple) -> None:
        before = self.tree.last_key()
        self.tree.insert(slot, partial)
        if before is None or slot > before:
            self.closed.extend(self.tree.evict_below((self.tree.total()[5] - self.cutoff) // self.period * self.period))

    def behind(self, t: int, value: float) -> str:
        if t < self.tree.total()[5] - self.cutoff:
            return "dropped"
        self.tree.insert(t - t % self.period, (1, 1, *_valued(value), t))
        return "late"

    def drain(self) -> list[tuple]:
        """The partials of all periods that have a record."""
        out = [(k, *p[:5]) for k, p in (*self.closed, *self.tree.entries()) if p[0]]
        self.closed, self.tree = [], FingerTree(_merge)
        return out


def _valued(v: float) -> tuple[float, float, float]:
    return (v, v, v) if v == v else (0.0, float("inf"), float("-inf"))


def _worker(period: int, cutoff: int, emit: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, at = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            origin, key, block = batch.column("origin"), batch.column("key"), batch.column("block").to_numpy()
            codes = [pa.compute.dictionary_encode(c).indices.to_numpy() for c in (origin, key)]
            change = (np.diff(codes[0]) != 0) | (np.diff(codes[1]) != 0) | (np.diff(block) != 0)
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            rows, pos = batch.column("row_id").to_numpy(), batch.column("bet_pos").to_numpy()
            times, marks = batch.column("t").to_numpy(), batch.column("marker").to_numpy(zero_copy_only=False)
            values = batch.column("value").to_numpy(zero_copy_only=False)
            found: list[list] = [[], [], [], []]
            periods: list[tuple] = []
            for a, b in zip(edges, edges[1:]):
                here = (origin[a].as_py(), key[a].as_py(), int(block[a]))
                if here != at:
                    if run and emit == "periods":
                        periods += [(*at[:2], *p) for p in run.drain()]
                    run, at = _Run(period, cutoff), here
                    if marks[a]:
                        run.start(int(times[a]))
                        a += 1
                if a == b:
                    continue
                # Records of one period that follow each other are on time together or not: none of them moves the clock beyond the period.
                t, v = times[a:b], values[a:b]
                slot = t - t % period
                starts = np.flatnonzero(np.concatenate(([True], np.diff(slot) != 0)))
                ends = np.append(starts[1:], b - a)
                some = v == v
                sums = np.add.reduceat(np.where(some, v, 0.0), starts)
                least = np.minimum.reduceat(np.where(some, v, np.inf), starts)
                most = np.maximum.reduceat(np.where(some, v, -np.inf), starts)
                newest = np.maximum.reduceat(t, starts)
                for i, j, k, s, lo, hi, new in zip(
                    starts.tolist(), ends.tolist(), slot[starts].tolist(), sums.tolist(), least.tolist(), most.tolist(), newest.tolist()
                ):
                    if not run.ended(k):
                        run.on_time(k, (j - i, 0, s, lo, hi, new))
                        continue
                    for n in range(i, j):
                        verdict = run.behind(int(t[n]), float(v[n]))
                        if emit == "verdicts":
                            for column, x in zip(found, (here[0], int(rows[a + n]), int(pos[a + n]), verdict)):
                                column.append(x)
                        elif verdict == "dropped":
                            periods.append((here[0], here[1], k, 0, 0, 0.0, float("inf"), float("-inf")))
            if emit == "verdicts":
                if run:
                    run.closed.clear()
                if found[0]:
                    yield _batch(VERDICTS, found)
            elif periods:
                yield _batch(PERIODS, list(zip(*periods)))
        if run and emit == "periods" and (last := [(*at[:2], *p) for p in run.drain()]):
            yield _batch(PERIODS, list(zip(*last)))

    return work


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _worked(rows: DataFrame, emit: str, schema: str, period_ns: int, cutoff_ns: int, block_rows: int) -> DataFrame:
    rows = rows.withColumn("block", F.expr(f"row_id div {block_rows}"))
    by_key = Window.partitionBy("origin", "key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    clocks = rows.groupBy("origin", "key", "block").agg(F.max("t").alias("t")).withColumn("t", F.max("t").over(by_key)).where("t is not null")
    markers = clocks.select(
        "origin", "key", F.lit(0).cast("bigint").alias("row_id"), F.lit(-1).alias("bet_pos"), "t", F.lit(None).cast("double").alias("value"), "block"
    )
    both = rows.withColumn("marker", F.lit(False)).unionByName(markers.withColumn("marker", F.lit(True)))
    order = ("origin", "key", "block", F.col("marker").desc(), "row_id", "bet_pos")
    ready = both.repartition("origin", "key", "block").sortWithinPartitions(*order)
    return ready.mapInArrow(_worker(period_ns, cutoff_ns, emit), schema)


def late_records(rows: DataFrame, period_ns: int = HOUR_NS, cutoff_ns: int = 6 * HOUR_NS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The late and the dropped records of rows (see records()) with their verdict."""
    return _worked(rows.drop("value").withColumn("value", F.lit(None).cast("double")), "verdicts", VERDICTS, period_ns, cutoff_ns, block_rows)


def corrected_periods(rows: DataFrame, period_ns: int = HOUR_NS, cutoff_ns: int = 6 * HOUR_NS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per origin, key and period with a record: counts, sum and range of the values corrected by late records.

    n counts the records taken, n_late those of them that were late, n_dropped those beyond the cut-off, which are in no
    other figure. total, least and most are null where no taken record has a value.
    """
    parts = _worked(rows, "periods", PERIODS, period_ns, cutoff_ns, block_rows)
    dropped = F.sum(F.when(F.col("n") == 0, 1).otherwise(0))
    some = F.max("most") > float("-inf")
    return parts.groupBy("origin", "key", "period_ns").agg(
        F.sum("n").alias("n"), F.sum("n_late").alias("n_late"), dropped.alias("n_dropped"), F.when(some, F.sum("total")).alias("total"),
        F.when(some, F.min("least")).alias("least"), F.when(some, F.max("most")).alias("most"),
    )
