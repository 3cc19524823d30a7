"""Rolling features of bets: by event time over a trailing window (F1 to F4), by count over the last bets (F5), and series.

The event-time window of a bet is what lies in the last window_ns, among the last `capacity` bets of its market, in (ts_ns, id) order.
A hot market is spread over time slots: each slot also gets the bets of the window before it, so that a slot is complete by
itself. The bets of a slot stream through in order; a task holds one batch and the last `capacity` bets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinewell.operators.positions import chunked, placed

SECOND = 1_000_000_000
SNAPSHOT = "id bigint, market_id string, ts_ns bigint, prob_velocity double, bet_arrival_rate double, realized_vol double, n_window int"


def window_features(
    ts: np.ndarray, before: np.ndarray, after: np.ndarray, window_ns: int, capacity: int, group: np.ndarray | None = None
) -> tuple[np.ndarray, ...]:
    """Velocity, arrival rate, volatility and number of bets at each bet. The bets of a group (a market) lie together, in order of time."""
    seconds, at = window_ns / SECOND, np.arange(len(ts))
    if group is None:
        start = np.searchsorted(ts, ts - window_ns, side="left")
    else:
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        place = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ts))))
        since = ts - ts[first][place]
        line = since + place * (int(since.max()) + window_ns + 1)  # all groups on one axis, further apart than a window
        start = np.maximum(np.searchsorted(line, line - window_ns, side="left"), first[place])
    start = np.maximum(start, at - capacity + 1)
    count = at - start + 1
    steps = np.diff(after) ** 2
    if group is not None:
        steps[group[1:] != group[:-1]] = 0.0
    squares = np.concatenate([[0.0], np.cumsum(steps)])
    total = np.maximum(squares[at] - squares[start], 0.0)
    if seconds == 0:
        return np.zeros(len(ts)), np.zeros(len(ts)), np.sqrt(total), count
    return (after - before[start]) / seconds, count / seconds, np.sqrt(total), count


def arrival_features(ts: np.ndarray, before: np.ndarray, after: np.ndarray, window_ns: int, capacity: int, first: int = 0) -> tuple[np.ndarray, ...]:
    """The same for bets in order of arrival, whose times need not be in order, from place first on.

    The window of a bet is what arrived among the last `capacity` bets, itself included, with a time from window_ns before its own up to its own.
    """
    if np.all(np.diff(ts) >= 0):
        return tuple(f[first:] for f in window_features(ts, before, after, window_ns, capacity))
    seconds, out = window_ns / SECOND, []
    for k in range(first, len(ts)):
        a = max(0, k - capacity + 1)
        own = a + np.flatnonzero((ts[a : k + 1] >= ts[k] - window_ns) & (ts[a : k + 1] <= ts[k]))
        moved = float(np.sqrt((np.diff(after[own]) ** 2).sum()))
        out.append(((after[k] - before[own[0]]) / seconds, len(own) / seconds, moved, len(own)) if seconds else (0.0, 0.0, moved, len(own)))
    return tuple(np.array(x) for x in zip(*out)) if out else (np.zeros(0),) * 4


def event_time_features(bets: DataFrame, window_ns: int = 60 * SECOND, capacity: int = 512, slots: int = 8) -> DataFrame:
    """One row per bet. Rows with a null market, time or probability give none."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    width = max(window_ns, 1) * slots
    rows = bets.select("id", "market_id", "ts_ns", "prob_before", "prob_after").dropna(subset=["market_id", "ts_ns", "prob_before", "prob_after"])
    slot = lambda shift: F.expr(f"(ts_ns + {shift} - pmod(ts_ns + {shift}, {width})) div {width}")
    spread = rows.withColumn("own", slot(0)).withColumn("slot", F.explode(F.array_distinct(F.array(slot(0), slot(window_ns)))))
    ready = spread.withColumn("counts", F.col("slot") == F.col("own")).drop("own").repartition("market_id", "slot")
    ready = ready.sortWithinPartitions("market_id", "slot", "ts_ns", "id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_key = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            market, slots_at = batch.column("market_id"), batch.column("slot").to_numpy()
            codes = pa.compute.dictionary_encode(market).indices.to_numpy()
            change = (np.diff(codes) != 0) | (np.diff(slots_at) != 0)
            group = np.concatenate(([0], np.cumsum(change)))
            series = [batch.column(c).to_numpy() for c in ("ts_ns", "prob_before", "prob_after")]
            counts = batch.column("counts").to_numpy(zero_copy_only=False)
            before = held if held_key == (market[0].as_py(), int(slots_at[0])) else [s[:0] for s in series]
            extra = len(before[0])
            whole = [np.concatenate([h, s]) for h, s in zip(before, series)]
            groups = np.concatenate([np.zeros(extra, group.dtype), group])
            # Groups are put on one axis, as many at once as it has room for.
            step = max(1, 2**62 // (width + 2 * window_ns + 2))
            parts = []
            for a in range(0, int(groups[-1]) + 1, step):
                x, y = np.searchsorted(groups, [a, a + step])
                parts.append(window_features(*[w[x:y] for w in whole], window_ns, capacity, groups[x:y]))
            found = [np.concatenate(f)[extra:][counts] for f in zip(*parts)]
            last = int(np.searchsorted(groups, groups[-1]))
            held, held_key = [w[max(last, len(w) - capacity) :] for w in whole], (market[-1].as_py(), int(slots_at[-1]))
            if counts.any():
                keep = pa.array(counts)
                columns = [batch.column(c).filter(keep) for c in ("id", "market_id", "ts_ns")]
                columns += [*map(pa.array, found[:3]), pa.array(found[3].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SNAPSHOT.split(", ")])

    return ready.mapInArrow(work, SNAPSHOT)


def count_features(bets: DataFrame, last: int = 25) -> DataFrame:
    """over the last bets of a market; zeros where there are fewer than two or no time between them; volatility needs two differences."""
    rows = chunked(placed(bets.select("id", "market_id", "ts_ns", "prob_after"), "market_id", "ts_ns", "id"), last)
    order = Window.partitionBy("market_id", "chunk").orderBy("place")
    frame, inner = order.rowsBetween(-(last - 1), 0), order.rowsBetween(-(last - 2), 0)
    rows = rows.withColumn("diff", F.col("prob_after") - F.lag("prob_after").over(order))
    rows = rows.select(
        "id", "market_id", "ts_ns", "prob_after", "own", F.count("*").over(frame).alias("n"), F.first("prob_after").over(frame).alias("first_prob"),
        F.first("ts_ns").over(frame).alias("first_ts"), F.stddev_pop("diff").over(inner).alias("spread"), F.count("diff").over(inner).alias("diffs"),
    ).where("own")
    span = (F.col("ts_ns") - F.col("first_ts")).cast("double") / SECOND
    some = (F.col("n") >= 2) & (F.col("ts_ns") > F.col("first_ts"))
    return rows.select(
        "id", "market_id", "ts_ns", F.when(some, (F.col("prob_after") - F.col("first_prob")) / span).otherwise(0.0).alias("prob_velocity"),
        F.when(some, F.col("n") / span).otherwise(0.0).alias("bet_arrival_rate"), F.when(F.col("diffs") >= 2, F.col("spread")).otherwise(0.0).alias("realized_vol"),
    )


def last_values(df: DataFrame, key: str, order: list[str], value: str, n: int, out: str = "recent") -> DataFrame:
    """The last n values of each key, oldest first. The rows are cut down inside blocks of order before a key's rows meet."""
    parts = [f"__{k}" for k in range(len(order))]
    rows = df.select(key, *[F.col(c).alias(p) for c, p in zip(order, parts)], F.col(value).alias("__v"))
    block = Window.partitionBy(key, F.pmod(F.xxhash64(*parts), F.lit(64))).orderBy(*[F.col(p).desc() for p in parts])
    rows = rows.withColumn("__n", F.row_number().over(block)).where(f"__n <= {n}")
    whole = Window.partitionBy(key).orderBy(*[F.col(p).desc() for p in parts])
    rows = rows.withColumn("__n", F.row_number().over(whole)).where(f"__n <= {n}")
    listed = F.sort_array(F.collect_list(F.struct(*parts, "__v")))
    return rows.groupBy(key).agg(F.transform(listed, lambda s: s["__v"]).alias(out))


def bounded_history(bets: DataFrame, capacity: int = 512) -> DataFrame:
    """The last `capacity` bets of each market in order of arrival, with their place from the oldest."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    rows = placed(bets, "market_id", "id", block=1 << 16)
    first = F.greatest(F.col("n") - capacity, F.lit(0))
    return rows.where(F.col("place") >= first).withColumn("place", F.col("place") - first).drop("n")


def tail_with_now(probabilities: DataFrame, now: DataFrame, keep: int = 120) -> DataFrame:
    """Each market's readings and a point for now, the last `keep` of them."""
    both = probabilities.select("market_id", "ts_ns", "probability").unionByName(now.select("market_id", "ts_ns", "probability"))
    return placed(both, "market_id", "ts_ns").where(F.col("place") >= F.col("n") - keep).drop("place", "n")


def even_places(n: int, k: int) -> list[int]:
    """At most k places spread evenly over 2..n-1, halves to even; of up to two rows the last one."""
    if n <= 0 or k <= 0:
        return []
    if n <= 2:
        return [n - 1]
    span = n - 1 - 2
    if k == 1 or span == 0:
        return [2]
    return sorted({2 + round(i * span / (k - 1)) for i in range(k)})


def sampled_bets(bets: DataFrame, k: int = 6, least: int = 8) -> DataFrame:
    """The bets at evenly spread places of each market with enough of them."""
    rows = placed(bets, "market_id", "ts_ns", "id").where(F.col("n") >= least)
    span = F.col("n") - 3
    if k == 1:
        places = F.array(F.lit(2).cast("bigint"))
    else:
        places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (F.lit(2) + F.bround(i * span / (k - 1), 0)).cast("bigint"))
    wanted = F.when(F.col("n") <= 2, F.array(F.col("n") - 1)).otherwise(places)
    return rows.where(F.array_contains(wanted, F.col("place")))


def training_features(bets: DataFrame, k: int = 6, least: int = 8, last: int = 25) -> DataFrame:
    """Count-based features of the whole history at the sampled bets."""
    return count_features(bets, last).join(sampled_bets(bets, k, least).select("id", "place"), "id")
