"""Read-only views for serving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinewell.functions.domain import DASH, gross_violation
from brinewell.operators.asof import latest
from brinewell.operators.calibration import side_by_side
from brinewell.operators.features import last_values


def market_list(markets: DataFrame, probabilities: DataFrame, predictions: DataFrame | None = None, recent: int = 24) -> DataFrame:
    """Markets with their newest probability, newest prediction and recent series; markets without any are kept."""
    newest = latest(probabilities, "market_id", ["ts_ns", "id"], "probability", "ts_ns")
    series = last_values(probabilities, "market_id", ["ts_ns", "id"], "probability", recent)
    out = markets.join(newest, "market_id", "left").join(series, "market_id", "left")
    if predictions is not None:
        best = latest(predictions, "market_id", ["ts_ns", "id"], "p_model", "edge", "ev")
        out = out.join(best, "market_id", "left")
    return out


def listed_order() -> list[Column]:
    """O1: markets without a time last, the newest first, then by id."""
    return [F.col("ts_ns").isNull(), F.col("ts_ns").desc(), F.col("market_id")]


def explorer_key(by: str) -> Column:
    """A missing probability counts as -1, a missing value as minus infinity, a missing edge as 1, which puts it on top."""
    keys = {"probability": F.coalesce("probability", F.lit(-1.0)), "ev": F.coalesce("ev", F.lit(float("-inf"))), "edge": F.coalesce(F.abs("edge"), F.lit(1.0))}
    return keys[by]


def explorer_order(by: str) -> list[Column]:
    """The greatest key first, then by id."""
    return [explorer_key(by).desc(), F.col("market_id")]


def market(markets: DataFrame, market_id: str) -> DataFrame:
    """Q3: an empty frame stands for not found."""
    return markets.where(F.col("market_id") == market_id)


def series(probabilities: DataFrame, market_id: str) -> DataFrame:
    """Q4, O10."""
    return probabilities.where(F.col("market_id") == market_id).orderBy("ts_ns", "id")


def page(signals: DataFrame, kind: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first by the text of detected_at, then by id; limit 1 to 200."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1 to 200, offset not below 0")
    rows = signals if kind is None else signals.where(F.col("type") == kind)
    return rows.orderBy(F.col("detected_at").desc(), F.col("id").desc()).offset(offset).limit(limit)


def pager(total: int, limit: int, offset: int) -> dict:
    """O12."""
    end = min(offset + limit, total)
    return {"start": offset + 1 if total else 0, "end": end, "has_prev": offset > 0, "has_next": end < total}


def pager_columns(total: Column, limit: Column, offset: Column) -> list[Column]:
    """O12 over rows of totals and offsets."""
    end = F.least(offset + limit, total)
    return [F.when(total > 0, offset + 1).otherwise(0).alias("start"), end.alias("end"), (offset > 0).alias("has_prev"), (end < total).alias("has_next")]


def total(signals: DataFrame, kind: str | None = None) -> DataFrame:
    """The number of rows that the page's filter leaves; one row."""
    return (signals if kind is None else signals.where(F.col("type") == kind)).agg(F.count("*").alias("total"))


def signals_view(signals: DataFrame, markets: DataFrame, kind: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Q6: a page of signals, each with the labels of its markets and the total of the filter."""
    labelled = signal_labels(page(signals, kind, limit, offset), markets)
    one = total(signals, kind).withColumn("__one", F.lit(1))
    return labelled.withColumn("__one", F.lit(1)).join(one, "__one").drop("__one")


def groups_view(members: DataFrame, constraints: DataFrame, markets: DataFrame, prices: DataFrame, leg_cost: float = 0.02) -> DataFrame:
    """Q5: a row per group: its category, whether it is consistent, its markets and its constraints, nested in order; violations rounded to 4 places.

    members: (group_id, pos, market_id), constraints: (group_id, pos, lhs_market, op, rhs_market). Missing prices count as holding. A group's lists are as long as its
    configuration.
    """
    known = members.join(markets.select("market_id", "question_text", "category"), "market_id", "left").join(prices.select("market_id", "probability"), "market_id", "left")
    listed = known.groupBy("group_id").agg(
        F.min_by("category", F.when(F.col("category") != "", F.col("pos"))).alias("category"),
        F.sort_array(F.collect_list(F.struct("pos", "market_id", "question_text", "probability"))).alias("markets"),
    )
    price = lambda side: prices.select(F.col("market_id").alias(f"{side}_market"), F.col("probability").alias(f"{side}_prob"))
    rows = constraints.join(price("lhs"), "lhs_market", "left").join(price("rhs"), "rhs_market", "left")
    gross = F.coalesce(gross_violation(F.col("op"), F.col("lhs_prob"), F.col("rhs_prob")), F.lit(0.0))
    judged = rows.withColumn("gross", gross).withColumn("holds", F.col("gross") <= 0)
    parts = F.struct("pos", "lhs_market", "op", "rhs_market", "holds", F.round("gross", 4).alias("gross"), F.round(F.col("gross") - 2 * leg_cost, 4).alias("net"))
    told = judged.groupBy("group_id").agg(F.min("holds").alias("consistent"), F.sort_array(F.collect_list(parts)).alias("constraints"))
    return listed.join(told, "group_id", "left").withColumn("consistent", F.coalesce("consistent", F.lit(True)))


def first_rows(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n of an order, as a page shows them."""
    return rows.orderBy(*order).limit(n)


def signal_labels(signals: DataFrame, markets: DataFrame) -> DataFrame:
    """Signals with a map of the questions of the markets they refer to; unknown ones are left out."""
    refs = signals.select("id", F.explode(F.from_json("market_refs", "array<string>")).alias("market_id"))
    named = refs.join(markets.select("market_id", "question_text"), "market_id").distinct()
    labels = named.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("market_id", "question_text")))).alias("labels"))
    return signals.join(labels, "id", "left")


def mentioning(signals: DataFrame, market_id: str, newest: int = 200) -> DataFrame:
    """Of the newest signals those that refer to a market."""
    return page(signals, limit=newest).where(F.array_contains(F.from_json("market_refs", "array<string>"), market_id))


def explored(rows: DataFrame, text: str = "", category: str | None = None, only_open: bool = False, with_edge: bool = False) -> DataFrame:
    """The filters of the explorer."""
    out = rows.where(F.contains(F.lower("question_text"), F.lit(text.lower())))
    if category is not None:
        out = out.where(F.col("category") == category)
    if only_open:
        out = out.where("resolved_outcome is null")
    return out.where("edge <> 0") if with_edge else out


def watched(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """P10."""
    return rows.join(ids.select("market_id").distinct(), "market_id", "left_semi")


def category_counts(markets: DataFrame, name_missing: bool = True) -> DataFrame:
    """A10: with missing categories as 'Other', or without them."""
    rows = markets.withColumn("category", F.coalesce("category", F.lit("Other"))) if name_missing else markets.where("category is not null")
    return rows.groupBy("category").agg(F.count("*").alias("n"))


def counts(markets: DataFrame, signals: DataFrame, groups: DataFrame) -> DataFrame:
    """Open markets, constraint signals, inconsistent groups; one row."""
    a = markets.agg(F.count_if(F.col("resolved_outcome").isNull()).alias("open_markets"))
    b = signals.agg(F.count_if(F.col("type") == "logical_constraint").alias("constraint_signals"))
    c = groups.select("group_id", "consistent").distinct().agg(F.count_if(~F.col("consistent")).alias("inconsistent_groups"))
    return side_by_side(a, b, c)


def group_category(members: DataFrame) -> DataFrame:
    """The first category, in member order, that is not empty: (group_id, pos, category)."""
    some = members.where("category is not null and category <> ''")
    return some.groupBy("group_id").agg(F.min_by("category", "pos").alias("category"))


def spark_range(series: Column) -> list[Column]:
    """Least, greatest and span of a series, a span of 0 as 1."""
    low, high = F.array_min(series), F.array_max(series)
    return [low.alias("low"), high.alias("high"), F.when(high - low == 0, 1.0).otherwise(high - low).alias("span")]


def featured(rows: DataFrame) -> DataFrame:
    """The market with the greatest absolute edge among those with a prediction; one row."""
    some = rows.where("edge is not null")
    return some.agg(F.max_by("market_id", F.struct(F.abs("edge"), "market_id")).alias("market_id"), F.max(F.abs("edge")).alias("edge_size"))


def first_marks(rows: DataFrame, key: str, stage: str, at: str, order: str, stages: list[str]) -> DataFrame:
    """One row per key with a column per stage: of the marks (key, stage, at) of a stage the one that came first in order counts."""
    first = lambda n: F.min_by(F.when(F.col(stage) == n, F.col(at)), F.when(F.col(stage) == n, F.col(order))).alias(n)
    return rows.groupBy(key).agg(*[first(n) for n in stages])


def monotonic(stages: list[str]) -> Column:
    """Whether each mark is at or after the mark before it; missing ones are passed over."""
    marks = F.array_compact(F.array(*stages))
    return F.forall(F.zip_with(marks, F.slice(marks, 2, len(stages)), lambda x, y: F.coalesce(y >= x, F.lit(True))), lambda ok: ok)


def stage_times(rows: DataFrame, marks: list[str]) -> DataFrame:
    """Durations between consecutive marks, null where a mark is missing or runs backwards, and in total."""
    for a, b in zip([*marks[:-1], marks[0]], [*marks[1:], marks[-1]]):
        rows = rows.withColumn(f"{a}_{b}", F.when(F.col(b) >= F.col(a), F.col(b) - F.col(a)))
    return rows


LEAST_NS, MOST_NS, SUB_BUCKETS = 1, 60_000_000_000, 2048  # of the latency histogram: three digits


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """Low, high, n: the filled buckets of a histogram of three digits; values are held within 1 ns to 60 s.

    Values below SUB_BUCKETS have buckets of their own, each doubling beyond has half as many, twice as wide: at most some 28,000 buckets.
    """
    v = F.least(F.greatest(F.col(column).cast("bigint"), F.lit(LEAST_NS)), F.lit(MOST_NS))
    level = F.greatest(F.length(F.bin(v)) - 11, F.lit(0))  # doublings beyond the first buckets
    width = F.expr("shiftleft(1L, level)")
    rows = rows.where(F.col(column).isNotNull()).select(v.alias("v"), level.alias("level"))
    return rows.select((F.col("v") - F.pmod("v", width)).alias("low"), width.alias("width")).groupBy("low", "width").agg(F.count("*").alias("n"))


def latency_report(rows: DataFrame, column: str) -> DataFrame:
    """One row: count, percentiles, greatest and mean of a duration by the histogram; a percentile is the top of its bucket, the mean weighs middles."""
    # The windows see buckets, not rows: a bounded number of them.
    buckets = histogram(rows, column).withColumn("high", F.col("low") + F.col("width") - 1)
    up_to = Window.partitionBy(F.lit(0)).orderBy("low")
    counted = buckets.withColumn("upto", F.sum("n").over(up_to)).withColumn("all", F.sum("n").over(Window.partitionBy(F.lit(0))))
    at = lambda q: F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.lit(q) * F.col("all")), F.lit(1)), F.col("high")))
    middle = F.col("low") + F.expr("width div 2")
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[at(q).alias(name) for q, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"), (0.999, "p999"))],
        F.max("high").alias("greatest"), (F.sum(F.col("n") * middle) / F.nullif(F.sum("n"), F.lit(0))).alias("mean"),
    )


def rates(rows: DataFrame, time_ms: str, seconds: int) -> DataFrame:
    """Per interval that has a row: its start, events, events so far in all, and events a second."""
    start = F.expr(f"`{time_ms}` - pmod(`{time_ms}`, {seconds * 1000})")
    counted = rows.where(F.col(time_ms).isNotNull()).groupBy(start.alias("start_ms")).agg(F.count("*").alias("n"))
    # Running totals by day first, so that no task sees more than a day of intervals and the days.
    day = F.expr("start_ms - pmod(start_ms, 86400000)")
    days = counted.groupBy(day.alias("day")).agg(F.sum("n").alias("of_day"))
    before = F.sum("of_day").over(Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    placed = counted.withColumn("day", day).join(days.select("day", F.coalesce(before, F.lit(0)).alias("before")), "day")
    inside = F.sum("n").over(Window.partitionBy("day").orderBy("start_ms"))
    return placed.select("start_ms", "n", (F.col("before") + inside).alias("total"), (F.col("n") / seconds).alias("per_second"))


def markdown(rows: DataFrame, title: str) -> str:
    """A frame as a Markdown report, every row of it; a report is read by a person, so its frame is small."""
    head = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(head + ["| " + " | ".join(DASH if v is None else str(v) for v in r) + " |" for r in rows.toLocalIterator()]) + "\n"


def backtest_markdown(total: dict, title: str, note: str, period: str) -> str:
    """A row of backtest.totals() as a report."""
    figures = [
        ("Hit rate", f"{total['hit_rate']:.1%}"), ("Total staked", f"{total['stake']:.2f}"), ("Total cost", f"{total['cost']:.2f}"), ("Total payout", f"{total['payout']:.2f}"),
        ("**Realized P&L**", f"**{total['pnl']:+.2f}**"), ("Theoretical P&L (model-expected)", f"{total['theoretical_pnl'] or 0.0:+.2f}"), ("ROI (P&L / cost)", f"{total['roi']:+.2%}"),
        ("Realized edge (P&L / stake)", f"{total['realized_edge']:+.4f}"), ("Theoretical edge (expected / stake)", f"{total['theoretical_edge']:+.4f}"),
    ]
    run = ["## Run", "", f"- Range: {period}", f"- Trades: {total['n']}  (wins: {total['wins']})", ""]
    return "\n".join([f"# {title}", "", f"> {note}", "", *run, "## Results", "", "| Metric | Value |", "|---|---:|", *[f"| {k} | {v} |" for k, v in figures], ""])


def calibration_markdown(report: dict, curve: list[dict], title: str, note: str, bins: int = 10) -> str:
    """A row of calibration.report() and the rows of its reliability curve; empty bins are left out."""
    run = [f"- Training examples: {report['n']}", f"- Distinct resolved markets: {report['n_markets']}", f"- Base rate (YES fraction): {report['base_rate']:.4f}", ""]
    scores = ["| Metric | Value |", "|---|---:|", f"| Brier score | {report['brier']:.4f} |", f"| Expected calibration error | {report['ece']:.4f} |", ""]
    filled = [r for r in sorted(curve, key=lambda r: r["bin"]) if r["count"]]
    rows = [f"| [{r['bin'] / bins:.2f}, {(r['bin'] + 1) / bins:.2f}) | {r['count']} | {r['mean_predicted']:.4f} | {r['observed']:.4f} |" for r in filled]
    table = ["| Bin | Count | Mean predicted | Observed frequency |", "|---|---:|---:|---:|", *rows, ""]
    return "\n".join([f"# {title}", "", f"> {note}", "", "## Run", "", *run, "## Calibration metrics", "", *scores, "## Reliability diagram data", "", *table])


def latency_markdown(segments: dict[str, dict], title: str, parameters: dict) -> str:
    """Rows of latency_report() by segment, in microseconds."""
    columns = ("p50", "p95", "p99", "p999", "greatest", "mean")
    rows = [f"| {name} | {r['n']} | " + " | ".join(f"{r[c] / 1000:.3f}" for c in columns) + " |" for name, r in segments.items()]
    head = ["| Segment | Count | p50 | p95 | p99 | p99.9 | max | mean |", "|---|---:|---:|---:|---:|---:|---:|---:|"]
    return "\n".join([f"# {title}", "", "## Run parameters", "", *[f"- {k}: {v}" for k, v in parameters.items()], "", "## Per-stage latency (microseconds)", "", *head, *rows, ""])


def live_markdown(model: dict, market: dict, title: str) -> str:
    """The model's report beside the market price's."""
    names = (("Brier score", "brier"), ("Log loss", "log_loss"), ("Expected calibration error", "ece"))
    better = "the model" if model["brier"] < market["brier"] else "the market price"
    rows = [f"| {n} | {model[k]:.4f} | {market[k]:.4f} |" for n, k in names]
    return "\n".join([f"# {title}", "", "| Metric (holdout, lower is better) | Model | Market price |", "|---|---|---|", *rows, "", f"**Verdict:** {better} is better calibrated.", ""])
