"""The operators of the inventory as queries over the whole tables (r_ and the inventory's id), with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewell.functions import domain as d
from brinewell.functions.instants import epoch_ns, roomy
from brinewell.operators import archive, asof, backtest, calibration, constraints, features, matches, replay, serving, similarity, sinks
from brinewell.plans.ingest_queries import _INSTANT
from brinewell.session import shared_dir
from brinewell.schemas import BETS, PREDICTIONS
from brinewell.sources import configs, frames, markets, pages, synthetic
from brinewell.sources.tables import table

HOUR = 3_600_000_000_000
SIX_HOURS = 6 * HOUR
MID_NS = 1_521_417_600_000_000_000
END_NS = 1_521_504_000_000_000_000
c = F.col

# ---- the logical tables ------------------------------------------------------------------------------------------------------


def bets(s: SparkSession, at: str) -> DataFrame:
    """Bets with their instant as ts_ns; those without one, or with one within a week of the ends of 64 bits, are left out."""
    return table(s, at, "bets").withColumn("ts_ns", epoch_ns(c("ts_ns"))).where(roomy(c("ts_ns")))


def prices(s: SparkSession, at: str) -> DataFrame:
    return table(s, at, "probability_snapshots").where("probability between 0 and 1 and not isnan(probability)")


def newest_prices(s: SparkSession, at: str) -> DataFrame:
    return asof.latest(prices(s, at), "market_id", ["ts_ns", "id"], "probability", "ts_ns")


def newest_polls(s: SparkSession, at: str) -> DataFrame:
    return matches.newest_external(table(s, at, "cross_source_snapshots"))


def confirmed(s: SparkSession, at: str) -> DataFrame:
    return matches.confirmed(table(s, at, "market_matches"))


def ladder(s: SparkSession, at: str) -> DataFrame:
    """Constraints between neighbours of the markets whose ids begin alike."""
    m = constraints.neighbours(table(s, at, "markets").select("market_id", F.substring("market_id", 1, 1).alias("group_id")))
    op = F.when(F.ascii(F.substring("lhs_market", 3, 1)) % 2 == 0, "<=").otherwise(">=")
    return m.select("group_id", "lhs_market", "rhs_market", op.alias("op"))


def predicted(s: SparkSession, at: str) -> DataFrame:
    """A closed-form stand-in for model output at the newest price of each open market."""
    open_markets = table(s, at, "markets").where("resolved_outcome is null").select("market_id")
    rows = newest_prices(s, at).join(open_markets, "market_id")
    return rows.select("market_id", "ts_ns", c("probability").alias("p_market"), (c("probability") * 0.9 + 0.06).alias("p_model"))


def scored(s: SparkSession, at: str) -> DataFrame:
    outcomes = table(s, at, "markets").where("resolved_outcome is not null").select("market_id", c("resolved_outcome").alias("y"))
    return newest_prices(s, at).join(outcomes, "market_id").select("market_id", "y", c("probability").alias("p"))


def found_signals(s: SparkSession, at: str) -> DataFrame:
    """Signals of both kinds with made-up ids and times, from all constraints and matches."""
    a = constraints.constraint_signals(constraints.violations(ladder(s, at), newest_prices(s, at)), "2018-04-01T00:00:00+00:00")
    b = constraints.divergence_signals(
        constraints.divergences(confirmed(s, at), newest_prices(s, at), newest_polls(s, at)), "2018-04-02T00:00:00+00:00"
    )
    return a.unionByName(b).withColumn("id", F.conv(F.substring(F.md5(F.concat("type", "market_refs")), 1, 15), 16, 10).cast("bigint"))


def entry_ticks(s: SparkSession, at: str) -> DataFrame:
    """Constraints evaluated on the merged timeline of each pair of markets."""
    pairs = ladder(s, at).select(F.concat_ws(">", "lhs_market", "rhs_market").alias("group_id"), "lhs_market", "rhs_market", "op")
    members = pairs.select("group_id", F.explode(F.array("lhs_market", "rhs_market")).alias("market_id"))
    return constraints.ticks(pairs, asof.merged_timeline(members, prices(s, at)))


def signals_to_fill(s: SparkSession, at: str) -> DataFrame:
    """A trade signal at every bet."""
    rows = bets(s, at)
    return rows.select("id", "market_id", "ts_ns", F.when(c("id") % 100 == 0, "YES").otherwise("NO").alias("side"), F.lit(10.0).alias("stake"))


# ---- queries -----------------------------------------------------------------------------------------------------------------


def r_s4_frames(s, at):
    parsed = frames.parse_frames(table(s, at, "ws_raw"), "raw_text")
    return parsed.select("line_no", "frame.type", "frame.topic", "frame.txid", "frame.success")


def r_s5_s6_domain_bets(s, at):
    rows = frames.flatten(table(s, at, "ws_session").where("type = 'broadcast'"), c("data.bets"), "line_no")
    return frames.domain_bets(rows, "line_no", "bet_pos")


def r_s9_complete_bets(s, at):
    return frames.in_time_order(frames.complete_bets(r_s5_s6_domain_bets(s, at)), "line_no", "bet_pos")


def r_s11_first_seen(s, at):
    m = table(s, at, "markets").where("resolved_outcome is not null")
    parts = [m.where(F.contains(F.lower("question_text"), F.lit(w))).select("market_id") for w in ("win", "acquire", "rain", "governor")]
    return markets.first_seen(parts, "market_id", "market_id")


def _raw_manifold(s, at):
    m = table(s, at, "markets").join(newest_prices(s, at).select("market_id", "probability"), "market_id", "left")
    return m.select(
        c("market_id").alias("id"), c("question_text").alias("question"), F.when(c("platform") == "manifold", "BINARY").otherwise("MULTI").alias("outcomeType"),
        "probability", F.lit(None).cast("bigint").alias("closeTime"), c("resolved_outcome").isNotNull().alias("isResolved"),
        F.when(c("resolved_outcome") == 1, "YES").when(c("resolved_outcome") == 0, "NO").alias("resolution"), F.split(c("question_text"), " ").alias("groupSlugs"),
        F.lit(None).cast("double").alias("volume"), F.lit(None).cast("double").alias("totalLiquidity"),
    )


def r_s12_s13_manifold(s, at):
    rows = markets.normalize_manifold(_raw_manifold(s, at))
    return rows.select("market_id", "question_text", "probability", "is_resolved", "resolved_outcome", "category")


def r_s8_market(s, at):
    """The first usable market, asked for by its id."""
    first = table(s, at, "markets").where("platform = 'manifold'").join(newest_prices(s, at), "market_id", "left_semi").agg(F.min("market_id")).first()[0] or ""
    return markets.market_by_id(_raw_manifold(s, at), first).select("market_id", "question_text", "probability", "is_resolved")


def r_s14_s16_polymarket(s, at):
    return markets.normalize_polymarket(table(s, at, "polymarket_markets"))


def r_s20_range(s, at):
    return replay.time_range(table(s, at, "feature_snapshots"), MID_NS, END_NS)


def r_s21_iso_range(s, at):
    return replay.iso_range(table(s, at, "cross_source_snapshots"), "polled_at", MID_NS, END_NS)


def r_s22_newer(s, at):
    return replay.newer_than(table(s, at, "feature_snapshots"), 20_000_001_000).select("id", "market_id", "ts_ns")


def r_s24_load(s, at):
    rows = synthetic.load(s, 1000, 16)
    return rows.groupBy("market_id").agg(F.count("*").alias("n"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


def r_w1_state(s, at):
    return asof.market_state(bets(s, at))


def r_w3_history(s, at):
    return features.bounded_history(bets(s, at), 64).select("id", "market_id", "ts_ns", "prob_after", "place")


def r_w5_recent(s, at):
    rows = features.last_values(prices(s, at), "market_id", ["ts_ns", "id"], "probability", 24)
    return rows.select("market_id", F.posexplode("recent").alias("place", "probability"))


def r_w6_tail(s, at):
    now = newest_prices(s, at).withColumn("ts_ns", F.lit(1_600_000_000_000_000_000))
    distinct = prices(s, at).groupBy("market_id", "ts_ns").agg(F.max_by("probability", "id").alias("probability"))
    return features.tail_with_now(distinct, now, 120)


def r_w7_samples(s, at):
    return features.sampled_bets(bets(s, at)).select("id", "market_id", "place")


def r_w8_training(s, at):
    rows = features.training_features(bets(s, at))
    return rows.select("id", "market_id", "place", d.rounded(c("prob_velocity"), 1e9).alias("velocity_e9"), d.rounded(c("realized_vol"), 1e6).alias("vol_e6"))


def _f4(s, at, window):
    rows = features.event_time_features(bets(s, at), window)
    return rows.select("id", "market_id", "prob_velocity", "bet_arrival_rate", d.rounded(c("realized_vol"), 1e6).alias("vol_e6"), "n_window")


def r_f4_six_hours(s, at):
    return _f4(s, at, SIX_HOURS)


def r_f4_minute(s, at):
    return _f4(s, at, 60 * 10**9)


def r_f5_count(s, at):
    rows = features.count_features(bets(s, at))
    return rows.select(
        "id", "market_id", d.rounded(c("prob_velocity"), 1e9).alias("velocity_e9"), d.rounded(c("bet_arrival_rate"), 1e9).alias("rate_e9"),
        d.rounded(c("realized_vol"), 1e6).alias("vol_e6"),
    )


def r_j1_training(s, at):
    rows = calibration.training_rows(table(s, at, "feature_snapshots"), table(s, at, "markets"), prices(s, at))
    return rows.select("id", "market_id", "ts_ns", "prob_velocity", "resolved_outcome", "market_prob")


def r_p3_guard(s, at):
    rows = calibration.training_rows(table(s, at, "feature_snapshots"), table(s, at, "markets"), prices(s, at))
    rows = calibration.not_ahead(rows.withColumn("close_ns", d.iso_ns(c("close_time"))))
    return calibration.priced(rows).select("id", "market_id", "ts_ns", "close_ns", "market_prob")


def r_j2_open_rows(s, at):
    rows = calibration.newest_open_rows(table(s, at, "feature_snapshots"), table(s, at, "markets"), prices(s, at))
    return rows.select("id", "market_id", "ts_ns", "prob_velocity", "market_prob")


def r_j3_market_list(s, at):
    rows = serving.market_list(table(s, at, "markets"), prices(s, at))
    return rows.select("market_id", "probability", "ts_ns", F.size("recent").alias("n_recent"))


def r_j4_asof(s, at):
    probes = bets(s, at).select("id", "market_id", "ts_ns")
    return asof.asof_backward(probes, prices(s, at), "market_id", "ts_ns", "ts_ns", "id", "probability", "price")


def r_j5_latency(s, at):
    probes = bets(s, at).select("id", "market_id", "ts_ns")
    return asof.asof_with_latency(probes, prices(s, at), HOUR)


def r_j6_timeline(s, at):
    pairs = ladder(s, at).select(F.concat_ws(">", "lhs_market", "rhs_market").alias("group_id"), F.explode(F.array("lhs_market", "rhs_market")).alias("market_id"))
    return asof.merged_timeline(pairs, prices(s, at))


def r_j7_divergence(s, at):
    return constraints.divergences(confirmed(s, at), newest_prices(s, at), newest_polls(s, at))


def r_j8_violations(s, at):
    rows = constraints.violations(ladder(s, at), newest_prices(s, at))
    return rows.select("lhs_market", "rhs_market", "op", "gross", "net", "actionable", "dear_market", "cheap_market")


def r_j9_groups(s, at):
    rows = constraints.group_report(ladder(s, at), newest_prices(s, at))
    return rows.select("group_id", "lhs_market", "rhs_market", "gross", "net", "holds", "consistent")


def r_j10_similar(s, at):
    rows = table(s, at, "embeddings").select(c("vec_id").alias("id"), c("embedding").alias("v"), (c("vec_id") % 60).alias("day"))
    found = similarity.top_matches(rows.where("id % 50 = 0"), rows, top=3, threshold=0.0)
    return found.select("left_id", "right_id", d.rounded(c("score"), 1e6).alias("score_e6"), "rank")


def r_j11_labels(s, at):
    rows = serving.signal_labels(found_signals(s, at), table(s, at, "markets"))
    return rows.select("market_refs", F.explode("labels").alias("market_id", "question_text"))


def r_j12_new_pairs(s, at):
    known = table(s, at, "market_matches").select("manifold_market_id", "external_market_id", "platform")
    wanted = known.where("hash(external_market_id) % 2 = 0").unionByName(
        table(s, at, "markets").select(c("market_id").alias("manifold_market_id"), F.lit("0x0").alias("external_market_id"), F.lit("polymarket").alias("platform"))
    )
    return similarity.not_yet_known(wanted, known, ["manifold_market_id", "external_market_id", "platform"])


def r_j13_buckets(s, at):
    rows = table(s, at, "polymarket_markets").select("conditionId", "volumeNum", F.substring("conditionId", 3, 1).alias("bucket"))
    picked = markets.filled_buckets(rows, "bucket", "conditionId", [c("volumeNum").desc_nulls_last(), c("conditionId")], [("a", 6), ("b", 4), ("c", 3)])
    return s.createDataFrame(picked, "bucket string, condition_id string")


def r_a1_a5_report(s, at):
    r = calibration.report(scored(s, at))
    return r.select("n", "n_markets", *[d.rounded(c(k), 1e6).alias(f"{k}_e6") for k in ("base_rate", "brier", "log_loss", "ece")])


def r_a3_reliability(s, at):
    r = calibration.reliability(scored(s, at), 10)
    return r.select("bin", "count", d.rounded(c("mean_predicted"), 1e6).alias("mean_e6"), d.rounded(c("observed"), 1e6).alias("observed_e6"))


def _waits(s, at):
    rows = table(s, at, "ws_session").select(F.explode("data.bets").alias("b"), "received_ms")
    return rows.select(((c("received_ms") - c("b.createdTime")) * 1_000_000).alias("wait"), "received_ms")


def r_a7_latency(s, at):
    r = serving.latency_report(_waits(s, at), "wait")
    return r.select("n", "p50", "p95", "p99", "p999", "greatest", d.rounded(c("mean"), 1e3).alias("mean_e3"))


def r_a10_categories(s, at):
    return serving.category_counts(table(s, at, "markets"))


def r_a13_counts(s, at):
    groups = constraints.group_report(ladder(s, at), newest_prices(s, at))
    return serving.counts(table(s, at, "markets"), found_signals(s, at), groups)


def r_a14_group_category(s, at):
    m = table(s, at, "markets").select(F.substring("market_id", 1, 1).alias("group_id"), c("market_id").alias("pos"), "category")
    return serving.group_category(m)


def r_a15_spark_range(s, at):
    rows = features.last_values(prices(s, at), "market_id", ["ts_ns", "id"], "probability", 24)
    return rows.select("market_id", *serving.spark_range(c("recent")))


def r_d8_predictions(s, at):
    return calibration.predictions(predicted(s, at), 0.01, 0.005).select("market_id", "p_market", "p_model", "edge", "side", "ev")


def r_k14_above(s, at):
    return calibration.predictions(predicted(s, at), 0.01, 0.005, 0.02).select("market_id", "ev")


def r_d9_d11_pool(s, at):
    half, pool = F.lit(0.5), F.lit(100.0)
    rows = newest_prices(s, at).where("probability > 0 and probability < 1")
    rows = rows.withColumn("yes", d.pool_yes(c("probability"), pool, half)).withColumn("no", pool - c("yes"))
    shares = d.fill_shares(F.lit("YES"), F.lit(10.0), c("yes"), c("no"), half)
    k = d.pool_invariant(c("yes"), c("no"), half)
    return rows.select("market_id", d.rounded(d.pool_probability(c("yes"), c("no"), half), 1e9).alias("p_e9"), d.rounded(shares, 1e6).alias("shares_e6"), d.rounded(k, 1e6).alias("k_e6"))


def r_d12_executions(s, at):
    rows = backtest.executions(signals_to_fill(s, at), prices(s, at), latency_ns=HOUR)
    return rows.select("id", "market_id", "fill_price", d.rounded(c("shares"), 1e6).alias("shares_e6"), "cost", "error")


def r_d13_a6_totals(s, at):
    trades = backtest.executions(signals_to_fill(s, at), prices(s, at), latency_ns=HOUR).where("error is null")
    r = backtest.totals(backtest.settled(trades, table(s, at, "markets").select("market_id", "resolved_outcome")))
    return r.select("n", c("wins").cast("bigint").alias("wins"), d.rounded(c("pnl"), 1e3).alias("pnl_e3"), "cost", d.rounded(c("roi"), 1e6).alias("roi_e6"))


def r_d18_iso(s, at):
    return table(s, at, "cross_source_snapshots").select("id", d.iso_ns(c("polled_at")).alias("ts_ns"))


def r_d20_dates(s, at):
    return bets(s, at).groupBy(d.ns_to_date(c("ts_ns")).alias("dt")).agg(F.count("*").alias("n"))


def r_w9_replay(s, at):
    """The whole tables in one order; rows without an instant have no place in it."""
    polls = table(s, at, "cross_source_snapshots").withColumn("ts_ns", d.iso_ns(c("polled_at")))
    sources = {"bet": bets(s, at), "feature": table(s, at, "feature_snapshots"), "cross_source": polls, "probability": table(s, at, "probability_snapshots")}
    timed = {k: v.where("ts_ns is not null") for k, v in sources.items()}
    return replay.in_order(replay.replay(timed)).select("ts_ns", "source_rank", "row_id", "source", "market_id")


def r_w10_entries(s, at):
    return constraints.entries(entry_ticks(s, at)).select("constraint_id", "ts_ns")


def r_a11_entry_counts(s, at):
    return constraints.entry_counts(constraints.entries(entry_ticks(s, at)))


def r_w11_picks(s, at):
    return backtest.spread_picks(bets(s, at)).select("id", "market_id", "place")


def r_w12_stages(s, at):
    rows = table(s, at, "bets").select("id", c("ts_ns").alias("a"), (c("ts_ns") + 5).alias("b"), F.when(c("id") % 3 == 0, c("ts_ns") + 3).otherwise(c("ts_ns") + 9).alias("z"))
    return serving.stage_times(rows, ["a", "b", "z"]).select("id", "a_b", "b_z", "a_z")


def r_d14_legs(s, at):
    rows = constraints.violations(ladder(s, at), newest_prices(s, at)).where("actionable")
    return constraints.two_legs(rows).select("lhs_market", "rhs_market", "market_id", "side", "theoretical")


def r_o2_page(s, at):
    return serving.page(found_signals(s, at), limit=20, offset=5).select("type", "market_refs", "detected_at")


def r_q6_signals(s, at):
    return found_signals(s, at).select("type", "market_refs", "edge", "detected_at")


def r_o7_explorer(s, at):
    """The keys of the explorer's three orders, for every market."""
    priced = predicted(s, at).select("market_id", c("p_market").alias("probability"), (c("p_model") - c("p_market")).alias("edge"), d.expected_value(c("p_model"), c("p_market")).alias("ev"))
    rows = table(s, at, "markets").join(priced, "market_id", "left")
    keys = [serving.explorer_key(by).alias(f"by_{by}") for by in ("probability", "ev", "edge")]
    return rows.select("market_id", *keys).orderBy(*[F.col(f"by_{by}").desc() for by in ("edge", "ev", "probability")], "market_id")


def r_o8_featured(s, at):
    return serving.featured(predicted(s, at).withColumn("edge", c("p_model") - c("p_market")))


def r_p9_explored(s, at):
    return serving.explored(table(s, at, "markets"), "WIN", None, True).select("market_id", "question_text")


def r_p10_watched(s, at):
    return serving.watched(table(s, at, "markets"), confirmed(s, at).select(c("manifold_market_id").alias("market_id"))).select("market_id")


def r_p6_by_status(s, at):
    return matches.by_status(table(s, at, "market_matches"), "pending").select("id", "manifold_market_id", "external_market_id")


def r_p6_oldest(s, at):
    """Of the matches twice over, the second time under later ids, the oldest of each triple."""
    known = table(s, at, "market_matches")
    return matches.oldest(known.unionByName(known.withColumn("id", c("id") + 10**9))).select("id", *matches.TRIPLE, "status")


def r_p6_by_id(s, at):
    known = table(s, at, "market_matches")
    return matches.by_id(known, known.agg(F.max("id")).first()[0] or 0).select("id", "manifold_market_id", "status")


def r_p7_liquid(s, at):
    return pages.liquid(table(s, at, "polymarket_markets"), 100.0, "volumeNum").groupBy("conditionId").agg(F.count("*").alias("n"))


def r_k3_by_date(s, at):
    path = shared_dir(s, "bets-by-date")
    rows = bets(s, at)
    sinks.write_by_date(rows, path)
    return s.read.schema(rows.withColumn("dt", F.lit("")).schema).parquet(path).groupBy(c("dt").cast("string").alias("dt")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def r_k6_placeholders(s, at):
    seen = frames.flatten(table(s, at, "ws_session"), c("data.bets"), "line_no").select(c("bet.contractId").alias("market_id")).where("market_id is not null")
    return sinks.placeholders(table(s, at, "markets").where("resolved_outcome is null"), seen).select("market_id", "question_text")


def r_k7_replaced(s, at):
    m = table(s, at, "markets")
    return sinks.replaced(m, m.where("platform = 'metaculus'").withColumn("category", F.lit("New")), "market_id").select("market_id", "category")


def r_k8_refilled(s, at):
    b = bets(s, at)
    new = b.where("market_id < 'c' and is_limit_order = 1")
    return sinks.refilled(b, new, "market_id").groupBy("market_id").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


# ---- composed views ------------------------------------------------------------------------------------------------------------


def scored_prices(s: SparkSession, at: str) -> DataFrame:
    """A prediction at every price of an open market, by a closed form."""
    rows = prices(s, at).join(table(s, at, "markets").where("resolved_outcome is null").select("market_id"), "market_id")
    rows = rows.select("id", "market_id", "ts_ns", (c("probability") * 0.9 + 0.06).alias("p_model"), c("probability").alias("p_market"))
    return calibration.predictions(rows).select(*[x.split()[0] for x in PREDICTIONS.split(", ")])


def r_o1_q2_markets(s, at):
    rows = serving.market_list(table(s, at, "markets"), prices(s, at), scored_prices(s, at))
    return rows.orderBy(*serving.listed_order()).select("market_id", "probability", "ts_ns", "p_model", "edge", "ev", F.size("recent").alias("n_recent"))


def r_o3_predictions(s, at):
    return asof.latest(scored_prices(s, at), "market_id", ["ts_ns", "id"], "p_model", "edge", "ev")


def _one_market(s, at):
    return prices(s, at).agg(F.min("market_id")).first()[0] or ""


def r_q3_market(s, at):
    rows = serving.market_list(table(s, at, "markets"), prices(s, at))
    return serving.market(rows, _one_market(s, at)).select("market_id", "probability", "ts_ns", F.size("recent").alias("n_recent"))


def r_q4_o10_series(s, at):
    return serving.series(prices(s, at), _one_market(s, at)).select("id", "ts_ns", "probability")


def _groups(s, at):
    members = table(s, at, "markets").select(F.substring("market_id", 1, 1).alias("group_id"), c("market_id").alias("pos"), "market_id")
    return serving.groups_view(members, ladder(s, at).withColumn("pos", c("lhs_market")), table(s, at, "markets"), newest_prices(s, at))


def r_q5_groups(s, at):
    """The nested view, unfolded again."""
    rows = _groups(s, at).select("group_id", "category", "consistent", F.size("markets").alias("n_markets"), F.explode_outer("constraints").alias("x"))
    return rows.select(
        "group_id", "category", "consistent", "n_markets", "x.lhs_market", "x.op", "x.rhs_market", "x.holds", d.rounded(c("x.gross"), 1e4).alias("gross_e4"), d.rounded(c("x.net"), 1e4).alias("net_e4")
    )


def r_q5_members(s, at):
    rows = _groups(s, at).select("group_id", F.posexplode("markets").alias("place", "m"))
    return rows.select("group_id", "place", "m.market_id", "m.probability")


def r_q6_page(s, at):
    rows = serving.signals_view(found_signals(s, at), table(s, at, "markets"), "cross_source_divergence", 50, 0)
    return rows.select("id", "market_refs", "detected_at", "total", F.coalesce(F.size("labels"), F.lit(0)).alias("n_labels"))


def r_p11_mentioning(s, at):
    """Signals about the first market that any signal names."""
    found = found_signals(s, at)
    first = found.select(F.min(F.get_json_object("market_refs", "$[0]"))).first()[0] or ""
    return serving.mentioning(found, first).select("id", "market_refs")


def r_p12_kind(s, at):
    return serving.page(found_signals(s, at), "logical_constraint", 200).select("id", "type", "edge")


def r_a9_total(s, at):
    return serving.total(found_signals(s, at), "cross_source_divergence")


def r_o12_pager(s, at):
    """Every page of the signals, ten a page."""
    whole = serving.total(found_signals(s, at)).select("total", F.explode(F.sequence(F.lit(0), c("total"), F.lit(10))).alias("offset"))
    return whole.select("total", "offset", *serving.pager_columns(c("total"), F.lit(10), c("offset")))


def r_o9_slices(s, at):
    """Eight markets of the greatest edge and six signals."""
    edges = predicted(s, at).withColumn("edge", c("p_model") - c("p_market"))
    top = serving.first_rows(edges, [F.abs("edge").desc(), c("market_id")], 8).select(F.lit("market").alias("kind"), c("market_id").alias("ref"))
    new = serving.first_rows(found_signals(s, at), [c("detected_at").desc(), c("id").desc()], 6).select(F.lit("signal").alias("kind"), c("id").cast("string").alias("ref"))
    return top.unionByName(new)


# ---- formats and small sources -------------------------------------------------------------------------------------------------


def r_d19_iso(s, at):
    return table(s, at, "ws_session").select("line_no", d.ms_to_iso(c("received_ms")).alias("iso"))


def r_d22_formats(s, at):
    rows = scored_prices(s, at)
    return rows.select(
        "id", d.percent(c("p_market")).alias("percent"), d.signed_points(c("edge")).alias("points"), d.signed_value(c("ev")).alias("value"), d.minute_text(c("ts_ns")).alias("minute")
    )


def r_d22_dates(s, at):
    return table(s, at, "markets").select("market_id", d.date_text(c("close_time")).alias("day"))


def r_d23_labels(s, at):
    named = table(s, at, "polymarket_markets").select("conditionId", F.when(c("active"), c("question")).alias("label")).distinct()
    return named.select("conditionId", d.ref_label(c("label"), c("conditionId")).alias("shown"))


def r_d24_spans(s, at):
    return scored_prices(s, at).select("id", *d.edge_span(c("p_market") * 1.2 - 0.1, c("p_model")))


def r_d25_throughput(s, at):
    """The rates of a report made for each market."""
    n = table(s, at, "bets").groupBy("market_id").agg(F.count("*").alias("n"))
    text = F.concat(F.lit("| Throughput | "), F.format_number("n", 0), F.lit(" ev/s | "), F.format_number(c("n") * 1000, 0), F.lit(" ev/s | 7 ev/s |"))
    return n.withColumn("text", text).select("market_id", *[x.alias(f"rate{k}") for k, x in enumerate(configs.throughput(c("text")))])


def _written(s, name: str, files: dict[str, str]) -> str:
    """Small text files in a shared folder."""
    from brinewell.session import file_system

    path = shared_dir(s, name)
    for file, text in files.items():
        fs, where = file_system(s, f"{path}/{file}")
        out = fs.create(where, True)
        out.write(bytearray(text.encode()))
        out.close()
    return path


def r_s19_constraints(s, at):
    groups = [{"id": g, "markets": [{"key": k, "manifold_market_id": f"{g}-{k}"} for k in "xyz"], "constraints": [{"lhs": "x", "rhs": "y"}, {"lhs": "y", "op": ">=", "rhs": "z"}]} for g in ("a", "b")]
    return s.createDataFrame(configs.constraint_rows({"groups": groups}), configs.CONSTRAINTS)


def r_s19_loaded(s, at):
    """A mapping file of every market: the pairs that are known already stay out."""
    known = table(s, at, "market_matches")
    mapped = known.where("status <> 'rejected'").select("manifold_market_id", "external_market_id").unionByName(
        table(s, at, "markets").select(c("market_id").alias("manifold_market_id"), F.lit("0xnew").alias("external_market_id"))
    )
    return matches.loaded(mapped, known).select(*matches.TRIPLE, "status")


def r_s23_q7_reports(s, at):
    path = _written(s, "reports", {"latency-v1.md": "# One", "latency-v2.md": "# Two", "backtest.md": "# Three", "notes.txt": "# Four"})
    return configs.read_reports(s, path, "^latency")


def r_s26_demo(s, at):
    """Series to the newest price of each bucket of markets; they end on it."""
    targets = newest_prices(s, at).groupBy(F.substring("market_id", 1, 1).alias("market_id")).agg(F.max("probability").alias("p")).orderBy("market_id").collect()
    made = synthetic.demo_series(s, {r.market_id: r.p for r in targets}, 48)
    ends = made.groupBy("market_id").agg(F.count("*").alias("n"), F.max_by("probability", "ts_ns").alias("last"), F.min("probability").alias("low"), F.max("probability").alias("high"))
    return ends.select("market_id", "n", d.rounded(c("last"), 1e4).alias("last_e4"), (c("low") >= 0.02).alias("above"), (c("high") <= 0.98).alias("below"))


def r_s10_search(s, at):
    raw = _raw_manifold(s, at).withColumn("totalLiquidity", c("probability")).withColumn("groupSlugs", F.split(F.lower("question"), " "))
    return pages.search(raw, "win", None, "open", "liquidity", 20).select("id")


def r_s17_open(s, at):
    """Every record through landed page files, the open ones by volume."""
    path = shared_dir(s, "pages")
    raw = table(s, at, "polymarket_markets")
    raw.distinct().write.mode("overwrite").json(path)
    schema = ", ".join(f"{n} {k}" for n, k in raw.dtypes)
    rows = s.read.schema(schema).json(path)
    return pages.open_by_volume(rows).select("conditionId", "question", "volumeNum")


def r_s18_paged(s, at):
    return pages.newest_bets(bets(s, at), pages.PAGE).select("id", "market_id", "ts_ns")


# ---- sinks and passes ----------------------------------------------------------------------------------------------------------


def r_k1_four_tables(s, at):
    """Every bet with its features through the four-table sink, read back."""
    made = features.event_time_features(bets(s, at), SIX_HOURS).drop("market_id", "ts_ns")
    path = shared_dir(s, "four")
    batch = bets(s, at).join(made, "id")
    sinks.write_four(batch, 7, path, dry_run=True)
    for _ in range(2):  # a batch that comes again replaces itself
        sinks.write_four(batch, 7, path)
    names = ("markets", "bets", "probability_snapshots", "feature_snapshots")
    parts = [sinks.committed(s, path, n).groupBy("market_id").agg(F.count("*").alias("n")).select(F.lit(n).alias("table"), "market_id", "n") for n in names]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def r_k4_export(s, at):
    """Three tables in two passes: the first half of the ids, then what is new, then nothing new."""
    names = ("bets", "probability_snapshots", "feature_snapshots")
    tables = {n: table(s, at, n).select("id", "market_id", "ts_ns").where("id is not null") for n in names}
    halves = {n: t.where(c("id") <= (t.agg(F.avg("id")).first()[0] or 0)) for n, t in tables.items()}
    path = shared_dir(s, "export")
    for step in (halves, tables, tables):
        archive.export_new(step, path)
    empty = s.createDataFrame([], "id bigint, dt string")
    marks = archive.watermarks(s, path)
    out = [(archive.exported(s, path, n).select("id", c("dt").cast("string").alias("dt")) if n in marks else empty).withColumn("table", F.lit(n)) for n in names]
    rows = out[0].unionByName(out[1]).unionByName(out[2])
    return rows.groupBy("table", "dt").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


NOW_NS = 1_600_000_000_000_000_000


def _backfilled(s, at):
    known = {n: table(s, at, n) for n in ("markets", "bets", "probability_snapshots", "feature_snapshots")}
    fresh = newest_prices(s, at).select("market_id", "probability")
    given = table(s, at, "markets").select("market_id", "question_text", "close_time", "resolved_outcome", F.lit("New").alias("category")).join(fresh, "market_id", "left")
    return archive.backfill(known, given, bets(s, at), NOW_NS)


def r_k9_backfill(s, at):
    """All markets filled anew but those without a price, which are skipped and keep what they had: rows and their last time, by table and market."""
    tables = _backfilled(s, at)
    parts = [t.groupBy("market_id").agg(F.count("*").alias("n"), F.max("ts_ns").alias("last_ns")).withColumn("table", F.lit(n)) for n, t in tables.items() if n != "markets"]
    new = tables["markets"].select("market_id", F.lit(1).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("last_ns"), F.coalesce("category", F.lit("")).alias("table"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(new)


def r_k10_k11_polls(s, at):
    """Two polls of the open venue's prices by the loop, one of three tries failing."""
    path, tries = shared_dir(s, "polls"), []

    def once():
        tries.append(len(tries))
        if tries[-1] == 1:
            raise OSError("no answer")
        rows = markets.normalize_polymarket(table(s, at, "polymarket_markets").distinct())
        sinks.poll(rows, f"2018-04-0{len(tries)}T00:00:00+00:00").write.mode("append").parquet(path)

    archive.repeated(once, 0.0, most=3, errors=(OSError,))
    return s.read.parquet(path)


def r_k13_detection(s, at):
    """Two detection passes: the second replaces the kinds that it finds."""
    path = shared_dir(s, "signals")
    for stamp in ("2018-04-01T00:00:00+00:00", "2018-04-02T00:00:00+00:00"):
        sinks.replace_kind(constraints.detection(ladder(s, at), confirmed(s, at), newest_prices(s, at), newest_polls(s, at), stamp), path)
    schema = "market_refs string, edge double, detected_at string, details_json string, type string"
    return s.read.schema(schema).parquet(path).select("type", "market_refs", "edge", "detected_at")


def r_a6_edges(s, at):
    """Totals with the edges per unit staked, each trade promising what its side is dear by."""
    trades = backtest.executions(signals_to_fill(s, at), prices(s, at), latency_ns=HOUR).where("error is null").withColumn("theoretical_edge", F.abs(c("fill_price") - 0.5))
    r = backtest.totals(backtest.settled(trades, table(s, at, "markets").select("market_id", "resolved_outcome")))
    return r.select("n", "stake", *[d.rounded(c(k), 1e3).alias(f"{k}_e3") for k in ("payout", "theoretical_pnl")], *[d.rounded(c(k), 1e6).alias(f"{k}_e6") for k in ("realized_edge", "theoretical_edge")])


def r_a8_rates(s, at):
    return serving.rates(table(s, at, "ws_session"), "received_ms", 3600).select("start_ms", "n", "total", d.rounded(c("per_second"), 1e9).alias("rate_e9"))


def r_w12_marks(s, at):
    """Marks of three stages of every bet, the last one marked again later."""
    rows = table(s, at, "bets").where("ts_ns is not null").select("id", "ts_ns")
    mark = lambda stage, at_ns, n: F.struct(F.lit(stage).alias("stage"), at_ns.alias("at"), F.lit(n).alias("n"))
    last = F.when(c("id") % 3 == 0, c("ts_ns") + 3).otherwise(c("ts_ns") + 9)
    marks = rows.select("id", F.explode(F.array(mark("a", c("ts_ns"), 1), mark("b", c("ts_ns") + 5, 2), mark("z", last, 3), mark("z", c("ts_ns") - 1, 4))).alias("m")).select("id", "m.*")
    timed = serving.first_marks(marks, "id", "stage", "at", "n", ["a", "b", "z"])
    return serving.stage_times(timed, ["a", "b", "z"]).select("id", "a_b", "b_z", "a_z", serving.monotonic(["a", "b", "z"]).alias("in_order"))


class ClosedForm:
    """A fitted object as others bring it."""

    def predict_proba(self, frame):
        import numpy as np

        p = 1 / (1 + np.exp(-(frame["bet_arrival_rate"].fillna(0.0) - 2 * frame["prob_velocity"].fillna(0.0) - 0.25)))
        return np.column_stack([1 - p, p])


def r_u_predict_proba(s, at):
    scored_rows = calibration.predicted_by(table(s, at, "feature_snapshots"), ClosedForm(), ("prob_velocity", "bet_arrival_rate"))
    return scored_rows.select("id", "market_id", d.rounded(c("p_model"), 1e6).alias("p_e6"))


def letters(texts):
    """An encoder as others inject it: how often each letter occurs."""
    import numpy as np

    return np.array([[t.lower().count(x) for x in "abcdefghijklmnopqrstuvwxyz"] for t in texts], float)


def r_u_encoder(s, at):
    """Questions by an injected encoder: those with an id divisible by 50 against all of the other source."""
    number = lambda k: F.conv(F.substring(F.md5(k), 1, 15), 16, 10).cast("bigint").alias("id")
    left = table(s, at, "markets").select(number("market_id"), c("question_text").alias("text"), F.lit(None).cast("double").alias("day"))
    other = table(s, at, "polymarket_markets").groupBy("question").agg(F.min("conditionId").alias("k"))
    right = other.select(number("k"), c("question").alias("text"), F.lit(None).cast("double").alias("day"))
    found = similarity.match_texts(left.where("id % 50 = 0"), right, letters, top=3, threshold=0.6)
    return found.select("left_id", d.rounded(c("score"), 1e6).alias("score_e6"), "rank")


_HERE = globals()
QUERIES = {k: v for k, v in list(_HERE.items()) if k.startswith("r_") and callable(v)}

from brinewell.plans.reference_sql import SQL  # noqa: E402, F401
