"""SQL for the queries of reference_queries.py, by the same names. Written from the definitions, not from the Spark plans."""

from __future__ import annotations

from brinewell.functions.domain import CATEGORY_NEEDLES
from brinewell.plans.ingest_queries import _INSTANT, _SESSION

MID, END, HOUR = 1_521_417_600_000_000_000, 1_521_504_000_000_000_000, 3_600_000_000_000

_B = f"b as (select id, market_id, {_INSTANT} as ts_ns, prob_before, prob_after, amount, shares, is_limit_order from bets where ts_ns <> 0)"
_P = "p as (select * from probability_snapshots where probability between 0 and 1 and not isnan(probability))"
_N = (
    "n as (select market_id, probability, ts_ns from (select *, row_number() over (partition by market_id order by ts_ns desc, id desc) as k from p) where k = 1)"
)
_L = """l as (select * from (select substr(market_id, 1, 1) as group_id, market_id as lhs_market,
  lead(market_id) over (partition by substr(market_id, 1, 1) order by market_id) as rhs_market,
  case when ascii(substr(market_id, 3, 1)) % 2 = 0 then '<=' else '>=' end as op from markets) where rhs_market is not null)"""
_E = (
    "e as (select external_market_id, community_prediction from (select market_id as external_market_id, community_prediction, "
    "row_number() over (partition by market_id order by id desc) as k from cross_source_snapshots) where k = 1)"
)
_V = """v as (select l.*, a.probability as lhs_prob, z.probability as rhs_prob,
  case when op = '>=' then greatest(0.0, z.probability - a.probability) else greatest(0.0, a.probability - z.probability) end as gross
  from l join n a on a.market_id = lhs_market join n z on z.market_id = rhs_market)"""
_C = "m as (select * from market_matches where status = 'confirmed')"
_D = """dv as (select manifold_market_id, m.external_market_id, probability, community_prediction, probability - community_prediction as edge
  from m join n on n.market_id = manifold_market_id join e on e.external_market_id = m.external_market_id
  where abs(probability - community_prediction) >= 0.05)"""
_PRED = "pr as (select n.market_id, n.ts_ns, probability as p_market, probability * 0.9 + 0.06 as p_model from n join markets using (market_id) where resolved_outcome is null)"
_SC = "s as (select market_id, resolved_outcome as y, probability as p from n join markets using (market_id) where resolved_outcome is not null)"
_O = "o as (select *, row_number() over (partition by market_id order by ts_ns, id) - 1 as place, count(*) over (partition by market_id) as n from b)"
_FACT = "f as (select market_id, ts_ns, arg_max(probability, id) as probability from p group by 1, 2)"
_DOMAIN = f"""dom as (select s.line_no, s.bet_pos, bet.contractId as market_id, greatest(bet.createdTime, 0) * 1000000 as ts_ns, bet.probBefore as prob_before,
  bet.probAfter as prob_after, bet.amount as amount, bet.shares as shares, cast(bet.limitProb is not null as integer) as is_limit_order
  from ({_SESSION}) s join ws_session w on w.line_no = s.line_no where w.type = 'broadcast')"""
_ISO = (
    r"^(\d{4}-\d\d-\d\d|\d{8})(?:.(\d\d)(?::(\d\d)(?::(\d\d)(?:[.,](\d+))?)?|(\d\d)(?:(\d\d)(?:[.,](\d+))?)?)?(?:(Z)|([+-]\d\d)(?::?(\d\d)(?::?\d\d(?:\.\d+)?)?)?)?)?$"
)
_ISO_NAMES = "'date', 'h', 'i', 's', 'f', 'i2', 's2', 'f2', 'z', 'oh', 'om'"


def _iso(column: str) -> str:
    """ISO text with a calendar date; week dates and seconds in offsets do not occur in the tables."""
    two = lambda *k: "coalesce(" + ", ".join(f"nullif(p.{x}, '')" for x in k) + ", '00')"
    text = f"strftime(d, '%Y-%m-%d') || ' ' || {two('h')} || ':' || {two('i', 'i2')} || ':' || {two('s', 's2')} || '.' || rpad(left(p.f || p.f2, 6), 6, '0') || {two('oh').replace('00', '+00')} || ':' || {two('om')}"
    day = "try_strptime(replace(p.date, '-', ''), '%Y%m%d')"
    return f"""(select case when p.date <> '' and {two('h')} < '24' and {two('oh').replace('00', '+00')}[2:] < '24' and {two('om')} < '60' then epoch_us(try_cast({text} as timestamptz)) * 1000 end
  from (select p, {day} as d from (select regexp_extract({column}, '{_ISO}', [{_ISO_NAMES}], 's') as p)))"""


def _w(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


def _features(window_ns: int) -> str:
    return _w(
        _B,
        "o as (select *, row_number() over (partition by market_id order by ts_ns, id) as rn, "
        "prob_after - lag(prob_after) over (partition by market_id order by ts_ns, id) as d from b)",
        f"w as (select *, min(rn) over (partition by market_id order by ts_ns range between {window_ns} preceding and current row) as s0, "
        "sum(coalesce(d * d, 0)) over (partition by market_id order by ts_ns, id rows unbounded preceding) as q from o)",
        "x as (select *, greatest(s0, rn - 511) as s from w)",
    ) + f"""select x.id, x.market_id, (x.prob_after - y.prob_before) / {window_ns / 1e9!r} as prob_velocity, (x.rn - x.s + 1) / {window_ns / 1e9!r} as bet_arrival_rate,
cast(floor(sqrt(greatest(x.q - y.q, 0)) * 1e6 + 0.5) as bigint) as vol_e6, cast(x.rn - x.s + 1 as integer) as n_window from x join x y on y.market_id = x.market_id and y.rn = x.s"""


_COUNT = """cf as (select id, market_id, ts_ns, prob_after, count(*) over w as n, first_value(prob_after) over w as fp, first_value(ts_ns) over w as ft,
  stddev_pop(d) over i as sd, count(d) over i as nd from (select *, prob_after - lag(prob_after) over (partition by market_id order by ts_ns, id) as d from b)
  window w as (partition by market_id order by ts_ns, id rows between 24 preceding and current row),
  i as (partition by market_id order by ts_ns, id rows between 23 preceding and current row)),
cg as (select id, market_id, case when n >= 2 and ts_ns > ft then (prob_after - fp) / (cast(ts_ns - ft as double) / 1e9) else 0 end as velocity,
  case when n >= 2 and ts_ns > ft then n / (cast(ts_ns - ft as double) / 1e9) else 0 end as rate, case when nd >= 2 then sd else 0 end as vol from cf)"""
_FILL = f"""sg as (select id, market_id, ts_ns, case when id % 100 = 0 then 'YES' else 'NO' end as side from b),
ex as (select sg.id, sg.market_id, sg.side, f.probability as fill_price from sg asof join f on sg.market_id = f.market_id and sg.ts_ns + {HOUR} >= f.ts_ns),
fl as (select *, case when fill_price > 0 and fill_price < 1 then 200.0 / (1 + (fill_price * 0.5) / (0.5 * (1 - fill_price))) end as yes from ex),
fm as (select *, 200.0 - yes as no from fl),
fs as (select *, case when side = 'YES' then yes + 10.0 - yes * pow(no / (no + 10.0), 1.0) else no + 10.0 - no * pow(yes / (yes + 10.0), 1.0) end as shares from fm)"""
_TICKS = """pairs as (select lhs_market || '>' || rhs_market as group_id, lhs_market, rhs_market, op from l),
members as (select group_id, unnest([lhs_market, rhs_market]) as market_id from pairs),
times as (select distinct group_id, f.ts_ns from members join f using (market_id)),
line as (select t.group_id, t.ts_ns, t.market_id, f.probability from (select * from times join members using (group_id)) t
  asof left join f on f.market_id = t.market_id and t.ts_ns >= f.ts_ns)"""
_ENTRY = """tk as (select pairs.group_id as constraint_id, a.ts_ns,
  case when op = '>=' then greatest(0.0, z.probability - a.probability) else greatest(0.0, a.probability - z.probability) end as gross
  from pairs join line a on a.group_id = pairs.group_id and a.market_id = lhs_market
  join line z on z.group_id = pairs.group_id and z.market_id = rhs_market and z.ts_ns = a.ts_ns where a.probability is not null and z.probability is not null),
br as (select *, gross - 0.04 > 0 as act, lag(gross - 0.04 > 0, 1, false) over (partition by constraint_id order by ts_ns) as was from tk where gross > 0),
en as (select constraint_id, ts_ns from br where act and not was)"""
_SIG = """sg as (select 'logical_constraint' as type, '["' || lhs_market || '","' || rhs_market || '"]' as market_refs, gross - 0.04 as edge,
  '2018-04-01T00:00:00+00:00' as detected_at from v where gross > 0 and gross - 0.04 > 0
  union all select 'cross_source_divergence', '["' || manifold_market_id || '","' || external_market_id || '"]', edge, '2018-04-02T00:00:00+00:00' from dv)"""
_CATEGORY = "case " + " ".join(f"when contains(lower(question_text), '{n}') then '{c}'" for n, c in CATEGORY_NEEDLES) + " end"
_OUTCOMES = "case when json_valid({0}) then case when json_type({0}) = 'ARRAY' then from_json({0}, '[\"VARCHAR\"]') end end"

SQL = {
    "r_s5_s6_domain_bets": _w(_DOMAIN) + "select * from dom",
    "r_s9_complete_bets": _w(_DOMAIN)
    + "select * replace (coalesce(amount, 0.0) as amount, coalesce(shares, 0.0) as shares) from dom where ts_ns is not null and prob_before is not null and prob_after is not null",
    "r_s11_first_seen": """with x as (select market_id, lower(question_text) as q from markets where resolved_outcome is not null)
select market_id, cast(case when contains(q, 'win') then 0 when contains(q, 'acquire') then 1 when contains(q, 'rain') then 2 else 3 end as integer) as part
from x where contains(q, 'win') or contains(q, 'acquire') or contains(q, 'rain') or contains(q, 'governor')""",
    "r_s12_s13_manifold": _w(_P, _N) + f"""select market_id, trim(question_text, ' ') as question_text, probability, resolved_outcome is not null as is_resolved, resolved_outcome,
{_CATEGORY} as category from markets join n using (market_id) where platform = 'manifold'""",
    "r_s14_s16_polymarket": f"""with x as (select coalesce(nullif(conditionId, ''), id) as market_id, trim(question, ' ') as question_text,
  {_OUTCOMES.format('outcomes')} as o, {_OUTCOMES.format('outcomePrices')} as pr, coalesce(volumeNum, try_cast(volume as double)) as volume, endDate as close_time
  from polymarket_markets where (closed is null or not closed) and (active is null or active)),
y as (select *, case when len(o) = 2 and len(pr) = 2 then try_cast(pr[case when lower(trim(o[1])) = 'yes' then 1 when lower(trim(o[2])) = 'yes' then 2 else 1 end] as double) end as probability from x)
select market_id, question_text, probability, volume, close_time from y
where market_id <> '' and question_text <> '' and probability between 0 and 1 and (volume is null or volume >= 0)""",
    "r_s20_range": f"select * from feature_snapshots where ts_ns between {MID} and {END}",
    "r_s21_iso_range": f"select * from (select *, {_iso('polled_at')} as ts_ns from cross_source_snapshots) where ts_ns between {MID} and {END}",
    "r_s22_newer": "select id, market_id, ts_ns from feature_snapshots where id > 20000001000",
    "r_s24_load": """select 'synthetic-market-' || m as market_id, cast(1000 as bigint) as n, (1700000000000 + m) * 1000000 as first_ns,
(1700000000000 + 999 * 16 + m) * 1000000 as last_ns from range(16) t(m)""",
    "r_w1_state": _w(_B) + "select market_id, arg_max(prob_after, id) as current_prob, arg_max(ts_ns, id) as last_updated_ns from b group by 1",
    "r_w3_history": _w(_B) + """select id, market_id, ts_ns, prob_after, cast(least(n, 64) - k as bigint) as place from (select *, row_number() over (partition by market_id order by id desc) as k,
count(*) over (partition by market_id) as n from b) where k <= 64""",
    "r_w5_recent": _w(_P) + """select market_id, cast(least(n, 24) - k as integer) as place, probability from (select *, count(*) over (partition by market_id) as n,
row_number() over (partition by market_id order by ts_ns desc, id desc) as k from p) where k <= 24""",
    "r_w6_tail": _w(_P, _N, _FACT) + """, u as (select market_id, ts_ns, probability from f union all select market_id, 1600000000000000000, probability from n)
select market_id, ts_ns, probability from (select *, row_number() over (partition by market_id order by ts_ns desc) as k from u) where k <= 120""".replace("\n, u", ", u"),
    "r_w7_samples": _w(_B, _O) + "select distinct id, market_id, cast(place as bigint) as place from o, range(6) g(i) where n >= 8 and place = 2 + cast(round_even(i * (n - 3) / 5.0, 0) as bigint)",
    "r_w8_training": _w(_B, _O, _COUNT) + """select distinct id, market_id, cast(place as bigint) as place, cast(floor(velocity * 1e9 + 0.5) as bigint) as velocity_e9,
cast(floor(vol * 1e6 + 0.5) as bigint) as vol_e6 from o join cg using (id, market_id), range(6) g(i) where n >= 8 and place = 2 + cast(round_even(i * (n - 3) / 5.0, 0) as bigint)""",
    "r_f4_six_hours": _features(6 * HOUR),
    "r_f4_minute": _features(60 * 10**9),
    "r_f5_count": _w(_B, _COUNT) + """select id, market_id, cast(floor(velocity * 1e9 + 0.5) as bigint) as velocity_e9, cast(floor(rate * 1e9 + 0.5) as bigint) as rate_e9,
cast(floor(vol * 1e6 + 0.5) as bigint) as vol_e6 from cg""",
    "r_j1_training": _w(_P) + """select f.id, f.market_id, f.ts_ns, prob_velocity, resolved_outcome, probability as market_prob from feature_snapshots f join markets m using (market_id)
left join p on p.market_id = f.market_id and p.ts_ns = f.ts_ns where platform = 'manifold' and resolved_outcome is not null""",
    "r_p3_guard": _w(_P) + f"""select * from (select f.id, f.market_id, f.ts_ns, {_iso('close_time')} as close_ns, probability as market_prob from feature_snapshots f join markets m using (market_id)
left join p on p.market_id = f.market_id and p.ts_ns = f.ts_ns where platform = 'manifold' and resolved_outcome is not null)
where market_prob is not null and (close_ns is null or ts_ns < close_ns)""",
    "r_j2_open_rows": _w(_P) + """select f.id, f.market_id, f.ts_ns, prob_velocity, probability as market_prob from feature_snapshots f join markets m using (market_id)
left join p on p.market_id = f.market_id and p.ts_ns = f.ts_ns where platform = 'manifold' and resolved_outcome is null
and f.ts_ns = (select max(ts_ns) from feature_snapshots g where g.market_id = f.market_id)""",
    "r_j3_market_list": _w(_P, _N) + """select m.market_id, n.probability, n.ts_ns, cast(case when k.c is not null then least(k.c, 24) end as integer) as n_recent from markets m left join n using (market_id)
left join (select market_id, count(*) as c from p group by 1) k using (market_id)""",
    "r_j4_asof": _w(_B, _P, _FACT) + "select b.id, b.market_id, b.ts_ns, f.probability as price from b asof left join f on b.market_id = f.market_id and b.ts_ns >= f.ts_ns",
    "r_j5_latency": _w(_B, _P, _FACT) + f"""select x.id, x.market_id, x.ts_ns, x.signal_price, x.exec_ns, f.probability as fill_price from (select b.id, b.market_id, b.ts_ns, f.probability as signal_price,
b.ts_ns + {HOUR} as exec_ns from b asof left join f on b.market_id = f.market_id and b.ts_ns >= f.ts_ns) x
asof left join f on x.market_id = f.market_id and x.exec_ns >= f.ts_ns""",
    "r_j6_timeline": _w(_P, _FACT, _L, _TICKS) + "select * from line",
    "r_j7_divergence": _w(_P, _N, _E, _C, _D) + "select *, case when edge > 0 then 'manifold_higher' else 'polymarket_higher' end as direction from dv",
    "r_j8_violations": _w(_P, _N, _L, _V) + """select lhs_market, rhs_market, op, gross, gross - 0.04 as net, gross - 0.04 > 0 as actionable, case when op = '<=' then lhs_market else rhs_market end as dear_market,
case when op = '<=' then rhs_market else lhs_market end as cheap_market from v where gross > 0""",
    "r_j9_groups": _w(_P, _N, _L) + """, v as (select l.*, coalesce(case when op = '>=' then z.probability - a.probability else a.probability - z.probability end, 0.0) as g
from l left join n a on a.market_id = lhs_market left join n z on z.market_id = rhs_market)
select group_id, lhs_market, rhs_market, greatest(0.0, g) as gross, greatest(0.0, g) - 0.04 as net, g <= 0 as holds, bool_and(g <= 0) over (partition by group_id) as consistent from v""",
    "r_j10_similar": """with e as (select vec_id, embedding::double[] as v from embeddings), u as (select vec_id, v, sqrt(list_dot_product(v, v)) as len from e),
x as (select a.vec_id as left_id, b.vec_id as right_id, 0.8 * list_dot_product(a.v, b.v) / (a.len * b.len) + 0.2 * greatest(0.0, 1 - abs(a.vec_id % 60 - b.vec_id % 60) / 30.0) as score
  from u a join u b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0)
select left_id, right_id, cast(floor(score * 1e6 + 0.5) as bigint) as score_e6, rank from (select *, cast(row_number() over (partition by left_id order by score desc, right_id) as integer) as rank
from x where score >= 0) where rank <= 3""",
    "r_a1_a5_report": _w(_P, _N, _SC) + """, r as (select least(greatest(cast(trunc(p * 10) as integer), 0), 9) as bin, count(*) as k, avg(p) as mp, avg(y) as my from s group by 1)
select count(*) as n, count(distinct market_id) as n_markets, cast(floor(avg(y) * 1e6 + 0.5) as bigint) as base_rate_e6, cast(floor(avg(pow(p - y, 2)) * 1e6 + 0.5) as bigint) as brier_e6,
cast(floor(avg(-(y * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - y) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)))) * 1e6 + 0.5) as bigint) as log_loss_e6,
(select cast(floor(sum(k * abs(my - mp)) / sum(k) * 1e6 + 0.5) as bigint) from r) as ece_e6 from s""",
    "r_a3_reliability": _w(_P, _N, _SC) + """, r as (select least(greatest(cast(trunc(p * 10) as integer), 0), 9) as bin, count(*) as k, avg(p) as mp, avg(y) as my from s group by 1)
select cast(g.i as integer) as bin, coalesce(k, 0) as count, cast(floor(mp * 1e6 + 0.5) as bigint) as mean_e6, cast(floor(my * 1e6 + 0.5) as bigint) as observed_e6 from range(10) g(i) left join r on r.bin = g.i""",
    "r_a7_latency": f"""with w as (select greatest(1, least(60000000000, (w.received_ms - s.bet.createdTime) * 1000000)) as v from ({_SESSION}) s join ws_session w using (line_no) where s.bet.createdTime is not null and w.received_ms is not null),
h as (select v, cast(pow(2, greatest(0, floor(log2(v)) - 10)) as bigint) as width from w), b as (select v // width * width as low, width, count(*) as n from h group by 1, 2),
u as (select *, low + width - 1 as high, sum(n) over (order by low) as upto, sum(n) over () as whole from b)
select cast(sum(n) as bigint) as n, min(high) filter (upto >= ceil(0.5 * whole)) as p50, min(high) filter (upto >= ceil(0.95 * whole)) as p95, min(high) filter (upto >= ceil(0.99 * whole)) as p99,
min(high) filter (upto >= ceil(0.999 * whole)) as p999, max(high) as greatest, cast(floor(sum(n * (low + width // 2)) / cast(sum(n) as double) * 1e3 + 0.5) as bigint) as mean_e3 from u""",
    "r_a10_categories": "select coalesce(category, 'Other') as category, count(*) as n from markets group by 1",
    "r_a13_counts": _w(_P, _N, _L, _V) + """select (select count(*) from markets where resolved_outcome is null) as open_markets, (select count(*) from v where gross > 0 and gross - 0.04 > 0) as constraint_signals,
(select count(distinct group_id) from v where gross > 0) as inconsistent_groups""",
    "r_a14_group_category": "select substr(market_id, 1, 1) as group_id, arg_min(category, market_id) as category from markets where category <> '' group by 1",
    "r_a15_spark_range": _w(_P) + """select market_id, min(probability) as low, max(probability) as high, case when max(probability) - min(probability) = 0 then 1.0 else max(probability) - min(probability) end as span
from (select *, row_number() over (partition by market_id order by ts_ns desc, id desc) as k from p) where k <= 24 group by 1""",
    "r_d8_predictions": _w(_P, _N, _PRED) + """, q as (select *, p_model - p_market >= 0 as up from pr)
select market_id, p_market, p_model, p_model - p_market as edge, case when up then 'YES' else 'NO' end as side,
case when up then p_model * (1 - p_market) - (1 - p_model) * p_market else (1 - p_model) * (1 - (1 - p_market)) - (1 - (1 - p_model)) * (1 - p_market) end - 0.01 - 0.005 as ev from q""",
    "r_k14_above": _w(_P, _N, _PRED) + """, q as (select market_id, case when p_model - p_market >= 0 then p_model * (1 - p_market) - (1 - p_model) * p_market
else (1 - p_model) * (1 - (1 - p_market)) - (1 - (1 - p_model)) * (1 - p_market) end - 0.01 - 0.005 as ev from pr) select * from q where ev > 0.02""",
    "r_d9_d11_pool": _w(_P, _N) + """, q as (select market_id, 100.0 / (1 + (probability * 0.5) / (0.5 * (1 - probability))) as yes from n where probability > 0 and probability < 1), r as (select *, 100.0 - yes as no from q)
select market_id, cast(floor(0.5 * no / (0.5 * no + 0.5 * yes) * 1e9 + 0.5) as bigint) as p_e9, cast(floor((yes + 10.0 - yes * (no / (no + 10.0))) * 1e6 + 0.5) as bigint) as shares_e6,
cast(floor(sqrt(yes) * sqrt(no) * 1e6 + 0.5) as bigint) as k_e6 from r""",
    "r_d12_executions": _w(_B, _P, _FACT, _FILL) + """select id, market_id, fill_price, cast(floor(shares * 1e6 + 0.5) as bigint) as shares_e6, cast(10.0 as double) as cost,
case when yes is null then 'price out of range' end as error from fs""",
    "r_d13_a6_totals": _w(_B, _P, _FACT, _FILL) + """, st as (select case when (side = 'YES' and resolved_outcome = 1) or (side = 'NO' and resolved_outcome = 0) then shares else 0.0 end - 10.0 as pnl
from fs join markets using (market_id) where yes is not null and resolved_outcome is not null)
select count(*) as n, cast(count(*) filter (pnl > 0) as bigint) as wins, cast(floor(sum(pnl) * 1e3 + 0.5) as bigint) as pnl_e3, cast(count(*) * 10.0 as double) as cost,
cast(floor(sum(pnl) / (count(*) * 10.0) * 1e6 + 0.5) as bigint) as roi_e6 from st""",
    "r_d18_iso": f"select id, {_iso('polled_at')} as ts_ns from cross_source_snapshots",
    "r_d20_dates": _w(_B) + "select strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d') as dt, count(*) as n from b group by 1",
    "r_w9_replay": _w(_B) + f"""select * from (select ts_ns, cast(0 as integer) as source_rank, id as row_id, 'bet' as source, market_id from b
union all select ts_ns, 1, id, 'probability', market_id from probability_snapshots union all select ts_ns, 2, id, 'feature', market_id from feature_snapshots
union all select {_iso('polled_at')}, 4, id, 'cross_source', market_id from cross_source_snapshots) where ts_ns is not null""",
    "r_w10_entries": _w(_P, _FACT, _L, _TICKS, _ENTRY) + "select * from en",
    "r_a11_entry_counts": _w(_P, _FACT, _L, _TICKS, _ENTRY) + "select constraint_id, count(*) as n from en group by 1",
    "r_w11_picks": _w(_B, _O) + """select id, market_id, cast(place as bigint) as place from o where place < n // 2 and place % greatest(1, (n // 2) // 5) = 0 and place // greatest(1, (n // 2) // 5) < 5""",
    "r_w12_stages": "select id, cast(5 as bigint) as a_b, case when id % 3 <> 0 then cast(4 as bigint) end as b_z, case when id % 3 = 0 then cast(3 as bigint) else 9 end as a_z from bets",
    "r_d14_legs": _w(_P, _N, _L, _V) + """select lhs_market, rhs_market, case when (op = '<=') = (s = 'NO') then lhs_market else rhs_market end as market_id, s as side, (gross - 0.04) / 2 as theoretical
from v, (select unnest(['NO', 'YES']) as s) where gross > 0 and gross - 0.04 > 0""",
    "r_q6_signals": _w(_P, _N, _E, _C, _D, _L, _V, _SIG) + "select * from sg",
    "r_j11_labels": _w(_P, _N, _E, _C, _D, _L, _V, _SIG)
    + "select distinct market_refs, m.market_id, m.question_text from (select market_refs, unnest(from_json(market_refs, '[\"VARCHAR\"]')) as ref from sg) x join markets m on m.market_id = x.ref",
    "r_j13_buckets": """with x as (select distinct on (conditionId) conditionId, volumeNum, substr(conditionId, 3, 1) as bucket from polymarket_markets),
r as (select *, row_number() over (partition by bucket order by volumeNum desc nulls last, conditionId) as k from x)
select bucket, conditionId as condition_id from r where (bucket = 'a' and k <= 6) or (bucket = 'b' and k <= 4) or (bucket = 'c' and k <= 3)""",
    "r_o7_explorer": _w(_P, _N, _PRED) + """select market_id, coalesce(p_market, -1.0) as by_probability, coalesce(abs(p_model - p_market), 1.0) as by_edge,
coalesce(case when p_model - p_market >= 0 then p_model * (1 - p_market) - (1 - p_model) * p_market else (1 - p_model) * (1 - (1 - p_market)) - (1 - (1 - p_model)) * (1 - p_market) end - 0.0 - 0.0,
cast('-inf' as double)) as by_ev from markets left join pr using (market_id)""",
    "r_o8_featured": _w(_P, _N, _PRED) + "select market_id, abs(p_model - p_market) as edge_size from pr order by 2 desc, 1 desc limit 1",
    "r_p9_explored": "select market_id, question_text from markets where contains(lower(question_text), 'win') and resolved_outcome is null",
    "r_p10_watched": _w(_C) + "select market_id from markets where market_id in (select manifold_market_id from m)",
    "r_p6_by_status": "select id, manifold_market_id, external_market_id from market_matches where status = 'pending'",
    "r_k3_by_date": _w(_B) + "select strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d') as dt, count(*) as n, cast(sum(id) as bigint) as ids from b group by 1",
    "r_k6_placeholders": f"""select distinct bet.contractId as market_id, bet.contractId as question_text from ({_SESSION}) s where bet.contractId is not null
and bet.contractId not in (select market_id from markets where resolved_outcome is null)""",
    "r_k7_replaced": "select market_id, case when platform = 'metaculus' then 'New' else category end as category from markets",
    "r_k8_refilled": _w(_B) + """select market_id, count(*) as n, cast(sum(id) as bigint) as ids from b
where is_limit_order = 1 and market_id < 'c' or market_id not in (select market_id from b where is_limit_order = 1 and market_id < 'c') group by 1""",
    "r_j12_new_pairs": "select market_id as manifold_market_id, '0x0' as external_market_id, 'polymarket' as platform from markets",
}
_SIGNED = _w(_P, _N, _E, _C, _D, _L, _V, _SIG, "si as (select *, cast('0x' || substr(md5(type || market_refs), 1, 15) as bigint) as id from sg)")
_ALL = """pa as (select p.id, p.market_id, p.ts_ns, p.probability as p_market, p.probability * 0.9 + 0.06 as p_model from p join markets using (market_id) where resolved_outcome is null),
pe as (select *, p_model - p_market as edge, case when p_model - p_market >= 0 then p_model * (1 - p_market) - (1 - p_model) * p_market
  else (1 - p_model) * (1 - (1 - p_market)) - (1 - (1 - p_model)) * (1 - p_market) end - 0.0 - 0.0 as ev from pa),
pn as (select * from (select *, row_number() over (partition by market_id order by ts_ns desc, id desc) as k from pe) where k = 1)"""
_LIST = """ml as (select m.market_id, n.probability, n.ts_ns, cast(case when k.c is not null then least(k.c, 24) end as integer) as n_recent from markets m left join n using (market_id)
left join (select market_id, count(*) as c from p group by 1) k using (market_id))"""
_GROUP = """gm as (select substr(market_id, 1, 1) as group_id, market_id, category from markets),
gc as (select l.*, coalesce(case when op = '>=' then z.probability - a.probability else a.probability - z.probability end, 0.0) as g
  from l left join n a on a.market_id = lhs_market left join n z on z.market_id = rhs_market)"""


def _digits(x: str, digits: int) -> str:
    """x with so many decimals, a half going up."""
    whole = f"cast(floor({x} * {10**digits} + 0.5) as bigint)"
    return f"case when {whole} < 0 then '-' else '' end || cast(abs({whole}) // {10**digits} as varchar) || '.' || lpad(cast(abs({whole}) % {10**digits} as varchar), {digits}, '0')"


_BACK = """good as (select m.market_id, n.probability from markets m join n using (market_id)),
gb as (select b.* from b join good using (market_id) where prob_after is not null),
ser as (select market_id, ts_ns from (select *, row_number() over (partition by market_id order by ts_ns desc, id desc) as k from
  (select id, market_id, ts_ns from gb union all select 4611686018427387904, market_id, 1600000000000000000 from good)) where k <= 120)"""
SQL |= {
    "r_s4_frames": """select line_no, v->>'$.type' as type, v->>'$.topic' as topic, try_cast(v->>'$.txid' as bigint) as txid, try_cast(v->>'$.success' as boolean) as success
from (select line_no, case when json_valid(raw_text) then cast(raw_text as json) end as v from ws_raw) where v->>'$.type' in ('ack', 'broadcast')""",
    "r_o2_page": _SIGNED + "select type, market_refs, detected_at from si order by detected_at desc, id desc limit 20 offset 5",
    "r_o1_q2_markets": _w(_P, _N, _ALL, _LIST) + "select ml.market_id, probability, ml.ts_ns, p_model, edge, ev, n_recent from ml left join pn using (market_id)",
    "r_o3_predictions": _w(_P, _ALL) + "select market_id, p_model, edge, ev from pn",
    "r_q3_market": _w(_P, _N, _LIST) + "select * from ml where market_id = (select min(market_id) from p)",
    "r_q4_o10_series": _w(_P) + "select id, ts_ns, probability from p where market_id = (select min(market_id) from p)",
    "r_q5_groups": _w(_P, _N, _L, _GROUP) + """select m.group_id, m.category, coalesce(bool_and(g <= 0) over (partition by m.group_id), true) as consistent, n_markets, lhs_market, op, rhs_market, g <= 0 as holds,
cast(floor(round(greatest(0.0, g), 4) * 1e4 + 0.5) as bigint) as gross_e4, cast(floor(round(greatest(0.0, g) - 0.04, 4) * 1e4 + 0.5) as bigint) as net_e4
from (select group_id, cast(count(*) as integer) as n_markets, arg_min(category, market_id) filter (category <> '') as category from gm group by 1) m left join gc on gc.group_id = m.group_id""",
    "r_q5_members": _w(_P, _N, _GROUP.split("),\n")[0] + ")") + """select group_id, cast(row_number() over (partition by group_id order by market_id) - 1 as integer) as place, market_id, probability from gm left join n using (market_id)""",
    "r_q6_page": _SIGNED + """, k as (select *, count(*) over () as total from si where type = 'cross_source_divergence'), w as (select * from k order by detected_at desc, id desc limit 50)
select id, market_refs, detected_at, total, cast((select count(distinct m.market_id) from markets m where list_contains(from_json(market_refs, '["VARCHAR"]'), m.market_id)) as integer) as n_labels from w""",
    "r_p11_mentioning": _SIGNED + """, w as (select * from si order by detected_at desc, id desc limit 200)
select id, market_refs from w where list_contains(from_json(market_refs, '["VARCHAR"]'), (select min(market_refs->>'$[0]') from si))""",
    "r_p12_kind": _SIGNED + "select id, type, edge from si where type = 'logical_constraint' order by detected_at desc, id desc limit 200",
    "r_a9_total": _SIGNED + "select count(*) as total from si where type = 'cross_source_divergence'",
    "r_o12_pager": _SIGNED + """, t as (select count(*) as total from si), o as (select total, cast(unnest(range(0, total + 1, 10)) as bigint) as offset_ from t)
select total, offset_ as "offset", case when total > 0 then offset_ + 1 else 0 end as start, least(offset_ + 10, total) as "end", offset_ > 0 as has_prev, least(offset_ + 10, total) < total as has_next from o""",
    "r_o9_slices": _w(_P, _N, _PRED, _E, _C, _D, _L, _V, _SIG, "si as (select *, cast('0x' || substr(md5(type || market_refs), 1, 15) as bigint) as id from sg)") + """select * from (select 'market' as kind, market_id as ref from pr order by abs(p_model - p_market) desc, market_id limit 8)
union all select * from (select 'signal', cast(id as varchar) from si order by detected_at desc, id desc limit 6)""",
    "r_d19_iso": """select line_no, case when coalesce(received_ms, 0) = 0 then '' else strftime(make_timestamp(received_ms * 1000), '%Y-%m-%dT%H:%M:%S') ||
case when received_ms % 1000 <> 0 then strftime(make_timestamp(received_ms * 1000), '.%f') else '' end || '+00:00' end as iso from ws_session""",
    "r_d22_formats": _w(_P, _ALL) + f"""select id, {_digits('(p_market * 100)', 1)} || '%' as percent, case when edge * 100 >= 0 then '+' else '' end || {_digits('(edge * 100)', 1)} || ' pp' as points,
case when ev >= 0 then '+' else '' end || {_digits('ev', 3)} as value, strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d %H:%M UTC') as minute from pe""",
    "r_d22_dates": f"""select market_id, case when close_time is null or close_time = '' then '\u2014' else coalesce(strftime(make_timestamp({_iso('close_time')} // 1000), '%b %-d, %Y'), close_time) end as day from markets""",
    "r_d23_labels": """select distinct conditionId, coalesce(case when active then question end, case when starts_with(conditionId, '0x') then substr(conditionId, 1, 6) || '\u2026' || right(conditionId, 4) end, conditionId) as shown from polymarket_markets""",
    "r_d24_spans": _w(_P, _ALL) + """, q as (select id, least(1.0, greatest(0.0, p_market * 1.2 - 0.1)) as a, least(1.0, greatest(0.0, p_model)) as b from pe)
select id, least(a, b) as low, greatest(a, b) as high, b >= a as positive from q""",
    "r_d25_throughput": "select market_id, cast(count(*) as double) as rate0, cast(count(*) * 1000 as double) as rate1, cast(7 as double) as rate2 from bets group by 1",
    "r_s19_constraints": """select group_id, pos, lhs, op, rhs, group_id || '-' || lhs as lhs_market, group_id || '-' || rhs as rhs_market from (select unnest(['a', 'b']) as group_id) g,
(select cast(0 as integer) as pos, 'x' as lhs, '<=' as op, 'y' as rhs union all select 1, 'y', '>=', 'z') c""",
    "r_s19_loaded": """select distinct market_id as manifold_market_id, '0xnew' as external_market_id, 'polymarket' as platform, 'confirmed' as status from markets
union select manifold_market_id, external_market_id, 'polymarket', 'confirmed' from market_matches m where status <> 'rejected' and not exists
(select 1 from market_matches k where k.manifold_market_id = m.manifold_market_id and k.external_market_id = m.external_market_id and k.platform = 'polymarket')""",
    "r_s23_q7_reports": "select * from (values ('latency-v1.md', '# One'), ('latency-v2.md', '# Two')) t(name, text)",
    "r_s26_demo": _w(_P, _N) + """select substr(market_id, 1, 1) as market_id, cast(48 as bigint) as n, cast(floor(round(least(0.98, greatest(0.02, max(probability))), 4) * 1e4 + 0.5) as bigint) as last_e4, true as above, true as below
from n group by 1""",
    "r_s10_search": _w(_P, _N) + """select market_id as id from markets left join n using (market_id) where platform = 'manifold' and contains(lower(question_text), 'win') and resolved_outcome is null
order by probability desc nulls last, market_id limit 20""",
    "r_s17_open": "select conditionId, question, volumeNum from (select distinct * from polymarket_markets) where active and not closed",
    "r_s18_paged": _w(_B) + "select id, market_id, ts_ns from (select *, row_number() over (partition by market_id order by ts_ns desc, id desc) as k from b) where k <= 1000 and prob_after is not null",
    "r_p6_oldest": "select min(id) as id, manifold_market_id, external_market_id, platform, arg_min(status, id) as status from market_matches group by 2, 3, 4",
    "r_p6_by_id": "select id, manifold_market_id, status from market_matches where id = (select max(id) from market_matches)",
    "r_p7_liquid": "select conditionId, count(*) as n from polymarket_markets where coalesce(volumeNum, 0) >= 100 group by 1",
    "r_k1_four_tables": _w(_B) + """select t as "table", market_id, case when t = 'markets' then 1 else n end as n from (select market_id, count(*) as n from b where prob_before is not null and prob_after is not null group by 1),
(select unnest(['markets', 'bets', 'probability_snapshots', 'feature_snapshots']) as t)""",
    "r_k4_export": """select "table", strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d') as dt, count(*) as n, cast(sum(id) as bigint) as ids from (select 'bets' as "table", id, ts_ns from bets
union all select 'probability_snapshots', id, ts_ns from probability_snapshots union all select 'feature_snapshots', id, ts_ns from feature_snapshots) group by 1, 2""",
    "r_k9_backfill": _w(_B, _P, _N, _BACK) + """select market_id, count(*) as n, max(ts_ns) as last_ns, 'bets' as "table" from (select market_id, ts_ns from bets where market_id not in (select market_id from good) union all select market_id, ts_ns from gb) group by 1
union all select market_id, count(*), max(ts_ns), 'probability_snapshots' from (select market_id, ts_ns from probability_snapshots where market_id not in (select market_id from good) union all select * from ser) group by 1
union all select market_id, count(*), max(ts_ns), 'feature_snapshots' from (select market_id, ts_ns from feature_snapshots where market_id not in (select market_id from good) union all select market_id, 1600000000000000000 from good) group by 1
union all select market_id, 1, null, case when market_id in (select market_id from good) then 'New' else coalesce(category, '') end from markets""",
    "r_k13_detection": _w(_P, _N, _E, _C, _D, _L, _V, _SIG) + "select type, market_refs, edge, '2018-04-02T00:00:00+00:00' as detected_at from sg",
    "r_a6_edges": _w(_B, _P, _FACT, _FILL) + """, st as (select case when (side = 'YES' and resolved_outcome = 1) or (side = 'NO' and resolved_outcome = 0) then shares else 0.0 end as payout, abs(fill_price - 0.5) as te
from fs join markets using (market_id) where yes is not null and resolved_outcome is not null)
select count(*) as n, cast(count(*) * 10.0 as double) as stake, cast(floor(sum(payout) * 1e3 + 0.5) as bigint) as payout_e3, cast(floor(sum(te * 10.0) * 1e3 + 0.5) as bigint) as theoretical_pnl_e3,
cast(floor(sum(payout - 10.0) / (count(*) * 10.0) * 1e6 + 0.5) as bigint) as realized_edge_e6, cast(floor(sum(te * 10.0) / (count(*) * 10.0) * 1e6 + 0.5) as bigint) as theoretical_edge_e6 from st""",
    "r_a8_rates": """with h as (select received_ms // 3600000 * 3600000 as start_ms, count(*) as n from ws_session where received_ms is not null group by 1)
select start_ms, n, cast(sum(n) over (order by start_ms) as bigint) as total, cast(floor(n / 3600.0 * 1e9 + 0.5) as bigint) as rate_e9 from h""",
    "r_w12_marks": """select id, cast(5 as bigint) as a_b, case when id % 3 <> 0 then cast(4 as bigint) end as b_z, case when id % 3 = 0 then cast(3 as bigint) else 9 end as a_z, id % 3 <> 0 as in_order from bets where ts_ns is not null""",
    "r_u_predict_proba": """select id, market_id, cast(floor(1 / (1 + exp(-(coalesce(nullif(bet_arrival_rate, 'nan'), 0.0) - 2 * coalesce(nullif(prob_velocity, 'nan'), 0.0) - 0.25))) * 1e6 + 0.5) as bigint) as p_e6 from feature_snapshots""",
}
SQL["r_s8_market"] = _w(_P, _N) + """select market_id, trim(question_text, ' ') as question_text, probability, resolved_outcome is not null as is_resolved from markets join n using (market_id)
where market_id = (select min(market_id) from markets join n using (market_id) where platform = 'manifold')"""
_LETTERS = "[cast(length(q) - length(replace(q, x, '')) as double) for x in split('abcdefghijklmnopqrstuvwxyz', '')]"
SQL["r_u_encoder"] = f"""with l as (select cast('0x' || substr(md5(market_id), 1, 15) as bigint) as id, lower(question_text) as q from markets),
r as (select lower(question) as q from (select distinct question from polymarket_markets where question is not null)),
lv as (select id, {_LETTERS} as v from l where id % 50 = 0), rv as (select {_LETTERS} as v from r),
x as (select id, coalesce(0.8 * list_dot_product(lv.v, rv.v) / nullif(sqrt(list_dot_product(lv.v, lv.v)) * sqrt(list_dot_product(rv.v, rv.v)), 0), 0.0) + 0.2 as score from lv join rv on true)
select id as left_id, cast(floor(score * 1e6 + 0.5) as bigint) as score_e6, rank from (select *, cast(row_number() over (partition by id order by score desc) as integer) as rank from x where score >= 0.6) where rank <= 3"""
_POLLS = SQL["r_s14_s16_polymarket"].replace("from polymarket_markets", "from (select distinct * from polymarket_markets)")
SQL["r_k10_k11_polls"] = f"""with v as ({_POLLS}) select market_id, polled_at, probability as community_prediction from v, (select unnest(['2018-04-01T00:00:00+00:00', '2018-04-03T00:00:00+00:00']) as polled_at)"""
SQL = {k: v.replace("\n, ", ",\n") for k, v in SQL.items()}
