"""Queries of the ingest operators (p2 to p5 and p7) over the whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewell.functions.instants import NORMAL_TEXT, epoch_ns, instant_columns
from brinewell.operators import dewey, grid, late
from brinewell.operators.runs import RunStore
from brinewell.sources.tables import table



# The declared fields of a frame, for the labels of its nodes.
FRAME_NAMES = {"$": ["type", "topic", "txid", "success", "data"], "$.data": ["bets"]}
TO_FRAME = 3  # levels from a bet over its list and the data to its frame


def _session_bets(spark: SparkSession, d: str) -> DataFrame:
    """The bets of ws_session, each with its label and its place in its frame: line_no, dewey, bet_pos, bet."""
    frames = table(spark, d, "ws_session")
    nodes = dewey.label_list(frames, F.col("line_no"), F.col("data.bets"), dewey.ordinals("$.data.bets", FRAME_NAMES))
    return nodes.select(F.col("row_id").alias("line_no"), "dewey", dewey.place(F.col("dewey")).alias("bet_pos"), F.col("member").alias("bet"))


def _session_fields(spark: SparkSession, d: str, *fields: str) -> DataFrame:
    """line_no, bet_pos and some fields of the bets of ws_session, null where a member or the field is null; only these leaves are read."""
    whole = table(spark, d, "ws_session").select("line_no", *[F.col(f"data.bets.{f}").alias(f) for f in fields])
    spread = whole.select("line_no", F.posexplode(F.arrays_zip(*fields)).alias("bet_pos", "bet"))
    return spread.select("line_no", "bet_pos", *[F.col("bet")[f].alias(f) for f in fields])


def _late_input(spark: SparkSession, d: str) -> DataFrame:
    bets, features, session = table(spark, d, "bets"), table(spark, d, "feature_snapshots"), _session_fields(spark, d, "contractId", "createdTime", "probAfter")
    c = F.col
    parts = (
        late.records("bets", bets, c("market_id"), c("id"), F.lit(0), epoch_ns(c("ts_ns")), c("prob_after")),
        late.records("feature_snapshots", features, c("market_id"), c("id"), F.lit(0), c("ts_ns"), c("prob_velocity")),
        late.records(
            "ws_session", session, c("contractId"), c("line_no"), c("bet_pos"), F.try_multiply(c("createdTime"), F.lit(10**6)), c("probAfter")
        ),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return late.late_records(_late_input(spark, d))


def p2_hourly(spark: SparkSession, d: str) -> DataFrame:
    hours = late.corrected_periods(_late_input(spark, d))
    return hours.select(
        "origin", F.col("key").alias("market_id"), F.expr("period_ns div 1000000000").alias("hour_epoch_s"), "n", "n_late", "n_dropped",
        F.floor(F.col("total") * 1e7 + 0.5).cast("bigint").alias("total_e7"), "least", "most",
    )


def _raw_nodes(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "ws_raw")
    return dewey.label_json(raw, F.col("line_no"), F.col("raw_text"), as_list={"$.data.bets"}, as_json={"$.data", "$.data.bets"}, names=FRAME_NAMES)


def p3_bets(spark: SparkSession, d: str) -> DataFrame:
    """The table of bets: each with its place in its frame, its label, and its frame's label in the table of frames, by truncation."""
    b, f = F.col("bet"), F.col("fields")
    labels = lambda row: (dewey.label(F.col(row), F.col("dewey")).alias("label"), dewey.label(F.col(row), dewey.parent(F.col("dewey"), TO_FRAME)).alias("parent"))
    session = _session_bets(spark, d).select(
        F.lit("ws_session").alias("origin"), "line_no", "bet_pos", *labels("line_no"),
        F.coalesce(b.contractId, F.lit("")).alias("contract_id"), b.id.alias("bet_id"), b.createdTime.alias("created_ms"), b.probBefore.alias("prob_before"),
        b.probAfter.alias("prob_after"), b.amount.alias("amount"), b.shares.alias("shares"), b.limitProb.alias("limit_prob"),
        b.isFilled.alias("is_filled"), b.isCancelled.alias("is_cancelled"),
    )
    n = lambda name, kind: f[name].try_cast(kind)
    raw = _raw_nodes(spark, d).where("path = '$.data.bets[]'").select(
        F.lit("ws_raw").alias("origin"), F.col("row_id").alias("line_no"), dewey.place(F.col("dewey")).alias("bet_pos"),
        *labels("row_id"),
        F.coalesce(f["contractId"], F.lit("")).alias("contract_id"), f["id"].alias("bet_id"), n("createdTime", "bigint").alias("created_ms"),
        n("probBefore", "double").alias("prob_before"), n("probAfter", "double").alias("prob_after"), n("amount", "double").alias("amount"),
        n("shares", "double").alias("shares"), n("limitProb", "double").alias("limit_prob"), n("isFilled", "boolean").alias("is_filled"),
        n("isCancelled", "boolean").alias("is_cancelled"),
    )
    return session.unionByName(raw)


def p3_frames(spark: SparkSession, d: str) -> DataFrame:
    """The table of frames: every line of ws_session and every line of ws_raw that is one JSON object, with the label that its bets name as their parent."""
    session = table(spark, d, "ws_session").select(
        F.lit("ws_session").alias("origin"), "line_no", dewey.label(F.col("line_no"), F.array()).alias("label"), "type", "topic", "txid", "success", F.coalesce(F.size("data.bets"), F.lit(0)).alias("n_places")
    )
    session = session.withColumn("n_places", F.greatest("n_places", F.lit(0)))
    nodes, f = _raw_nodes(spark, d), F.col("fields")
    raw = nodes.where("path in ('$', '$.data')").groupBy("row_id").agg(
        *[F.max(F.when(F.col("path") == "$", f[k])).alias(k) for k in ("type", "topic", "txid", "success")],
        F.coalesce(F.max(F.when(F.col("path") == "$.data", F.col("counts")["bets"])), F.lit(0)).alias("n_places"),
        F.max((F.col("path") == "$").cast("int")).alias("is_frame"),
    )
    raw = raw.where("is_frame = 1").select(
        F.lit("ws_raw").alias("origin"), F.col("row_id").alias("line_no"), dewey.label(F.col("row_id"), F.array()).alias("label"), "type", "topic", F.expr("try_cast(txid as bigint)").alias("txid"),
        F.expr("try_cast(success as boolean)").alias("success"), "n_places",
    )
    return session.unionByName(raw)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    session = _session_bets(spark, d).select(
        F.lit("ws_session").alias("origin"), "line_no", "bet_pos", F.coalesce("bet.contractId", F.lit("")).alias("contract_id")
    )
    raw = _raw_nodes(spark, d).where("path = '$.data.bets[]'").select(
        F.lit("ws_raw").alias("origin"), F.col("row_id").alias("line_no"), dewey.place(F.col("dewey")).alias("bet_pos"),
        F.coalesce(F.col("fields")["contractId"], F.lit("")).alias("contract_id"),
    )
    return session.unionByName(raw)


def p4_grid(spark: SparkSession, d: str) -> DataFrame:
    cells = grid.to_grid(table(spark, d, "probability_snapshots"), "market_id", "ts_ns", "probability", "id")
    scaled = lambda c, k: F.floor(F.col(c) * k + 0.5).cast("bigint")
    return cells.select(
        F.col("source").alias("market_id"), F.col("cell_epoch_s").alias("hour_epoch_s"), "n_readings", scaled("value", 1e6).alias("value_e6"),
        scaled("coverage", 1e6).alias("coverage_e6"), "state",
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    cells = grid.to_grid(table(spark, d, "probability_snapshots"), "market_id", "ts_ns", "probability", "id")
    return cells.where("n_readings = 0").select(F.col("source").alias("market_id"), F.col("cell_epoch_s").alias("hour_epoch_s"))


BET_KEY = ["market_id", "instant", "prob_before", "prob_after", "amount", "shares", "is_limit_order"]


def _stores(spark: SparkSession, d: str) -> tuple[RunStore, RunStore]:
    """The rows as they arrive, in two batches a store; merging the runs finds the copies that lie in different batches."""
    bets = RunStore(spark, BET_KEY, ["row_id"], required=["instant"])
    rows = table(spark, d, "bets").select(F.col("id").alias("row_id"), epoch_ns(F.col("ts_ns")).alias("instant"), *[c for c in BET_KEY if c != "instant"])
    session = RunStore(spark, ["bet_id"], ["row_id", "bet_pos"], required=["bet_id"])
    frames = _session_fields(spark, d, "id").select(F.col("line_no").alias("row_id"), "bet_pos", F.col("id").alias("bet_id"))
    for store, whole, source, order in ((bets, rows, "bets", "id"), (session, frames, "ws_session", "line_no")):
        ends = table(spark, d, source).agg(F.min(order), F.max(order)).first()
        middle = (ends[0] + ends[1]) // 2 if ends[0] is not None else 0
        store.upsert(whole.where(F.col("row_id") <= middle), "first half")
        store.upsert(whole.where(F.col("row_id") > middle), "second half")
    return bets, session


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    bets, session = _stores(spark, d)
    return (
        bets.copies().select(F.lit("bets").alias("origin"), "row_id", F.lit(0).alias("bet_pos"))
        .unionByName(session.copies().select(F.lit("ws_session").alias("origin"), "row_id", "bet_pos"))
    )


def p5_unique(spark: SparkSession, d: str) -> DataFrame:
    """The rows that remain: exactly one copy of each bet that has an identifier."""
    bets, session = _stores(spark, d)
    return (
        bets.unique().select(F.lit("bets").alias("origin"), "row_id", F.lit(0).alias("bet_pos"))
        .unionByName(session.unique().select(F.lit("ws_session").alias("origin"), "row_id", "bet_pos"))
    )


def _texts(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        table(spark, d, t).select(F.lit(t).alias("origin"), F.col(k).cast("string").alias("row_key"), F.col(c).alias("written"))
        for t, k, c in (("markets", "market_id", "close_time"), ("cross_source_snapshots", "id", "polled_at"), ("polymarket_markets", "conditionId", "endDate"))
    ]
    return instant_columns(parts[0].unionByName(parts[1]).unionByName(parts[2]), "written", "epoch_ns")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts(spark, d).where(F.col("epoch_ns").isNotNull() & ~F.col("written").rlike(NORMAL_TEXT))
    numbers = table(spark, d, "bets").select(
        F.lit("bets").alias("origin"), F.col("id").cast("string").alias("row_key"), epoch_ns(F.col("ts_ns")).alias("epoch_ns"), "ts_ns"
    )
    numbers = numbers.where("epoch_ns is not null and epoch_ns <> ts_ns").drop("ts_ns")
    # Only polymarket_markets repeats rows; the keys of the others are unique.
    repeated = texts.where("origin = 'polymarket_markets'").drop("written").distinct()
    return texts.where("origin <> 'polymarket_markets'").drop("written").unionByName(repeated).unionByName(numbers)


def p7_bets(spark: SparkSession, d: str) -> DataFrame:
    """Every bet with its instant, those in normal form included; null where ts_ns is no instant."""
    return table(spark, d, "bets").select("id", "ts_ns", epoch_ns(F.col("ts_ns")).alias("epoch_ns"))


QUERIES = {
    "p2_found": p2_found, "p2_hourly": p2_hourly, "p3_found": p3_found, "p3_bets": p3_bets, "p3_frames": p3_frames, "p4_found": p4_found,
    "p4_grid": p4_grid, "p5_found": p5_found, "p5_unique": p5_unique, "p7_found": p7_found, "p7_bets": p7_bets,
}

_INSTANT = (
    "case when ts_ns = 0 then null when abs(ts_ns) < 100000000000 then ts_ns * 1000000000 when abs(ts_ns) < 100000000000000 then ts_ns * 1000000 "
    "when abs(ts_ns) < 100000000000000000 then ts_ns * 1000 else ts_ns end"
)
# Texts as written by people, from TESTDATA's rules: a date in one of six forms, a time, a zone by offset, abbreviation or region; or an epoch number.
_WRITTEN = (
    r"^(?:(\d{4})-(\d\d?)-(\d\d?)|(\d{4})(\d\d)(\d\d)|(\d\d?)/(\d\d?)/(\d{4})|(\d\d?)\.(\d\d?)\.(\d{4})|(?:[a-z]{3,9}, )?(\d\d?) ([a-z]{3})[a-z]* (\d{4})|([a-z]{3})[a-z]* (\d\d?), (\d{4}))"
    r"(?:[t ](\d\d?):(\d\d)(?::(\d\d)(?:\.(\d+))?)?|t(\d\d)(\d\d)(\d\d))?(?: ([ap])m\b)?(?: ?([+-])(\d\d):?(\d\d)| ?([a-z]{1,5})| ?\[?([a-z]+/[a-z_]+)\]?)?$"
)
_WRITTEN_NAMES = [
    "y1", "m1", "d1", "y2", "m2", "d2", "m3", "d3", "y3", "d4", "m4", "y4", "d5", "n5", "y5", "n6", "d6", "y6", "h1", "i1", "s1", "f1", "h2", "i2", "s2", "half", "sign", "oh", "om", "word", "region",
]
_HOURS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 1, "bst": 1, "cet": 1, "cest": 2, "eet": 2, "eest": 3, "msk": 3,
    "ast": -4, "adt": -3, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7,
}


def _texts_sql() -> str:
    """Common table expressions up to t (origin, row_key, written, epoch_ns)."""
    n = lambda *k: "coalesce(" + ", ".join(f"try_cast(p.{x} as integer)" for x in k) + ")"
    zero = lambda *k: n(*k)[:-1] + ", 0)"
    month = "(instr('janfebmaraprmayjunjulaugsepoctnovdec', nullif(p.n5 || p.n6, '')) + 2) // 3"
    names = ", ".join(f"'{x}'" for x in _WRITTEN_NAMES)
    hour = f"case when p.half = '' then {zero('h1', 'h2')} when {n('h1')} between 1 and 12 then {n('h1')} % 12 + case when p.half = 'p' then 12 else 0 end end"
    away = "case p.word " + " ".join(f"when '{k}' then {v}" for k, v in _HOURS.items()) + " end"
    return f"""w as (
  select 'markets' as origin, market_id as row_key, close_time as written from markets
  union all select 'cross_source_snapshots', cast(id as varchar), polled_at from cross_source_snapshots
  union all select distinct 'polymarket_markets', conditionId, endDate from polymarket_markets),
r as (select *, regexp_extract(lower(trim(written, ' ')), '{_WRITTEN}', [{names}]) as p, try_cast(case when regexp_full_match(written, '\\d{{9,19}}') then written end as bigint) as ts_ns from w),
c as (select *, make_date({n('y1', 'y2', 'y3', 'y4', 'y5', 'y6')}, {n('m1', 'm2', 'm3', 'm4')[:-1]}, {month}), 1) as first, {n('d1', 'd2', 'd3', 'd4', 'd5', 'd6')} as day, {hour} as hour,
  {zero('i1', 'i2')} as minute, {zero('s1', 's2')} as second from r where {n('m1', 'm2', 'm3', 'm4')[:-1]}, {month}, 1) between 1 and 12),
v as (select *, make_timestamp(epoch_us(first + interval (day - 1) day) + cast((hour * 60 + minute) * 60 + second as bigint) * 1000000) as local
  from c where day between 1 and extract(day from last_day(first)) and hour <= 23 and minute <= 59 and second <= 59),
z as (select *, case when p.sign <> '' then epoch_us(local) - (case p.sign when '-' then -1 else 1 end) * ({zero('oh')} * 60 + {zero('om')}) * cast(60000000 as bigint)
    when p.word <> '' then epoch_us(local) - {away} * cast(3600000000 as bigint) when p.region <> '' then epoch_us(timezone(p.region, local)) else epoch_us(local) end as us from v where p.y1 || p.y2 || p.y3 || p.y4 || p.y5 || p.y6 <> ''),
t as (select origin, row_key, written, us * 1000 + cast(rpad(left(p.f1, 9), 9, '0') as bigint) as epoch_ns from z where us is not null
  union all select origin, row_key, written, {_INSTANT} from r where ts_ns <> 0)"""


_SESSION = (
    "select line_no, cast(pos - 1 as integer) as bet_pos, data.bets[pos] as bet from (select line_no, data, unnest(range(1, len(data.bets) + 1)) as pos "
    "from ws_session where data is not null and data.bets is not null) where data.bets[pos] is not null"
)
# The lines of ws_raw that are whole JSON: frames j (line_no, v), their bets m (line_no, path, v) with the lists in a list unfolded.
_RAW = """j as (select line_no, cast(t as json) as v from (select line_no, ltrim(raw_text, chr(65279)) as t from ws_raw) where json_valid(t)),
d as (select line_no, case when json_type(v, '$.data') = 'VARCHAR' then case when json_valid(v->>'$.data') then cast(v->>'$.data' as json) end else v->'$.data' end as v from j where json_type(v) = 'OBJECT'),
l as (select line_no, case when json_type(v, '$.bets') = 'VARCHAR' then case when json_valid(v->>'$.bets') then cast(v->>'$.bets' as json) end else v->'$.bets' end as v from d where json_type(v) = 'OBJECT'),
u(line_no, path, v) as (
  select line_no, [k], v[k] from (select line_no, v, unnest(range(1, len(v) + 1)) as k from (select line_no, case json_type(v) when 'ARRAY' then from_json(v, '["JSON"]') when 'OBJECT' then [v] end as v from l))
  union all select line_no, list_append(path, k), v[k] from (select line_no, path, v, unnest(range(1, len(v) + 1)) as k from (select line_no, path, from_json(v, '["JSON"]') as v from u where json_type(v) = 'ARRAY'))),
m as (select line_no, cast(row_number() over (partition by line_no order by path) - 1 as integer) as bet_pos, v from u where json_type(v) is distinct from 'ARRAY')"""
_CONTRACT = "case when json_type(v, '$.contractId') in ('OBJECT', 'ARRAY') then '' else coalesce(v->>'$.contractId', '') end"
_LATE = f"""
with session as ({_SESSION}),
rows_in as (
  select 'bets' as origin, market_id as k, id as row_id, cast(0 as integer) as bet_pos, {_INSTANT} as t, prob_after as v from bets
  union all select 'feature_snapshots', market_id, id, 0, ts_ns, prob_velocity from feature_snapshots
  union all select 'ws_session', bet.contractId, line_no, bet_pos, bet.createdTime * 1000000, bet.probAfter from session),
clocked as (
  select *, max(t) over (partition by origin, k order by row_id, bet_pos rows between unbounded preceding and 1 preceding) as m
  from rows_in where k is not null and t is not null),
judged as (
  select *, t // 3600000000000 as h,
    case when m is null or (t // 3600000000000 + 1) * 3600000000000 > m then 'ok' when m - t > 21600000000000 then 'dropped' else 'late' end as verdict
  from clocked)"""
_READINGS = """
with r as (select market_id, id, ts_ns as t, probability as p, ts_ns // 3600000000000 as h from probability_snapshots
  where market_id is not null and ts_ns is not null and probability between 0 and 1 and not isnan(probability)),
c as (select market_id, h, count(*) as n, min(t) as first_t, max(t) as last_t from r group by 1, 2),
n as (select *, lead(h) over (partition by market_id order by h) as nh from c),
holes as (select market_id, h as from_h, unnest(range(h + 1, nh)) as h, last_t from n where nh > h + 1)"""

_RAW_FIELD = lambda name, kind: f"try_cast(v->>'$.{name}' as {kind})"
SQL = {
    "p3_found": f"""with recursive {_RAW} select 'ws_session' as origin, line_no, bet_pos, coalesce(bet.contractId, '') as contract_id from ({_SESSION})
union all select 'ws_raw', line_no, bet_pos, {_CONTRACT} from m where json_type(v) = 'OBJECT'""",
    "p3_bets": f"""with recursive {_RAW}
select 'ws_session' as origin, line_no, bet_pos, line_no || '.4.0.' || bet_pos as label, cast(line_no as varchar) as parent, coalesce(bet.contractId, '') as contract_id, bet.id as bet_id,
  bet.createdTime as created_ms, bet.probBefore as prob_before, bet.probAfter as prob_after, bet.amount as amount, bet.shares as shares, bet.limitProb as limit_prob,
  bet.isFilled as is_filled, bet.isCancelled as is_cancelled from ({_SESSION})
union all select 'ws_raw', line_no, bet_pos, line_no || '.4.0.' || bet_pos, cast(line_no as varchar), {_CONTRACT}, v->>'$.id', {_RAW_FIELD('createdTime', 'bigint')},
  {_RAW_FIELD('probBefore', 'double')}, {_RAW_FIELD('probAfter', 'double')}, {_RAW_FIELD('amount', 'double')}, {_RAW_FIELD('shares', 'double')}, {_RAW_FIELD('limitProb', 'double')},
  {_RAW_FIELD('isFilled', 'boolean')}, {_RAW_FIELD('isCancelled', 'boolean')} from m where json_type(v) = 'OBJECT'""",
    "p3_frames": f"""with recursive {_RAW}
select 'ws_session' as origin, line_no, cast(line_no as varchar) as label, type, topic, txid, success, cast(coalesce(len(data.bets), 0) as integer) as n_places from ws_session
union all select 'ws_raw', line_no, cast(line_no as varchar), v->>'$.type', v->>'$.topic', {_RAW_FIELD('txid', 'bigint')}, {_RAW_FIELD('success', 'boolean')},
  cast((select count(*) from m where m.line_no = j.line_no) as integer) from j where json_type(v) = 'OBJECT'""",
    "p2_found": f"{_LATE} select origin, row_id, bet_pos, verdict from judged where verdict <> 'ok'",
    "p2_hourly": f"""{_LATE} select origin, k as market_id, cast(h * 3600 as bigint) as hour_epoch_s,
  cast(count(*) filter (verdict <> 'dropped') as bigint) as n, cast(count(*) filter (verdict = 'late') as bigint) as n_late,
  cast(count(*) filter (verdict = 'dropped') as bigint) as n_dropped,
  cast(floor(sum(v) filter (verdict <> 'dropped') * 1e7 + 0.5) as bigint) as total_e7,
  min(v) filter (verdict <> 'dropped') as least, max(v) filter (verdict <> 'dropped') as most from judged group by origin, k, h""",
    "p4_found": f"{_READINGS} select market_id, cast(h * 3600 as bigint) as hour_epoch_s from holes",
    "p4_grid": f"""{_READINGS},
iv as (select *, lead(t) over (partition by market_id order by t, id) as nt from r),
cut as (select market_id, p, t, least(coalesce(nt, (h + 1) * 3600000000000), t + 3600000000000) as e, h from iv),
ends as (select market_id, h, p, t, id, row_number() over (partition by market_id, h order by t desc, id desc) as k from r),
cells as (select market_id, h, n from c union all select market_id, h, 0 from holes),
known as (select x.market_id, x.h, x.n, (select max(e.h) from ends e where e.market_id = x.market_id and e.h <= x.h) as kh from cells x),
part as (
  select market_id, g.h, sum(p * (least(e, (g.h + 1) * 3600000000000) - greatest(t, g.h * 3600000000000))) as area,
    sum(least(e, (g.h + 1) * 3600000000000) - greatest(t, g.h * 3600000000000)) as valid
  from cut join (select 0 as d union all select 1) o on true, lateral (select cut.h + o.d as h) g
  where e > g.h * 3600000000000 and t < (g.h + 1) * 3600000000000 and least(e, (g.h + 1) * 3600000000000) > greatest(t, g.h * 3600000000000) group by 1, 2)
select k.market_id, cast(k.h * 3600 as bigint) as hour_epoch_s, cast(k.n as bigint) as n_readings,
  cast(floor(coalesce(case when part.valid > 0 then part.area / part.valid end, e.p) * 1e6 + 0.5) as bigint) as value_e6,
  cast(floor(coalesce(part.valid, 0) / 3600000000000.0 * 1e6 + 0.5) as bigint) as coverage_e6,
  case when k.n > 0 then 'measured' when coalesce(part.valid, 0) > 0 then 'carried' else 'missing' end as state
from known k left join part on part.market_id = k.market_id and part.h = k.h
join ends e on e.market_id = k.market_id and e.h = k.kh and e.k = 1""",
    "p5_found": f"""with session as ({_SESSION}), b as (select id, row_number() over (partition by market_id, {_INSTANT}, prob_before, prob_after,
  amount, shares, is_limit_order order by id) as k from bets where ts_ns <> 0),
s as (select line_no, bet_pos, row_number() over (partition by bet.id order by line_no, bet_pos) as k from session where bet.id is not null)
select 'bets' as origin, id as row_id, cast(0 as integer) as bet_pos from b where k > 1
union all select 'ws_session', line_no, bet_pos from s where k > 1""",
    "p5_unique": f"""with session as ({_SESSION}), b as (select id, row_number() over (partition by market_id, {_INSTANT}, prob_before, prob_after,
  amount, shares, is_limit_order order by id) as k from bets where ts_ns <> 0),
s as (select line_no, bet_pos, row_number() over (partition by bet.id order by line_no, bet_pos) as k from session where bet.id is not null)
select 'bets' as origin, id as row_id, cast(0 as integer) as bet_pos from b where k = 1
union all select 'ws_session', line_no, bet_pos from s where k = 1""",
    "p7_found": f"""with {_texts_sql()}
select distinct origin, row_key, epoch_ns from t where not regexp_full_match(written, '\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\dZ')
union all select 'bets', cast(id as varchar), {_INSTANT} from bets where ts_ns <> 0 and {_INSTANT} <> ts_ns""",
    "p7_bets": f"select id, ts_ns, {_INSTANT} as epoch_ns from bets",
}
