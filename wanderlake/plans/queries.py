"""The registered queries with their SQL for DuckDB. Counts are longs, doubles rounded to six places, times strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, stats
from ..operators import clean, days, evidence, joins, locate, recommend, reliability, serving, windows
from ..sources.trajectories import points, table, visits
from . import home_office

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def tidy(df: DataFrame) -> DataFrame:
    form = {"int": lambda c: c.cast("long"), "double": lambda c: F.round(c, 6), "timestamp_ntz": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"), "date": lambda c: c.cast("string")}
    return df.select(*[form.get(t, lambda c: c)(F.col(f"`{n}`")).alias(n) for n, t in df.dtypes])


VISITS = """
with g as (select *, lag(ts) over (partition by user_id order by ts, event_id) as p from events),
w as (select user_id, event_id, event_type, ts, ts + interval 8 hour as lt from g where p is null or epoch_us(ts) - epoch_us(p) >= 7200000000),
v as (select *, case when user_id % 3 = 0 then event_id % 4 when event_id % 5 = 0 then 2 + event_id % 3
    when hour(lt) >= 21 or hour(lt) < 6 then 0 when isodow(lt) <= 5 and hour(lt) between 9 and 17 then 1 else 2 + event_id % 3 end as place from w)
"""
STAYS = VISITS + """,
l as (select user_id, place, dense_rank() over (partition by user_id order by min(ts)) - 1 as location_id from v group by user_id, place),
s as (select v.*, location_id, lt as la, lt + interval 1500 second as ld, cast(lt as date) as ldate from v join l using (user_id, place)),
loc as (select user_id, location_id, count(*) as stay_count, count(distinct ldate) as distinct_dates, count(*) * 1500 / 3600.0 as dwell_h from s group by all)
"""
DEFECTS = VISITS + """,
q as (select user_id, event_id, unnest(range(6)) as k, ts, 39.90 + 0.01 * (user_id % 50) + 0.005 * place + 0.00005 * (event_id % 3 - 1) as lat, 116.40 + 0.004 * place as lon from v),
p0 as (select user_id, event_id, k, ts + to_seconds(k * 300) as ts, lat, lon from q),
pts as (
  select user_id, ts, case when event_id % 97 = 0 and k = 2 then 200.0 else lat end as lat, lon from p0
  union all select user_id, ts, lat + 0.02, lon from p0 where event_id % 89 = 0 and k = 3
  union all select user_id, ts + interval 60 second, lat + 1.0, lon from p0 where event_id % 83 = 0 and k = 1),
m as (select user_id, ts, count(*) as n, count(*) filter (abs(lat) <= 90) as ok, median(lat) filter (abs(lat) <= 90) as la, median(lon) filter (abs(lat) <= 90) as lo from pts group by all),
r as (select m.user_id, m.ts, n, ok, la, lo, max(2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(la - lat) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lo - lon) / 2), 2))))) filter (abs(lat) <= 90) as rad
  from m join pts using (user_id, ts) group by all),
e as (select *, ok > 0 and rad > 10 as amb, n > ok as inv, ok > 0 and not (ok > 0 and rad > 10) as kept, case when ok > 0 and rad > 10 then 'same_second_spatial_ambiguity' when n > ok then 'invalid_coordinate' end as own from r),
x as (select *, last_value(case when own is not null then ts end ignore nulls) over a as b_ts, last_value(own ignore nulls) over a as b_own,
    last_value(case when kept then ts end ignore nulls) over b as p_ts, last_value(case when kept then la end ignore nulls) over b as p_la, last_value(case when kept then lo end ignore nulls) over b as p_lo
  from e window a as (partition by user_id order by ts rows between unbounded preceding and current row), b as (partition by user_id order by ts rows between unbounded preceding and 1 preceding)),
y as (select *, case when p_ts is null or b_ts > p_ts then b_own end as explicit, (epoch_us(ts) - epoch_us(p_ts)) / 1e6 as dt,
    2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(la - p_la) / 2), 2) + cos(radians(la)) * cos(radians(p_la)) * pow(sin(radians(lo - p_lo) / 2), 2)))) as dist from x),
z as (select *, case when kept and explicit is null then case when dt > 300 then 'temporal_gap' when dt > 0 and dist / dt * 3.6 > 1200 then 'hard_speed_guard' end end as implied from y)
"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _contrib(rule: evidence.WindowRule) -> str:
    end = rule.end_hour if rule.end_hour > rule.start_hour else rule.end_hour + 24
    return f"""
  select user_id, location_id, d, sum(o) as o from (
    select user_id, location_id, d, (least(epoch_us(ld), epoch_us(d + interval {end} hour)) - greatest(epoch_us(la), epoch_us(d + interval {rule.start_hour} hour))) / 1e6 as o
    from (select *, unnest(generate_series(date_trunc('day', la) - interval 1 day, date_trunc('day', ld), interval 1 day)) as d from s) where isodow(d) - 1 in ({", ".join(map(str, rule.weekdays))}))
  where o > 0 group by all"""


def _features(rule: evidence.WindowRule) -> str:
    return f"""
  select user_id, location_id, stay_count, coalesce(dwell_s, 0) as dwell_s, coalesce(dates, 0) as dates, '{rule.label}' as label,
    case when sum(coalesce(dwell_s, 0)) over (partition by user_id) > 0 then coalesce(dwell_s, 0) / sum(coalesce(dwell_s, 0)) over (partition by user_id) else 0.0 end as share
  from loc left join (select user_id, location_id, sum(o) as dwell_s, count(*) filter (o >= 600) as dates from ({_contrib(rule)}) group by all) using (user_id, location_id)"""


def _top(rule: evidence.WindowRule) -> str:
    return f"""
  select * from (select *, row_number() over w as rn, share - coalesce(lead(share) over w, 0) as margin
    from ({_features(rule)}) where stay_count >= 2 and dates >= {rule.min_dates} and dwell_s > 0 window w as (partition by user_id order by share desc, dates desc, dwell_s desc, stay_count desc, location_id)) where rn = 1"""


_LABELS = " union all ".join(
    f"select user_id, label, location_id, round(share, 6) as share, round(margin, 6) as margin, dates::bigint as dates, round((share + margin + least(dates / 5.0, 1.0)) / 3, 6) as strength from ({_top(r)}) where share >= {r.min_share} and margin >= {r.min_margin}"
    for r in evidence.RULES
)


@query(STAYS + _LABELS)
def home_office_labels(spark, sf_dir):
    return home_office.labels(spark, sf_dir)


@query(DEFECTS + """select user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, round(la, 6) as lat, round(lo, 6) as lon, ok as raw_point_count, round(rad, 6) as max_radius_m,
  sum(case when coalesce(explicit, implied) is not null and p_ts is not null then 1 else 0 end) over (partition by user_id order by ts)::bigint as sequence_id, coalesce(explicit, implied) as boundary_before_reason from z where kept""")
def clean_points(spark, sf_dir):
    return clean.clean_trajectory(home_office.observations(spark, sf_dir, defects=True))


@query(DEFECTS + """select user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, reason from (
  select user_id, ts, 'invalid_coordinate' as reason from z where inv union all select user_id, ts, 'same_second_spatial_ambiguity' from z where amb union all select user_id, ts, implied from z where implied is not null)""")
def cleaning_audit(spark, sf_dir):
    return clean.audit_events(home_office.observations(spark, sf_dir, defects=True))


@query(VISITS + """select user_id, row_number() over (partition by user_id order by ts) - 1 as sequence_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as arrival, strftime(ts + interval 1500 second, '%Y-%m-%d %H:%M:%S') as departure, 1500.0::double as duration_s,
  round(39.90 + 0.01 * (user_id % 50) + 0.005 * place + 0.00005 * (event_id % 3 - 1), 6) as lat, round(116.40 + 0.004 * place, 6) as lon, 6::bigint as n_points from v""")
def stay_points(spark, sf_dir):
    return home_office.detect(home_office.observations(spark, sf_dir))


@query(STAYS + "select user_id, location_id::bigint as location_id, stay_count, distinct_dates, round(dwell_h, 6)::double as dwell_h from loc")
def semantic_locations(spark, sf_dir):
    return home_office.from_events(spark, sf_dir).locations.drop("lat", "lon")


@query(STAYS + "select user_id, location_id::bigint as location_id, stay_count, distinct_dates, round(dwell_h, 6)::double as dwell_h from loc")
def distance_chain_locations(spark, sf_dir):
    return home_office.locate_stays(home_office.detect(home_office.observations(spark, sf_dir)), "dbscan", 100.0).locations.drop("lat", "lon")


@query(STAYS + " union all ".join(f"select user_id, location_id::bigint as location_id, label, round(dwell_s, 6)::double as dwell_s, dates::bigint as dates, round(share, 6) as share from ({_features(r)})" for r in evidence.RULES))
def window_features(spark, sf_dir):
    x = home_office.from_events(spark, sf_dir)
    f = [evidence.window_features(x.semantic, x.locations, r) for r in evidence.RULES]
    return f[0].unionByName(f[1]).select("user_id", "location_id", "label", "dwell_s", "dates", "share")


_STATUS = " union all ".join(
    f"""select u.user_id, '{r.label}' as label, case when recurs = 0 then 'no_recurring_location' when dwell <= 0 then 'no_window_dwell' when most < {r.min_dates} then 'too_few_dates'
  when t.share is null then 'no_candidate' when t.share < {r.min_share} then 'low_share' when t.margin < {r.min_margin} then 'low_margin' else 'emitted' end as status
  from (select user_id, max(case when stay_count >= 2 then 1 else 0 end) as recurs, max(dates) filter (stay_count >= 2) as most, sum(dwell_s) as dwell from ({_features(r)}) group by all) u left join ({_top(r)}) t using (user_id)"""
    for r in evidence.RULES
)


@query(STAYS + _STATUS)
def gate_status(spark, sf_dir):
    x = home_office.from_events(spark, sf_dir)
    return evidence.gate_status(x.semantic, x.locations, evidence.HOME).unionByName(evidence.gate_status(x.semantic, x.locations, evidence.OFFICE))


_HOURS = """, h as (select user_id, location_id, cast(greatest(la, hh) as date) as local_date, hour(greatest(la, hh)) as hour, sum(epoch_us(least(ld, hh + interval 1 hour)) - epoch_us(greatest(la, hh))) / 1e6 as dwell_s
  from (select *, unnest(generate_series(date_trunc('hour', la), ld, interval 1 hour)) as hh from s) where least(ld, hh + interval 1 hour) > greatest(la, hh) group by all)"""


@query(STAYS + _HOURS + "select user_id, location_id::bigint as location_id, cast(local_date as varchar) as local_date, hour, round(dwell_s, 6) as dwell_s from h where dwell_s > 0")
def hourly_dwell(spark, sf_dir):
    return days.hourly_dwell(home_office.from_events(spark, sf_dir).semantic)


_SEQ = """, t as (select *, lag(location_id) over o as prv, lead(location_id) over o as nxt from s window o as (partition by user_id, ldate order by ts, location_id))"""


@query(STAYS + _SEQ + "select user_id, cast(ldate as varchar) as local_date, string_agg(location_id::varchar, '>' order by ts, location_id) as motif from t where prv is null or prv <> location_id group by all")
def daily_motifs(spark, sf_dir):
    return days.daily_motifs(home_office.from_events(spark, sf_dir).semantic)


@query(STAYS + _SEQ + "select user_id, location_id::bigint as origin, nxt::bigint as destination, count(*) as moves, count(distinct ldate) as days, count(distinct ldate) >= 2 as recurrent from t where nxt <> location_id group by all")
def transitions(spark, sf_dir):
    return days.transitions(home_office.from_events(spark, sf_dir).semantic)


@query(STAYS + _HOURS + """, pl as (select user_id, location_id, count(*) * 1500.0 as d from s group by all),
tp as (select user_id, sum(case when r = 1 then d else 0 end) / sum(d) as top1, sum(case when r = 2 then d else 0 end) / sum(d) as top2, sum(case when r = 3 then d else 0 end) / sum(d) as top3
  from (select *, row_number() over (partition by user_id order by d desc, location_id) as r from pl) group by all),
hs as (select user_id, hour, sum(dwell_s) as x from h group by all), hp as (select user_id, x / sum(x) over (partition by user_id) as p from hs),
he as (select user_id, sum(case when p > 0 then -p * log2(p) else 0 end) as hour_entropy from hp group by all),
pu as (select user_id, count(*) as stays, avg(sin((hour(la) + minute(la) / 60.0) * pi() / 12)) as sn, avg(cos((hour(la) + minute(la) / 60.0) * pi() / 12)) as cs, avg(case when isodow(la) >= 6 then 1.0 else 0.0 end) as wk from s group by all)
select user_id, stays, round(case when atan2(sn, cs) < 0 then atan2(sn, cs) * 12 / pi() + 24 else atan2(sn, cs) * 12 / pi() end, 6) as mean_hour, round(sqrt(sn * sn + cs * cs), 6) as concentration, round(wk, 6) as weekend_share,
  round(top1, 6)::double as top1_share, round(top2, 6)::double as top2_share, round(top3, 6)::double as top3_share, round(hour_entropy, 6) as hour_entropy from pu join tp using (user_id) join he using (user_id)""")
def user_behavior_features(spark, sf_dir):
    semantic = home_office.from_events(spark, sf_dir).semantic
    return days.user_features(semantic, days.hourly_dwell(semantic))


@query(STAYS + _HOURS + """, dd as (select distinct user_id, local_date from h), dn as (select *, count(*) over (partition by user_id) as n, row_number() over (partition by user_id order by local_date) as k from dd),
pr as (select user_id, hour, sum(case when k * 2 <= n then dwell_s else 0 end)::double as a, sum(case when k * 2 > n then dwell_s else 0 end)::double as b from h join dn using (user_id, local_date) where n >= 4 group by all),
pp as (select user_id, a / sum(a) over (partition by user_id) as p, b / sum(b) over (partition by user_id) as q from pr)
select user_id, round(sum((case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2), 6) as jsd from pp group by all""")
def schedule_stability(spark, sf_dir):
    return days.schedule_stability(days.hourly_dwell(home_office.from_events(spark, sf_dir).semantic))


_REC = """, f as (select user_id, location_id, count(*) * 1500.0 as d, count(distinct ldate) filter (isodow(ldate) <= 5) as wd from s group by all),
f1 as (select *, row_number() over (partition by user_id order by d desc, location_id) as r from f),
f2 as (select *, row_number() over (partition by user_id order by wd desc, d desc, location_id) as o from f1 where r > 1 and wd >= 3),
rec as (select user_id, 'HOME' as label, location_id from f1 where r = 1 union all select user_id, 'OFFICE', location_id from f2 where o = 1)"""


@query(STAYS + _REC + f", fix as ({_LABELS}) select rec.label as label, count(*) as users, count(*) filter (rec.location_id = fix.location_id) as agree, round(count(*) filter (rec.location_id = fix.location_id) / count(*), 6) as agree_share from rec join fix using (user_id, label) group by all")
def method_agreement(spark, sf_dir):
    x = home_office.from_events(spark, sf_dir)
    return reliability.agreement(reliability.recurrence_assignments(x.semantic), evidence.infer_home_office(x.semantic, x.locations))


@query(STAYS + """, n as (select *, dense_rank() over (partition by user_id order by ldate) as k from s), n2 as (select *, max(k) over (partition by user_id) as mk from n)
select user_id, sum(case when k * 2 <= mk then 1 else 0 end)::bigint as first_half, sum(case when week(ldate) % 2 = 1 then 1 else 0 end)::bigint as odd_weeks, count(*) as stays from n2 group by all""")
def date_splits(spark, sf_dir):
    s = reliability.date_halves(home_office.from_events(spark, sf_dir).semantic)
    return s.groupBy("user_id").agg(F.count_if(F.col("half") == 1).alias("first_half"), F.count_if("odd_week").alias("odd_weeks"), F.count("*").alias("stays"))


@query(VISITS + """, c as (select user_id, count(*) filter (place = 0) as n from v group by all),
r as (select *, (rank() over (order by n) + (count(*) over (partition by n) - 1) / 2.0) / count(*) over () as p from c where n > 0)
select user_id, n, case when p <= 1 / 3.0 then 'low' when p <= 2 / 3.0 then 'middle' else 'high' end as regime from r union all select user_id, n, 'zero' from c where n = 0""")
def exposure_regimes(spark, sf_dir):
    counts = visits(_events(spark, sf_dir)).groupBy("user_id").agg(F.count_if(F.col("place") == 0).alias("n"))
    return reliability.exposure_regime(counts, "n")


_LOG = "with log as (select user_id as owner_id, event_type as place_id, ts as observed_at, lag(event_type) over (partition by user_id order by ts, event_id) as origin_place_id, event_id from events),"
_LAST = "q as (select owner_id, max(observed_at) as query_at, arg_max(origin_place_id, event_id) as origin from (select * from log qualify rank() over (partition by owner_id order by observed_at desc) = 1) group by owner_id)"
_SUGGEST = """,
hh as (select log.*, query_at, origin, count(*) over (partition by log.owner_id) as total from log join q on log.owner_id = q.owner_id and observed_at < query_at),
gg as (select owner_id, place_id, query_at, count(*) as visits, max(observed_at) as latest, any_value(total) as total,
  avg(case when least((hour(observed_at) - hour(query_at) + 24) % 24, (hour(query_at) - hour(observed_at) + 24) % 24) <= 2 then 1.0 else 0.0 end) as near,
  avg(case when isodow(observed_at) = isodow(query_at) then 1.0 else 0.0 end) as wk, avg(case when coalesce(origin_place_id = origin, false) then 1.0 else 0.0 end) as fo
  from hh where origin is null or place_id <> origin group by all having count(*) >= 2),
ss as (select *, {score} as score from gg),
rr as (select *, row_number() over (partition by owner_id order by score desc, visits desc, latest desc, place_id) as rank from ss)
"""
_DAYS = "((epoch_us(query_at) - epoch_us(latest)) // 1000000 / 86400.0)"
_SCORES = {"contextual": f"0.35 * visits / total + 0.20 / (1 + {_DAYS} / 7) + 0.20 * near + 0.10 * wk + 0.15 * fo", "frequency": "visits::double", "recency": f"-{_DAYS}"}


def _visit_log(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _events(spark, sf_dir).select(F.col("user_id").alias("owner_id"), F.col("event_type").alias("place_id"), F.col("ts").alias("observed_at"), F.lag("event_type").over(w).alias("origin_place_id"), "event_id")


def _suggest(method: str):
    def run(spark, sf_dir):
        log = _visit_log(spark, sf_dir)
        last = log.groupBy("owner_id").agg(F.max(F.struct("observed_at", "event_id", "origin_place_id")).alias("m")).select("owner_id", F.col("m.observed_at").alias("query_at"), F.col("m.origin_place_id").alias("origin"))
        return recommend.suggest_destinations(log, last, method)

    run.__name__ = f"suggest_{method}"
    query(_LOG + _LAST + _SUGGEST.format(score=_SCORES[method]) + "select owner_id, rank, place_id, round(score, 6) as score, visits from rr where rank <= 3")(run)


for _m in recommend.METHODS:
    _suggest(_m)


@query(_LOG + """nn as (select *, row_number() over (partition by owner_id order by observed_at, place_id) as k, count(*) over (partition by owner_id) as n from log),
cc as (select *, greatest(3, floor(n * 0.7)) as cut from nn), tg as (select owner_id, observed_at as query_at, origin_place_id as origin, place_id as target from cc where k = cut + 1),
tr as (select * from cc where k <= cut),
hh as (select tr.*, query_at, origin, count(*) over (partition by tr.owner_id) as total from tr join tg on tr.owner_id = tg.owner_id and observed_at < query_at)""" + _SUGGEST[_SUGGEST.index(",\ngg"):].format(score=_SCORES["contextual"]) + """,
bb as (select rr.owner_id, min(rank) filter (place_id = target) as hit from rr join tg on rr.owner_id = tg.owner_id where rank <= 3 group by all)
select count(*) as owners, count(*) filter (hit = 1) as hit1, count(*) filter (hit <= 3) as hit3, count(*) filter (bb.owner_id is null) as without, count(*) filter (sn.owner_id is null) as novel
from tg left join bb on tg.owner_id = bb.owner_id left join (select distinct owner_id, place_id from tr) sn on tg.owner_id = sn.owner_id and sn.place_id = tg.target""")
def first_heldout_evaluation(spark, sf_dir):
    return recommend.evaluate_first_heldout(_visit_log(spark, sf_dir).drop("event_id"))


#: Orders at times among the events', of the users that every size has; many have ties and some come before any event.
_ORDERS = "with o as (select o_orderkey, o_custkey % 15 as user_id, timestamp '2024-01-01' + to_days((o_orderkey % 29)::int) + to_hours((o_orderkey % 24)::int) as at from orders)"


def _orders(spark, sf_dir) -> DataFrame:
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("o_orderkey") % 29).cast("int"), hours=(F.col("o_orderkey") % 24).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 15).alias("user_id"), at.alias("at"))


@query(_ORDERS + """, m as (select o_orderkey, max(ts) as mt, any_value(user_id) as user_id from (select o.o_orderkey, o.user_id, e.ts from o left join events e on e.user_id = o.user_id and e.ts <= o.at) group by o_orderkey)
select o_orderkey, max(event_type) as asof_event_type from m left join events e on e.user_id = m.user_id and e.ts = m.mt group by o_orderkey""")
def orders_asof_event(spark, sf_dir):
    return joins.asof_backward(_orders(spark, sf_dir), _events(spark, sf_dir).select("user_id", "ts", "event_type"), "user_id", "at", "ts", "event_type").select("o_orderkey", "asof_event_type")


_MODES = """with m as (select user_id, event_id, ts as a, ts + interval 1800 second as b, event_type as mode from events),
t as (select distinct user_id, unnest([a, b]) as t from m), sl as (select user_id, t, lead(t) over (partition by user_id order by t) as u from t),
sg as (select sl.user_id, sl.t, sl.u, min(mode) as mode from sl join m on m.user_id = sl.user_id and a <= sl.t and b >= sl.u group by all having count(distinct mode) = 1),
rn as (select *, case when lag(u) over o = t and lag(mode) over o = mode then 0 else 1 end as nw from sg window o as (partition by user_id order by t)),
cw as (select user_id, min(t) as a, max(u) as b, mode from (select *, sum(nw) over (partition by user_id order by t) as run from rn) group by user_id, run, mode)"""


def _mode_windows(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).select("user_id", "event_id", F.col("ts").alias("start_time"), (F.col("ts") + F.expr("interval 1800 seconds")).alias("end_time"), F.col("event_type").alias("mode"))


@query(_MODES + "select user_id, strftime(a, '%Y-%m-%d %H:%M:%S') as start_time, strftime(b, '%Y-%m-%d %H:%M:%S') as end_time, mode from cw")
def canonical_mode_windows(spark, sf_dir):
    return joins.canonical_windows(_mode_windows(spark, sf_dir))


@query(_MODES + ", seg as (select user_id, event_id, ts + interval 300 second as x, ts + interval 900 second as y from events) select event_id, min(cw.mode) as mode from seg join cw on seg.user_id = cw.user_id and cw.a <= x and y <= cw.b group by all having count(*) = 1")
def segments_in_one_mode(spark, sf_dir):
    s = _events(spark, sf_dir).select("user_id", "event_id", (F.col("ts") + F.expr("interval 300 seconds")).alias("start_time"), (F.col("ts") + F.expr("interval 900 seconds")).alias("end_time"))
    return joins.contained_in_one(s, joins.canonical_windows(_mode_windows(spark, sf_dir)), "event_id")


@query(_ORDERS + """, e as (select event_id, user_id, ts as a, ts + interval 6 hour as b from events),
j as (select o_orderkey, event_id, (epoch_us(least(o.at + interval 2 day, e.b)) - epoch_us(greatest(o.at, e.a))) // 1000000 as overlap_s from o join e on o.user_id = e.user_id and o.at < e.b and e.a < o.at + interval 2 day)
select o_orderkey, event_id, overlap_s::bigint as overlap_s from j qualify row_number() over (partition by o_orderkey order by overlap_s desc, event_id) = 1""")
def orders_best_overlap(spark, sf_dir):
    o = _orders(spark, sf_dir).select("o_orderkey", "user_id", F.col("at").alias("start_time"), (F.col("at") + F.expr("interval 2 days")).alias("end_time"))
    e = _events(spark, sf_dir).select("event_id", "user_id", F.col("ts").alias("start_time"), (F.col("ts") + F.expr("interval 6 hours")).alias("end_time"))
    return joins.best_overlap(o, e, "o_orderkey", "event_id")


_SPOTS = """with a as (select s_suppkey as id, 39.0 + s_suppkey % 100 / 50.0 as lat, 116.0 + s_suppkey % 77 / 40.0 as lon from supplier), p as (select c_custkey as id, 39.0 + c_custkey % 997 / 500.0 as lat, 116.0 + c_custkey % 613 / 320.0 as lon from customer)"""


@query(_SPOTS + """ select anchor_id, place_id, round(d, 6) as distance_m from (select a.id as anchor_id, p.id as place_id, 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(p.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - a.lon) / 2), 2)))) as d from a, p) where d <= 2000""")
def places_within_radius(spark, sf_dir):
    spot = lambda t, k, m, s, n, u: table(spark, sf_dir, t).select(F.col(k).alias("id"), (39.0 + F.col(k) % m / s).alias("lat"), (116.0 + F.col(k) % n / u).alias("lon"))
    return joins.within_radius(spot("supplier", "s_suppkey", 100, 50.0, 77, 40.0), spot("customer", "c_custkey", 997, 500.0, 613, 320.0), 2000.0, 0.02)


@query("select c_custkey, (('0x' || substr(sha256(c_custkey::varchar), 1, 8))::bigint % 10000) as bucket from customer")
def rollout_buckets(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", serving.rollout_bucket(F.col("c_custkey")).alias("bucket"))


@query("select c_mktsegment, c_nationkey, count(*) as n from customer group by grouping sets ((c_mktsegment), (c_nationkey), ()) having count(*) >= 5")
def suppressed_customer_counts(spark, sf_dir):
    return reliability.suppressed_counts(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], 5).select("c_mktsegment", "c_nationkey", "n")


@query("""with n as (select event_type as kind, user_id % 10 as grp, row_number() over (partition by user_id % 10 order by ts, event_id) - 1 as i from events), b as (select grp, kind, case when i < 100 then -1 else (i - 100) // 50 end as block from n),
c as (select grp, block, kind, count(*) as c from b group by all), sh as (select *, sum(c) over (partition by grp, block) as size, c / sum(c) over (partition by grp, block) as share from c),
g as (select distinct x.grp, x.block, y.kind from sh x join sh y on x.grp = y.grp where x.block >= 0 and x.size = 50),
d as (select g.grp, g.block, max(abs(coalesce(s.share, 0) - coalesce(r.share, 0))) as shift from g left join sh s on s.grp = g.grp and s.block = g.block and s.kind = g.kind left join sh r on r.grp = g.grp and r.block = -1 and r.kind = g.kind group by all)
select grp, block::bigint as block, round(shift, 6) as shift, shift >= 0.2 and coalesce(lag(shift >= 0.2) over (partition by grp order by block), false) as alert from d""")
def drift_windows(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("grp", F.col("user_id") % 10)
    return serving.drift_alerts(e, "grp", ["ts", "event_id"], "event_type")


@query("select event_type, date_trunc('hour', ts)::varchar as start, count(*) as n, round(sum(value), 4) as total from events group by all".replace("date_trunc('hour', ts)::varchar", "strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S')"))
def hourly_event_counts(spark, sf_dir):
    from ..streaming.sessions import windowed_counts

    c = windowed_counts(_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")))
    return c.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("total", 4).alias("total"))


@query(VISITS + """, p as (select user_id, ts + to_seconds(unnest(range(6)) * 300) as t from v), b as (select *, case when lag(t) over o is null or epoch_us(t) - epoch_us(lag(t) over o) >= 301000000 then 1 else 0 end as nw from p window o as (partition by user_id order by t)),
r as (select *, sum(nw) over (partition by user_id order by t) as run from b) select user_id, strftime(min(t), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from r group by user_id, run""")
def point_sessions(spark, sf_dir):
    from ..streaming.sessions import sessions

    p = points(_events(spark, sf_dir)).withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(p, "301 seconds").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("select event_type, count(*) as n, sum(cast(json_extract(props, '$.k') as bigint))::bigint as k_sum, count(distinct cast(json_extract(props, '$.k') as bigint)) as k_kinds from events group by all")
def json_props(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("k", F.from_json("props", "k bigint")["k"])
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k_sum"), F.countDistinct("k").alias("k_kinds"))


@query("""with d as (select doc_id, ' ' || trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) || ' ' as t from documents)
select doc_id, contains(t, ' the ') as has_the, contains(t, ' und ') as has_und, contains(t, ' que ') as has_que, length(t) - 2 as chars from d""")
def lexical_categories(spark, sf_dir):
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("text"), "\\s+", " ")), F.lit(" "))
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", *[F.contains("t", F.lit(f" {w} ")).alias(f"has_{w}") for w in ("the", "und", "que")], (F.length("t") - 2).cast("long").alias("chars"))


_LATLON = "(39.90 + 0.01 * (user_id % 50) + 0.005 * place + 0.00005 * (event_id % 3 - 1))", "(116.40 + 0.004 * place)"


def _geohash_sql(precision: int) -> str:
    n_lon, n_lat = (5 * precision + 1) // 2, 5 * precision // 2
    bit = lambda b: f"((x >> {n_lon - 1 - b // 2}) & 1)" if b % 2 == 0 else f"((y >> {n_lat - 1 - b // 2}) & 1)"
    letters = [f"substr('0123456789bcdefghjkmnpqrstuvwxyz', (1 + {' + '.join(f'{16 >> j} * {bit(5 * k + j)}' for j in range(5))})::int, 1)" for k in range(precision)]
    xy = f"select user_id, floor(({_LATLON[1]}::double + 180) / 360 * {1 << n_lon})::bigint as x, floor(({_LATLON[0]}::double + 90) / 180 * {1 << n_lat})::bigint as y from v"
    return f"select {' || '.join(letters)} as geohash6, count(*) as n, count(distinct user_id) as users from ({xy}) group by 1"


@query(VISITS + _geohash_sql(6))
def geohash_counts(spark, sf_dir):
    v = visits(_events(spark, sf_dir))
    return v.groupBy(geo.geohash(F.col("lat"), F.col("lon"), 6).alias("geohash6")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query(VISITS + f"""select (round({_LATLON[0]} * 1000000)::bigint // 20000) as cy, (round({_LATLON[1]} * 1000000)::bigint // 20000) as cx, count(*) as visits, count(distinct user_id) as users from v group by all""")
def spatial_tiles(spark, sf_dir):
    v = visits(_events(spark, sf_dir))
    return v.groupBy(geo.micro_cell(F.col("lat"), 20_000).alias("cy"), geo.micro_cell(F.col("lon"), 20_000).alias("cx")).agg(F.count("*").alias("visits"), F.countDistinct("user_id").alias("users"))


@query(VISITS + "select place, quantile_cont(value, 0.25)::double as q25, median(value)::double as q50, quantile_cont(value, 0.75)::double as q75, count(*) as n from v join events using (user_id, event_id) group by all".replace("quantile_cont(value, 0.25)::double", "round(quantile_cont(value, 0.25), 6)").replace("median(value)::double", "round(median(value), 6)").replace("quantile_cont(value, 0.75)::double", "round(quantile_cont(value, 0.75), 6)"))
def place_value_quantiles(spark, sf_dir):
    v = visits(_events(spark, sf_dir)).join(_events(spark, sf_dir).select("event_id", "value"), "event_id")
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return v.groupBy("place").agg(q.alias("q"), F.count("*").alias("n")).select("place", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "n")


_DAYS_SEEN = STAYS + ", ud as (select user_id, ldate, count(*) as stays, count(distinct location_id) as places from s group by all)"


@query(_DAYS_SEEN + """, wk as (select *, date_diff('day', min(ldate) over (partition by user_id), ldate) // 28 as k from ud)
select user_id, k::bigint as "window", count(*) as days, sum(stays)::bigint as stays, count(*) >= 6 as eligible from wk group by user_id, k""")
def calendar_windows(spark, sf_dir):
    return windows.calendar_windows(home_office.from_events(spark, sf_dir).semantic, 28, 6)


@query(_DAYS_SEEN + """, wk as (select *, (row_number() over (partition by user_id order by ldate) - 1) // 8 as k from ud)
select user_id, k::bigint as block, cast(min(ldate) as varchar) as first_date, cast(max(ldate) as varchar) as last_date, sum(places)::bigint as place_days, date_diff('day', min(ldate), max(ldate)) + 1 as span_days,
  date_diff('day', min(ldate), max(ldate)) + 1 <= 56 as eligible from wk group by user_id, k having count(*) = 8""")
def support_windows(spark, sf_dir):
    return windows.support_windows(home_office.from_events(spark, sf_dir).semantic, 8, 56)


@query(STAYS + """select user_id, location_id::bigint as location_id, cast(min(ldate) as varchar) as first_date, cast(cast(quantile_disc(ldate, 0.5) as date) as varchar) as median_date, cast(max(ldate) as varchar) as last_date, count(*) as dates
  from (select distinct user_id, location_id, ldate from s) group by user_id, location_id""")
def location_observation_dates(spark, sf_dir):
    return windows.observation_dates(home_office.from_events(spark, sf_dir).semantic)


@query(STAYS + _SEQ + """, n as (select *, dense_rank() over (partition by user_id order by ldate) as k from t), n2 as (select *, max(k) over (partition by user_id) as mk from n),
e as (select user_id, location_id, nxt, sum(case when k * 2 <= mk then 1 else 0 end)::double as a, sum(case when k * 2 > mk then 1 else 0 end)::double as b from n2 where mk >= 4 and nxt <> location_id group by all),
pq as (select user_id, a / sum(a) over w as p, b / sum(b) over w as q, sum(a) over w as ta, sum(b) over w as tb from e window w as (partition by user_id))
select user_id, count(*) as edges, round(sum(abs(p - q)) / 2, 6) as total_variation, round(sum(least(p, q)) / sum(greatest(p, q)), 6) as weighted_jaccard,
  round(sum(case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end) / 2, 6) as jsd from pq where ta > 0 and tb > 0 group by user_id""")
def edge_shift(spark, sf_dir):
    return windows.edge_shift(home_office.from_events(spark, sf_dir).semantic)

from . import alignment, anchors, archives, audits, bootstraps, habits, places, spatial, sweeps, zones  # noqa: E402,F401  (their queries register themselves)
