"""Registered queries of the audits, with their SQL for DuckDB. Variants of one table are nested selects, so that each has stays of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import jensen_shannon
from ..operators import clean, comparators, days, evidence, forward, locate, relational, reliability, routines, userdays
from ..sources.shared import shared_folder
from ..sources.trajectories import table
from . import home_office
from .queries import _HOURS, DEFECTS, STAYS, VISITS, _contrib, _features, _top, query

ZONE = "Asia/Shanghai"
#: Stays as s0, before any variant is made of them.
BASE = STAYS[: STAYS.index("\nloc as (")].rstrip().rstrip(",").replace("\ns as (", "\ns0 as (")
LOC = "loc as (select user_id, location_id, count(*) as stay_count, count(distinct ldate) as distinct_dates from s group by all)"


def _hourly(label: str) -> str:
    hours = reliability.TARGET_HOURS[label]
    need = -(-4 * len(hours) // 10)
    order = "hf desc, ds desc" if label == "HOME" else "ds desc, hf desc"
    k = label[0]
    return f"""
t1{k} as (select *, count(*) over (partition by user_id, d) as obs from hd where hour(hour_start) in ({", ".join(map(str, hours))}) {"" if label == "HOME" else "and isodow(d) <= 5"}),
d1{k} as (select user_id, d, location_id, count(*) / any_value(obs) as fr from t1{k} where obs >= {need} group by user_id, d, location_id),
n1{k} as (select user_id, count(distinct d) as vd from d1{k} group by user_id),
p1{k} as (select user_id, location_id, round(avg(fr), 9) as hf, count(*) as visited, any_value(vd) as vd, count(*) / any_value(vd) as ds from d1{k} join n1{k} using (user_id) group by user_id, location_id),
q1{k} as (select user_id, 'hourly_dominant' as method, '{label}' as label, location_id, {"hf" if label == "HOME" else "ds"} as score, vd as support_days, false as emitted
  from (select p1{k}.*, row_number() over (partition by user_id order by {order}, visited desc, location_id) as r from p1{k} join loc using (user_id, location_id) where vd >= 3 and stay_count >= 2) where r = 1)"""


_FIXED = " union all ".join(
    f"select user_id, 'fixed_window' as method, label, location_id, share as score, dates as support_days, share >= {r.min_share} and margin >= {r.min_margin} as emitted from ({_top(r)})" for r in evidence.RULES
)
ASSIGN = f"""hb as (select user_id, hh as hour_start, location_id, sum(epoch_us(least(ld, hh + interval 1 hour)) - epoch_us(greatest(la, hh))) as o
  from (select *, unnest(generate_series(date_trunc('hour', la), ld, interval 1 hour)) as hh from s) where least(ld, hh + interval 1 hour) > greatest(la, hh) group by all),
hd as (select user_id, hour_start, location_id, cast(hour_start as date) as d from hb qualify row_number() over (partition by user_id, hour_start order by o desc, location_id) = 1),{_hourly("HOME")},{_hourly("OFFICE")},
rf as (select user_id, location_id, count(*) * 1500.0 as dw, count(*) as n, count(distinct ldate) as days, count(distinct ldate) filter (isodow(ldate) <= 5) as wd from s group by user_id, location_id having count(*) >= 2),
rh as (select *, row_number() over (partition by user_id order by dw desc, days desc, n desc, location_id) as h, dw / sum(dw) over (partition by user_id) as share, greatest(max(wd) over (partition by user_id), 1) as most from rf),
ro as (select *, row_number() over (partition by user_id order by wd desc, dw desc, n desc, location_id) as o from rh where h > 1),
asg as ({_FIXED} union all select * from q1H union all select * from q1O
  union all select user_id, 'recurrence', 'HOME', location_id, share, days, false from rh where h = 1 union all select user_id, 'recurrence', 'OFFICE', location_id, wd / most, wd, false from ro where o = 1 and wd >= 3)"""


def _assigned(stays: str, result: str = "select * from asg") -> str:
    """The candidates of all methods over a select of stays from s0."""
    return f"(with s as ({stays}), {LOC}, {ASSIGN} {result})"


_RANKED = "(select *, max(k) over (partition by user_id) as mk from (select *, dense_rank() over (partition by user_id order by ldate) as k from s0))"
_ALL = _assigned("select * from s0")
_SPLITS = _assigned(f"""select x.* exclude (k, mk) replace (user_id::varchar || '|' || variant as user_id) from {_RANKED} x, (values ('first_second|l'), ('first_second|r'), ('odd_even|l'), ('odd_even|r')) t(variant)
  where case variant when 'first_second|l' then k <= greatest(1, floor(mk * 0.5)) when 'first_second|r' then not k <= greatest(1, floor(mk * 0.5)) when 'odd_even|l' then week(ldate) % 2 = 1 else week(ldate) % 2 <> 1 end""")
_SPLIT_DETAILS = f"""(select split_part(user_id, '|', 1)::bigint as user_id, split_part(user_id, '|', 2) as split, method, label, max(location_id) filter (split_part(user_id, '|', 3) = 'l') as a, max(location_id) filter (split_part(user_id, '|', 3) = 'r') as b
  from {_SPLITS} group by 1, 2, 3, 4 having a is not null and b is not null)"""
_HELD = f"""(with lt as (select * from {_RANKED} where not k <= greatest(1, floor(mk * 0.6))),
  om as (select user_id, location_id, count(*) * 1500.0 as dw, count(distinct ldate) filter (isodow(ldate) <= 5) as wd from lt group by user_id, location_id),
  oa as (select user_id, count(distinct ldate) filter (isodow(ldate) <= 5) as aw from lt group by user_id),
  mm as (select om.user_id, location_id, dw / sum(dw) over (partition by om.user_id) as hs, case when aw > 0 then wd / aw else 0 end as os from om join oa using (user_id)),
  mr as (select *, rank() over (partition by user_id order by hs desc) as hr, rank() over (partition by user_id order by os desc) as orr from mm)
  select x.*, case when label = 'HOME' then hs else os end as metric, case when label = 'HOME' then hr else orr end as rnk from {_assigned(f"select * exclude (k, mk) from {_RANKED} where k <= greatest(1, floor(mk * 0.6))")} x left join mr using (user_id, location_id))"""
_RATES = [(rate, seed) for rate in (0.1, 0.2, 0.3) for seed in (11, 23, 42)]
_DROPS = f"""(with dv as (select split_part(user_id, '|', 1)::bigint as user_id, split_part(user_id, '|', 2)::double as rate, split_part(user_id, '|', 3)::int as seed, method, label, location_id as other
  from {_assigned(f'''select s0.* replace (user_id::varchar || '|' || rate || '|' || seed as user_id) from s0, (values {", ".join(f"('{r}', '{x}')" for r, x in _RATES)}) t(rate, seed)
    where ('0x' || substr(sha256(seed || '|' || user_id || '|' || location_id || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S')), 1, 8))::bigint / 4294967296.0 >= rate::double''')})
  select rate, seed, a.user_id, a.method, a.label, a.location_id, coalesce(other = a.location_id, false) as retained
  from {_ALL} a cross join (values {", ".join(f"({r}, {x})" for r, x in _RATES)}) g(rate, seed) left join dv using (user_id, rate, seed, method, label))"""


def _semantic(spark, sf_dir) -> home_office.Located:
    return home_office.from_events(spark, sf_dir)


_CLEAN = """, cl as (select user_id, ts, la, lo, sum(case when coalesce(explicit, implied) is not null and p_ts is not null then 1 else 0 end) over (partition by user_id order by ts) as seq, coalesce(explicit, implied) as reason from z where kept)"""
_HAV = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(la - bla) / 2), 2) + cos(radians(la)) * cos(radians(bla)) * pow(sin(radians(lo - blo) / 2), 2))))"


@query(DEFECTS + _CLEAN + f""", pd as (select *, cast(ts + interval 8 hour as date) as d, hour(ts + interval 8 hour) as h from cl),
pb as (select *, (epoch_us(ts) - epoch_us(lag(ts) over o)) / 1e6 as gap, lag(seq) over o as bs, lag(la) over o as bla, lag(lo) over o as blo from pd window o as (partition by user_id, d order by ts))
select user_id, cast(d as varchar) as local_date, count(*) as point_count, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 6) as observed_span_h, round(coalesce(max(gap) / 3600, 0), 6) as largest_gap_h,
  round(coalesce(sum(case when bs = seq and gap > 0 then {_HAV} end) / 1000, 0), 6) as distance_km,
  round(least(coalesce(sum(case when bs = seq and gap > 0 then gap end) / 3600, 0), (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9), 6) as moved_h,
  count(reason) as boundary_count, min(h) as first_hour, max(h) as last_hour, count(distinct h) as hours from pb group by user_id, d""")
def point_days(spark, sf_dir):
    return userdays.point_days(clean.clean_trajectory(home_office.observations(spark, sf_dir, defects=True)), ZONE)


@query(DEFECTS + _CLEAN + f""", pb as (select *, (epoch_us(ts) - epoch_us(lag(ts) over o)) / 1e6 as gap, lag(seq) over o as bs, lag(la) over o as bla, lag(lo) over o as blo from cl window o as (partition by user_id order by ts)),
ed as (select user_id, gap, bs = seq as within, {_HAV} as dist from pb where gap is not null)
select user_id, count(*) as edges, count(*) filter (within) as within, round(median(gap), 6) as median_gap_s, round(max(gap), 6) as largest_gap_s, round(max(dist / gap * 3.6), 6) as largest_speed_kmh,
  count(*) filter (dist / gap * 3.6 > 1000) as hard_speed_events, round(sum(case when within then 0.0 else dist end) / 1000, 6) as bridged_km from ed group by user_id""")
def segment_profile(spark, sf_dir):
    return clean.segment_profile(clean.consecutive_edges(clean.clean_trajectory(home_office.observations(spark, sf_dir, defects=True))))


_DAYS = STAYS + _HOURS + """,
pk as (select user_id, ts + to_seconds(k * 300) as pt, k = 0 and nth > 1 as bd from (select user_id, ts, unnest(range(6)) as k, row_number() over (partition by user_id order by ts) as nth from v)),
pe as (select *, cast(pt + interval 8 hour as date) as d, (epoch_us(pt) - epoch_us(lag(pt) over (partition by user_id, cast(pt + interval 8 hour as date) order by pt))) / 1e6 as gap from pk),
pday as (select user_id, d, count(*) as point_count, (epoch_us(max(pt)) - epoch_us(min(pt))) / 3.6e9 as span, coalesce(max(gap) / 3600, 0) as lgap, count(*) filter (bd) as boundaries,
  least(coalesce(sum(case when gap <= 300 then gap end) / 3600, 0), (epoch_us(max(pt)) - epoch_us(min(pt))) / 3.6e9) as moved from pe group by user_id, d),
hv as (select user_id, local_date as d, count(distinct location_id) as places, sum(dwell_s) / 3600 as dwell_h from h where dwell_s > 0 group by user_id, local_date),
hs as (select user_id, local_date as d, hour, sum(dwell_s) as x from h where dwell_s > 0 group by all),
tc as (select user_id, ldate, ts, unnest(generate_series(date_trunc('day', la), date_trunc('day', ld), interval 1 day)) as dd, ld from s),
sday as (select user_id, cast(dd as date) as d, count(*) filter (ldate = cast(dd as date)) as stay_count, (epoch_us(max(ts)) + 1500000000 - epoch_us(min(ts))) / 3.6e9 as stay_span from tc where dd < ld group by all),
ud as (select coalesce(p.user_id, q.user_id) as user_id, coalesce(p.d, q.d) as d, point_count, span, lgap, boundaries, moved, coalesce(stay_count, 0) as stay_count, coalesce(places, 0) as places, coalesce(dwell_h, 0) as dwell_h, coalesce(stay_span, 0) as stay_span,
    coalesce(point_count >= 3 and span >= 2 and lgap <= 6, false) as up, coalesce(stay_count >= 1 and stay_span >= 2, false) as um
  from pday p full join (select * from hv join sday using (user_id, d)) q on p.user_id = q.user_id and p.d = q.d)
"""


@query(_DAYS + """select user_id, cast(d as varchar) as local_date, point_count, round(span, 6) as observed_span_h, round(lgap, 6) as largest_gap_h, boundaries as boundary_count, round(moved, 6) as moved_h, stay_count, places, round(dwell_h, 6) as dwell_h,
  round(stay_span, 6) as stay_span_h, isodow(d) - 1 as weekday, up as usable_for_profile, um as usable_for_motif,
  (select string_agg(floor(round(coalesce(x, 0), 3))::bigint::varchar, ',' order by r.k) from range(24) r(k) left join hs on hs.hour = r.k and hs.user_id = ud.user_id and hs.d = ud.d) as hourly from ud""")
def user_days(spark, sf_dir):
    d = _user_days(spark, sf_dir)[0].withColumn("hourly", F.array_join(F.transform("hourly_dwell", lambda x: F.floor(F.round(x, 3)).cast("string")), ","))
    return d.select("user_id", "local_date", "point_count", "observed_span_h", "largest_gap_h", "boundary_count", "moved_h", "stay_count", "places", "dwell_h", "stay_span_h", "weekday", "usable_for_profile", "usable_for_motif", "hourly")


def _user_days(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    semantic = _semantic(spark, sf_dir).semantic
    moved = userdays.point_days(clean.clean_trajectory(home_office.observations(spark, sf_dir)), ZONE)
    return userdays.user_days(moved, semantic, days.hourly_dwell(semantic)), semantic


_MOTIFS = """, mt as (select user_id, ldate as d, string_agg(location_id::varchar, '>' order by ts, location_id) as motif from (select *, lag(location_id) over (partition by user_id, ldate order by ts, location_id) as prv from s) where prv is null or prv <> location_id group by user_id, ldate)"""


@query(_DAYS + _MOTIFS + """, a1 as (select user_id, count(*) as active_days, count(*) filter (up) as usable_days, count(*) filter (um) as motif_days, sum(case when isodow(d) <= 5 then dwell_h else 0 end) as wh, sum(dwell_h) as th,
    sum(moved) filter (up) as mv, sum(boundaries) filter (up) as bo from ud group by user_id),
a2 as (select user_id, hour, sum(x) as x from hs group by all), a3 as (select user_id, x / sum(x) over (partition by user_id) as p from a2), a4 as (select user_id, sum(-p * log2(p)) as he, max(p) as hc from a3 group by user_id),
b1 as (select user_id, location_id, count(*) as n from s group by all), b2 as (select *, row_number() over (partition by user_id order by n desc, location_id) as r from b1),
b3 as (select user_id, sum(n)::bigint as stays, count(*) as places, count(*) filter (n >= 2) as rec, sum(n) filter (r <= 1) / sum(n) as t1, sum(n) filter (r <= 2) / sum(n) as t2, sum(n) filter (r <= 3) / sum(n) as t3 from b2 group by user_id),
c1 as (select user_id, motif, count(*) as n, count(*) filter (isodow(d) <= 5) as nw, count(*) filter (isodow(d) > 5) as ne from mt join (select user_id, d from ud where um) using (user_id, d) group by user_id, motif),
c2 as (select *, n / sum(n) over (partition by user_id) as p, row_number() over (partition by user_id order by n desc, motif) as r from c1),
c3 as (select user_id, max(p) as mf, sum(-p * log2(p)) as me, case when sum(nw) > 0 then max(nw) / sum(nw) else 0 end as ws, case when sum(ne) > 0 then max(ne) / sum(ne) else 0 end as es, max(motif) filter (r = 1) as top_motif from c2 group by user_id)
select user_id, active_days, usable_days, motif_days, round(case when th > 0 then wh / th else 0 end, 6) as weekday_dwell_share, round(case when th > 0 then (th - wh) / th else 0 end, 6) as weekend_dwell_share,
  round(case when usable_days > 0 then mv / usable_days else 0 end, 6) as moved_per_day_h, round(case when usable_days > 0 then bo / usable_days else 0 end, 6) as boundaries_per_day, round(coalesce(he, 0), 6) as hour_entropy, round(coalesce(hc, 0), 6) as hour_concentration,
  coalesce(stays, 0) as stays, coalesce(places, 0) as places, coalesce(rec, 0) as recurring_places, round(coalesce(t1, 0), 6) as top_1_share, round(coalesce(t2, 0), 6) as top_2_share, round(coalesce(t3, 0), 6) as top_3_share,
  round(coalesce(mf, 0), 6) as motif_frequency, round(coalesce(me, 0), 6) as motif_entropy, round(coalesce(ws, 0), 6) as weekday_motif_share, round(coalesce(es, 0), 6) as weekend_motif_share, top_motif
from a1 left join a4 using (user_id) left join b3 using (user_id) left join c3 using (user_id)""")
def behaviour_profile(spark, sf_dir):
    d, semantic = _user_days(spark, sf_dir)
    return userdays.behaviour_features(d, semantic, days.daily_motifs(semantic)).drop("distance_per_day_km")


@query(_DAYS + """, g1 as (select *, row_number() over (partition by user_id order by d) as k, count(*) over (partition by user_id) as n, date_trunc('week', d) as wk from ud where up), g2 as (select *, k > n // 2 as late from g1),
e as (select user_id, count(distinct wk) as weeks, count(*) filter (not late) as early_days, count(*) filter (late) as late_days, coalesce(sum(dwell_h) filter (not late), 0) as eh, coalesce(sum(dwell_h) filter (late), 0) as lh from g2 group by user_id),
pr as (select g2.user_id, hour, sum(case when late then 0 else x end) as a, sum(case when late then x else 0 end) as b from g2 join hs using (user_id, d) group by all),
pp as (select user_id, case when sum(a) over w > 0 then a / sum(a) over w end as p, case when sum(b) over w > 0 then b / sum(b) over w end as q from pr window w as (partition by user_id)),
js as (select user_id, sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2 as jsd from pp where p is not null and q is not null group by user_id),
wv as (select g2.user_id, wk, hour, sum(x) as x from g2 join hs using (user_id, d) group by all), wp as (select *, x / sum(x) over (partition by user_id, wk) as p from wv), ws as (select distinct user_id, wk from wv),
wj as (select a.user_id, a.wk as w1, b.wk as w2, sum(case when p1 > 0 then p1 * log2(p1 / ((p1 + p2) / 2)) else 0 end + case when p2 > 0 then p2 * log2(p2 / ((p1 + p2) / 2)) else 0 end) / 2 as j from ws a join ws b on a.user_id = b.user_id and a.wk < b.wk
  join (select x.k1, x.k2, x.user_id, hour, max(p1) as p1, max(p2) as p2 from (select a.user_id, a.wk as k1, b.wk as k2, t.hour, case when t.wk = a.wk then t.p else 0 end as p1, case when t.wk = b.wk then t.p else 0 end as p2
    from ws a join ws b on a.user_id = b.user_id and a.wk < b.wk join wp t on t.user_id = a.user_id and (t.wk = a.wk or t.wk = b.wk)) x group by all) y on y.user_id = a.user_id and y.k1 = a.wk and y.k2 = b.wk group by all),
wm as (select user_id, median(j) as wj from wj group by user_id)
select e.user_id, weeks >= 2 and early_days >= 3 and late_days >= 3 and eh >= 6 and lh >= 6 as eligible, case when weeks >= 2 and early_days >= 3 and late_days >= 3 and eh >= 6 and lh >= 6 then round(jsd, 6) end as early_late_jsd,
  case when weeks >= 2 and early_days >= 3 and late_days >= 3 and eh >= 6 and lh >= 6 then round(wj, 6) end as weekly_jsd_median, weeks, early_days, late_days from e left join js using (user_id) left join wm using (user_id)""")
def supported_stability(spark, sf_dir):
    return userdays.stability(_user_days(spark, sf_dir)[0], jensen_shannon)


_AUDIT = " union all ".join(
    f"""select u.user_id, '{r.label}' as label, case when st.user_id is null then 'no_cp1_stay' when lo.user_id is null then 'outside_frozen_v1_geographic_scope' when recurs = 0 then 'no_recurring_location' when ra.user_id is null then 'no_behavioral_window_overlap'
    when t.share is null then 'insufficient_relevant_dates' when t.share < {r.min_share} then 'share_below_frozen_gate' when t.margin < {r.min_margin} then 'margin_below_frozen_gate' else 'emitted' end as outcome,
    t.location_id::bigint as location_id, round(t.share, 6) as share, round(t.margin, 6) as margin, t.dates::bigint as dates, round(t.dwell_s / 3600, 6) as dwell_h
  from (select c_custkey as user_id from customer) u left join (select distinct user_id from s) st using (user_id) left join (select user_id, max(case when stay_count >= 2 then 1 else 0 end) as recurs from loc group by user_id) lo using (user_id)
  left join (select distinct user_id from ({_features(r)}) where stay_count >= 2 and dwell_s > 0) ra using (user_id) left join ({_top(r)}) t using (user_id)"""
    for r in evidence.RULES
)


@query(STAYS + _AUDIT)
def label_audit(spark, sf_dir):
    x = _semantic(spark, sf_dir)
    universe = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    a = [evidence.label_audit(universe, x.semantic, x.semantic, x.locations, r) for r in evidence.RULES]
    return a[0].unionByName(a[1])


def _raw(rule: evidence.WindowRule) -> str:
    return f"""select * from (select *, row_number() over w as rn, share - coalesce(lead(share) over w, 0) as margin from ({_features(rule)}) where stay_count >= 2 and dwell_s > 0 window w as (partition by user_id order by share desc, dates desc, dwell_s desc, stay_count desc, location_id)) where rn = 1"""


_GATES = " union all ".join(
    f"""select u.user_id, '{r.label}' as label, stays::bigint as stays, recurring, coalesce(od, 0)::bigint as opportunity_dates, round(coalesce(oh, 0), 6) as opportunity_hours, ra.location_id::bigint as raw_location, round(ra.share, 6) as raw_share, round(ra.margin, 6) as raw_margin,
    t.location_id::bigint as location_id, case when od > 0 then round(coalesce(ra.dates, 0) / od, 6) end as raw_coverage, case when od > 0 then round(coalesce(t.dates, 0) / od, 6) end as coverage,
    case when coalesce(od, 0) <= 0 then 'no_observed_opportunity' when ra.location_id is null then 'no_recurring_candidate' when t.location_id is null then 'min_dates_blocked' when t.share < {r.min_share} and t.margin < {r.min_margin} then 'share_and_margin_blocked'
      when t.share < {r.min_share} then 'share_blocked' when t.margin < {r.min_margin} then 'margin_blocked' else 'emitted' end as status
  from (select user_id, sum(stay_count) as stays, count(*) filter (stay_count >= 2) as recurring from loc group by user_id) u
  left join (select user_id, count(*) filter (o >= 600) as od, sum(o) / 3600 as oh from (select user_id, d, sum(o) as o from ({_contrib(r)}) group by user_id, d) group by user_id) op using (user_id)
  left join ({_raw(r)}) ra using (user_id) left join ({_top(r)}) t using (user_id)"""
    for r in evidence.RULES
)


@query(STAYS + _GATES)
def gate_diagnostics(spark, sf_dir):
    x = _semantic(spark, sf_dir)
    g = [evidence.gate_diagnostics(x.semantic, x.locations, r) for r in evidence.RULES]
    return g[0].unionByName(g[1]).select("user_id", "label", "stays", "recurring", "opportunity_dates", "opportunity_hours", "raw_location", "raw_share", "raw_margin", "location_id", "raw_coverage", "coverage", "status")


_GRID = (1, 2, 3, 5), (0.3, 0.4, 0.5, 0.6), (0.0, 0.1, 0.2)


def _grid_sql(rule: evidence.WindowRule) -> str:
    values = lambda v: ", ".join(f"({x})" for x in v)
    return f"""select '{rule.label}' as label, md as min_dates, ms::double as min_share, mm::double as min_margin, users, count(*) filter (share >= ms and margin >= mm) as emitted, round(count(*) filter (share >= ms and margin >= mm) / users, 6) as coverage
  from (values {values(_GRID[0])}) a(md) cross join (values {values(_GRID[1])}) b(ms) cross join (values {values(_GRID[2])}) c(mm) cross join (select count(distinct user_id) as users from loc)
  left join (select user_id, gd, share, share - coalesce(lead(share) over w, 0) as margin, row_number() over w as rn from ({_features(rule)}) cross join (values {values(_GRID[0])}) g(gd) where stay_count >= 2 and dwell_s > 0 and dates >= gd
    window w as (partition by user_id, gd order by share desc, dates desc, dwell_s desc, stay_count desc, location_id)) t on gd = md and rn = 1 group by md, ms, mm, users"""


@query(STAYS + " union all ".join(_grid_sql(r) for r in evidence.RULES))
def emission_grid(spark, sf_dir):
    x = _semantic(spark, sf_dir)
    g = [evidence.emission_grid(evidence.window_features(x.semantic, x.locations, r), *_GRID).withColumn("label", F.lit(r.label)) for r in evidence.RULES]
    return g[0].unionByName(g[1])


@query(BASE + f" select user_id, method, label, location_id::bigint as location_id, round(score, 6) as score, support_days::bigint as support_days, emitted from {_ALL}")
def method_assignments(spark, sf_dir):
    return reliability.infer_assignments(_semantic(spark, sf_dir).semantic)


@query(BASE + f" select split, method, label, count(*) as both_halves, count(*) filter (a = b) as same_location, round(count(*) filter (a = b) / count(*), 6) as agreement from {_SPLIT_DETAILS} group by all")
def split_half_reliability(spark, sf_dir):
    return reliability.split_half_summary(reliability.split_half(_semantic(spark, sf_dir).semantic))


@query(BASE + f""" select method, label, count(*) as candidates, round(avg(case when rnk is not null then 1.0 else 0.0 end), 6) as seen_share, round(avg(case when rnk = 1 then 1.0 else 0.0 end), 6) as top1_share,
  round(median(coalesce(metric, 0)), 6) as median_metric, round(median(rnk), 6) as median_rank from {_HELD} group by all""")
def heldout_validity(spark, sf_dir):
    return reliability.heldout_summary(reliability.heldout(_semantic(spark, sf_dir).semantic))


@query(BASE + f" select rate::double as rate, method, label, count(*) as candidates, round(avg(case when retained then 1.0 else 0.0 end), 6) as retention from {_DROPS} group by all")
def dropout_retention(spark, sf_dir):
    return reliability.retention(reliability.dropout(_semantic(spark, sf_dir).semantic), "rate")


_SHIFTED = _assigned("select s0.* replace (la + interval 12 hour as la, ld + interval 12 hour as ld, cast(la + interval 12 hour as date) as ldate) from s0")


@query(BASE + f" select 12::bigint as shift_hours, a.method, a.label, count(*) as candidates, round(avg(case when b.location_id = a.location_id then 1.0 else 0.0 end), 6) as retention from {_ALL} a left join {_SHIFTED} b using (user_id, method, label) group by all")
def time_shift_retention(spark, sf_dir):
    return reliability.retention(reliability.time_shift(_semantic(spark, sf_dir).semantic), "shift_hours")


@query(BASE + f""", ho as (select * from {_ALL} where label = 'HOME'),
vo as (select user_id, location_id, count(*) as votes, bool_or(method = 'fixed_window') as fs, bool_or(emitted) as fe from ho group by all), vw as (select *, votes = max(votes) over (partition by user_id) as top from vo),
vx as (select *, top and count(*) filter (top) over (partition by user_id) = 1 as uw from vw),
sp as (select ho.user_id, ho.location_id, count(distinct split) as sa, count(distinct ho.method) as sm from ho join (select * from {_SPLIT_DETAILS} where label = 'HOME' and a = b) x on x.user_id = ho.user_id and x.method = ho.method and x.a = ho.location_id group by all),
hl as (select ho.user_id, ho.location_id, count(*) as seen, count(*) filter (rnk = 1) as t1 from ho join (select * from {_HELD} where label = 'HOME' and rnk is not null) x on x.user_id = ho.user_id and x.method = ho.method and x.location_id = ho.location_id group by all),
dr as (select user_id, location_id, count(*) filter (r >= 2.0 / 3.0) as dm, avg(r) as mr from (select user_id, location_id, method, avg(case when retained then 1.0 else 0.0 end) as r from {_DROPS} where label = 'HOME' and abs(rate - 0.3) < 1e-9 group by all) group by all),
ev as (select vx.*, coalesce(sa, 0) as sa, coalesce(sm, 0) as sm, coalesce(seen, 0) as seen, coalesce(t1, 0) as t1, coalesce(dm, 0) as dm, mr, (coalesce(sa, 0) > 0)::int + (coalesce(t1, 0) > 0)::int + (coalesce(dm, 0) > 0)::int as axes
  from vx left join sp using (user_id, location_id) left join hl using (user_id, location_id) left join dr using (user_id, location_id)),
et as (select *, case when uw and votes >= 2 and axes = 3 then 'high' when uw and votes >= 2 and axes = 2 then 'medium' else 'uncertain' end as tier, case when fe then 'baseline_emitted' when fs then 'fixed_candidate_not_emitted' else 'outside_fixed_candidate' end as production from ev)
select user_id, location_id::bigint as location_id, votes, fs as fixed_selected, fe as fixed_emitted, uw as unique_winner, sa as split_axes, sm as split_methods, seen as seen_methods, t1 as top1_methods, dm as dropout_methods, round(mr, 6) as mean_retention, axes::bigint as axes, tier, production,
  tier in ('high', 'medium') and production <> 'baseline_emitted' as expansion from et""")
def home_consensus(spark, sf_dir):
    s = _semantic(spark, sf_dir).semantic
    return reliability.home_consensus(*reliability.suite(s, shared_folder(spark, "suite")))


_SECOND = f""", hm as (select user_id, location_id as home_id from (with s as (select * from s0), {LOC}, {ASSIGN} select * from asg where method = 'recurrence' and label = 'HOME')),
sd as (select s0.*, home_id, date_diff('day', min(ldate) over (partition by s0.user_id), ldate) as day, hour(la) + minute(la) / 60.0 + second(la) / 3600.0 as clk from s0 join hm using (user_id)),
sx as (select *, unnest(range(greatest(0, floor((day - 14) / 7.0)::bigint + 1), floor(day / 7.0)::bigint + 1)) as w from sd),
seen as (select user_id, w, count(distinct ldate) as days from sx group by all having count(distinct ldate) >= 6),
pl as (select user_id, w, location_id, count(distinct ldate) as pd, count(*) as n, avg(sin(clk * pi() / 12)) as sn, avg(cos(clk * pi() / 12)) as cs from sx where location_id <> home_id group by user_id, w, location_id having count(distinct ldate) >= 3 and count(*) >= 2),
tp as (select *, row_number() over o as r, lead(pd) over o as np from pl window o as (partition by user_id, w order by pd desc, n desc, location_id)),
sw as (select seen.user_id, seen.w, days, location_id, pd, pd / days as vs, (pd - coalesce(np, 0)) / days as mg, case when atan2(sn, cs) < 0 then atan2(sn, cs) * 12 / pi() + 24 else atan2(sn, cs) * 12 / pi() end as hr, sqrt(sn * sn + cs * cs) as cc
  from seen left join tp on tp.user_id = seen.user_id and tp.w = seen.w and r = 1)"""


def _secondary(spark, sf_dir) -> DataFrame:
    s = _semantic(spark, sf_dir).semantic
    homes = reliability.schedule_free_assignments(s).where("label = 'HOME'").select("user_id", F.col("location_id").alias("home_id"))
    return reliability.secondary_windows(s, homes, 14, 7)


@query(BASE + _SECOND + """ select user_id, w as "window", days, location_id::bigint as location_id, pd as place_days, round(vs, 6) as visit_share, round(mg, 6) as margin, round(hr, 6) as hour, round(cc, 6) as concentration from sw""")
def secondary_windows(spark, sf_dir):
    return _secondary(spark, sf_dir)


@query(BASE + _SECOND + """, ct as (select user_id, location_id, count(*) as n from sw where location_id is not null group by all), cr as (select *, row_number() over (partition by user_id order by n desc, location_id) as r from ct),
cb as (select user_id, count(*) as places, max(location_id) filter (r = 1) as dominant, max(n) filter (r = 1) as n1, coalesce(max(n) filter (r = 2), 0) as n2 from cr group by user_id),
ru as (select *, case when lag(location_id) over (partition by user_id order by w) = location_id then 0 else 1 end as nw from sw where location_id is not null), rv as (select *, sum(nw) over (partition by user_id order by w) as run from ru),
rl as (select user_id, count(*) - 1 as switches, max(n) as longest from (select user_id, run, count(*) as n from rv group by all) group by user_id), tt as (select user_id, count(*) as windows, count(location_id) as cw from sw group by user_id)
select tt.user_id, windows, cw as candidate_windows, coalesce(places, 0) as places, dominant::bigint as dominant, case when cw > 0 then round(n1 / cw, 6) end as dominant_share, case when cw > 0 then round(n2 / cw, 6) end as second_share, coalesce(switches, 0) as switches, coalesce(longest, 0) as longest_run,
  case when windows < 3 or cw < 2 then 'insufficient' when n1 / cw >= 0.7 then 'stable_secondary_anchor' when n2 >= 2 then 'multi_anchor' else 'unstable' end as pattern from tt left join cb using (user_id) left join rl using (user_id)""")
def secondary_patterns(spark, sf_dir):
    return reliability.secondary_patterns(_secondary(spark, sf_dir))
