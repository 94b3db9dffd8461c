"""Registered queries of cluster alignment and interval inventories, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment, forward
from ..sources.trajectories import table, visits
from . import home_office
from .queries import STAYS, VISITS, query

# Places are one clustering; in the other, by user, they are named anew, put together by twos, or taken apart by the event's number.
_TWO = VISITS + """, cl as (select user_id, event_id, place as a, case when user_id % 3 = 0 then 10 - place when user_id % 3 = 1 then place // 2 else place * 2 + event_id % 2 end as b from v),
ab as (select user_id, a as left_id, b as right_id, count(*) as shared from cl group by all),
nn as (select *, count(*) over (partition by user_id, left_id) as nl, count(*) over (partition by user_id, right_id) as nr from ab),
rl as (select *, case when nl = 1 and nr = 1 then 'same' when nl > 1 then 'split' else 'merge' end as relation from nn)
"""


def _two(spark, sf_dir):
    v = visits(table(spark, sf_dir, "events"))
    u, place, event = F.col("user_id"), F.col("place"), F.col("event_id")
    other = F.when(u % 3 == 0, 10 - place).when(u % 3 == 1, F.floor(place / 2)).otherwise(place * 2 + event % 2)
    return v.select("user_id", "event_id", place.alias("location_id")), v.select("user_id", "event_id", other.cast("long").alias("location_id"))


@query(_TWO + """select user_id, left_id, right_id, shared, relation, row_number() over (partition by user_id, case relation when 'merge' then right_id else left_id end, relation order by shared desc, left_id, right_id) = 1 as assigned from rl""")
def cluster_alignment(spark, sf_dir):
    left, right = _two(spark, sf_dir)
    return alignment.assigned(alignment.contingency(left, right, ["event_id"]))


@query(_TWO + """, sa as (select user_id, a, list_sort(list(event_id)) as m from cl group by user_id, a), sb as (select user_id, b, list_sort(list(event_id)) as m from cl group by user_id, b),
fu as (select coalesce(sa.user_id, sb.user_id) as user_id, sa.user_id is not null as l, sb.user_id is not null as r from sa full join sb on sa.user_id = sb.user_id and sa.m = sb.m)
select user_id, count(*) filter (l and r) as in_both, count(*) filter (not r) as only_left, count(*) filter (not l) as only_right, bool_and(l and r) as exact from fu group by user_id""")
def cluster_parity(spark, sf_dir):
    return alignment.membership_parity(*_two(spark, sf_dir), ["event_id"])


_PLACE = "39.90 + 0.01 * (s.user_id % 50) + 0.005 * place + 0.00005 * (event_id % 3 - 1)"


@query(STAYS + f""", dd as (select distinct user_id, cast(ts as date) as d from v), dk as (select *, row_number() over (partition by user_id order by d) - 1 as k, count(*) over (partition by user_id) as n from dd),
ct as (select user_id, d::timestamp as cut from dk where n >= 2 and k = least(greatest(1, ceil(n * 0.7 - 1e-9)), n - 1)),
pa as (select s.*, {_PLACE} as lat, 116.40 + 0.004 * place as lon, case when cut is null then 'none' when ts + interval 1500 second <= cut then 'train' when ts >= cut then 'future' else 'crossing' end as part from s left join ct on ct.user_id = s.user_id),
op as (select f.user_id as user_id, f.event_id as event_id, t.location_id as loc, max(2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(t.lat - f.lat) / 2), 2) + cos(radians(f.lat)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - f.lon) / 2), 2))))) as far from pa f join pa t on t.user_id = f.user_id and t.part = 'train' where f.part = 'future' group by all),
oc as (select user_id, event_id, count(*) as n, min(loc) as loc from op where far <= 200 group by all)
select pa.user_id as user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as arrival, case when n = 1 then loc when n > 1 then -2 else -1 end::bigint as location_id, case when n = 1 then 'matched' when n > 1 then 'ambiguous' else 'not_matched' end as match
from pa left join oc on oc.user_id = pa.user_id and oc.event_id = pa.event_id where part = 'future'""")
def frozen_locations(spark, sf_dir):
    parts = forward.cut_by_dates(home_office.from_events(spark, sf_dir).semantic)
    later = parts.where("part = 'future'").select("user_id", "arrival", "lat", "lon")
    return alignment.align_to_frozen(later, parts.where("part = 'train'"), ["arrival"], 200.0).drop("lat", "lon")


# The other inventory has, by the event's number, the same stay moved, two parts of it with a pause, one that goes on to the next hour, or none.
_INVENTORIES = VISITS + """, le as (select user_id, event_id as id, ts as s, ts + interval 1500 second as e, 39.90 + 0.01 * (user_id % 50) + 0.005 * place as lat, 116.40 + 0.004 * place as lon from v),
ri as (select user_id, event_id * 2 as id, ts + to_seconds(300 * (event_id % 4)) as s, ts + to_seconds(case event_id % 4 when 1 then 700 when 2 then 3600 else 1500 end) as e, 39.90 + 0.01 * (user_id % 50) + 0.005 * place + 0.003 * (event_id % 2) as lat, 116.40 + 0.004 * place as lon from v where event_id % 4 < 3
  union all select user_id, event_id * 2 + 1, ts + interval 800 second, ts + interval 1600 second, 39.90 + 0.01 * (user_id % 50) + 0.005 * place, 116.40 + 0.004 * place from v where event_id % 4 = 1),
pr as (select le.user_id as user_id, le.id as l, ri.id as r, (epoch_us(least(le.e, ri.e)) - epoch_us(greatest(le.s, ri.s))) / 1e6 as o, (epoch_us(le.e) - epoch_us(le.s)) / 1e6 as ll, (epoch_us(ri.e) - epoch_us(ri.s)) / 1e6 as rl, le.lat as la, le.lon as lo, ri.lat as ra, ri.lon as ro
  from le join ri on le.user_id = ri.user_id and greatest(le.s, ri.s) < least(le.e, ri.e)),
mt as (select *, 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(ra - la) / 2), 2) + cos(radians(la)) * cos(radians(ra)) * pow(sin(radians(ro - lo) / 2), 2)))) as d from (select *, row_number() over (partition by user_id, l order by o desc) as k from pr) where k = 1),
de as (select 'left' as source, le.user_id as user_id, le.id as id, r as matched_id, coalesce(o, 0.0) as o, coalesce(o / least(ll, rl), 0.0) as q, d from le left join mt on mt.user_id = le.user_id and l = le.id
  union all select 'right', ri.user_id, ri.id, l, coalesce(o, 0.0), coalesce(o / least(ll, rl), 0.0), d from ri left join mt on mt.user_id = ri.user_id and r = ri.id)
"""


def _inventories(spark, sf_dir):
    v = visits(table(spark, sf_dir, "events"))
    e = F.col("event_id")
    lat, lon = 39.90 + 0.01 * (F.col("user_id") % 50) + 0.005 * F.col("place"), 116.40 + 0.004 * F.col("place")
    at = lambda s: F.col("ts") + F.make_dt_interval(secs=s)
    part = lambda i, s, t, y: F.struct(i.alias("id"), at(s).alias("start_time"), at(t).alias("end_time"), y.alias("lat"), lon.alias("lon"))
    left = v.select("user_id", e.alias("id"), F.col("ts").alias("start_time"), at(F.lit(1500)).alias("end_time"), lat.alias("lat"), lon.alias("lon"))
    first = F.when(e % 4 < 3, part(e * 2, 300 * (e % 4), F.when(e % 4 == 1, 700).when(e % 4 == 2, 3600).otherwise(1500), lat + 0.003 * (e % 2)))
    second = F.when(e % 4 == 1, part(e * 2 + 1, F.lit(800), F.lit(1600), lat))
    return left, v.select("user_id", F.inline(F.array_compact(F.array(first, second))))


@query(_INVENTORIES + "select source, user_id, id, matched_id, round(o, 6)::double as overlap_s, round(q, 6)::double as overlap_over_shorter, round(d, 6) as distance_m from de")
def stay_inventories(spark, sf_dir):
    return alignment.inventory_details(*_inventories(spark, sf_dir))


@query(_INVENTORIES + """, su as (select source, count(*) as stays, count(*) filter (o > 0) as overlap_any, count(*) filter (o > 0 and d <= 200) as overlap_near, count(*) filter (q >= 0.5 and d <= 200) as strong_match from de group by source)
select *, round(overlap_any / stays, 6) as overlap_any_rate, round(overlap_near / stays, 6) as overlap_near_rate, round(strong_match / stays, 6) as strong_match_rate from su""")
def inventory_agreement(spark, sf_dir):
    return alignment.inventory_summary(alignment.inventory_details(*_inventories(spark, sf_dir)))
