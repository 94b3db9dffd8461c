"""Registered queries of the evidence for stable secondary places, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import anchors, reliability
from ..sources.shared import shared_folder
from . import home_office
from .audits import _SECOND, BASE
from .queries import query

_METRICS = BASE + _SECOND + """, ct as (select user_id, location_id, count(*) as n from sw where location_id is not null group by all), cr as (select *, row_number() over (partition by user_id order by n desc, location_id) as r from ct),
tt as (select user_id, count(*) as windows, count(location_id) as cw from sw group by user_id),
co as (select tt.user_id, home_id, location_id as secondary_id from tt join cr on cr.user_id = tt.user_id and r = 1 join hm on hm.user_id = tt.user_id where windows >= 3 and cw >= 2 and n / cw >= 0.7),
cs as (select s0.*, home_id, secondary_id, (epoch(ld) - epoch(la)) / 3600.0 as dh, hour(la) + minute(la) / 60.0 as h from s0 join co using (user_id)),
dd as (select user_id, count(distinct ldate) filter (isodow(ldate) <= 5) as aw, count(distinct ldate) filter (isodow(ldate) > 5) as ar from cs group by user_id),
mo as (select *, lag(location_id) over (partition by user_id, ldate order by la, ld, location_id) as bf from cs),
pd as (select user_id, case when bf = home_id then location_id else bf end as location_id, count(distinct ldate) as pairs from mo where bf <> location_id and home_id in (bf, location_id) group by all),
ac as (select user_id, location_id, secondary_id, count(distinct ldate) as days, count(distinct ldate) filter (isodow(ldate) <= 5) as wk, count(distinct ldate) filter (isodow(ldate) > 5) as we, sqrt(pow(avg(sin(h * pi() / 12)), 2) + pow(avg(cos(h * pi() / 12)), 2)) as conc,
  quantile_cont(dh, 0.25) as q1, quantile_cont(dh, 0.5) as q2, quantile_cont(dh, 0.75) as q3 from cs where location_id <> home_id group by all having count(distinct ldate) >= 3 and count(*) >= 2),
am as (select user_id, location_id::bigint as location_id, location_id = secondary_id as is_secondary, days as active_days, case when aw > 0 and ar > 0 then wk / aw - we / ar end as visit_contrast, coalesce(pairs, 0) / days as home_pair_share, conc as arrival_concentration,
  case when q2 <= 0 then 0.0 else 1 / (1 + (q3 - q1) / q2) end as dwell_regularity from ac join dd using (user_id) left join pd using (user_id, location_id))"""
_RANKS = _METRICS + """, un as (select user_id, location_id, is_secondary, unnest(['visit_contrast', 'home_pair_share', 'arrival_concentration', 'dwell_regularity']) as metric, unnest([visit_contrast, home_pair_share, arrival_concentration, dwell_regularity]) as v from am),
ow as (select user_id, metric, max(location_id) filter (is_secondary) as secondary_id, max(v) filter (is_secondary) as value, count(*) - 1 as peers, count(v) filter (not is_secondary) as n, max(v) as most, quantile_cont(v, 0.5) filter (not is_secondary) as md from un group by user_id, metric having count(*) filter (is_secondary) = 1 and count(*) > 1),
rk as (select user_id, secondary_id, peers, metric, value, value is not null and n > 0 as valid, case when value is not null and n > 0 then (select count(*) filter (u.v <= ow.value) / count(u.v) from un u where u.user_id = ow.user_id and u.metric = ow.metric) end as percentile,
  coalesce(n > 0 and value >= most - 1e-12, false) as top1, case when value is not null then md end as peer_median, value - md as difference, coalesce(value > md, false) as beats from ow)"""


def _kept(df: DataFrame) -> DataFrame:
    """Written once and read back: each of these has a few rows a user, and several readers that would work it out again."""
    folder = shared_folder(df.sparkSession, "anchors")
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def _metrics(spark, sf_dir) -> DataFrame:
    s = home_office.from_events(spark, sf_dir).semantic
    homes = _kept(reliability.schedule_free_assignments(s).where("label = 'HOME'").select("user_id", F.col("location_id").alias("home_id")))
    windows = _kept(reliability.secondary_windows(s, homes, 14, 7))
    return anchors.anchor_metrics(s, _kept(anchors.stable_cohort(reliability.secondary_patterns(windows), homes)))


@query(_METRICS + " select * replace (round(visit_contrast, 6) as visit_contrast, round(home_pair_share, 6) as home_pair_share, round(arrival_concentration, 6) as arrival_concentration, round(dwell_regularity, 6) as dwell_regularity) from am")
def secondary_anchor_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


@query(_RANKS + " select * replace (round(value, 6) as value, round(percentile, 6) as percentile, round(peer_median, 6) as peer_median, round(difference, 6) as difference) from rk")
def secondary_anchor_ranks(spark, sf_dir):
    return anchors.rank_within_user(_metrics(spark, sf_dir))


@query(_RANKS + """ select metric, count(*) filter (valid) as users, count(*) filter (top1) as top1_users, count(*) filter (beats) as beats_users, round(quantile_cont(percentile, 0.5), 6) as median_percentile, round(quantile_cont(difference, 0.5), 6) as median_difference from rk group by metric""")
def secondary_metric_comparison(spark, sf_dir):
    return anchors.compare_metrics(anchors.rank_within_user(_metrics(spark, sf_dir)))


@query(_RANKS + """, ax as (select user_id, count(*) filter (valid) as valid_axes, count(*) filter (top1) as top1_axes, count(*) filter (beats) as beats_axes from rk group by user_id) select valid_axes, top1_axes, beats_axes, count(*) as users from ax group by all""")
def secondary_convergence(spark, sf_dir):
    return anchors.convergence(anchors.rank_within_user(_metrics(spark, sf_dir)))
