"""Registered queries of sensitivity sweeps, with their SQL for DuckDB."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from ..operators import clean, locate, sweeps
from ..sources.shared import dealt, kept
from ..sources.trajectories import points, table
from . import home_office
from .queries import STAYS, VISITS, query

GAPS, RADII, DWELLS = [240.0, 300.0], [100.0, 200.0, 300.0], [600.0, 1200.0, 1800.0]
THRESHOLDS, BASELINE = [100.0, 200.0, 600.0], 200.0

# Points of a visit are 300 s apart, at one spot, for 1500 s, and two hours lie between visits: so a gap of under 300 s leaves no stay, and a dwell of 1500 s or less each visit.
_GRID = ", ".join(f"({g}, {r}, {d})" for g, r, d in product(GAPS, RADII, DWELLS))


@query(VISITS + f""", gr(gap_s, radius_m, dwell_s) as (values {_GRID}),
st as (select user_id, 39.90 + 0.01 * (user_id % 50) + 0.005 * place + 0.00005 * (event_id % 3 - 1) as lat, 116.40 + 0.004 * place as lon from v),
nu as (select user_id, count(*) as n, max(lat) as x, min(lat) as y from st group by user_id),
nr as (select distinct a.user_id as user_id from (select *, row_number() over (partition by user_id order by lat, lon) as i from st) a join (select *, row_number() over (partition by user_id order by lat, lon) as i from st) b on a.user_id = b.user_id and a.i < b.i
  and 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 200),
su as (select sum(n)::bigint as n_stays, count(*) as users_with_stays, median(n) as med, count(*) filter (n > 1) as two, count(*) filter (n > 1 and user_id in (select user_id from nr)) as rep from nu),
al as (select count(distinct user_id) as u from events)
select gap_s::double as gap_s, radius_m::double as radius_m, dwell_s::double as dwell_s, case when ok then n_stays else 0 end as n_stays, case when ok then 1500.0 end::double as median_duration_s, case when ok then 1500.0 end::double as p90_duration_s, case when ok then users_with_stays else 0 end as users_with_stays,
  case when ok then med end::double as median_stays_per_active_user, case when ok then two else 0 end as users_with_2plus_stays, case when ok then rep else 0 end as repeat_location_users, round(case when ok then n_stays else 0 end / u, 6)::double as mean_stays_per_user, round(case when ok and two > 0 then rep / two end, 6)::double as repeat_location_user_rate
from (select *, gap_s >= 300 and dwell_s <= 1500 as ok from gr) cross join su cross join al""")
def stay_grid(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    swept = sweeps.sweep_staypoints(clean.clean_trajectory(points(events), clean.CleaningConfig(max_gap_s=max(GAPS))), GAPS, RADII, DWELLS)
    grid = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(c, sweeps.CONFIG, strict=True)]) for c in product(GAPS, RADII, DWELLS)])))
    return sweeps.grid_summary(swept, events, grid, 200.0)


# Places of a user are 645 m apart or more along the line of places, so 100 and 200 m give the places, and a threshold of 600 m does too.
@query(STAYS + """, pp as (select user_id, location_id, count(*) as n from s group by all), pu as (select user_id, count(*) filter (n >= 2) as r from pp group by user_id)
select unnest([100.0, 200.0, 600.0])::double as threshold_m, count(*) filter (r = 0) as no_stable_anchor, count(*) filter (r = 1) as dominant_anchor, count(*) filter (r = 2) as two_anchor, count(*) filter (r >= 3) as multiple_anchor, sum(r)::bigint as recurring_locations, 1.0::double as top_anchor_stability, 1.0::double as motif_stability from pu""")
def location_sensitivity(spark, sf_dir):
    stays = locate.with_local_time(home_office.detect(home_office.observations(spark, sf_dir)))
    # Written once, since three groupings read them and the kernels behind them are dear; all thresholds stand in one row, and are spread after that.
    numbered = dealt(kept(sweeps.numbered_at(stays, THRESHOLDS), "sweeps"), "user_id")
    return sweeps.location_sensitivity(sweeps.at_thresholds(numbered, THRESHOLDS), BASELINE)
