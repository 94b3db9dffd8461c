"""Registered queries of anchors' context and of seeded resampling, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import context, routines
from ..sources.shared import dealt, kept
from ..sources.trajectories import table
from .habits import _SEG, _routine
from .queries import _SPOTS, query

THRESHOLDS = (500.0, 1000.0, 2000.0)
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_PLACES = _SPOTS + """, pc as (select c_custkey as id, c_mktsegment as category from customer),
nr as (select anchor_id, category, min(d) as nearest, count(*) as places from (select a.id as anchor_id, p.id as place_id, 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(p.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - a.lon) / 2), 2)))) as d from a, p) join pc on pc.id = place_id where d <= 2000 group by all),
mt as (select s.s_suppkey as anchor_id, s.s_nationkey as grp, c.category, nearest, coalesce(places, 0) as places from supplier s cross join (values ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'), ('MACHINERY')) c(category) left join nr on nr.anchor_id = s.s_suppkey and nr.category = c.category)"""


def _metrics(spark, sf_dir) -> DataFrame:
    spot = lambda t, k, m, s, n, u: table(spark, sf_dir, t).select(F.col(k).alias("id"), (39.0 + F.col(k) % m / s).alias("lat"), (116.0 + F.col(k) % n / u).alias("lon"))
    customers = spot("customer", "c_custkey", 997, 500.0, 613, 320.0).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("category")), "id")
    return context.category_metrics(spot("supplier", "s_suppkey", 100, 50.0, 77, 40.0), customers, THRESHOLDS, SEGMENTS, 0.02)


@query(_PLACES + """ select anchor_id, category, round(nearest, 6) as nearest_m, places, coalesce(nearest <= 500, false) as within_500, coalesce(nearest <= 1000, false) as within_1000, coalesce(nearest <= 2000, false) as within_2000, round(coalesce(nearest, 2000.0), 6) as censored_m,
  case when nearest <= 500 then 'within_500' when nearest <= 1000 then 'within_1000' when nearest <= 2000 then 'within_2000' else 'beyond' end as bucket from mt""")
def anchor_category_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


@query(_PLACES + " select category, t::double as threshold_m, count(*) as anchors, count(*) filter (nearest <= t) as hits, round(count(*) filter (nearest <= t) / count(*), 6) as share from mt cross join (values (500), (1000), (2000)) x(t) group by category, t")
def category_threshold_shares(spark, sf_dir):
    return context.threshold_shares(_metrics(spark, sf_dir), THRESHOLDS)


@query(_PLACES + """, r as (select grp, anchor_id = min(anchor_id) over (partition by grp) as c, coalesce(nearest, 2000.0) as v from mt), g as (select grp, avg(v) filter (c) as own, avg(v) filter (not c) as peers, count(*) filter (not c) as n from r group by grp)
select grp as nation, round(own, 6) as own, round(peers, 6) as peers, n as n_peers, round(own - peers, 6) as difference, case when own - peers > 1e-12 then '+' when own - peers < -1e-12 then '-' when peers is not null then '0' end as sign from g""")
def anchors_against_peers(spark, sf_dir):
    from pyspark.sql import Window

    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("anchor_id"), F.col("s_nationkey").alias("nation"))
    m = _metrics(spark, sf_dir).join(own, "anchor_id").withColumn("candidate", F.col("anchor_id") == F.min("anchor_id").over(Window.partitionBy("nation")))
    return context.against_peers(m, "nation", "candidate", "censored_m")


@query(_SPOTS + """, t as (select round(lat * 1000000)::bigint // 250000 as cy, round(lon * 1000000)::bigint // 250000 as cx, count(*) as anchors, avg(lat) as ml, min(lat) as s, max(lat) as n, min(lon) as w, max(lon) as e from p group by all)
select cy, cx, anchors, round(s - 150 / 111320.0, 6) as south, round(n + 150 / 111320.0, 6) as north, round(w - 150 / (111320.0 * greatest(cos(radians(ml)), 1e-6)), 6) as west, round(e + 150 / (111320.0 * greatest(cos(radians(ml)), 1e-6)), 6) as east from t""")
def padded_tiles(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select((39.0 + F.col("c_custkey") % 997 / 500.0).alias("lat"), (116.0 + F.col("c_custkey") % 613 / 320.0).alias("lon"))
    return context.padded_tiles(c, 250_000, 150.0)


RULES = {"steel": ("steel", "iron"), "small": ("small", "mini"), "promo": ("promo",), "brass": ("brass", "copper")}


@query("""with n as (select p_partkey, lower(regexp_replace(trim(p_name || '  ' || p_type), '\\s+', ' ', 'g')) as t from part), c as (select *, list_filter([case when contains(t, 'steel') or contains(t, 'iron') then 'steel' end, case when contains(t, 'small') or contains(t, 'mini') then 'small' end, case when contains(t, 'promo') then 'promo' end,
  case when contains(t, 'brass') or contains(t, 'copper') then 'brass' end], lambda x: x is not null) as cs from n)
select p_partkey, array_to_string(cs, ',') as categories, len(cs) as signals, case len(cs) when 0 then 'unknown' when 1 then 'single_signal' else 'ambiguous_multi_signal' end as status, list_contains(cs, 'steel') or list_contains(cs, 'brass') as work_signal from c""")
def part_name_signals(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit("  "), "p_type").alias("name"))
    c = context.classified_names(p, "name", RULES, ("steel", "brass"))
    return c.select("p_partkey", F.array_join("categories", ",").alias("categories"), "signals", "status", "work_signal")


@query(_SEG + """, dy as (select user_id, ldate, r, row_number() over (partition by user_id, r order by case when r < 0 then 0.0 else ('0x' || substr(sha256('42|' || user_id || '|' || r || '|' || ldate), 1, 8))::bigint / 4294967296.0 end, ldate) as k, count(*) over (partition by user_id, r) as n from sq cross join range(-1, 20) t(r)),
hf as (select user_id, ldate, r, k > n // 2 as late from dy where n >= 6), ec as (select mv.user_id, r, o, de, count(*) filter (not late)::double as a, count(*) filter (late)::double as b from mv join hf using (user_id, ldate) group by mv.user_id, r, o, de),
ep as (select user_id, r, case when sum(a) over w > 0 then a / sum(a) over w end as p, case when sum(b) over w > 0 then b / sum(b) over w end as q from ec window w as (partition by user_id, r)),
jj as (select user_id, r, round(sum(case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end) / 2, 9) as jsd from ep where p is not null and q is not null group by user_id, r),
jr as (select *, max(jsd) filter (r < 0) over (partition by user_id) as rl from jj)
select user_id, round(any_value(rl), 6) as jsd, count(*) filter (r >= 0) as replicates, round(median(jsd) filter (r >= 0), 6) as median_null, count(*) filter (r >= 0 and jsd >= rl) as as_far, round((count(*) filter (r >= 0 and jsd >= rl) + 1) / (count(*) filter (r >= 0) + 1), 6) as p_value from jr where rl is not null group by user_id""")
def partition_null(spark, sf_dir):
    sequences, moves, _ = _routine(spark, sf_dir)
    # Dealt out by rows of days: each becomes 21 replicates within its task.
    return routines.partition_null(dealt(kept(routines.days_with_moves(moves, sequences), "days"), "user_id"), 20, 42)
