"""Registered queries of seeded bootstraps, with the same hashes in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bootstrap
from ..sources.trajectories import table, visits
from .queries import VISITS, query

REPLICATES, SEED = 20, 7


def _uniform(key: str, r: str = "r", seed: int = SEED) -> str:
    return f"(('0x' || substr(sha256('{seed}|' || {key} || '|' || ({r} // 8)), ({r} % 8 * 8 + 1)::integer, 8))::bigint / 4294967296.0)"


def _poisson(u: str) -> str:
    return "case " + " ".join(f"when {u} < {p!r} then {n}" for n, p in enumerate(bootstrap.POISSON_ONE)) + f" else {len(bootstrap.POISSON_ONE)} end"


@query(f"""with v as (select p_brand, p_partkey, p_retailprice - 1200 as v from part where p_size <= 10), d as (select p_brand, v, r, {_uniform("p_brand || '|' || p_partkey", seed=42)} as u from v cross join range(40) t(r)),
w as (select p_brand, r, v, {_poisson("u")} as w from d), m as (select p_brand, r, sum(w * v) / sum(w) as m from w where w > 0 group by p_brand, r), n as (select p_brand, count(*) as n, avg(v) as mean from v group by p_brand)
select n.p_brand as p_brand, any_value(n) as n, round(any_value(mean), 4) as mean, round(quantile_cont(m, 0.025), 4) as low, round(quantile_cont(m, 0.975), 4) as high, round(avg(case when m > 0 then 1.0 else 0.0 end), 6) as over_zero from m join n on n.p_brand = m.p_brand group by n.p_brand""")
def brand_bootstrap(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_size <= 10").select("p_brand", "p_partkey", (F.col("p_retailprice") - 1200).alias("v"))
    b = bootstrap.bootstrap_means(p, "p_brand", ["p_partkey"], "v", 40, 42)
    return b.withColumns({c: F.round(c, 4) for c in ("mean", "low", "high")})


def _pairs(users):
    """Each even user against the next odd one."""
    even = users.where("user_id % 2 = 0").select(F.col("user_id").alias("pair"), F.col("user_id").alias("candidate"), (F.col("user_id") + 1).alias("control"))
    odd = users.where("user_id % 2 = 1").select((F.col("user_id") - 1).alias("pair"))
    return even.join(odd, "pair")


_SUMMARY = """select pair, metric, count(*) as replicates, round(quantile_cont(difference, 0.025), 6) as low, round(quantile_cont(difference, 0.5), 6) as median, round(quantile_cont(difference, 0.975), 6) as high,
  round(avg(case when difference > 0 then 1.0 else 0.0 end), 6) as over_zero from df where difference is not null group by pair, metric"""


@query(VISITS + f""", dy as (select user_id, cast(lt as date) as d, isodow(lt) <= 5 as workday, count(*)::double as visits, count(distinct place)::double as places from v group by all),
sd as (select user_id - user_id % 2 as pair, user_id % 2 = 0 as cand, * from dy),
ct as (select pair, workday, count(*) filter (cand) as a, count(*) filter (not cand) as b from sd group by all),
dr as (select sd.pair as pair, cand, sd.workday as workday, visits, places, r, least(a, b) as n, row_number() over (partition by sd.pair, cand, sd.workday, r order by {_uniform("sd.pair || '|' || cand || '|' || d")}, sd.pair || '|' || cand || '|' || d) as rk
  from sd join ct on ct.pair = sd.pair and ct.workday = sd.workday cross join range({REPLICATES}) t(r)),
mn as (select pair, cand, r, avg(visits) as visits, avg(places) as places from dr where rk <= n group by pair, cand, r),
df as (select pair, r, 'visits' as metric, max(visits) filter (cand) - max(visits) filter (not cand) as difference from mn group by pair, r union all select pair, r, 'places', max(places) filter (cand) - max(places) filter (not cand) from mn group by pair, r)
""" + _SUMMARY)
def paired_day_bootstrap(spark, sf_dir):
    local = F.col("ts") + F.expr("interval 8 hours")
    v = visits(table(spark, sf_dir, "events")).withColumn("d", F.to_date(local)).withColumn("workday", F.weekday(local) < 5)
    days = v.groupBy("user_id", "d", "workday").agg(F.count("*").alias("visits"), F.count_distinct("place").alias("places"))
    return bootstrap.paired_bootstrap(days, _pairs(days.select("user_id").distinct()), "workday", ["d"], ["visits", "places"], REPLICATES, SEED)


@query(VISITS + f""", lg as (select user_id, event_id, event_type, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id)) / 1e6 as s from v),
sg as (select user_id - user_id % 2 as pair, user_id % 2 = 0 as cand, event_id, s, (event_id % 97 * 100)::double as m, event_type in ('purchase', 'signup') as mot, event_type in ('click') as act from lg where s > 0),
tg as (select pair, least(sum(s) filter (cand), sum(s) filter (not cand)) as target from sg group by pair having sum(s) filter (cand) > 0 and sum(s) filter (not cand) > 0),
dr as (select sg.*, r, target, coalesce(sum(s) over (partition by sg.pair, cand, r order by {_uniform("sg.pair || '|' || cand || '|' || event_id")}, sg.pair || '|' || cand || '|' || event_id rows between unbounded preceding and 1 preceding), 0) as before from sg join tg on tg.pair = sg.pair and target >= 7200 cross join range({REPLICATES}) t(r)),
us as (select *, least(s, target - before) as used from dr),
gg as (select pair, cand, r, sum(m * used / s) as m, sum(used) as s, sum(case when mot then m * used / s else 0 end) as mm, sum(case when act then m * used / s else 0 end) as am from us where used > 0 group by pair, cand, r),
me as (select pair, cand, r, unnest(['distance_km_per_hour', 'motorized_distance_share', 'active_distance_share']) as metric, unnest([m / 1000 / (s / 3600), case when m > 0 then mm / m else 0 end, case when m > 0 then am / m else 0 end]) as val from gg),
df as (select pair, r, metric, case when abs(max(val) filter (cand) - max(val) filter (not cand)) < 1e-9 then 0.0 else max(val) filter (cand) - max(val) filter (not cand) end as difference from me group by pair, r, metric)
""" + _SUMMARY)
def transport_bootstrap(spark, sf_dir):
    v = visits(table(spark, sf_dir, "events"))
    micros = F.timestamp_diff("MICROSECOND", F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.col("ts"))
    s = v.select("user_id", "event_id", (micros / 1e6).alias("duration_s"), (F.col("event_id") % 97 * 100).cast("double").alias("distance_m"), F.col("event_type").isin("purchase", "signup").alias("motorized"), F.col("event_type").isin("click").alias("active"))
    return bootstrap.transport_bootstrap(s, _pairs(v.select("user_id").distinct()), ["event_id"], REPLICATES, SEED, 2.0)
