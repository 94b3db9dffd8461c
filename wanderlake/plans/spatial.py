"""Registered queries of geohash homes, raster windows, diameters and even samples, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import comparators, geohomes, spatial
from ..sources.trajectories import table, visits
from . import home_office
from .queries import STAYS, VISITS, query


def _code(precision: int, source: str) -> str:
    n_lon, n_lat = (5 * precision + 1) // 2, 5 * precision // 2
    bit = lambda b: f"((x >> {n_lon - 1 - b // 2}) & 1)" if b % 2 == 0 else f"((y >> {n_lat - 1 - b // 2}) & 1)"
    letters = [f"substr('{geo.GEOHASH_LETTERS}', (1 + {' + '.join(f'{16 >> j} * {bit(5 * k + j)}' for j in range(5))})::int, 1)" for k in range(precision)]
    return f"select *, {' || '.join(letters)} as code, (y + 0.5) / {float(1 << n_lat)} * 180 - 90 as cla, (x + 0.5) / {float(1 << n_lon)} * 360 - 180 as clo from (select *, floor((lon + 180) / 360 * {1 << n_lon})::bigint as x, floor((lat + 90) / 180 * {1 << n_lat})::bigint as y from {source})"


def _chosen(source: str, code: str) -> str:
    return f"""select * from (select *, row_number() over (partition by user_id, ym order by nights desc, hn desc, sn desc, {code}) as k2 from (select *, row_number() over (partition by user_id, ym order by od desc, hd desc, sh desc, {code}) as k1 from (
  select a.user_id as user_id, a.ym as ym, {code}, count(distinct d) as od, count(distinct hat) / count(distinct d) as hd, count(*) / count(distinct hat) as sh, count(distinct nd) as nights, count(distinct hat) filter (nd is not null) as nh,
    case when count(distinct nd) > 0 then count(distinct hat) filter (nd is not null) / count(distinct nd) else 0 end as hn, case when count(nd) > 0 then count(nd) / count(distinct hat) filter (nd is not null) else 0 end as sn, any_value(days) as days
  from {source} a join (select user_id, ym, count(distinct d) as days from {source} group by user_id, ym) b on a.user_id = b.user_id and a.ym = b.ym group by a.user_id, a.ym, {code}) where od >= 3 and od > days * 0.5 and hd >= 2) where k1 <= 3) where k2 = 1"""


_HOMES = STAYS + f""", lc as (select user_id, location_id, median((39.90 + 0.01 * (user_id % 50) + 0.005 * place + 0.00005 * (event_id % 3 - 1))::double) as lat, median((116.40 + 0.004 * place)::double) as lon from s group by all),
gh as ({_code(7, "lc")}),
ob as (select hr.user_id as user_id, hat, strftime(hat, '%Y-%m') as ym, cast(hat as date) as d, code as g7, substr(code, 1, 6) as g6, cla, clo, case when hour(hat) < 6 then cast(hat as date) - 1 when hour(hat) >= 21 then cast(hat as date) end as nd
  from (select s.user_id as user_id, s.location_id as location_id, unnest(generate_series(date_trunc('hour', la), date_trunc('hour', ld), interval 1 hour)) as hat from s) hr join gh on gh.user_id = hr.user_id and gh.location_id = hr.location_id),
c6 as ({_chosen("ob", "g6")}), o7 as (select ob.* from ob join c6 on c6.user_id = ob.user_id and c6.ym = ob.ym and c6.g6 = ob.g6), c7 as ({_chosen("o7", "g7")}),
dm as (select user_id, ym, count(distinct d) as observed_days from ob group by user_id, ym),
mh as (select c7.user_id as user_id, c7.ym as year_month, substr(g7, 1, 6) as geohash6, g7 as geohash7, observed_days, nights as home_nights, nh as home_night_hours from c7 join dm on dm.user_id = c7.user_id and dm.ym = c7.ym)
"""


def _monthly(spark, sf_dir):
    x = home_office.from_events(spark, sf_dir)
    return geohomes.monthly_homes(comparators.stay_hours(x.semantic, x.locations))


@query(_HOMES + "select mh.user_id as user_id, year_month, geohash6, geohash7, round(la, 6) as lat, round(lo, 6) as lon, observed_days, home_nights, home_night_hours from mh join (select distinct g7, cla as la, clo as lo from ob) z on z.g7 = geohash7")
def monthly_geohash_homes(spark, sf_dir):
    return _monthly(spark, sf_dir)


@query(_HOMES + """select b.user_id as user_id, geohash7, round(la, 6) as lat, round(lo, 6) as lon, qm as qualifying_months, round(months / qm, 6) as modal_month_share
from (select *, row_number() over (partition by user_id order by months desc, nh desc, geohash7) as k, sum(months) over (partition by user_id)::bigint as qm from (select user_id, geohash7, count(*) as months, sum(home_night_hours) as nh from mh group by user_id, geohash7)) b
join (select distinct g7, cla as la, clo as lo from ob) z on z.g7 = geohash7 where k = 1""")
def geohash_homes(spark, sf_dir):
    return geohomes.homes_over_months(_monthly(spark, sf_dir))


@query(VISITS + f""", vv as (select distinct 39.90 + 0.01 * (user_id % 50) + 0.005 * place as lat, 116.40 + 0.004 * place as lon from v), cc as (select distinct code, x, y from ({_code(5, "vv")})),
nb as (select code, x + dx as x, y + dy as y from cc cross join (values (-1), (0), (1)) a(dx) cross join (values (-1), (0), (1)) b(dy))
select code as geohash5, array_to_string(list_sort(list(near)), ',') as neighbours from (select code, {_code(5, "nb").split(" as code")[0].removeprefix("select *, ")} as near from nb) group by code""")
def geohash_neighbours(spark, sf_dir):
    lat, lon = 39.90 + 0.01 * (F.col("user_id") % 50) + 0.005 * F.col("place"), 116.40 + 0.004 * F.col("place")
    codes = visits(table(spark, sf_dir, "events")).select(geo.geohash(lat, lon, 5).alias("geohash5")).distinct()
    return codes.select("geohash5", F.array_join(geo.geohash_neighbours(F.col("geohash5"), 5), ",").alias("neighbours"))


# Every order is a pixel of a raster, by its number; suppliers and customers look at windows of it.
_RASTER = """with px as (select o_orderkey // 64 as r, o_orderkey % 64 as c, min(case o_orderstatus when 'F' then 3 when 'O' then 1 else 2 end + 3 * (o_custkey % 3)) as code from orders group by 1, 2),
an as (select c_custkey as id, c_custkey % 90 as r, c_custkey * 7 % 64 as c from customer),
w as (select an.id as id, px.code as code, greatest(abs(px.r - an.r), abs(px.c - an.c)) as far from an join px on px.r between an.r - 2 and an.r + 2 and px.c between an.c - 2 and an.c + 2 where code <> 5),
"""


@query(_RASTER + """n as (select id, code, count(*) filter (far = 0) as n0, count(*) filter (far <= 1) as n1, count(*) as n2 from w group by id, code),
rk as (select *, row_number() over (partition by id order by n0 desc, code) as k0, row_number() over (partition by id order by n1 desc, code) as k1, row_number() over (partition by id order by n2 desc, code) as k2 from n)
select an.id as id, max(code) filter (k0 = 1 and n0 > 0) as point_code, max(code) filter (k1 = 1 and n1 > 0) as mode_3, max(code) filter (k2 = 1) as mode_5 from an left join rk on rk.id = an.id group by an.id""")
def raster_modes(spark, sf_dir):
    o, size = table(spark, sf_dir, "orders"), 16
    code = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 1).otherwise(2) + 3 * (F.col("o_custkey") % 3)
    px = o.groupBy(F.floor(F.col("o_orderkey") / 64).alias("r"), (F.col("o_orderkey") % 64).alias("c")).agg(F.min(code).alias("code"))
    place = ((F.col("r") % size) * size + F.col("c") % size).cast("int")
    tile = px.groupBy(F.floor(F.col("r") / size).alias("tile_row"), F.floor(F.col("c") / size).alias("tile_col")).agg(F.map_from_entries(F.collect_list(F.struct(place, "code"))).alias("m"))
    tiles = tile.select("tile_row", "tile_col", F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("codes"))
    anchors = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 90).alias("row"), (F.col("c_custkey") * 7 % 64).alias("col"))
    return spatial.raster_modes(anchors, tiles, size, (3, 5), 5)


@query("""with p as (select c_nationkey as nation, 39.0 + c_custkey % 997 / 500.0 as lat, 116.0 + c_custkey % 613 / 320.0 as lon from customer)
select a.nation as nation, any_value(n) as points, round(max(2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))), 4) as diameter_m
from p a join p b on a.nation = b.nation join (select nation, count(*) as n from p group by nation) c on c.nation = a.nation group by a.nation""")
def nation_diameters(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), (39.0 + F.col("c_custkey") % 997 / 500.0).alias("lat"), (116.0 + F.col("c_custkey") % 613 / 320.0).alias("lon"))
    return spatial.group_diameters(c, ["nation"]).withColumn("diameter_m", F.round("diameter_m", 4))


@query("""with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as i, count(*) over (partition by o_custkey) as n from orders)
select o_custkey, o_orderkey from r where n <= 5 or list_contains([0, (n - 1) // 4, (n - 1) * 2 // 4, (n - 1) * 3 // 4, n - 1], i)""")
def orders_evenly_spaced(spark, sf_dir):
    return spatial.evenly_spaced(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 5)
