"""Registered queries of routines, forward validation, comparators and relational pieces, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import comparators, evidence, forward, locate, relational, reliability, routines
from ..sources.trajectories import table, visits
from . import home_office
from .audits import _ALL, BASE
from .queries import STAYS, VISITS, _contrib, _events, _features, _top, query


def _semantic(spark, sf_dir) -> home_office.Located:
    return home_office.from_events(spark, sf_dir)


_SEG = STAYS + """,
sg0 as (select *, case when lag(location_id) over (partition by user_id, ldate order by ts, location_id) = location_id then 0 else 1 end as nw from s), sg1 as (select *, sum(nw) over (partition by user_id, ldate order by ts, location_id) as seg from sg0),
sg as (select user_id, ldate, seg, location_id, min(ts) as a, max(ts) + interval 1500 second as b, max(ld) as lft from sg1 group by all),
sq as (select user_id, ldate, string_agg('L' || location_id, '>' order by seg) as motif, count(*) as segments, count(*) - 1 as moves from sg group by user_id, ldate),
mv as (select * from (select user_id, ldate, seg, location_id as o, lead(location_id) over w as de, lead(a) over w as na, b, hour(lft) + minute(lft) / 60.0 + second(lft) / 3600.0 as dh from sg window w as (partition by user_id, ldate order by seg)) where de is not null),
eg0 as (select user_id, o, de, count(*) as moves, count(distinct ldate) as days, count(distinct ldate) filter (isodow(ldate) <= 5) as wd, count(distinct ldate) filter (isodow(ldate) > 5) as we, avg(sin(dh * pi() / 12)) as sn, avg(cos(dh * pi() / 12)) as cs from mv group by user_id, o, de),
eg as (select eg0.*, sqrt(sn * sn + cs * cs) as conc, days / ud as day_share, eg0.moves / sum(eg0.moves) over (partition by eg0.user_id) as move_share, days >= 2 as repeated from eg0 join (select user_id, count(*) as ud from sq group by user_id) using (user_id))
"""


def _routine(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    segments = routines.day_segments(_semantic(spark, sf_dir).semantic)
    sequences, moves = routines.day_sequences(segments), routines.day_moves(segments)
    return sequences, moves, routines.edges(moves, sequences)


@query(_SEG + "select user_id, cast(ldate as varchar) as local_date, motif, segments, moves from sq")
def day_sequences(spark, sf_dir):
    return _routine(spark, sf_dir)[0]


@query(_SEG + "select user_id, cast(ldate as varchar) as local_date, seg::bigint as move, o::bigint as origin, de::bigint as destination, round(dh, 6) as departure_hour, round((epoch_us(na) - epoch_us(b)) / 3.6e9, 6) as gap_h from mv")
def day_moves(spark, sf_dir):
    return _routine(spark, sf_dir)[1]


@query(_SEG + """select user_id, o::bigint as origin, de::bigint as destination, moves, days, wd as week_days, we as weekend_days, round(case when round(conc, 9) > 0 then case when case when atan2(sn, cs) < 0 then atan2(sn, cs) * 12 / pi() + 24 else atan2(sn, cs) * 12 / pi() end < 24 - 5e-10 then case when atan2(sn, cs) < 0 then atan2(sn, cs) * 12 / pi() + 24 else atan2(sn, cs) * 12 / pi() end else 0 end end, 6) as hour, round(conc, 6) as concentration,
  round(day_share, 6) as day_share, round(move_share, 6) as move_share, repeated from eg""")
def routine_edges(spark, sf_dir):
    return _routine(spark, sf_dir)[2].drop("usable_days")


@query(_SEG + """, d as (select user_id, count(*) as usable_days, count(*) filter (moves > 0) as move_days from sq group by user_id), m as (select user_id, max(n) / sum(n) as tm from (select user_id, motif, count(*) as n from sq group by all) group by user_id),
e as (select *, row_number() over (partition by user_id order by days desc, moves desc, round(conc, 9) desc, o, de) as r from eg),
g1 as (select user_id, sum(moves)::bigint as moves, count(*) as edges, count(*) filter (repeated) as rep, max(day_share) filter (r = 1) as tds, max(move_share) filter (r = 1) as tms, sum(-move_share * log2(move_share)) as ent, median(conc) filter (repeated) as rc from e group by user_id)
select user_id, usable_days, move_days, round(tm, 6) as top_motif_share, coalesce(moves, 0) as moves, coalesce(edges, 0) as edges, coalesce(rep, 0) as repeated_edges, round(coalesce(tds, 0), 6) as top_day_share, round(coalesce(tms, 0), 6) as top_move_share,
  round(coalesce(ent, 0), 6) as edge_entropy, round(rc, 6) as repeated_concentration, coalesce(rep, 0) > 0 as has_repeated, tm >= 0.5 as motif_half from d join m using (user_id) left join g1 using (user_id)""")
def routine_users(spark, sf_dir):
    sequences, _, edge = _routine(spark, sf_dir)
    return routines.users(edge, sequences)


@query(_SEG + """, k as (select user_id, ldate, row_number() over (partition by user_id order by ldate) > count(*) over (partition by user_id) // 2 as late from sq),
h1 as (select user_id, count(*) filter (not late) as e, count(*) filter (late) as l from k group by user_id),
g1 as (select user_id, late, o, de, count(distinct ldate) as days, count(*) as n from mv join k using (user_id, ldate) group by all),
t as (select user_id, max(o || '>' || de) filter (not late) as ee, max(o || '>' || de) filter (late) as le from (select * from g1 qualify row_number() over (partition by user_id, late order by days desc, n desc, o, de) = 1) group by user_id)
select user_id, e >= 3 and l >= 3 as eligible, e as early_days, l as late_days, case when e >= 3 and l >= 3 then ee end as early_edge, case when e >= 3 and l >= 3 then le end as late_edge, case when e >= 3 and l >= 3 then coalesce(ee = le, false) end as same_edge from h1 left join t using (user_id)""")
def top_edge_halves(spark, sf_dir):
    sequences, moves, _ = _routine(spark, sf_dir)
    return routines.top_edge_halves(moves, sequences)


@query(_SEG + """select a as least_days, b::double as least_concentration, count(*) filter (days >= a and round(conc, 9) >= b) as edges, count(distinct user_id) filter (days >= a and round(conc, 9) >= b) as users from eg cross join (values (2), (3), (5)) x(a) cross join (values (0.5), (0.7), (0.9)) y(b) group by all""")
def recurrence_grid(spark, sf_dir):
    return routines.recurrence_grid(_routine(spark, sf_dir)[2])


@query(_SEG + """, n as (select user_id, sum(n) as days, max(n) as most from (select user_id, motif, count(*) as n from sq group by all) group by user_id), ab as (select * from n where days >= 6), mo as (select user_id from ab where most / days >= 0.5),
od as (select distinct user_id from eg join ab using (user_id) where repeated)
select coalesce(mo.user_id, od.user_id) as user_id, case when od.user_id is null then 'motif_only' when mo.user_id is null then 'edge_only' else 'both' end as side from mo full join od on mo.user_id = od.user_id""")
def motif_edge_users(spark, sf_dir):
    sequences, _, edge = _routine(spark, sf_dir)
    return routines.motif_and_edge_users(sequences, edge)


@query(_SEG + """, bl as (select user_id, ldate, (row_number() over (partition by user_id order by ldate) - 1) // 6 as block, count(*) over (partition by user_id) as n from sq), wn as (select user_id, ldate, block from bl where (block + 1) * 6 <= n),
c as (select user_id, block, o, de, count(*) as n from mv join wn using (user_id, ldate) group by all), p as (select user_id, block, o, de, n / sum(n) over (partition by user_id, block) as p from c),
ids as (select distinct user_id, block from wn), pr as (select a.user_id, a.block from ids a join ids b on a.user_id = b.user_id and b.block = a.block + 1),
bo as (select pr.user_id, pr.block, o, de, sum(case when p.block = pr.block then p else 0 end) as x, sum(case when p.block = pr.block then 0 else p end) as y from pr join p on p.user_id = pr.user_id and p.block in (pr.block, pr.block + 1) group by all),
ou as (select user_id, block, case when sum(x) > 0 and sum(y) > 0 then round(sum(case when x > 0 then x * log2(2 * x / (x + y)) else 0 end + case when y > 0 then y * log2(2 * y / (x + y)) else 0 end) / 2, 6) end as jsd, case when sum(x) > 0 and sum(y) > 0 then round(sum(abs(x - y)) / 2, 6) end as tv from bo group by user_id, block)
select pr.user_id, pr.block::bigint as block, jsd, tv as total_variation from pr left join ou using (user_id, block)""")
def adjacent_blocks(spark, sf_dir):
    from pyspark.sql import Window

    sequences, moves, _ = _routine(spark, sf_dir)
    w = Window.partitionBy("user_id")
    d = sequences.select("user_id", "local_date").withColumns({"block": F.floor((F.row_number().over(w.orderBy("local_date")) - 1) / 6), "n": F.count("*").over(w)})
    return routines.adjacent_windows(d.where((F.col("block") + 1) * 6 <= F.col("n")).drop("n"), moves, "block")


_SCORED = STAYS + ", c as (" + " union all ".join(
    f"""select t.user_id, '{r.label}' as label, t.location_id, t.share as top_share, case when t.margin < t.share then t.share - t.margin end as runner_up_share, t.dates as support_days, coalesce(od, 0) as opportunity_days, (t.user_id % 11) / 10.0 as stability
  from ({_top(r)}) t left join (select user_id, count(*) filter (o >= 600) as od from (select user_id, d, sum(o) as o from ({_contrib(r)}) group by user_id, d) group by user_id) op using (user_id)"""
    for r in evidence.RULES
) + """),
e as (select *, top_share > 0 and top_share <= 1 and runner_up_share is not null and runner_up_share <= top_share as v1, support_days >= 1 and support_days <= opportunity_days as v2, stability between 0 and 1 as v3 from c),
f as (select *, case when v1 then top_share / (top_share + runner_up_share) end as dominance, case when v2 then support_days / opportunity_days end as coverage, case when v2 then least(support_days / 5.0, 1.0) end as support from e),
sc as (select *, case when v1 and v2 and v3 then cbrt(dominance * coverage * stability) * sqrt(support) end as evidence, case when not v1 then 'missing_or_invalid_runner_up' when not v2 then 'missing_or_invalid_opportunity' when not v3 then 'missing_or_invalid_stability' else 'ok' end as status,
  concat_ws('+', case when not v1 then 'runner_up' end, case when not v2 then 'opportunity' end, case when not v3 then 'stability' end) as blockers from f)
"""


def _scored(spark, sf_dir) -> DataFrame:
    """Top candidates of both labels with their evidence. The stability here is a function of the user's number."""
    x, out = _semantic(spark, sf_dir), None
    for rule in evidence.RULES:
        top = evidence.top_candidate(evidence.window_features(x.semantic, x.locations, rule), rule).join(evidence.opportunities(x.semantic, rule), "user_id", "left").fillna({"opportunity_dates": 0})
        rows = top.select(
            "user_id", F.lit(rule.label).alias("label"), "location_id", F.col("share").alias("top_share"), F.when(F.col("margin") < F.col("share"), F.col("share") - F.col("margin")).alias("runner_up_share"),
            F.col("dates").alias("support_days"), F.col("opportunity_dates").alias("opportunity_days"), (F.col("user_id") % 11 / 10).alias("stability"),
        )
        out = rows if out is None else out.unionByName(rows)
    return forward.score_evidence(out)


@query(_SCORED + "select user_id, label, location_id::bigint as location_id, round(dominance, 6) as dominance, round(coverage, 6) as coverage, round(support, 6) as support, round(evidence, 6) as evidence, status, blockers from sc")
def evidence_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("user_id", "label", "location_id", "dominance", "coverage", "support", "evidence", "status", "blockers")


@query(_SCORED + """select label, status, n, case when n >= 5 then round(me, 6) end as median_evidence, case when n >= 5 then round(mc, 6) end as median_coverage
  from (select label, status, count(*) as n, median(evidence) as me, median(coverage) as mc from sc group by grouping sets ((label, status), (label), ()))""")
def evidence_summary(spark, sf_dir):
    return forward.suppressed_summary(_scored(spark, sf_dir), [["label", "status"], ["label"], []], ["evidence", "coverage"])


_CUT = BASE + """,
dd as (select user_id, cast(ts as date) as d, row_number() over (partition by user_id order by cast(ts as date)) - 1 as k, count(*) over (partition by user_id) as n from (select distinct user_id, cast(ts as date) as ts from s0)),
cu as (select user_id, d::timestamp as cut from dd where n >= 2 and k = least(greatest(1, ceil(n * {f} - 1e-9)), n - 1)),
pa as (select s0.*, case when cut is null then 'none' when ts + interval 1500 second <= cut then 'train' when ts >= cut then 'future' else 'crossing' end as part from s0 left join cu using (user_id))
"""


@query(_CUT.replace("{f}", "0.7") + "select user_id, count(distinct cast(ts as date)) as dates, count(*) filter (part = 'train') as train, count(*) filter (part = 'future') as future, count(*) filter (part = 'crossing') as crossing from pa group by user_id")
def forward_split(spark, sf_dir):
    return forward.split_counts(forward.cut_by_dates(_semantic(spark, sf_dir).semantic))


def _future_sql(f: str, label: str = "HOME") -> str:
    rule = next(r for r in evidence.RULES if r.label == label)
    train = f"(with s as (select * exclude (part) from pa where part = 'train'), loc as (select user_id, location_id, count(*) as stay_count from s group by all) select user_id, location_id from ({_top(rule)}) where share >= {rule.min_share} and margin >= {rule.min_margin})"
    later = f"(with s as (select * exclude (part) from pa where part = 'future') {_contrib(rule).strip()})"
    return f"""em as (select * from {train}), fd as (select user_id, location_id, d from {later} where o >= 600),
fu as (select em.user_id, em.location_id, count(distinct d) as opportunity, count(distinct d) filter (fd.location_id = em.location_id) as same, count(distinct d) filter (fd.location_id <> em.location_id) as other from em left join fd on fd.user_id = em.user_id group by all)"""


def _future(semantic: DataFrame, fraction: float) -> DataFrame:
    parts = forward.cut_by_dates(semantic, fraction)
    train = parts.where("part = 'train'")
    top = evidence.emit(evidence.top_candidate(evidence.window_features(train, locate.summarize_locations(train), evidence.HOME), evidence.HOME), evidence.HOME)
    return forward.future_windows(top.select("user_id", "location_id", "share"), parts.where("part = 'future'"), evidence.HOME)


@query(_CUT.replace("{f}", "0.7") + "," + _future_sql("0.7") + " select user_id, location_id::bigint as location_id, opportunity, same, other, opportunity > 0 as assessable, same > 0 as reappears from fu")
def future_windows(spark, sf_dir):
    return _future(_semantic(spark, sf_dir).semantic, 0.7).drop("share")


@query(BASE + ", " + ", ".join(f"{n} as (select user_id, same > 0 as r from (with" + _CUT.replace("{f}", f)[len(BASE):].lstrip().removeprefix(",") + "," + _future_sql(f) + " select * from fu))" for n, f in (("xa", "0.6"), ("xb", "0.8")))
       + " select count(*) as pairs, count(*) filter (xa.r and xb.r) as both, count(*) filter (xa.r and not xb.r) as early_only, count(*) filter (not xa.r and xb.r) as late_only, count(*) filter (not xa.r and not xb.r) as neither from xa join xb using (user_id)")
def cutoff_discordance(spark, sf_dir):
    semantic = _semantic(spark, sf_dir).semantic  # found and kept once for both cuts
    return forward.discordance(_future(semantic, 0.6), _future(semantic, 0.8), ["user_id"], "reappears")


@query(BASE + """, ds as (select distinct user_id, cast(ts as date) as d from s0), rk as (select *, row_number() over (partition by user_id order by ('0x' || substr(sha256('0.3|7|' || user_id || '|' || d), 1, 8))::bigint / 4294967296.0, d) as r, count(*) over (partition by user_id) as n from ds)
select s0.user_id, count(*) as stays, count(distinct cast(ts as date)) as dates from s0 join rk on rk.user_id = s0.user_id and rk.d = cast(s0.ts as date) where r > ceil(n * 0.3 - 1e-9) group by s0.user_id""")
def masked_dates(spark, sf_dir):
    s = forward.masked_dates(_semantic(spark, sf_dir).semantic, 0.3, 7)
    return s.groupBy("user_id").agg(F.count("*").alias("stays"), F.countDistinct(F.to_date("arrival")).alias("dates"))


@query("""with d as (select o_orderpriority, o_totalprice >= 200000 as big, o_custkey % 97 as score from orders) select a.o_orderpriority, yes, no, case when yes >= 5 and no >= 5 then round(w / (yes * no), 6) end as concordance from
  (select o_orderpriority, count(*) filter (big) as yes, count(*) filter (not big) as no from d group by all) a join
  (select x.o_orderpriority, sum(case when x.score > y.score then 1.0 when x.score = y.score then 0.5 else 0.0 end * x.n * y.n) as w from (select o_orderpriority, score, count(*) as n from d where big group by all) x join (select o_orderpriority, score, count(*) as n from d where not big group by all) y using (o_orderpriority) group by all) b using (o_orderpriority)""")
def order_concordance(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_totalprice") >= 200000).alias("big"), (F.col("o_custkey") % 97).alias("score"))
    return forward.concordance(o, ["o_orderpriority"], "big", "score")


@query(STAYS + """, hr as (select user_id, location_id, unnest(generate_series(date_trunc('hour', la), date_trunc('hour', ld), interval 1 hour)) as hat from s)
select user_id, location_id::bigint as location_id, strftime(hat, '%Y-%m') as year_month, count(*) as observations, count(distinct hour(hat)) as hours, count(distinct cast(hat as date)) as dates from hr group by all""")
def stay_hours(spark, sf_dir):
    x = _semantic(spark, sf_dir)
    h = comparators.stay_hours(x.semantic, x.locations)
    return h.groupBy("user_id", "location_id", F.date_format("at", "yyyy-MM").alias("year_month")).agg(F.count("*").alias("observations"), F.countDistinct(F.hour("at")).alias("hours"), F.countDistinct(F.to_date("at")).alias("dates"))


_NIGHT = """, pc as (select user_id, location_id, max(place) as place from s group by all),
ng as (select user_id, place, min(location_id) as location_id, count(*) filter (hour(la) * 3600 + minute(la) * 60 + second(la) >= 79200 or hour(la) * 3600 + minute(la) * 60 + second(la) <= 25200) as at_night, count(*) as n from s group by user_id, place),
nh as (select *, sum(at_night) over (partition by user_id) as nights from ng), nb as (select *, row_number() over (partition by user_id order by case when nights > 0 then at_night else n end desc, place) as r from nh)"""


@query(STAYS + _NIGHT + " select user_id, location_id::bigint as location_id, nights::bigint as nights, nights = 0 as all_visits from nb where r = 1")
def night_home(spark, sf_dir):
    x = _semantic(spark, sf_dir)
    return comparators.night_home(x.semantic, x.locations)


_TWO = ", ".join(
    f"""w{r.label[0]} as (select user_id, '{r.label}' as label, location_id, coalesce(o, 0) as o from (select tp.*, o, row_number() over (partition by user_id order by coalesce(o, 0) desc, stay_count desc, location_id) as rr
  from tp left join (select user_id, location_id, sum(o) as o from ({_contrib(r)}) group by all) using (user_id, location_id)) where rr = 1)"""
    for r in (comparators.REST, comparators.WORK)
)


@query(STAYS + ", tp as (select * from (select *, row_number() over (partition by user_id order by stay_count desc, location_id) as r, count(*) over (partition by user_id) as n from loc) where r <= 2 and n >= 2), " + _TWO
       + " select user_id, label, location_id::bigint as location_id, round(o / 3600, 6) as dwell_h, min(location_id) over (partition by user_id) = max(location_id) over (partition by user_id) as same_place from (select * from wH union all select * from wO)")
def two_place_candidates(spark, sf_dir):
    x = _semantic(spark, sf_dir)
    return comparators.two_place_candidates(x.semantic, x.locations)


@query(STAYS + _NIGHT + f""", pu as (select distinct c_custkey as user_id from customer where c_custkey % 2 = 0), rec as (select * from (select user_id, label, location_id from ({_top(evidence.HOME)}) where share >= {evidence.HOME.min_share} and margin >= {evidence.HOME.min_margin})),
cc as (select pu.user_id, l.label, rec.location_id as a, nb.location_id as b from pu cross join (values ('HOME'), ('OFFICE')) l(label) left join rec on rec.user_id = pu.user_id and rec.label = l.label left join nb on nb.user_id = pu.user_id and r = 1 and l.label = 'HOME')
select label, case when a is null and b is null then 'both_abstain' when b is null then 'production_only' when a is null then 'comparator_only' when a = b then 'same_place' else 'different_place' end as state, count(*) as users from cc group by all""")
def candidate_comparison(spark, sf_dir):
    x = _semantic(spark, sf_dir)
    rule = evidence.HOME
    home = evidence.emit(evidence.top_candidate(evidence.window_features(x.semantic, x.locations, rule), rule), rule)
    universe = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"))
    c = comparators.compare_candidates(universe, home, comparators.night_home(x.semantic, x.locations).withColumn("label", F.lit("HOME")))
    return c.groupBy("label", "state").agg(F.count("*").alias("users"))


@query(VISITS + """, a as (select user_id, place, 39.90 + 0.01 * (user_id % 50) + 0.005 * place as lat, 116.40 + 0.004 * place as lon from v group by all), e as (select user_id, place from v where event_type in ('purchase', 'signup') group by all),
j as (select a.user_id, a.place, e.place as other, 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(0.005 * (e.place - a.place)) / 2), 2) + cos(radians(a.lat)) * cos(radians(a.lat + 0.005 * (e.place - a.place))) * pow(sin(radians(0.004 * (e.place - a.place)) / 2), 2)))) as d from a left join e on e.user_id = a.user_id)
select user_id, place as location_id, arg_min(other, (round(d, 3), other)) as nearest_id, round(min(d), 3) as distance_m from j group by user_id, place""")
def nearest_places(spark, sf_dir):
    v = visits(_events(spark, sf_dir))
    at = lambda df: df.select("user_id", F.col("place").alias("location_id"), (39.90 + 0.01 * (F.col("user_id") % 50) + 0.005 * F.col("place")).alias("lat"), (116.40 + 0.004 * F.col("place")).alias("lon")).distinct()
    n = comparators.nearest_places(at(v), at(v.where(F.col("event_type").isin("purchase", "signup"))))
    return n.withColumn("distance_m", F.round("distance_m", 3))


@query("select c_nationkey, c_mktsegment, n from (select c_nationkey, c_mktsegment, count(*) as n, row_number() over (partition by c_nationkey order by count(*) desc, c_mktsegment) as r from customer group by c_nationkey, c_mktsegment) where r = 1")
def segment_modes(spark, sf_dir):
    return relational.mode_by(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment")


@query("""with r as (select p_brand, rank() over (partition by p_brand order by p_size) + (count(*) over (partition by p_brand, p_size) - 1) / 2.0 as x, rank() over (partition by p_brand order by p_retailprice) + (count(*) over (partition by p_brand, p_retailprice) - 1) / 2.0 as y from part)
select p_brand, count(*) as n, round(corr(x, y), 6) as rho from r group by p_brand""")
def part_rank_correlation(spark, sf_dir):
    return relational.spearman(table(spark, sf_dir, "part").select("p_brand", "p_size", "p_retailprice"), ["p_brand"], "p_size", "p_retailprice")


@query(STAYS + "".join(f", g{k} as (" + " union all ".join(f"select user_id, label from ({_top(r)}) where share >= {r.min_share * k / 10} and margin >= {r.min_margin}" for r in evidence.RULES) + ")" for k in (10, 7))
       + " select label, count(*) filter (a and b) as retained, count(*) filter (a and b is null) as dropped, count(*) filter (a is null and b) as added, round(count(*) filter (a and b) / count(*), 6) as jaccard from (select *, true as a from g10) full join (select *, true as b from g7) using (user_id, label) group by label")
def gate_set_overlap(spark, sf_dir):
    x = _semantic(spark, sf_dir)
    rows = None
    for rule in evidence.RULES:
        top = evidence.top_candidate(evidence.window_features(x.semantic, x.locations, rule), rule).where(F.col("margin") >= rule.min_margin).select("user_id", "label", "share", F.lit(rule.min_share).alias("least"))
        rows = top if rows is None else rows.unionByName(top)
    return relational.set_overlap(rows.where("share >= least"), rows.where(F.col("share") >= F.col("least") * 7 / 10), ["label"], ["user_id"])


@query("""with f as (select c_custkey, c_acctbal < 0 as debt, c_mktsegment = 'BUILDING' as building, c_nationkey < 10 as low from customer),
p as (select 'debt' as "left", 'building' as "right", count(*) filter (debt and building) as b, count(*) filter (debt or building) as e, count(*) filter (debt) as l, count(*) filter (building) as r from f union all
  select 'debt', 'low', count(*) filter (debt and low), count(*) filter (debt or low), count(*) filter (debt), count(*) filter (low) from f union all select 'building', 'low', count(*) filter (building and low), count(*) filter (building or low), count(*) filter (building), count(*) filter (low) from f)
select "left", "right", b as both, e as either, l as n_left, r as n_right, round(case when e > 0 then b / e end, 6) as jaccard, round(case when l > 0 then b / l end, 6) as left_share, round(case when r > 0 then b / r end, 6) as right_share from p""")
def customer_flag_overlap(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") < 0).alias("debt"), (F.col("c_mktsegment") == "BUILDING").alias("building"), (F.col("c_nationkey") < 10).alias("low"))
    return relational.pairwise_overlap(c, "c_custkey", ["debt", "building", "low"])


@query("""with l as (select user_id, event_type, lag(event_type) over o as b, row_number() over o as i from events window o as (partition by user_id order by ts, event_id)), r as (select *, sum(case when b = event_type then 0 else 1 end) over (partition by user_id order by i) as run from l)
select user_id, sum(n)::bigint as "rows", count(*) - 1 as switches, max(n) as longest_run from (select user_id, run, count(*) as n from r group by all) group by user_id""")
def event_runs(spark, sf_dir):
    return relational.longest_runs(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "event_type")


@query("""select coalesce(c.k, s.k) as nation, customers, suppliers, case when s.k is null then 'left_only' when c.k is null then 'right_only' else 'both' end as side
  from (select c_nationkey as k, count(*) as customers from customer where c_acctbal > 5000 group by all) c full join (select s_nationkey as k, count(*) as suppliers from supplier where s_acctbal > 3000 group by all) s on c.k = s.k""")
def nation_sides(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 3000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return relational.outer_with_side(relational.unique_on(c, ["nation"]), relational.unique_on(s, ["nation"]), ["nation"])


@query("""select l_returnflag, sum(case when l_linestatus = 'O' then 1 else 0 end)::bigint as open_lines, sum(case when l_linestatus = 'F' then 1 else 0 end)::bigint as filled_lines, round(stddev_pop(l_quantity), 6) as sd_quantity, round(stddev_pop(l_discount), 6) as sd_discount from lineitem group by l_returnflag""")
def line_status_pivot(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    counts = li.groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.count(F.lit(1))).fillna(0).withColumnsRenamed({"O": "open_lines", "F": "filled_lines"})
    return counts.join(li.groupBy("l_returnflag").agg(F.stddev_pop("l_quantity").alias("sd_quantity"), F.stddev_pop("l_discount").alias("sd_discount")), "l_returnflag")


@query()
def departure_modes(spark, sf_dir):
    m = routines.departure_modes(_routine(spark, sf_dir)[1], 6)
    return m.withColumn("hours", F.array_join(F.transform("hours", lambda h: F.format_number(h, 2)), " "))
