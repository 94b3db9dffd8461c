"""Evidence of secondary places against plain Python, with uneven stays, days without weekends, ties and users who do not count."""

import datetime as dt
import math
import random

import numpy as np

from wanderlake.operators import anchors


def _stays():
    r, out = random.Random(4), []
    for user in range(6):
        for day in range(28 if user < 4 else 5):
            date = dt.datetime(2024, 1, 1) + dt.timedelta(days=day)  # a Monday
            at = date + dt.timedelta(hours=r.randrange(3))
            for _ in range(r.randrange(1, 6)):
                place = r.choice([0, 0, 1, 1, 2, 3]) if user != 5 else r.choice([0, 1])
                size = 0 if user == 1 and place == 2 else r.choice([600, 1800, 5400])
                out.append((user, place, at, at + dt.timedelta(seconds=size), float(size)))
                at += dt.timedelta(seconds=size + 60 * r.randrange(1, 200))
    return [s for s in out if s[2].date() == s[3].date()]


def _plain(stays, cohort):
    rows = {}
    for user, home, second in cohort:
        own = sorted([s for s in stays if s[0] == user], key=lambda s: (s[2], s[3], s[1]))
        seen = {s[2].date() for s in own}
        work, rest = (sum(test(d.weekday()) for d in seen) for test in (lambda w: w < 5, lambda w: w >= 5))
        pairs = {}
        for d in seen:
            places = [s[1] for s in own if s[2].date() == d]
            for a, b in zip(places, places[1:], strict=False):
                if a != b and home in (a, b):
                    pairs.setdefault(b if a == home else a, set()).add(d)
        for place in {s[1] for s in own} - {home}:
            mine = [s for s in own if s[1] == place]
            days = {s[2].date() for s in mine}
            if len(days) < 3 or len(mine) < 2:
                continue
            w = sum(d.weekday() < 5 for d in days)
            angle = [2 * math.pi * (s[2].hour + s[2].minute / 60) / 24 for s in mine]
            q = np.quantile([s[4] / 3600 for s in mine], [0.25, 0.5, 0.75])
            rows[user, place] = (
                place == second, len(days), w / work - (len(days) - w) / rest if work and rest else None, len(pairs.get(place, ())) / len(days),
                math.hypot(np.mean(np.sin(angle)), np.mean(np.cos(angle))), 0.0 if q[1] <= 0 else 1 / (1 + (q[2] - q[0]) / q[1]),
            )
    return rows


def _same(a, b):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) < 1e-9)


def test_metrics_and_ranks(spark):
    stays, cohort = _stays(), [(0, 0, 1), (1, 0, 2), (2, 1, 0), (3, 0, 9), (4, 0, 1), (5, 0, 1)]
    s = spark.createDataFrame(stays, "user_id long, location_id int, local_arrival timestamp_ntz, local_departure timestamp_ntz, duration_s double").repartition(4)
    c = spark.createDataFrame(cohort, "user_id long, home_id int, secondary_id int")
    metrics = anchors.anchor_metrics(s, c).cache()
    want = _plain(stays, cohort)
    got = {(r.user_id, r.location_id): tuple(r)[2:] for r in metrics.collect()}
    assert got.keys() == want.keys() and any(v[2] is None for v in want.values()) and any(v[5] == 0 for v in want.values())
    for k, v in want.items():
        assert v[:2] == got[k][:2] and all(_same(a, b) for a, b in zip(v[2:], got[k][2:], strict=True)), k
    ranks = anchors.rank_within_user(metrics).cache()
    rows = {(r.user_id, r.metric): r for r in ranks.collect()}
    # Of user 3 the secondary place was never seen, user 5 has no other place.
    assert {u for u, _ in rows} == {u for u, _, _ in cohort if u not in (3, 5) and (u, dict((a, b) for a, _, b in cohort)[u]) in want and sum(x == u for x, _ in want) > 1}
    for (user, metric), r in rows.items():
        k = 2 + anchors.EVIDENCE.index(metric)
        own = next(v[k] for (u, _), v in got.items() if u == user and v[0])
        peers = [v[k] for (u, _), v in got.items() if u == user and not v[0] and v[k] is not None]
        everything = [*peers, own]
        if own is None or not peers:
            assert not r.valid and not r.top1 and not r.beats and r.percentile is None and r.peer_median is None
            continue
        middle = float(np.median(peers))
        assert r.valid and _same(r.percentile, np.mean([v <= own for v in everything])) and _same(r.peer_median, middle) and _same(r.difference, own - middle)
        assert r.top1 == (own >= max(everything) - 1e-12) and r.beats == (own > middle)
    compared = {r.metric: r for r in anchors.compare_metrics(ranks).collect()}
    for m, r in compared.items():
        valid = [x for (_, n), x in rows.items() if n == m and x.valid]
        assert r.users == len(valid) and r.top1_users == sum(x.top1 for x in valid) and _same(r.median_percentile, float(np.median([x.percentile for x in valid])) if valid else None)
    assert sum(r.users for r in anchors.convergence(ranks).collect()) == len({u for u, _ in rows})
    assert anchors.rank_within_user(anchors.anchor_metrics(s.limit(0), c)).count() == 0
