"""Clusterings, frozen locations and inventories against plain versions."""

import itertools
import random

import numpy as np
import pytest

from wanderlake.operators import alignment
from wanderlake.operators.stays import distances_m


def clusters(spark, labels):
    return spark.createDataFrame([(1, i, c) for i, c in enumerate(labels)], "user_id long, event_id long, location_id long")


def related(spark, a, b):
    return {(r.left_id, r.right_id): (r.shared, r.relation, r.assigned) for r in alignment.assigned(alignment.contingency(clusters(spark, a), clusters(spark, b), ["event_id"])).collect()}


def test_permuted_labels_align_and_changes_are_told(spark):
    assert related(spark, [0, 0, 1, 2, 2], [7, 7, 5, 9, 9]) == {(0, 7): (2, "same", True), (1, 5): (1, "same", True), (2, 9): (2, "same", True)}
    assert related(spark, [0, 0, 0, 1], [0, 0, 2, 1]) == {(0, 0): (2, "split", True), (0, 2): (1, "split", False), (1, 1): (1, "same", True)}
    assert related(spark, [0, 0, 2, 1], [0, 0, 0, 1]) == {(0, 0): (2, "merge", True), (2, 0): (1, "merge", False), (1, 1): (1, "same", True)}
    assert {r for _, r, _ in related(spark, [0, 0, 1, 1], [0, 1, 1, 0]).values()} == {"mixed"}


def test_assignment_is_one_to_one(spark):
    r = random.Random(1)
    got = related(spark, [r.randrange(12) for _ in range(300)], [r.randrange(9) for _ in range(300)])
    chosen = [k for k, v in got.items() if v[2]]
    assert len({a for a, _ in chosen}) == len({b for _, b in chosen}) == len(chosen) == 9
    order = sorted(got, key=lambda k: (-got[k][0], k))
    left, right, want = set(), set(), []
    for a, b in order:
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            want.append((a, b))
    assert sorted(chosen) == sorted(want)


def test_signatures_do_not_depend_on_order_or_label(spark):
    a = clusters(spark, [0, 0, 1, 2, 2])
    same = alignment.membership_parity(a, clusters(spark, [4, 4, 0, 3, 3]).repartition(5), ["event_id"]).collect()[0]
    assert (same.in_both, same.only_left, same.only_right, same.exact) == (3, 0, 0, True)
    moved = alignment.membership_parity(a, clusters(spark, [0, 1, 1, 2, 2]), ["event_id"]).collect()[0]
    assert (moved.in_both, moved.only_left, moved.only_right, moved.exact) == (1, 2, 2, False)


@pytest.mark.parametrize("lat", [0.0, 39.9, -65.0])
def test_later_stays_fit_frozen_locations(spark, lat):
    r = random.Random(2)
    spot = lambda: (lat + r.uniform(-0.01, 0.01), 100 + r.uniform(-0.02, 0.02))
    frozen = [(u, k % 9, *spot()) for u in (1, 2) for k in range(14)]
    later = [(u, i, *spot()) for u in (1, 2, 3) for i in range(80)]
    got = {(x.user_id, x.i): (x.location_id, x.match) for x in alignment.align_to_frozen(
        spark.createDataFrame(later, "user_id long, i long, lat double, lon double"), spark.createDataFrame(frozen, "user_id long, location_id long, lat double, lon double"), ["i"], 600.0).collect()}
    kinds = set()
    for u, i, y, x in later:
        fits = [k for k in range(9) if (own := [m for m in frozen if m[0] == u and m[1] == k]) and all(distances_m(y, x, np.array([m[2]]), np.array([m[3]]))[0] <= 600 for m in own)]
        want = (fits[0], "matched") if len(fits) == 1 else (-2, "ambiguous") if fits else (-1, "not_matched")
        assert got[u, i] == want
        kinds.add(want[1])
    assert len(got) == 240 and len(kinds) == 3


def inventory(r, n):
    t, out = 0, []
    for i in range(n):
        t += r.choice([0, 0, 1, 5, 20])
        s = t
        t += r.choice([1, 3, 10, 30, 60])
        out.append((i, s, t))
    return out


def test_matching_has_the_greatest_overlap(spark):
    r = random.Random(3)
    rows = {side: [(u, i + 100 * u, s, e) for u in range(40) for i, s, e in inventory(r, r.randrange(1, 8))] for side in "lr"}
    frame = lambda x: spark.createDataFrame(x, "user_id long, id long, s int, e int").selectExpr("user_id", "id", "timestamp_ntz'2024-01-01 23:00:00' + make_dt_interval(0, 0, s) as start_time", "timestamp_ntz'2024-01-01 23:00:00' + make_dt_interval(0, 0, e) as end_time")
    got = alignment.match_inventories(frame(rows["l"]), frame(rows["r"])).collect()
    for u in range(40):
        own = {side: [(i, s, e) for w, i, s, e in rows[side] if w == u] for side in "lr"}
        small, large = sorted(own.values(), key=len)
        shared = lambda a, b: max(0, min(a[2], b[2]) - max(a[1], b[1])) * 60
        most = max(sum(shared(a, b) for a, b in zip(small, p, strict=True)) for p in itertools.permutations([*large], len(small)))
        mine = [x for x in got if x.user_id == u]
        assert sum(x.overlap_s for x in mine) == most and all(x.overlap_s > 0 for x in mine)
        assert len({x.left_id for x in mine}) == len({x.right_id for x in mine}) == len(mine)


def test_no_intervals(spark):
    none = spark.createDataFrame([], "user_id long, id long, start_time timestamp_ntz, end_time timestamp_ntz, lat double, lon double")
    assert alignment.inventory_summary(alignment.inventory_details(none, none)).count() == 0
