import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kittiwake.operators.proximity import VantageTree, Voronoi, great_circle, in_ring, locate, locate_classes, ring_ball, unit

POINT = "id long, geopoint struct<_1:double,_2:double>, kind string, cell int"
ZONE = "zone_id long, ring array<struct<_1:double,_2:double>>, lat string"


@given(st.lists(st.tuples(st.floats(-90, 90), st.floats(-180, 180)), min_size=1, max_size=120), st.floats(1, 2e7))
@settings(deadline=None, max_examples=60)
def test_tree_finds_all_within(points, radius):
    p = unit(*np.array(points).T)
    found = {(int(a), int(b)) for q, i in VantageTree(p, leaf=4).within(p, radius) for a, b in zip(q, i)}
    d = great_circle(p[:, None], p[None])
    assert found == {tuple(map(int, x)) for x in zip(*np.nonzero(d <= radius))}


def test_replication_keeps_every_near_pair():
    rng = np.random.default_rng(1)
    p = unit(rng.normal(10, 0.2, 900), rng.normal(179.95, 0.2, 900))
    v, reach = Voronoi(p[:25]), 4000.0
    rows, cells, home = v.cells(p, np.full(len(p), reach))
    where = {}
    for r, c in zip(rows, cells):
        where.setdefault(int(r), set()).add(int(c))
    own = {int(r): int(c) for r, c in zip(rows[home], cells[home])}
    assert len(own) == len(p) and all(own[k] == int(great_circle(p[k], p[:25]).argmin()) for k in own)
    for a, b in zip(*np.nonzero(great_circle(p[:, None], p[None]) <= reach)):
        assert own[int(b)] in where[int(a)]


def rows(spark):
    rng = random.Random(3)
    data = []
    for k in range(400):
        base = rng.choice([(10.0, 179.9999), (-89.9999, 20.0), (45.0, 7.0)])
        data.append((k, (base[0] + rng.uniform(-4e-4, 4e-4), base[1] + rng.uniform(-4e-4, 4e-4) * (1 if base[0] > -80 else 1e5))))
    data = [(i, (max(-90.0, a), o if o <= 180 else o - 360)) for i, (a, o) in data]
    data += [(1000 + k, (45.0, 7.0)) for k in range(12)] + data[:5]
    bad = [(2000, None), (2001, (None, 1.0)), (2002, (math.nan, 1.0)), (2003, (0.0, 0.0)), (2004, (91.0, 1.0)), (2005, (1.0, math.inf)), (None, (45.0, 7.0))]
    return data, spark.createDataFrame([(i, g, "near", 1) for i, g in data + bad], POINT)


def brute(data, radius):
    data = sorted(set(data))
    p = unit(*np.array([g for _, g in data]).T)
    d = great_circle(p[:, None], p[None])
    ids = [i for i, _ in data]
    return {("near", min(ids[a], ids[b]), max(ids[a], ids[b])) for a, b in zip(*np.nonzero(d <= radius)) if ids[a] != ids[b]}


def test_near_pairs_against_brute_force(spark):
    data, points = rows(spark)
    want = brute(data, 30.0)
    for options in ({}, {"cell_target": 20}, {"cell_target": 60, "cell_limit": 25}, {"cell_limit": 7}):
        got = [tuple(r) for r in locate(points, **options).collect()]
        assert len(got) == len(set(got)) and set(got) == want, options


def test_classes_stand_for_all_pairs(spark):
    data, points = rows(spark)
    got = [tuple(r) for r in locate_classes(points, cell_target=60, cell_limit=25).collect()]
    assert len(got) == len(set(got)) and sum(k == "same" for k, _, _ in got) == 11
    members = {}
    for kind, a, b in got:
        if kind == "same":
            members.setdefault(a, [a]).append(b)
    classes = [members.get(i, [i]) for i in {i for i, _ in data} - {b for k, _, b in got if k == "same"}]
    by = {c[0]: c for c in classes}
    pairs = {("near", min(x, y), max(x, y)) for k, a, b in got if k == "near" for x in by[a] for y in by[b]}
    pairs |= {("near", x, y) for c in classes for x in c for y in c if x < y}
    assert pairs == brute(data, 30.0)
    # an id at several places is no error, and its pairs come once
    twice = spark.createDataFrame([(1, (5.0, 5.0), "", 0), (1, (5.0, 5.00001), "", 0), (2, (5.0, 5.0), "", 0)], POINT)
    assert [tuple(r) for r in locate(twice).collect()] == [("near", 1, 2)]


def test_zones(spark):
    square = [(10.0 - 3e-4, 180.0 - 2e-4), (10.0 - 3e-4, 180.0 + 2e-4), (10.0 + 3e-4, 180.0 + 2e-4), (10.0 + 3e-4, 180.0 - 2e-4)]
    star = [(45.0 - 3e-4, 7.0 - 3e-4), (45.0, 7.0), (45.0 - 3e-4, 7.0 + 3e-4), (45.0 + 3e-4, 7.0 + 3e-4), (45.0 + 3e-4, 7.0 - 3e-4), (45.0 - 3e-4, 7.0 - 3e-4)]
    zones = spark.createDataFrame([(1, square, "a"), (2, star, "b"), (3, None, "c"), (4, square[:2], "d"), (None, star, "e"), (2, star, "b")], ZONE)
    data, points = rows(spark)
    ids, at = [i for i, _ in data], np.array([g for _, g in data])
    want = {("in", z, ids[k]) for z, ring in ((1, square), (2, star)) for k in np.nonzero(in_ring(at[:, 0], at[:, 1], np.array(ring)))[0]}
    for options in ({}, {"cell_target": 30, "cell_limit": 9}):
        assert {tuple(r) for r in locate(points, zones, radius_m=None, **options).collect()} == want
    assert len(want) > 30


def test_ball_holds_the_ring():
    rng = np.random.default_rng(5)
    for _ in range(50):
        ring = np.stack([rng.uniform(-85, 85, 6), rng.uniform(-170, 170, 6)], axis=1) * rng.choice([1, 0.01])
        lat, lon, reach = ring_ball(ring)
        edge = np.concatenate([np.linspace(a, b, 50) for a, b in zip(ring, np.roll(ring, -1, 0))])
        assert great_circle(unit(edge[:, 0], edge[:, 1]), unit(lat, lon)).max() <= reach


def test_empty(spark):
    assert locate(spark.createDataFrame([], POINT), spark.createDataFrame([], ZONE)).count() == 0
    one = spark.createDataFrame([(1, (5.0, 5.0), "x", 0)], POINT)
    assert locate(one, spark.createDataFrame([], ZONE)).count() == 0
