import math
import random

import numpy as np

from quakeledger.operators.spatial import TriangleTree, assign_regions, ear_clip, even_odd, near_pairs, triangulate, unwrap_ring

SCHEMA = "g string, id long, lat double, lon double, extra string"


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1, h)))


def brute(rows, radius):
    ok = [r for r in {r[:4] for r in rows} if r[1] is not None and r[2] is not None and r[3] is not None and abs(r[2]) <= 90 and abs(r[3]) <= 180]
    return {(min(a[1], b[1]), max(a[1], b[1])) for a in ok for b in ok if a[1] != b[1] and a[0] == b[0] and km(a[2:4], b[2:4]) <= radius}


def test_near_pairs_equals_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(700):
        lat, lon = rng.choice([(10, 20), (89.99, 0), (-89.99, 120), (0, 180), (60, -180), (45, 7)])
        lat, lon = lat + rng.gauss(0, 0.01), lon + rng.gauss(0, 0.02)
        if rng.random() < 0.3 and abs(lat) > 89:
            lon = rng.uniform(-180, 180)
        lon = (lon + 180) % 360 - 180
        rows.append((rng.choice("ab"), i, min(90.0, max(-90.0, lat)), lon, "x"))
    rows += [("a", 1000, None, 1.0, ""), ("a", 1001, float("nan"), 1.0, ""), ("a", 1002, 91.0, 1.0, ""), ("a", None, 10.0, 20.0, ""), rows[0], rows[1], (None, 2000, 1.0, 1.0, ""), (None, 2001, 1.0, 1.0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    for hot in (4_000, 10):
        got = [tuple(r) for r in near_pairs(df, "g", "id", "lat", "lon", 0.8, hot_cell=hot).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, 0.8)


def test_near_pairs_empty(spark):
    assert near_pairs(spark.createDataFrame([], SCHEMA), "g", "id", "lat", "lon", 1.0).count() == 0


def test_ear_clip_covers_concave_ring():
    x, y = np.array([0, 4, 4, 2, 0.0]), np.array([0, 0, 4, 1, 4.0])
    assert len(ear_clip(x, y)) == 3
    assert ear_clip(np.array([0, 1, 0, 1.0]), np.array([0, 1, 1, 0.0])) is None  # crosses itself


def test_unwrap_turns_back_a_ring_across_the_antimeridian():
    x, _ = unwrap_ring(np.array([179.0, -179.0, -179.0, 179.0]), np.array([0, 0, 1, 1.0]))
    assert x.max() - x.min() == 2


REGIONS = "id long, ring array<struct<lon double, lat double>>"


def test_regions_equal_even_odd_rule(spark):
    rng = random.Random(3)
    rings = [(1, [(179.0, -1.0), (-178.0, -1.0), (-178.5, 1.5), (-179.5, 0.0), (178.0, 1.0)]), (2, [(-10.0, -5.0), (0.0, 5.0), (-10.0, 5.0), (0.0, -5.0)]), (3, [(0.0, 0.0), (1.0, 1.0)]), (4, [(5.0, 5.0), (9.0, 5.0), (9.0, 9.0), (7.0, 6.0), (5.0, 9.0), (5.0, 9.0)])]
    points = [(i, rng.uniform(-6, 10), rng.choice([rng.uniform(-12, 10), rng.uniform(177, 180), rng.uniform(-180, -177)])) for i in range(3000)] + [(9000, None, 1.0), (9001, 95.0, 1.0)]
    df = spark.createDataFrame([(*p, "x") for p in points + points[:50]], "id long, latitude double, longitude double, region_id string")
    zones = spark.createDataFrame(rings + [(None, rings[0][1]), (5, None)], REGIONS)
    want = set()
    for z, ring in rings:
        x, y = unwrap_ring(np.array([p[0] for p in ring]), np.array([p[1] for p in ring]))
        want |= {(z, i) for i, la, lo in points if la is not None and len(x) > 2 and any(even_odd(x, y, lo + t, la) for t in (-360, 0, 360))}
    for block in (200_000, 3):
        got = [tuple(r) for r in assign_regions(df, "id", "latitude", "longitude", zones, "id", "ring", block_triangles=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert assign_regions(df.limit(0), "id", "latitude", "longitude", zones, "id", "ring").count() == 0
    assert assign_regions(df, "id", "latitude", "longitude", zones.limit(0), "id", "ring").count() == 0


def test_shared_edges_leave_no_gap(spark):
    ring = spark.createDataFrame([(1, [(0.0, 0.0), (0.31, -0.77), (1.0, 0.0), (0.7, 1.0), (0.2, 0.9)])], REGIONS)
    tree = TriangleTree(triangulate(ring, "id", "ring").toPandas())
    f = np.linspace(0.001, 0.999, 4001)  # along a diagonal, where two triangles meet
    inner, _ = tree.regions_of(f * 1.0, f * 0.0)
    assert set(inner) == set(range(len(f)))
