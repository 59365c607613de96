"""Points near other points, and points inside polygonal regions.

near_pairs      every pair of points of one group within a radius, by a latitude-aware cell join.
triangulate     polygon rings to triangles by ear clipping.
assign_regions  region membership through a bounding-volume hierarchy over the triangles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeledger.runtime import checkpoint

EARTH_RADIUS_KM = 6371.0
#: Triangles held in one broadcast hierarchy (about 25 MB); more are processed block by block.
BLOCK_TRIANGLES = 200_000
LEAF_TRIANGLES = 4
#: Points of one cell above which the cell's join is split into salted parts.
HOT_CELL = 4_000
#: Hot cells that may be broadcast (12 bytes each).
HOT_LISTED = 100_000


def distance_km(lat1, lon1, lat2, lon2, radius_km: float = EARTH_RADIUS_KM) -> Column:
    """Great-circle distance by the haversine formula, as one codegen expression."""
    lat1, lon1, lat2, lon2 = (F.col(c) if isinstance(c, str) else c for c in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    a = F.when(a > 1.0, 1.0).when(a < 0.0, 0.0).otherwise(a)  # rounding, and latitudes beyond a pole; null stays null
    return F.lit(2.0 * radius_km) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def valid_place(lat="latitude", lon="longitude") -> Column:
    """Both coordinates present and within +-90 and +-180 (NaN compares greater and is refused)."""
    return F.col(lat).between(-90.0, 90.0) & F.col(lon).between(-180.0, 180.0)


def near_pairs(
    points: DataFrame, group: str | None, key: str, lat: str, lon: str, radius_km: float, hot_cell: int = HOT_CELL
) -> DataFrame:
    """Pairs (left_id < right_id) of points of one group at most radius_km apart, each pair once.

    The sphere is cut into rows four radii high, and each row into columns at least as wide, so that a point's
    neighbourhood touches 2.25 cells on average. Every point stands in its own cell on the left and in all cells its
    circle touches on the right: each pair meets in exactly one cell, also across the antimeridian and at the poles.
    Cells with more than ``hot_cell`` points are found first, by one pre-aggregated count; they are split: the left side
    is dealt into salts and the right one repeated. Up to HOT_LISTED such cells are broadcast, more join by shuffle.

    Nulls, NaN and out-of-range places take no part. Rows delivered several times count once (per key and place).
    An empty input gives an empty result. Points of a null group form a group of their own.
    """
    cell_deg = float(np.degrees(4 * radius_km / EARTH_RADIUS_KM))
    reach = float(np.degrees(radius_km / EARTH_RADIUS_KM)) * (1 + 1e-9) + 1e-12
    grp = F.xxhash64(F.coalesce(F.col(group).cast("string"), F.lit("\0"))) if group else F.lit(0).cast("long")
    raw = points.where(valid_place(lat, lon) & F.col(key).isNotNull()).select(
        F.col(key).alias("id"), F.col(lat).cast("double").alias("y"), F.col(lon).cast("double").alias("x"), grp.alias("g")
    )
    base = raw.dropDuplicates()

    def columns(row: Column) -> Column:
        """Number of cells in a row: by the cosine at the row's edge that is nearer to a pole."""
        edge = F.greatest(F.abs(row * cell_deg - 90.0), F.abs((row + 1) * cell_deg - 90.0))
        return F.greatest(F.lit(1), F.floor(F.cos(F.radians(F.least(F.lit(90.0), edge))) * (360.0 / cell_deg)).cast("int"))

    row = F.floor((F.col("y") + 90.0) / cell_deg).cast("int")
    cell = lambda g, r, c: F.xxhash64(g, r, c)

    def in_own_cell(df: DataFrame) -> DataFrame:
        column = F.pmod(F.floor((F.col("x") + 180.0) * F.col("n") / 360.0).cast("int"), F.col("n"))
        return df.withColumn("r", row).withColumn("n", columns(F.col("r"))).select("id", "y", "x", "g", cell(F.col("g"), F.col("r"), column).alias("cell"))

    hot = in_own_cell(raw).groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > hot_cell).select(
        "cell", F.ceil(F.col("n") / hot_cell).cast("int").alias("parts")
    )
    listed = hot.limit(HOT_LISTED + 1).collect()
    left = in_own_cell(base)
    widest = F.when(
        F.abs(F.col("y")) + reach >= 90.0, F.lit(180.0)
    ).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(reach))) / F.cos(F.radians(F.col("y"))))) ) + 1e-9)
    right = (
        base.withColumn("w", widest)
        .withColumn("r", F.explode(F.sequence(F.floor((F.col("y") - reach + 90.0) / cell_deg).cast("int"), F.floor((F.col("y") + reach + 90.0) / cell_deg).cast("int"))))
        .withColumn("n", columns(F.col("r")))
        .withColumn("a", F.floor((F.col("x") - F.col("w") + 180.0) * F.col("n") / 360.0).cast("int"))
        .withColumn("b", F.floor((F.col("x") + F.col("w") + 180.0) * F.col("n") / 360.0).cast("int"))
        .withColumn("b", F.least(F.col("b"), F.col("a") + F.col("n") - 1))
        .withColumn("c", F.explode(F.sequence(F.col("a"), F.col("b"))))
        .select("id", "y", "x", "g", cell(F.col("g"), F.col("r"), F.pmod(F.col("c"), F.col("n"))).alias("cell"))
    )
    right = right.select(F.col("id").alias("id2"), F.col("y").alias("y2"), F.col("x").alias("x2"), F.col("g").alias("g2"), "cell")
    on = ["cell"]
    if listed:
        if len(listed) <= HOT_LISTED:
            hot = F.broadcast(points.sparkSession.createDataFrame(listed, "cell long, parts int"))
        parts = F.coalesce("parts", F.lit(1))
        left = left.join(hot, "cell", "left").withColumn("salt", F.pmod(F.xxhash64("id", F.lit(7)), parts).cast("int")).drop("parts")
        right = right.join(hot, "cell", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        on = ["cell", "salt"]
    near = (
        left.join(right, on)
        .where((F.col("id") < F.col("id2")) & (F.col("g") == F.col("g2")) & (F.abs(F.col("y") - F.col("y2")) <= reach))
        .where(distance_km("y", "x", "y2", "x2") <= radius_km)
    )
    return near.select(F.col("id").alias("left_id"), F.col("id2").alias("right_id")).dropDuplicates()


# --- polygons ---------------------------------------------------------------------------------------------------------


def unwrap_ring(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A ring with longitudes made continuous (steps over 180 degrees cross the antimeridian), without repeats.

    A ring that runs once around a pole is closed over that pole (the one on its side of the equator).
    """
    ok = np.isfinite(lon) & np.isfinite(lat)
    lon, lat = lon[ok], lat[ok]
    if len(lon) < 3:
        return lon[:0], lat[:0]
    step = np.diff(np.append(lon, lon[0]))
    step = np.where(step > 180, step - 360, np.where(step < -180, step + 360, step))
    x = lon[0] + np.concatenate([[0.0], np.cumsum(step[:-1])])
    y = lat
    around = step.sum()
    if abs(around) > 180:
        pole = 90.0 if y.mean() >= 0 else -90.0
        x, y = np.append(x, [x[0] + around, x[0] + around, x[0]]), np.append(y, [y[0], pole, pole])
    # Whole turns are taken off with the vertices kept bit for bit where they need none.
    keep = [i for i in range(len(x)) if (x[i], y[i]) != (x[i - 1], y[i - 1])]
    x, y = x[keep], y[keep]
    return x - 360.0 * np.floor((x.min() + 180.0) / 360.0), y


def _turn(ax, ay, bx, by, cx, cy):
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def ear_clip(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]] | None:
    """Triangles (vertex numbers) of a simple ring; None where the ring crosses itself and has no ears left."""
    order = list(range(len(x)))
    if sum(_turn(0, 0, x[i - 1], y[i - 1], x[i], y[i]) for i in order) < 0:
        order.reverse()
    out: list[tuple[int, int, int]] = []
    while len(order) > 3:
        for k in range(len(order)):
            a, b, c = order[k - 1], order[k], order[(k + 1) % len(order)]
            area = _turn(x[a], y[a], x[b], y[b], x[c], y[c])
            if area < 0:
                continue
            if area > 0:
                others = [i for i in order if i not in (a, b, c)]
                px, py = x[others], y[others]
                inside = (
                    (_turn(x[a], y[a], x[b], y[b], px, py) >= 0)
                    & (_turn(x[b], y[b], x[c], y[c], px, py) >= 0)
                    & (_turn(x[c], y[c], x[a], y[a], px, py) >= 0)
                )
                if inside.any():
                    continue
                out.append((a, b, c))
            order.pop(k)  # an ear, or a vertex on a straight edge
            break
        else:
            return None
    if _turn(*(v for i in order for v in (x[i], y[i]))) > 0:
        out.append((order[0], order[1], order[2]))
    whole = abs(sum(_turn(0, 0, x[i - 1], y[i - 1], x[i], y[i]) for i in range(len(x))))
    cut = sum(_turn(*(v for i in t for v in (x[i], y[i]))) for t in out)
    return out if abs(cut - whole) <= 1e-9 * max(1.0, whole) else None


TRIANGLE_SCHEMA = "region_id long, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double, ring_x array<double>, ring_y array<double>"


def triangulate(regions: DataFrame, key: str, ring: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Each region's ring as triangles in longitudes near [-180, 180]; what crosses the antimeridian stands on both sides.

    A ring that crosses itself has no triangulation: its bounding box is given as two triangles with the ring beside
    them, and membership is decided by the even-odd rule after the box test. Rings with fewer than three distinct
    finite vertices, null rings and null keys enclose nothing and give no triangle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for region, xs, ys in zip(batch["k"], batch["xs"], batch["ys"]):
                x, y = unwrap_ring(np.array(xs, float), np.array(ys, float))
                if len(x) < 3:
                    continue
                cut = ear_clip(x, y)
                for turn in (0.0, 360.0):
                    if x.max() - turn < -180.0 or (turn and x.max() <= 180.0):
                        continue
                    u = x - turn
                    if cut is None:
                        a, b, c, d = u.min(), y.min(), u.max(), y.max()
                        rows += [(region, a, b, c, b, c, d, u.tolist(), y.tolist()), (region, a, b, c, d, a, d, u.tolist(), y.tolist())]
                    else:
                        rows += [(region, *(v for i in t for v in (u[i], y[i])), None, None) for t in cut]
            yield pd.DataFrame(rows, columns=["region_id", "x0", "y0", "x1", "y1", "x2", "y2", "ring_x", "ring_y"])

    rings = regions.where(F.col(key).isNotNull() & F.col(ring).isNotNull()).select(
        F.col(key).cast("long").alias("k"), F.col(f"{ring}.{lon}").alias("xs"), F.col(f"{ring}.{lat}").alias("ys")
    )
    return rings.mapInPandas(run, TRIANGLE_SCHEMA)


class TriangleTree:
    """A bounding-volume hierarchy over triangles, built by median splits and walked for many points at once."""

    def __init__(self, tri: pd.DataFrame):
        c = tri[["x0", "y0", "x1", "y1", "x2", "y2"]].to_numpy(float).reshape(-1, 3, 2)
        self.corners, self.region = c, tri["region_id"].to_numpy(np.int64)
        self.rings = {i: (np.array(a, float), np.array(b, float)) for i, (a, b) in enumerate(zip(tri["ring_x"], tri["ring_y"])) if a is not None}
        low, high, mid = c.min(1), c.max(1), c.mean(1)
        order = np.arange(len(c))
        boxes, first, count, kids = [], [], [], []

        def build(part: np.ndarray, start: int) -> int:
            me = len(boxes)
            a, b = low[part].min(0), high[part].max(0)
            boxes.append((*a, *b))
            first.append(start)
            count.append(len(part) if len(part) <= LEAF_TRIANGLES else 0)
            kids.append((-1, -1))
            if len(part) > LEAF_TRIANGLES:
                axis = int(np.argmax(b - a))
                part = part[np.argsort(mid[part, axis], kind="stable")]
                half = len(part) // 2
                one = build(part[:half], start)
                kids[me] = (one, build(part[half:], start + half))
            else:
                order[start : start + len(part)] = part
            return me

        if len(c):
            build(np.arange(len(c)), 0)
        self.order, self.boxes = order, np.array(boxes).reshape(-1, 4)
        self.first, self.count, self.kids = np.array(first, int), np.array(count, int), np.array(kids, int).reshape(-1, 2)

    def candidates(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, triangle) numbers whose leaf boxes hold the point."""
        if not len(self.boxes):
            return np.zeros(0, int), np.zeros(0, int)
        p, node = np.arange(len(x)), np.zeros(len(x), int)
        points, triangles = [], []
        while len(p):
            box = self.boxes[node]
            hit = (x[p] >= box[:, 0]) & (y[p] >= box[:, 1]) & (x[p] <= box[:, 2]) & (y[p] <= box[:, 3])
            p, node = p[hit], node[hit]
            leaf = self.count[node] > 0
            n = self.count[node[leaf]]
            if len(n):
                points.append(np.repeat(p[leaf], n))
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                triangles.append(self.order[np.repeat(self.first[node[leaf]], n) + within])
            p, node = np.repeat(p[~leaf], 2), self.kids[node[~leaf]].reshape(-1)
        return (np.concatenate(points), np.concatenate(triangles)) if points else (np.zeros(0, int), np.zeros(0, int))

    @staticmethod
    def _side(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """On which side of edge a-b; the edge is always read from its lesser end, so neighbours agree bit for bit."""
        swap = (a[:, 0] > b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1]))
        u, v = np.where(swap[:, None], b, a), np.where(swap[:, None], a, b)
        return np.where(swap, -1.0, 1.0) * _turn(u[:, 0], u[:, 1], v[:, 0], v[:, 1], x, y)

    def regions_of(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point number, region) with exact tests; triangles are closed, so a shared edge can give a region twice."""
        p, t = self.candidates(x, y)
        c, px, py = self.corners[t], x[p], y[p]
        s = [self._side(c[:, i], c[:, (i + 1) % 3], px, py) for i in range(3)]
        inside = (np.minimum.reduce(s) >= 0) | (np.maximum.reduce(s) <= 0)
        for k, ring in self.rings.items():
            here = np.nonzero(inside & (t == k))[0]
            inside[here] = even_odd(*ring, px[here], py[here])
        return p[inside], self.region[t[inside]]


def even_odd(rx: np.ndarray, ry: np.ndarray, x: np.ndarray, y: np.ndarray, most: int = 4_000_000) -> np.ndarray:
    """Whether a ray from each point crosses the ring an odd number of times; at most ``most`` crossings are tried at once."""
    x, y = np.atleast_1d(x), np.atleast_1d(y)
    bx, by = np.roll(rx, -1), np.roll(ry, -1)
    out = np.zeros(len(x), bool)
    for part in np.array_split(np.arange(len(x)), max(1, len(x) * len(rx) // most)):
        px, py = x[part, None], y[part, None]
        over = (ry > py) != (by > py)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = rx + (py - ry) * (bx - rx) / (by - ry)
        out[part] = (over & (px < at)).sum(axis=1) % 2 == 1
    return out


def assign_regions(
    points: DataFrame, key: str, lat: str, lon: str, regions: DataFrame, region_key: str, ring: str, block_triangles: int = BLOCK_TRIANGLES
) -> DataFrame:
    """(region_id, id) for each point inside a region, each once.

    The triangles are counted first. Up to ``block_triangles`` form one hierarchy, which is broadcast (its size is
    bounded by that parameter); more are dealt by the rank of their centres' longitude into blocks of that size, each of
    which is matched with the points in its span of longitudes, so nothing is dropped and no broadcast exceeds the bound. Points never shuffle
    before the match; only matches do, to count shared edges, duplicate deliveries and both sides of the antimeridian
    once. Invalid places and null keys are no matches; empty tables give an empty result.
    """
    spark = points.sparkSession
    tri = checkpoint(triangulate(regions, region_key, ring))  # ears are clipped once
    n = tri.count()
    places = points.where(valid_place(lat, lon) & F.col(key).isNotNull()).select(
        F.col(key).alias("id"), F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y")
    )
    blocks = [(tri, places)]
    if n > block_triangles:
        from quakeledger.operators.interval import ranked  # which itself needs distances

        corners = ("x0", "x1", "x2")
        order = ["c", "region_id", "x0", "y0", "x1", "y1"]
        dealt = ranked(tri.withColumn("c", F.col("x0") + F.col("x1") + F.col("x2")).withColumn("all", F.lit(0)), "all", order)
        dealt = checkpoint(dealt.withColumn("block", F.floor((F.col("rn") - 1) / block_triangles)).drop("all", "c", "rn", "n"))
        spans = dealt.groupBy("block").agg(F.min(F.least(*corners)).alias("a"), F.max(F.greatest(*corners)).alias("b")).orderBy("block").collect()  # n / block_triangles rows
        blocks = [(dealt.where(F.col("block") == r["block"]).drop("block"), places.where(F.col("x").between(r["a"], r["b"]))) for r in spans]
    id_type = dict(places.dtypes)["id"]
    found = []
    for block, near in blocks:
        tree = spark.sparkContext.broadcast(TriangleTree(block.toPandas()))

        def run(batches: Iterator[pd.DataFrame], tree=tree) -> Iterator[pd.DataFrame]:
            for b in batches:
                p, region = tree.value.regions_of(b["x"].to_numpy(float), b["y"].to_numpy(float))
                yield pd.DataFrame({"region_id": region, "id": b["id"].to_numpy()[p]}).drop_duplicates()

        found.append(near.mapInPandas(run, f"region_id long, id {id_type}"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.dropDuplicates()
