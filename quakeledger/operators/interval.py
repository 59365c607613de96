"""Joins that equality alone doesn't give: by interval, by nearest point, by rank; and bounded samples."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quakeledger.functions.scalars import AUDIT_RADIUS_KM, haversine_km
from quakeledger.operators.skew import split_join
from quakeledger.runtime import checkpoint


def interval_join(
    left: DataFrame, right: DataFrame, keys: list[str], at: str, tolerance: float, right_at: str, left_id: str, lat: tuple[str, str] | None = None, km: float = 0.0
) -> DataFrame:
    """Pairs of equal keys whose clocks (seconds) differ by at most ``tolerance``, as an equi-join on time buckets.

    With ``lat`` (left and right column) also latitudes no farther apart than ``km`` allows, by latitude bands in the key;
    the caller adds the exact distance. Buckets are four tolerances wide; the right side stands in all that its reach
    touches, so a pair meets exactly once. Null
    clocks, latitudes and keys join nothing. Hot buckets are split.
    """
    def place(df: DataFrame, c: str, reach: float, out: str, everywhere: bool) -> DataFrame:
        """The bucket of a value; or all buckets that its reach touches, 1.5 on average."""
        width = 4.0 * reach
        at = F.floor(F.col(c) / width)
        return df.withColumn(out, F.explode(F.sequence(F.floor((F.col(c) - reach) / width), F.floor((F.col(c) + reach) / width))) if everywhere else at)

    on = [*keys, "__bucket"]
    left, right = place(left, at, tolerance, "__bucket", False), place(right, right_at, tolerance, "__bucket", True)
    if lat:
        band = math.degrees(km / AUDIT_RADIUS_KM) * (1 + 1e-9)
        left, right = place(left, lat[0], band, "__band", False), place(right, lat[1], band, "__band", True)
        on.append("__band")
    got = split_join(left, right, on, left_id).where(F.abs(F.col(at) - F.col(right_at)) <= tolerance)
    return got.drop(*on[len(keys) :])


def ranked(df: DataFrame, key: str, order: list[str], out: str = "rn") -> DataFrame:
    """df with the row's 1-based rank within its key by the order columns, and n, the key's rows.

    Rows are first spread by range over (key, order), so a key with a third of all rows is cut into many ranges; ranks
    are a range's prefix count plus the rank inside. The order should end with a unique column.
    """
    spread = checkpoint(df.repartitionByRange(key, *order).withColumn("__range", F.spark_partition_id()))
    counts = spread.groupBy(key, "__range").agg(F.count("*").alias("__c"))
    by_key = Window.partitionBy(key)
    before = F.sum("__c").over(by_key.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(key, "__range", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__c").over(by_key).alias("n"))
    inside = F.row_number().over(Window.partitionBy(key, "__range").orderBy(*order))
    return spread.withColumn("__in", inside).join(counts, [key, "__range"]).withColumn(out, F.col("__in") + F.col("__before")).drop("__in", "__before", "__range")


def hash_sample(df: DataFrame, key: str, identity: list[str], k: int, seed: int = 42, parts: int = 64) -> DataFrame:
    """At most k rows of each key, those of lowest seeded hash of the identity columns: a sample that order can't change.

    Done in two steps, so that a hot key is first cut to k rows in each of ``parts`` parts. Rows with one hash are
    ordered by the identity columns.
    """
    h = df.withColumn("__h", F.xxhash64(*identity, F.lit(seed)))
    part = Window.partitionBy(key, "__part").orderBy("__h", *identity)
    cut = h.withColumn("__part", F.pmod("__h", F.lit(parts))).withColumn("__r", F.row_number().over(part)).where(F.col("__r") <= k)
    whole = Window.partitionBy(key).orderBy("__h", *identity)
    return cut.withColumn("__r", F.row_number().over(whole)).where(F.col("__r") <= k).drop("__h", "__part", "__r")


def positive_gaps(df: DataFrame, key: str, at: str, bucket_seconds: float = 30 * 86_400.0) -> DataFrame:
    """(key, gap): the positive differences between consecutive clocks of each key.

    Equal clocks give no gap, so only distinct ones are ordered, inside buckets of time; a bucket's first clock follows the
    last one of the key's bucket before, which a window over the few buckets gives.
    """
    t = df.where(F.col(at).isNotNull()).select(key, F.col(at).alias("t")).distinct().withColumn("b", F.floor(F.col("t") / bucket_seconds))
    inner = t.withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy(key, "b").orderBy("t"))).where("gap IS NOT NULL").select(key, "gap")
    ends = t.groupBy(key, "b").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    outer = ends.withColumn("gap", F.col("low") - F.lag("high").over(Window.partitionBy(key).orderBy("b"))).where("gap IS NOT NULL").select(key, "gap")
    return inner.unionByName(outer)


#: Reference points that may be broadcast (16 bytes each).
MOST_POINTS = 1_000_000


def nearest_km(
    points: DataFrame, references: DataFrame, lat: str = "latitude", lon: str = "longitude", cell_deg: float = 1.0, most_ring: int = 25, beyond_km: float = 5_000.0,
    most_points: int = MOST_POINTS,
) -> DataFrame:
    """points with ``nearest_km``, the distance to the nearest reference (latitude, longitude) by an expanding ring of cells.

    Cells that hold points meet cells that hold references within ``most_ring`` rings (longitudes wrap); of a cell's
    rings the nearest with references and the one after are searched. Points with no reference that near get
    ``beyond_km``; points without a place get null. An empty reference table gives ``beyond_km`` everywhere.

    References are few beside points: up to ``most_points`` are broadcast and points go through one narrow pass, searched
    cell by cell. More are joined by cells, with the same result; cell pairs are bounded by the grid.
    """
    refs = references.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(F.col("latitude").alias("ry"), F.col("longitude").alias("rx"))
    held = refs.limit(most_points + 1).toPandas()
    if len(held) > most_points:
        return _nearest_by_join(points, refs, lat, lon, cell_deg, most_ring, beyond_km)
    if "nearest_km" in points.columns:
        raise ValueError("points have a column nearest_km already")
    known = points.sparkSession.sparkContext.broadcast((held["ry"].to_numpy(), held["rx"].to_numpy()))
    wide = int(round(360 / cell_deg))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ry, rx = known.value
        cells, start = np.unique(np.floor(ry / cell_deg).astype(np.int64) * wide + np.floor(rx / cell_deg).astype(np.int64) % wide, return_inverse=True)
        order = np.argsort(start, kind="stable")
        bound = np.concatenate([[0], np.cumsum(np.bincount(start, minlength=len(cells)))])
        ry, rx = np.radians(ry[order]), np.radians(rx[order])
        gy, gx = cells // wide, cells % wide
        near: dict[int, np.ndarray] = {}

        def candidates(cell: int) -> np.ndarray:
            if cell not in near:
                if len(near) > 4_096:
                    near.clear()
                dx = np.abs(gx - cell % wide)
                ring = np.maximum(np.abs(gy - cell // wide), np.minimum(dx, wide - dx))
                first = ring.min(initial=most_ring + 1)
                hit = np.nonzero(ring <= min(first + 1, most_ring))[0] if first <= most_ring else np.zeros(0, int)
                near[cell] = np.concatenate([np.zeros(0, int), *(np.arange(bound[k], bound[k + 1]) for k in hit)])
            return near[cell]

        for batch in batches:
            y, x = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in (lat, lon))
            located = np.nonzero(~np.isnan(y) & ~np.isnan(x))[0]
            out = np.full(len(y), np.nan)
            out[located] = beyond_km
            mine = np.floor(y[located] / cell_deg).astype(np.int64) * wide + np.floor(x[located] / cell_deg).astype(np.int64) % wide
            by = np.argsort(mine, kind="stable")
            names, first = np.unique(mine[by], return_index=True)
            for cell, rows in zip(names, np.split(located[by], first[1:])):
                to = candidates(int(cell))
                if not len(to):
                    continue
                for part in np.array_split(rows, max(1, len(rows) * len(to) // 4_000_000)):
                    py, px = np.radians(y[part])[:, None], np.radians(x[part])[:, None]
                    h = np.sin((ry[to] - py) / 2) ** 2 + np.cos(py) * np.cos(ry[to]) * np.sin((rx[to] - px) / 2) ** 2
                    out[part] = 2 * AUDIT_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(1.0, h.min(axis=1))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, from_pandas=True)], [*batch.schema.names, "nearest_km"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema) + ", nearest_km double"
    return points.mapInArrow(run, schema)


def _nearest_by_join(points: DataFrame, refs: DataFrame, lat: str, lon: str, cell_deg: float, most_ring: int, beyond_km: float) -> DataFrame:
    """nearest_km for any number of references, by joins of cells."""
    wide = int(round(360 / cell_deg))
    cell = lambda y, x: (F.floor(F.col(y) / cell_deg), F.pmod(F.floor(F.col(x) / cell_deg), F.lit(wide)))
    (ry0, rx0), (cy, cx) = cell("ry", "rx"), cell(lat, lon)
    refs = refs.withColumn("ry0", ry0).withColumn("rx0", rx0)
    rows = points.withColumn("__cy", cy).withColumn("__cx", cx).withColumn("__i", F.monotonically_increasing_id())
    rows = checkpoint(rows)
    cells = rows.where("__cy IS NOT NULL AND __cx IS NOT NULL").select(F.col("__cy").alias("cy"), F.col("__cx").alias("cx")).distinct()
    held = refs.select("ry0", "rx0").distinct()
    # Cell pairs by blocks of most_ring cells: a cell's reach touches its block and the eight beside it.
    down = lambda c: F.floor(F.col(c) / most_ring)
    across = lambda c: F.floor(F.col(c) / most_ring)
    blocks = -(-wide // most_ring)
    beside = F.array_distinct(F.transform(F.array(*(F.lit(k) for k in range(-2, 3))), lambda k: F.pmod(across("cx") + k, F.lit(blocks))))
    near = (
        cells.withColumn("down", F.explode(F.sequence(down("cy") - 1, down("cy") + 1))).withColumn("across", F.explode(beside))
        .join(held.withColumn("down", down("ry0")).withColumn("across", across("rx0")), ["down", "across"])
        .withColumn("dx", F.abs(F.col("cx") - F.col("rx0")))
        .withColumn("ring", F.greatest(F.abs(F.col("cy") - F.col("ry0")), F.least("dx", F.lit(wide) - F.col("dx")))).where(F.col("ring") <= most_ring)
    )
    first = F.min("ring").over(Window.partitionBy("cy", "cx"))
    near = near.withColumn("first", first).where(F.col("ring") <= F.col("first") + 1).select("cy", "cx", "ry0", "rx0").distinct()
    search = near.join(refs, ["ry0", "rx0"]).select(F.col("cy").alias("__cy"), F.col("cx").alias("__cx"), "ry", "rx")
    best = split_join(rows.select("__i", "__cy", "__cx", F.col(lat).alias("py"), F.col(lon).alias("px")), search, ["__cy", "__cx"], "__i")
    best = best.groupBy("__i").agg(F.min(haversine_km("py", "px", "ry", "rx")).alias("nearest_km"))
    out = rows.join(best, "__i", "left").drop("__i", "__cy", "__cx")
    located = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    return out.withColumn("nearest_km", F.when(located, F.coalesce("nearest_km", F.lit(beyond_km))))


def exact_median(df: DataFrame, keys: list[str], value: str, width: float = 0.125) -> DataFrame:
    """(keys, median) of the non-null values of each key, the mean of the two middle ones where their number is even.

    Values are counted by distinct value and by buckets of ``width``; the counts of a key's buckets, few beside its rows,
    tell which one or two hold the middle, and only these are ordered. Nothing is approximated and no key is gathered.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    counts = checkpoint(counts.withColumn("b", F.floor(F.col("v") / width)))
    sums = counts.groupBy(*keys, "b").agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("b"))
    sums = sums.select(*keys, "b", (upto - F.col("c")).alias("before"), upto.alias("upto"), F.sum("c").over(Window.partitionBy(*keys)).alias("n"))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1  # ranks from 1
    middle = sums.where(((F.col("before") < low) & (low <= F.col("upto"))) | ((F.col("before") < high) & (high <= F.col("upto"))))
    held = counts.join(middle, [*keys, "b"])
    end = F.col("before") + F.sum("c").over(Window.partitionBy(*keys, "b").orderBy("v"))
    held = held.withColumn("end", end).withColumn("start", F.col("end") - F.col("c"))
    has = lambda r: F.max(F.when((F.col("start") < r) & (r <= F.col("end")), F.col("v")))
    return held.groupBy(*keys).agg(((has(low) + has(high)) / 2).alias("median"))


def densify(lines: DataFrame, key: str, at: str, most_km: float = 10.0) -> DataFrame:
    """(key, latitude, longitude): a polyline's vertices (ordered by ``at``) and points between, no farther apart than most_km."""
    nxt = lambda c: F.lead(c).over(Window.partitionBy(key).orderBy(at))
    step = lines.withColumn("y2", nxt("latitude")).withColumn("x2", nxt("longitude"))
    # The short way round across the antimeridian.
    dx = F.pmod(F.col("x2") - F.col("longitude") + 180.0, F.lit(360.0)) - 180.0
    n = F.greatest(F.lit(1), F.ceil(haversine_km("latitude", "longitude", "y2", "x2") / most_km)).cast("int")
    parts = F.when(F.col("y2").isNotNull(), n).otherwise(1)
    out = step.withColumn("dx", dx).withColumn("parts", parts).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    f = F.col("i") / F.col("parts")
    lon = F.col("longitude") + F.coalesce(F.col("dx"), F.lit(0.0)) * f
    return out.select(key, (F.col("latitude") + F.coalesce(F.col("y2") - F.col("latitude"), F.lit(0.0)) * f).alias("latitude"), (F.pmod(lon + 180.0, F.lit(360.0)) - 180.0).alias("longitude"))


def long_form(df: DataFrame, test: str, score: Column, applicable: Column, n_used: Column) -> DataFrame:
    """One row for each catalog in the form all sub-tests share; the score of a test that doesn't apply is null."""
    return df.select("catalog_id", F.lit(test).alias("test"), F.when(applicable, score).alias("score"), F.coalesce(applicable, F.lit(False)).alias("applicable"), n_used.cast("long").alias("n_used"))
