"""Queries of the general data-preparation operators (places, timestamps, faulty lines) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeledger.operators.faulty_rows import Field, check_lines, faulty, loaded
from quakeledger.operators.spatial import assign_regions, near_pairs
from quakeledger.operators.timestamps import STATUS, normalise
from quakeledger.runtime import table

NEAR_KM = 0.25


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near pairs of records inside each catalog, and zone memberships."""
    places = table(spark, sf_dir, "event_records").select("catalog_id", "record_id", "latitude", "longitude")
    pairs = near_pairs(places, "catalog_id", "record_id", "latitude", "longitude", NEAR_KM)
    zones = assign_regions(places, "record_id", "latitude", "longitude", table(spark, sf_dir, "zones"), "zone_id", "ring")
    return pairs.select(F.lit("pair").alias("kind"), "left_id", "right_id").unionByName(
        zones.select(F.lit("zone").alias("kind"), F.col("region_id").alias("left_id"), F.col("id").alias("right_id"))
    )


P1_FOUND_SQL = """
WITH place AS (
  SELECT DISTINCT catalog_id, record_id, latitude AS y, longitude AS x FROM event_records
  WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180
), pair AS (
  SELECT DISTINCT 'pair' AS kind, a.record_id AS left_id, b.record_id AS right_id
  FROM place a JOIN place b ON a.catalog_id IS NOT DISTINCT FROM b.catalog_id AND a.record_id < b.record_id AND abs(a.y - b.y) < 0.0023e0
  WHERE 2e0 * 6371e0 * asin(sqrt(least(1e0, pow(sin(radians(b.y - a.y) / 2), 2)
        + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2)))) <= 0.25e0
), vertex AS (
  SELECT zone_id, i, ring[i].lon AS x, ring[i].lat AS y, len(ring) AS n,
         ring[CASE WHEN i = 1 THEN len(ring) ELSE i - 1 END].lon AS px
  FROM zones, LATERAL (SELECT unnest(range(1, len(ring) + 1)) AS i)
), unwrapped AS (
  SELECT zone_id, i, n, y, first_value(x) OVER w + sum(CASE WHEN i = 1 THEN 0 WHEN x - px > 180 THEN x - px - 360
         WHEN x - px < -180 THEN x - px + 360 ELSE x - px END) OVER w AS x
  FROM vertex WINDOW w AS (PARTITION BY zone_id ORDER BY i)
), edge AS (
  SELECT a.zone_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_
  FROM unwrapped a JOIN unwrapped b ON a.zone_id = b.zone_id AND b.i = CASE WHEN a.i = a.n THEN 1 ELSE a.i + 1 END
), box AS (SELECT zone_id, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM edge GROUP BY zone_id),
turned AS (SELECT DISTINCT record_id, y, x + 360 * k AS x FROM place, (SELECT unnest([-1, 0, 1]) AS k)),
inside AS (
  SELECT e.zone_id, p.record_id FROM turned p
  JOIN box b ON p.x BETWEEN b.x0 AND b.x1 AND p.y BETWEEN b.y0 AND b.y1
  JOIN edge e ON e.zone_id = b.zone_id AND (e.ay > p.y) <> (e.by_ > p.y) AND p.x < e.ax + (p.y - e.ay) * (e.bx - e.ax) / (e.by_ - e.ay)
  GROUP BY e.zone_id, p.record_id, p.x, p.y HAVING count(*) % 2 = 1
)
SELECT * FROM pair UNION ALL SELECT DISTINCT 'zone', zone_id, record_id FROM inside
"""


def intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intake rows with their feed's zone and date order; rows of unlisted feeds keep nulls."""
    feeds = table(spark, sf_dir, "feeds").select("feed_id", "zone_name", "date_order").dropDuplicates(["feed_id"])
    rows = table(spark, sf_dir, "intake_times").select("row_id", "feed_id", "origin_time")
    return rows.join(feeds, "feed_id", "left")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instant of each row that names one."""
    got = normalise(intake(spark, sf_dir), ("row_id",), "origin_time", "zone_name", "date_order")
    return got.where("status = 0").groupBy("row_id").agg(F.min("origin_us").alias("origin_us"))


def p4_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each feed have no instant, by reason."""
    got = normalise(intake(spark, sf_dir), ("row_id", "feed_id"), "origin_time", "zone_name", "date_order")
    reason = F.element_at(F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv)), F.col("status"))
    return got.where("status <> 0").groupBy("feed_id", reason.alias("reason")).agg(F.countDistinct("row_id").alias("n_rows"))


LINE_LAYOUT = (
    Field("event_uid_source"),
    Field("origin_time", "time", True),
    Field("latitude", "number", True, -90.0, 90.0),
    Field("longitude", "number", True, -180.0, 180.0),
    Field("depth_km", "number"),
    Field("magnitude", "number", True, -2.5, 9.5),
    Field("magnitude_type"),
    Field("mechanism"),
    Field("source"),
    Field("place"),
)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faulty lines with each reason."""
    return faulty(check_lines(table(spark, sf_dir, "raw_lines"), "raw_text", LINE_LAYOUT, ("line_id",)), "line_id")


def p6_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid lines as typed rows."""
    return loaded(check_lines(table(spark, sf_dir, "raw_lines"), "raw_text", LINE_LAYOUT, ("line_id", "file_name", "line_no")))


_P6_LINES = r"""
WITH line AS (
  SELECT DISTINCT line_id, file_name, line_no, raw_text,
    regexp_full_match(raw_text, '([^",]*|"([^"]|"")*")(,([^",]*|"([^"]|"")*"))*') AS quoted,
    list_transform(regexp_extract_all(raw_text || ',', '([^",]*|"(?:[^"]|"")*"),', 1),
      lambda f: CASE WHEN starts_with(f, '"') THEN replace(substr(f, 2, length(f) - 2), '""', '"') ELSE f END) AS raw_f,
    list_transform(raw_f, lambda f: regexp_replace(f, '^\s+|\s+$', '', 'g')) AS f
  FROM raw_lines
), tested AS (
  SELECT *, raw_text IS NULL OR (quoted AND len(f) <> 10) AS miscounted,
    regexp_full_match(f[2], '[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]{1,9})?Z?')
      AND try_cast(substr(f[2], 1, 10) AS DATE) IS NOT NULL AS time_ok,
    list_transform(f, lambda v: CASE WHEN regexp_full_match(v, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
      THEN coalesce(try_cast(v AS DOUBLE), 'Infinity'::DOUBLE) END) AS num
  FROM line
), reason AS (
  SELECT *, CASE WHEN NOT quoted THEN ['quoting'] WHEN miscounted THEN ['columns'] ELSE list_filter([
    CASE WHEN f[2] <> '' AND NOT time_ok THEN 'origin_time' END,
    CASE WHEN f[3] <> '' AND NOT coalesce(num[3] BETWEEN -90 AND 90, false) THEN 'latitude' END,
    CASE WHEN f[4] <> '' AND NOT coalesce(num[4] BETWEEN -180 AND 180, false) THEN 'longitude' END,
    CASE WHEN f[6] <> '' AND NOT coalesce(num[6] BETWEEN -2.5 AND 9.5, false) THEN 'magnitude' END], lambda r: r IS NOT NULL) END AS reasons
  FROM tested
)
"""
P6_FOUND_SQL = _P6_LINES + "SELECT DISTINCT line_id, unnest(reasons) AS reason FROM reason"
P6_LOADED_SQL = _P6_LINES + r"""
SELECT line_id, file_name, line_no, CASE WHEN f[1] <> '' THEN raw_f[1] END AS event_uid_source,
  CASE WHEN f[2] <> '' THEN try_cast(regexp_replace(replace(replace(f[2], 'Z', ''), 'T', ' '), '(\.[0-9]{6})[0-9]+', '') AS TIMESTAMP) END AS origin_time,
  CASE WHEN f[3] <> '' THEN num[3] END AS latitude, CASE WHEN f[4] <> '' THEN num[4] END AS longitude,
  CASE WHEN f[5] <> '' THEN num[5] END AS depth_km, CASE WHEN f[6] <> '' THEN num[6] END AS magnitude,
  CASE WHEN f[7] <> '' THEN raw_f[7] END AS magnitude_type, CASE WHEN f[8] <> '' THEN raw_f[8] END AS mechanism,
  CASE WHEN f[9] <> '' THEN raw_f[9] END AS source, CASE WHEN f[10] <> '' THEN raw_f[10] END AS place
FROM reason WHERE len(reasons) = 0
"""

QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p4_refused": p4_refused, "p6_found": p6_found, "p6_loaded": p6_loaded}
SQL = {"p1_found": P1_FOUND_SQL, "p6_found": P6_FOUND_SQL, "p6_loaded": P6_LOADED_SQL}
