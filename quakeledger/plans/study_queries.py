"""Queries of ingest, generators, case studies, resampling and streams, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quakeledger.audit import Audit
from quakeledger.catalog import CATALOG_SQL, load, seconds
from quakeledger.functions.scalars import aftershock_radius_km, comparison_level, haversine_km, kernel_match_probability, leading_digit, mechanism_of_rake, merged_time, omori_integral, signed_degrees, wilson_interval
from quakeledger.functions.tails import binomial_lower, binomial_upper
from quakeledger.operators import generators as gen
from quakeledger.operators import studies
from quakeledger.operators.corpus import same_members
from quakeledger.operators import subtests as st
from quakeledger.operators.subtests import a6_external
from quakeledger.plans.audit_queries import bulletin, catalog, faults, flat, references
from quakeledger.plans.audit_queries import _FAULTS, _GATES, _TAIL, DIST, T4, _stats, _votes
from quakeledger.runtime import checkpoint, ensure_checkpoint_dir, fetch_bounded, passing, present, table, written
from quakeledger.sources import files
from quakeledger.streaming.incremental import daily_gate_counts, read_deliveries, run_to_end


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog written as canonical CSV and read again."""
    to = _folder(spark)
    files.write_csv(load(spark, sf_dir), to)
    got = files.read_csv(spark, to)
    return got.select("catalog_id", "record_id", "origin_time", "latitude", "longitude", "depth_km", "magnitude", "seismic_moment_n_m", F.nullif(F.trim("source"), F.lit("")).alias("source"))


def csv_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All deliveries of event_records as a CSV without ids; equal rows are records of their own."""
    to = _folder(spark)
    rows = table(spark, sf_dir, "event_records").select("catalog_id", "origin_time", *(present(c).alias(c) for c in ("latitude", "longitude", "depth_km", "magnitude")))
    rows.withColumn("origin_time", F.date_format("origin_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).write.csv(to, header=True)
    cat = checkpoint(files.read_csv(spark, to).withColumn("t", seconds()))
    a5 = st.a5_duplicates(cat).select("catalog_id", F.col("n_flagged"), F.round("score", 6).alias("a5"))
    return st.p7_timestamps(cat).select("catalog_id", "n_used", "n_repeated", F.round("score", 6).alias("p7")).join(a5, "catalog_id")


def raw_bulletin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """local_bulletin as a messy file would have it: other headers, split times, units and types inside texts."""
    t = table(spark, sf_dir, "local_bulletin").dropDuplicates(["report_id"])
    blank = lambda c: F.coalesce(F.when(~F.isnan(c), F.col(c)).cast("string"), F.lit(""))
    return t.select(
        F.col("network").alias("Agency"), F.col("report_id").cast("string").alias("Event-ID"), F.date_format("origin_time", "yyyy-MM-dd").alias("Date"), F.date_format("origin_time", "HH:mm:ss.SSSSSS").alias("Time"),
        F.concat(F.lit(" '"), blank("latitude"), F.lit("' ")).alias("LAT"), blank("longitude").alias("Long."), F.when(F.isnan("depth_km") | F.col("depth_km").isNull(), "").otherwise(F.concat(F.col("depth_km").cast("string"), F.lit(" km"))).alias("Depth"),
        F.concat_ws(" ", blank("magnitude"), "magnitude_type").alias("Mag"),
    )


def ingest_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messy bulletin brought into canonical columns."""
    got = files.prepare(raw_bulletin(spark, sf_dir), F.col("Agency"))
    return got.select("catalog_id", F.col("event_uid_source").cast("long").alias("report_id"), "origin_time", "latitude", "longitude", "depth_km", "magnitude", "magnitude_type")


def geojson_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: reference events written as feature collections, one a source, and read again."""
    r = references(spark, sf_dir).where("t IS NOT NULL")
    feature = F.struct(F.col("ref_id").cast("string").alias("id"), F.struct(F.col("magnitude").alias("mag"), F.floor(F.round(F.col("t") * 1e6) / 1000).alias("time"), F.col("source_id").alias("net")).alias("properties"), F.struct(F.array("longitude", "latitude").alias("coordinates")).alias("geometry"))
    part = F.pmod(F.xxhash64("ref_id"), F.lit(16))
    to = _folder(spark)
    r.groupBy("source_id", part.alias("part")).agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("value")).select("value").repartition(8).write.text(to)
    got = files.read_geojson_events(spark, to, "reference", multi_line=False)
    ms = F.unix_millis(F.col("origin_time").cast("timestamp"))
    return got.select(F.col("event_uid_source").cast("long").alias("ref_id"), ms.alias("ms"), "latitude", "longitude", "magnitude", F.col("source").alias("source_id"))


def record_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF1-SF13: the row-level functions on every record."""
    c = catalog(spark, sf_dir)
    low, high = wilson_interval(F.pmod("record_id", F.lit(50)), F.lit(50))
    return c.select(
        "catalog_id", "record_id", leading_digit("depth_km").alias("digit"), F.round(aftershock_radius_km(F.least("magnitude", F.lit(9.0))), 4).alias("radius"), comparison_level(F.col("magnitude") - 4.0, 1.0).alias("level"),
        F.round(kernel_match_probability([(F.col("magnitude") - 4.0, 0.5), (F.col("depth_km") - 10.0, 20.0)]), 6).alias("kernel"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"),
        F.round(omori_integral(F.lit(10.0), F.lit(0.1), F.lit(1.1), F.lit(0.0), F.pmod("record_id", F.lit(30)).cast("double") + 1.0), 6).alias("expected"), mechanism_of_rake(F.pmod(F.col("record_id"), F.lit(360)) - 180.0).alias("by_rake"),
        F.round(haversine_km("latitude", "longitude", F.lit(0.0), F.lit(0.0)), 4).alias("km"),
    )


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing depths filled from other records of the same upstream identifier; present ones stay."""
    c = load(spark, sf_dir, "event_uid_source", "depth_km")
    key = F.lower(F.trim("event_uid_source"))
    known = c.where(F.col("depth_km").isNotNull() & key.rlike("[1-9]")).groupBy(key.alias("uid")).agg(F.max("depth_km").alias("found"))
    got = c.where(F.col("depth_km").isNull()).withColumn("uid", key).join(known, "uid")
    return got.select("catalog_id", "record_id", F.col("found").alias("depth_km"))


def top_unmeasured(spark: SparkSession, sf_dir: str, k: int = 300) -> DataFrame:
    """Of each catalog the largest events from M5 without a moment, at most k: what a lookup would ask for.

    The window first works in parts of a catalog, so a hot catalog is cut to k rows a part before it is ranked.
    """
    c = load(spark, sf_dir, "magnitude", "seismic_moment_n_m").where("magnitude >= 5 AND seismic_moment_n_m IS NULL")
    order = (F.desc("magnitude"), "record_id")
    part = F.row_number().over(Window.partitionBy("catalog_id", F.pmod(F.xxhash64("record_id"), F.lit(64))).orderBy(*order))
    cut = c.withColumn("rn", part).where(F.col("rn") <= k)
    return cut.withColumn("rn", F.row_number().over(Window.partitionBy("catalog_id").orderBy(*order))).where(F.col("rn") <= k).select("catalog_id", "record_id", "magnitude", F.col("rn").cast("long").alias("rn"))


def gate_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C12x: how many catalogs each tolerance of the bounds would stop."""
    stats = _stats(spark, sf_dir)
    tol = F.explode(F.array(*(F.lit(x) for x in (0.001, 0.0005, 0.0002, 0.0001, 0.00005, 0.00001))))
    p = F.least(*(binomial_upper(F.col(f"{k}_k"), F.col("n"), F.col("tolerance")) for k in ("p1", "p2", "p3")))
    return stats.withColumn("tolerance", tol).withColumn("p", p).groupBy("tolerance").agg(F.count("*").alias("n_catalogs"), F.count_if(F.col("p") < 0.01 / 3).alias("n_stopped"))


def authenticity_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C13x and C14x: how many networks each matched share would count as contradicted, and how many are near the cut."""
    a6 = a6_external(_votes(spark, sf_dir)).withColumn("n", F.col("n_corroborated") + F.col("n_eligible"))
    theta = F.explode(F.array(*(F.lit(x) for x in (0.60, 0.55, 0.50, 0.45, 0.40, 0.35, 0.30, 0.25, 0.20))))
    rows = a6.withColumn("theta", theta).withColumn("p", binomial_lower("n_corroborated", "n", "theta"))
    return rows.groupBy("theta").agg(F.count_if(F.col("n") >= 20).alias("n_testable"), F.count_if((F.col("n") >= 20) & (F.col("p") < 0.01)).alias("n_contradicted"), F.count_if(F.abs(F.try_divide(F.col("n_corroborated"), F.col("n")) - F.col("theta")) < 0.05).alias("n_near"))


def ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on fabricated catalogs of all ten rungs, audited together."""
    out = None
    for level in range(1, 11):
        got = gen.fabricate(spark, f"rung_{level:02d}", 600, level)
        out = got if out is None else out.unionByName(got)
    return flat(Audit(faults=faults(spark, sf_dir)).verdicts(out.withColumn("t", seconds())))


def _lean(cat: DataFrame) -> DataFrame:
    """The ids, time and magnitude of a catalog, and a hash of its other columns by which rows that differ stay apart."""
    rest = [c for c in cat.columns if c not in ("catalog_id", "record_id", "origin_time", "t", "magnitude")]
    return cat.select("catalog_id", "record_id", seconds().alias("t"), "magnitude", F.xxhash64(*rest, *(F.col(c).isNull() for c in rest)).alias("same"))


def corrupted_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate counts and b-values of all catalogs in six corruptions at three severities, by variant."""
    return _r(studies.marked_b_value_shift(gen.marked_events(_lean(load(spark, sf_dir, repeated=False)))))


def agencies_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reference sources merged, in the order of their names: each is matched one to one with the union so far, which it joins without its duplicates."""
    r = references(spark, sf_dir).where("t IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL AND magnitude IS NOT NULL")
    r = checkpoint(r.select(F.coalesce("source_id", F.lit("")).alias("source"), F.col("ref_id").alias("id"), "t", "latitude", "longitude", "magnitude"))
    names = [x["source"] for x in fetch_bounded(r.select("source").distinct().orderBy("source"), 1_000, "the list of reference sources")]
    out = r.drop("source").limit(0)
    for name in names:
        own = r.where(F.col("source") == name).drop("source")
        out = checkpoint(studies.merged(out, own, studies.one_to_one(out, own)) if name != names[0] else own)
    return out.select("id", F.round("t", 3).alias("t"), "magnitude")


def aftershock_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17x: the forecasts of all catalogs in six corruptions at three severities, about the clean catalogs' shocks."""
    return _r(studies.marked_forecasts(gen.marked_events(_lean(load(spark, sf_dir, *T4, "depth_km", repeated=False)))))


def merge_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C18x: for the two largest reference sources the b-values of each, of their naive and of their deduplicated union, the

    share of duplicates that I4 expects in the naive union against the one-to-one matches over the smaller source, and
    whether both hold the same events (a reference that is compared with itself).
    """
    r = references(spark, sf_dir).where("t IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL AND magnitude IS NOT NULL AND source_id IS NOT NULL")
    r = checkpoint(r.select(F.col("source_id").alias("source"), F.col("ref_id").alias("id"), "t", "latitude", "longitude", "magnitude"))
    first, second = (x["source"] for x in r.groupBy("source").count().orderBy(F.desc("count"), "source").limit(2).collect())
    one, two = (r.where(F.col("source") == x) for x in (first, second))
    matches = checkpoint(studies.one_to_one(one.drop("source"), two.drop("source")))
    tables = {"first": one, "second": two, "naive": one.unionByName(two), "merged": studies.merged(one, two, matches)}
    rows = None
    for name, x in tables.items():
        x = x.select(F.lit(name).alias("catalog_id"), F.col("id").alias("record_id"), "t", "latitude", "longitude", "magnitude", "source")
        rows = x if rows is None else rows.unionByName(x)
    rows = checkpoint(rows)
    b = st.b_values(rows).select("catalog_id", "n", "mc", "b", "shi_bolt")
    i4 = st.i4_dedup(rows).select("catalog_id", (1 - F.col("score")).alias("i4_duplicates"))
    sizes = [x.count() for x in (one, two)]
    matched = F.lit(matches.count() / max(1, min(sizes)))
    same = same_members(one.select("t", "latitude", "longitude", "magnitude").withColumn("k", F.xxhash64("t", "latitude", "longitude", "magnitude")), two.withColumn("k", F.xxhash64("t", "latitude", "longitude", "magnitude")), "k")
    return _r(b.join(i4, "catalog_id", "left").withColumn("matched", matched).withColumn("circular", F.lit(same)))


#: Replicates of R2, and how many rows those audited at a time may be drawn from; one whole replicate is the least.
REPLICATES = 100
RESAMPLED_ROWS = 2_500_000


def uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: the spread of the verdict of every network and catalog over 100 replicates, each held against what it is audited with.

    Networks have the references and faults of audit_referenced, catalogs the faults of audit. The replicates of a table are
    audited in runs, so what the driver, disk and executors hold doesn't go with their number; of a run only its verdicts
    stay.
    """
    near = checkpoint(faults(spark, sf_dir))
    tables = {"local_bulletin": (bulletin(spark, sf_dir), references(spark, sf_dir)), "event_records": (catalog(spark, sf_dir), None)}
    out = None
    for name, (rows, refs) in tables.items():
        rows, audit, verdicts = written(rows), Audit(refs, near), None
        at_once = max(1, RESAMPLED_ROWS // max(1, rows.count()))
        for first in range(1, REPLICATES + 1, at_once):
            folder = _folder(spark)
            with passing(spark):
                got = audit.verdicts(gen.resampled(rows, replicates=min(at_once, REPLICATES + 1 - first), first=first)).select("catalog_id", "trust", "fired", "decision")
                got.write.parquet(folder)
            got = spark.read.parquet(folder)
            verdicts = got if verdicts is None else verdicts.unionByName(got)
        got = written(studies.uncertainty(verdicts).select(F.lit(name).alias("table"), "*"))
        out = got if out is None else out.unionByName(got)
    return _r(out)


def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate counts by day, kept by a stream over the deliveries."""
    schema = table(spark, sf_dir, "event_records").schema
    deliveries = read_deliveries(spark, f"{sf_dir}/event_records.parque[t]", schema)
    return run_to_end(daily_gate_counts(deliveries), ["catalog_id", "day"]).withColumn("day", F.col("day").cast("string"))


def raw_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """six time columns merged and signed degrees split, on texts made from the bulletin."""
    t = table(spark, sf_dir, "local_bulletin").select("report_id", "origin_time", "latitude", "longitude").dropDuplicates(["report_id"])
    text = F.concat(F.abs("latitude").cast("string"), F.when(F.col("latitude") < 0, "° S ").otherwise("° N "), F.abs("longitude").cast("string"), F.when(F.col("longitude") < 0, "° W").otherwise("° E"))
    lat, lon = signed_degrees("place")
    part = lambda f: f("origin_time")
    rows = t.withColumn("place", text)
    when = merged_time(part(F.year), part(F.month), part(F.dayofmonth), part(F.hour), F.minute("origin_time"), F.when(F.col("report_id") % 5 != 0, F.second("origin_time")))
    return rows.where("latitude IS NOT NULL AND NOT isnan(latitude)").select("report_id", when.alias("origin_time"), lat.alias("latitude"), lon.alias("longitude"))


QUERIES = {
    "source_csv_round_trip": csv_round_trip,
    "source_geojson_round_trip": geojson_round_trip,
    "ingest_prepare": ingest_prepare,
    "ingest_raw_forms": raw_forms,
    "record_scalars": record_scalars,
    "enrich_by_identifier": enriched,
    "top_unmeasured": top_unmeasured,
    "source_csv_duplicates": csv_duplicates,
    "fault_points": lambda s, d: faults(s, d).groupBy("zone_id").agg(F.count("*").alias("n_points"), F.round(F.avg("latitude"), 4).alias("latitude")),
    "gate_sweep": gate_sweep,
    "authenticity_sweep": authenticity_sweep,
    "rows_chosen": lambda s, d: gen.chosen(load(s, d, "magnitude"), 0.45, 1).groupBy("catalog_id").agg(F.count("*").alias("n"), F.count_if("chosen").alias("k")),
    "fabrication_ladder": ladder,
    "case_b_value_shift": corrupted_audit,
    "case_aftershock_forecast": lambda s, d: _r(studies.aftershock_forecast(catalog(s, d, *T4))),
    "case_aftershock_battery": aftershock_battery,
    "case_agencies_merged": agencies_merged,
    "case_merge_study": merge_study,
    "uncertainty": uncertainty,
    "stream_daily_gates": stream_daily,
    "row_stats_json": lambda s, d: files.as_json(_stats(s, d)),
}

_CAT = "WITH " + CATALOG_SQL + " "
_OOB = ("coalesce(abs(latitude) > 90, false) OR coalesce(abs(longitude) > 180, false)", "coalesce(NOT (depth_km BETWEEN -5 AND 750), false)", "coalesce(NOT (magnitude BETWEEN -2.5e0 AND 9.5e0), false)")
_W = "3.841458820694124e0"
SQL = {
    "gate_sweep": _CAT + f""", {_GATES}, tol(tolerance) AS (VALUES (0.001e0), (0.0005e0), (0.0002e0), (0.0001e0), (0.00005e0), (0.00001e0)),
      x AS (SELECT *, least({", ".join(_TAIL.format(p="tolerance", k=f"p{i}_k") for i in (1, 2, 3))}) AS p FROM g, tol)
      SELECT tolerance, count(*) AS n_catalogs, count(*) FILTER (p < 0.01e0 / 3) AS n_stopped FROM x GROUP BY 1""",
    "fault_points": f"WITH {_FAULTS} SELECT zone_id, count(*) AS n_points, round(avg(latitude), 4) AS latitude FROM fp GROUP BY zone_id",
    "source_csv_duplicates": f"""WITH cat AS (SELECT catalog_id, epoch_us(origin_time) / 1e6 AS t, {", ".join(f"CASE WHEN isfinite({c}) THEN {c} END AS {c}" for c in ("latitude", "longitude", "magnitude"))} FROM event_records),
      e AS (SELECT row_number() OVER () AS e, * FROM (SELECT catalog_id, t, latitude, longitude, magnitude, count(*) AS copies FROM cat WHERE t IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL AND magnitude IS NOT NULL GROUP BY ALL)),
      near AS (SELECT DISTINCT a.e FROM e a JOIN e b ON a.catalog_id = b.catalog_id AND a.e <> b.e AND abs(a.t - b.t) <= 5 AND abs(a.magnitude - b.magnitude) <= 0.05e0 + 1e-9 WHERE {DIST} <= 2),
      fl AS (SELECT catalog_id, CAST(sum(copies) AS BIGINT) AS n_flagged FROM e WHERE copies > 1 OR e IN (SELECT e FROM near) GROUP BY catalog_id),
      p AS (SELECT catalog_id, count(*) AS n_all, count(t) AS n, count(DISTINCT t) AS d FROM cat GROUP BY 1)
      SELECT catalog_id, n AS n_used, n - d AS n_repeated, round(CASE WHEN n >= 2 THEN d / n END, 6) AS p7, coalesce(n_flagged, 0) AS n_flagged, round(CASE WHEN n_all < 2 THEN 1e0 ELSE 1e0 - coalesce(n_flagged, 0) / n_all END, 6) AS a5 FROM p LEFT JOIN fl USING (catalog_id) WHERE n > 0""",
    "source_csv_round_trip": _CAT + "SELECT DISTINCT catalog_id, record_id, origin_time, latitude, longitude, depth_km, magnitude, seismic_moment_n_m, nullif(trim(source), '') AS source FROM cat",
    "source_geojson_round_trip": """SELECT ref_id, CAST(floor(epoch_us(origin_time) / 1000) AS BIGINT) AS ms, CASE WHEN isfinite(latitude) THEN latitude END AS latitude, CASE WHEN isfinite(longitude) THEN ((longitude + 180 + 720) % 360) - 180 END AS longitude,
      CASE WHEN isfinite(magnitude) THEN magnitude END AS magnitude, source_id FROM reference_events WHERE origin_time IS NOT NULL""",
    "ingest_prepare": """SELECT DISTINCT network AS catalog_id, report_id, origin_time, CASE WHEN isfinite(latitude) THEN latitude END AS latitude, CASE WHEN isfinite(longitude) THEN longitude END AS longitude, CASE WHEN isfinite(depth_km) THEN depth_km END AS depth_km,
      CASE WHEN isfinite(magnitude) THEN magnitude END AS magnitude, CASE WHEN isfinite(magnitude) THEN nullif(trim(magnitude_type), '') END AS magnitude_type FROM local_bulletin""",
    "ingest_raw_forms": """SELECT DISTINCT report_id, make_timestamp(year(origin_time), month(origin_time), day(origin_time), hour(origin_time), minute(origin_time), CASE WHEN report_id % 5 = 0 THEN 0 ELSE second(origin_time) END) AS origin_time, latitude, longitude
      FROM local_bulletin WHERE isfinite(latitude)""",
    "record_scalars": _CAT + f"""SELECT catalog_id, record_id,
      CASE WHEN depth_km <> 0 THEN CAST(floor(CASE WHEN m >= 10 THEN m / 10 WHEN m < 1 THEN m * 10 ELSE m END) AS INT) END AS digit, round(pow(10e0, 0.1238e0 * CASE WHEN magnitude IS NULL OR magnitude > 9 THEN 9e0 ELSE magnitude END + 0.983e0), 4) AS radius,
      CASE WHEN magnitude IS NULL THEN 4 ELSE (abs(magnitude - 4e0) >= 0.25e0)::INT + (abs(magnitude - 4e0) >= 0.6e0)::INT + (abs(magnitude - 4e0) >= 1e0)::INT END AS level,
      round(coalesce(exp(-0.5e0 * pow((magnitude - 4e0) / 0.5e0, 2)), 0.5e0) * coalesce(exp(-0.5e0 * pow((depth_km - 10e0) / 20e0, 2)), 0.5e0), 6) AS kernel,
      round(greatest(0e0, (p + {_W} / 100) / (1 + {_W} / 50) - 1.959963984540054e0 * sqrt(p * (1 - p) / 50 + {_W} / 4 / 2500) / (1 + {_W} / 50)), 6) AS low, round(least(1e0, (p + {_W} / 100) / (1 + {_W} / 50) + 1.959963984540054e0 * sqrt(p * (1 - p) / 50 + {_W} / 4 / 2500) / (1 + {_W} / 50)), 6) AS high,
      round(10e0 / -0.1e0 * (pow(record_id % 30 + 1.1e0, -0.1e0) - pow(0.1e0, -0.1e0)), 6) AS expected,
      CASE WHEN rake BETWEEN 45 AND 135 THEN 'reverse' WHEN rake BETWEEN -135 AND -45 THEN 'normal' ELSE 'strike-slip' END AS by_rake,
      round(2e0 * 6371.0088e0 * CASE WHEN a IS NULL THEN NULL ELSE asin(sqrt(CASE WHEN a > 1 THEN 1 WHEN a < 0 THEN 0 ELSE a END)) END, 4) AS km
      FROM (SELECT *, abs(depth_km) / pow(10e0, floor(log10(CASE WHEN depth_km <> 0 THEN abs(depth_km) END))) AS m, (record_id % 50) / 50e0 AS p, record_id % 360 - 180 AS rake,
        pow(sin(radians(latitude) / 2), 2) + cos(radians(latitude)) * pow(sin(radians(longitude) / 2), 2) AS a FROM cat)""",
    "enrich_by_identifier": _CAT + """, k AS (SELECT lower(trim(event_uid_source)) AS uid, max(depth_km) AS found FROM cat WHERE depth_km IS NOT NULL AND regexp_matches(lower(trim(event_uid_source)), '[1-9]') GROUP BY 1)
      SELECT catalog_id, record_id, found AS depth_km FROM cat JOIN k ON uid = lower(trim(event_uid_source)) WHERE depth_km IS NULL""",
    "top_unmeasured": _CAT + "SELECT catalog_id, record_id, magnitude, row_number() OVER (PARTITION BY catalog_id ORDER BY magnitude DESC, record_id) AS rn FROM cat WHERE magnitude >= 5 AND seismic_moment_n_m IS NULL QUALIFY rn <= 300",
    "rows_chosen": _CAT + "SELECT catalog_id, count(*) AS n, CAST(greatest(1, round_even(count(*) * 0.45e0, 0)) AS BIGINT) AS k FROM (SELECT DISTINCT catalog_id, record_id, magnitude FROM cat) GROUP BY catalog_id",
    "stream_daily_gates": _CAT + f"SELECT catalog_id, CAST(CAST(origin_time AS DATE) AS VARCHAR) AS day, count(*) AS n, count(*) FILTER ({_OOB[0]}) AS p1_k, count(*) FILTER ({_OOB[1]}) AS p2_k, count(*) FILTER ({_OOB[2]}) AS p3_k FROM cat GROUP BY ALL",
}
