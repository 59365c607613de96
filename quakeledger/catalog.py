"""The canonical catalog: a fixed schema, missing values as NULL, one row for each record of each catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakeledger.runtime import present, table

NUMBERS = (
    "latitude", "longitude", "depth_km", "magnitude", "seismic_moment_n_m", "tsunami_flag", "mmi", "station_distance_km",
    "rupture_length_km", "rupture_area_km2", "rupture_displacement_m", "azimuthal_gap_deg",
)
TEXTS = ("magnitude_type", "mechanism", "source", "event_uid_source", "revision_status")
REQUIRED = ("origin_time", "latitude", "longitude", "depth_km", "magnitude")
SCHEMA = T.StructType(
    [T.StructField("catalog_id", T.StringType()), T.StructField("record_id", T.LongType()), T.StructField("origin_time", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in NUMBERS]
    + [T.StructField(c, T.StringType()) for c in TEXTS]
)


def canonical(rows: DataFrame, repeated: bool = True) -> DataFrame:
    """rows in the canonical columns; NaN and infinities become NULL, absent optional columns are all NULL.

    A record delivered again (same record_id and values, whatever its other columns say) counts once, unless repeated is
    False: then no record is delivered twice and nothing is looked for. A missing required column is an error.
    """
    if missing := [c for c in ("catalog_id", "record_id", *REQUIRED) if c not in rows.columns]:
        raise ValueError(f"required columns are missing: {missing}")
    out = [F.col("catalog_id").cast("string").alias("catalog_id"), F.col("record_id").cast("long").alias("record_id"), F.col("origin_time").cast("timestamp_ntz").alias("origin_time")]
    out += [(present(F.col(c).cast("double")) if c in rows.columns else F.lit(None).cast("double")).alias(c) for c in NUMBERS]
    out += [(F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in TEXTS]
    got = rows.select(*out)
    return got.dropDuplicates() if repeated else got


def seconds(c: str = "origin_time"):
    """A timestamp without zone, read as UTC, in seconds since 1970."""
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


def load(spark: SparkSession, sf_dir: str, *columns: str, repeated: bool = True) -> DataFrame:
    """The catalog of event_records, with the named columns (all by default); only these reach the scan.

    repeated: as in canonical(); with False equal rows stay, for callers that look for them themselves.
    """
    got = table(spark, sf_dir, "event_records")
    wanted = columns or tuple(f.name for f in SCHEMA if f.name not in ("catalog_id", "record_id"))
    out = [F.col("catalog_id"), F.col("record_id")]
    out += [present(c).alias(c) if c in NUMBERS else F.col(c) for c in wanted]
    return got.select(*out).dropDuplicates() if repeated else got.select(*out)


#: The same catalog in SQL, for the comparison queries.
CATALOG_SQL = (
    "cat AS (SELECT DISTINCT catalog_id, record_id, origin_time, epoch_us(origin_time) / 1e6 AS t, "
    + ", ".join(f"CASE WHEN isfinite({c}) THEN {c} END AS {c}" for c in NUMBERS)
    + ", " + ", ".join(TEXTS) + " FROM event_records)"
)
