"""Best representative of each duplicate group: queries on event_records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeledger.llm.survivor import FieldPolicy, compared_uid, field_survivors, record_survivors
from quakeledger.runtime import present, table

UNKNOWN_TRUST = 1_000_000


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their compared uid, status rank and the trust of their source's agency."""
    name = lambda c: F.lower(F.trim(F.col(c)))
    trust = table(spark, sf_dir, "agencies").groupBy(name("agency_code").alias("__agency")).agg(F.min("trust").alias("trust"))
    status = name("revision_status")
    rank = F.when(status == "final", 3).when(status == "reviewed", 2).when(status.isin("preliminary", "prelim"), 1).otherwise(0)
    return (
        table(spark, sf_dir, "event_records")
        .select(
            compared_uid("event_uid_source").alias("event_uid"), "record_id", "ingested_at", name("source").alias("__agency"), rank.alias("status_rank"),
            present("magnitude").alias("magnitude"), "magnitude_type", present("seismic_moment_n_m").alias("seismic_moment_n_m"),
        )
        .where(F.col("event_uid").isNotNull())
        .join(trust, "__agency", "left")
        .withColumn("trust_rank", -F.coalesce("trust", F.lit(UNKNOWN_TRUST)))
    )


def _policies(carry: bool) -> tuple[FieldPolicy, ...]:
    typed = (F.coalesce(F.trim("magnitude_type"), F.lit("")) != "").cast("int")
    common = (F.col("status_rank"), F.col("trust_rank"))
    return (
        FieldPolicy("magnitude_best", F.col("magnitude").between(-2.5, 9.5), (typed, *common), ("magnitude", "magnitude_type") if carry else ()),
        FieldPolicy(
            "moment_best", (F.col("seismic_moment_n_m") > 0) & (F.col("seismic_moment_n_m") < 1e24), common, ("seismic_moment_n_m",) if carry else ()
        ),
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that give each quake its magnitude and its moment."""
    got = field_survivors(_records(spark, sf_dir), "event_uid", "record_id", "ingested_at", _policies(False))
    source = lambda f: F.coalesce(F.col(f"{f}.record_id"), F.lit(0)).cast("long")
    return got.select("event_uid", source("magnitude_best").alias("magnitude_from"), source("moment_best").alias("moment_from"))


def p5_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving values of each quake, with the record and layer each comes from."""
    got = field_survivors(_records(spark, sf_dir), "event_uid", "record_id", "ingested_at", _policies(True))
    return got.select(
        "event_uid", "magnitude_best.magnitude", "magnitude_best.magnitude_type", F.col("magnitude_best.record_id").alias("magnitude_from"),
        "moment_best.seismic_moment_n_m", F.col("moment_best.record_id").alias("moment_from"),
    )


MERGED_FIELDS = ("origin_time", "latitude", "longitude", "depth_km", "magnitude", "magnitude_type", "seismic_moment_n_m")


def p5_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One whole record for each quake: the skyline's base record, its gaps filled from the next layers."""
    name = lambda c: F.lower(F.trim(F.col(c)))
    trust = table(spark, sf_dir, "agencies").groupBy(name("agency_code").alias("__agency")).agg(F.min("trust").alias("__trust"))
    rows = table(spark, sf_dir, "event_records").select(
        compared_uid("event_uid_source").alias("event_uid"), "record_id", "ingested_at", name("source").alias("__agency"), *MERGED_FIELDS
    )
    rows = rows.where(F.col("event_uid").isNotNull()).join(trust, "__agency", "left")
    return record_survivors(rows, "event_uid", "record_id", "ingested_at", -F.col("__trust"), MERGED_FIELDS)


_P5 = r"""
WITH rec AS (
  SELECT regexp_replace(lower(event_uid_source), '[^\p{L}\p{Nd}]', '', 'g') AS event_uid, record_id, ingested_at, magnitude, magnitude_type,
    seismic_moment_n_m, CASE lower(trim(revision_status)) WHEN 'final' THEN 3 WHEN 'reviewed' THEN 2 WHEN 'preliminary' THEN 1 WHEN 'prelim' THEN 1 ELSE 0 END AS st,
    coalesce(a.trust, 1000000) AS trust, CASE WHEN trim(coalesce(magnitude_type, '')) <> '' THEN 1 ELSE 0 END AS typed
  FROM event_records e LEFT JOIN agencies a ON lower(trim(e.source)) = lower(trim(a.agency_code))
), uid AS (
  SELECT event_uid FROM rec WHERE regexp_matches(event_uid, '[1-9]') GROUP BY event_uid HAVING count(DISTINCT record_id) >= 2
), mag AS (
  SELECT * FROM rec WHERE magnitude BETWEEN -2.5e0 AND 9.5e0
  QUALIFY row_number() OVER (PARTITION BY event_uid ORDER BY typed DESC, st DESC, trust, ingested_at DESC NULLS LAST, record_id DESC) = 1
), mom AS (
  SELECT * FROM rec WHERE seismic_moment_n_m > 0 AND seismic_moment_n_m < 1e24
  QUALIFY row_number() OVER (PARTITION BY event_uid ORDER BY st DESC, trust, ingested_at DESC NULLS LAST, record_id DESC) = 1
)
"""
_V = ", ".join(f"v{i} DESC NULLS LAST" for i in range(len(MERGED_FIELDS)))
_BETTER = f"\"full\" DESC, trust DESC, ingested_at DESC NULLS LAST, record_id DESC, {_V}, mask DESC"
_NUMBERS = {"latitude", "longitude", "depth_km", "magnitude", "seismic_moment_n_m"}


def _value(f: str) -> str:
    if f in _NUMBERS:
        return f"CASE WHEN NOT isnan({f}) THEN {f} END"
    return f"CASE WHEN trim({f}) <> '' THEN {f} END" if f == "magnitude_type" else f


P5_MERGED_SQL = rf"""
WITH RECURSIVE raw AS (
  SELECT regexp_replace(lower(event_uid_source), '[^\p{{L}}\p{{Nd}}]', '', 'g') AS event_uid, record_id, ingested_at,
    coalesce(-(SELECT min(a.trust) FROM agencies a WHERE lower(trim(a.agency_code)) = lower(trim(e.source))), -1073741824) AS trust,
    {", ".join(f"{_value(f)} AS v{i}" for i, f in enumerate(MERGED_FIELDS))} FROM event_records e
), rec AS (
  SELECT *, {" + ".join(f"(v{i} IS NOT NULL)::INT * {1 << i}" for i in range(len(MERGED_FIELDS)))} AS mask,
    {" + ".join(f"(v{i} IS NOT NULL)::INT" for i in range(len(MERGED_FIELDS)))} AS "full"
  FROM raw WHERE regexp_matches(event_uid, '[1-9]') AND record_id IS NOT NULL
), many AS (SELECT event_uid FROM rec GROUP BY 1 HAVING count(DISTINCT record_id) >= 2),
best AS (
  SELECT * FROM rec JOIN many USING (event_uid)
  QUALIFY row_number() OVER (PARTITION BY event_uid, mask, trust ORDER BY ingested_at DESC NULLS LAST, record_id DESC, {_V}) = 1
), cell AS (SELECT row_number() OVER (ORDER BY event_uid, mask, trust) AS k, * FROM best),
beats AS (
  SELECT a.k AS a, b.k AS b FROM cell a JOIN cell b USING (event_uid)
  WHERE a."full" >= b."full" AND a.trust >= b.trust AND (b.ingested_at IS NULL OR a.ingested_at >= b.ingested_at)
    AND (a."full" > b."full" OR a.trust > b.trust OR a.ingested_at > b.ingested_at OR (b.ingested_at IS NULL AND a.ingested_at IS NOT NULL))
), chain AS (SELECT k, 1 AS depth FROM cell UNION SELECT beats.b, depth + 1 FROM chain JOIN beats ON beats.a = chain.k),
layered AS (SELECT cell.*, layer FROM cell JOIN (SELECT k, max(depth) AS layer FROM chain GROUP BY k) USING (k)),
base AS (SELECT event_uid, record_id AS base_from FROM layered QUALIFY row_number() OVER (PARTITION BY event_uid ORDER BY layer, {_BETTER}) = 1)
{"".join(f""", f{i} AS (SELECT event_uid, v{i} AS {f}, record_id AS {f}_from, layer AS {f}_layer FROM layered WHERE v{i} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY event_uid ORDER BY layer, {_BETTER}) = 1)""" for i, f in enumerate(MERGED_FIELDS))}
SELECT * FROM base {" ".join(f"LEFT JOIN f{i} USING (event_uid)" for i in range(len(MERGED_FIELDS)))}
"""
QUERIES = {"p5_found": p5_found, "p5_survivors": p5_survivors, "p5_merged": p5_merged}
SQL = {
    "p5_merged": P5_MERGED_SQL,
    "p5_found": _P5
    + """SELECT event_uid, coalesce(mag.record_id, 0) AS magnitude_from, coalesce(mom.record_id, 0) AS moment_from
FROM uid LEFT JOIN mag USING (event_uid) LEFT JOIN mom USING (event_uid)""",
    "p5_survivors": _P5
    + """SELECT event_uid, mag.magnitude, mag.magnitude_type, mag.record_id AS magnitude_from, mom.seismic_moment_n_m, mom.record_id AS moment_from
FROM uid LEFT JOIN mag USING (event_uid) LEFT JOIN mom USING (event_uid)""",
}
