"""Catalog files: canonical CSV, raw CSV with unknown headers, GeoJSON and QuakeML, read by Spark's own readers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeledger.catalog import NUMBERS, REQUIRED, SCHEMA, TEXTS, canonical
from quakeledger.functions.scalars import clean_text, number_or_null, parse_depth, parse_magnitude, parse_time
from quakeledger.runtime import written


def _quote_spans_lines(spark: SparkSession, path) -> bool:
    """Whether a line of the files holds an odd number of quotes, as it does where a quoted field goes on in the next line."""
    line = F.col("value")
    return bool(spark.read.text(path).where((F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1).limit(1).count())


def read_csv(spark: SparkSession, path, catalog_of: Column | None = None, multi_line: bool | None = None) -> DataFrame:
    """Canonical CSV files (a path, list or glob) as one catalog table; blank and unreadable values become null.

    catalog_id is the column of that name, else ``catalog_of``, else the file's name without its ending. record_id is
    the column of that name; without it every row is a record of its own, equal rows too, and gets a number that is its
    own within the table read (write the table where the numbers must last). Rows with the same record_id and values
    count once. A missing required column or an empty input is an error.

    Files are read in parts, each by a task of its own, unless a quoted field spans lines: then a file is one task.
    Whether one does is looked up in the text unless multi_line says so.
    """
    multi_line = _quote_spans_lines(spark, path) if multi_line is None else multi_line
    raw = spark.read.csv(path, header=True, multiLine=multi_line, escape='"', inferSchema=False)
    if missing := [c for c in REQUIRED if c not in raw.columns]:
        raise ValueError(f"required columns are missing: {missing}")
    if not raw.head(1):
        raise ValueError(f"{path} has no rows")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[A-Za-z]+)*$", 1)
    cid = F.col("catalog_id") if "catalog_id" in raw.columns else (catalog_of if catalog_of is not None else name)
    numbered = "record_id" in raw.columns
    rid = F.col("record_id").try_cast("long") if numbered else F.monotonically_increasing_id()
    out = [cid.alias("catalog_id"), rid.alias("record_id"), parse_time("origin_time").alias("origin_time")]
    out += [number_or_null(c).alias(c) for c in NUMBERS if c in raw.columns] + [F.nullif(F.trim(c), F.lit("")).alias(c) for c in TEXTS if c in raw.columns]
    return canonical(raw.select(*out), repeated=numbered)


def read_raw_csv(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(rows as text with trimmed headers, faulty lines) of a messy CSV: lines that don't fit the header are set apart."""
    head = spark.read.csv(path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=True)
    schema = ", ".join(f"`{c.strip()}` string" for c in head.columns) + ", `__faulty` string"
    got = spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="__faulty", ignoreLeadingWhiteSpace=True, enforceSchema=True)
    got = written(got)  # the reader can't give the faulty lines alone
    return got.where("__faulty IS NULL").drop("__faulty"), got.where("__faulty IS NOT NULL").select("__faulty")


# Header spellings by canonical column.
HEADERS = {
    "origin_time": ("origintime", "origin_time", "utc date", "time", "date_time", "datetime", "event_time"),
    "latitude": ("latitude", "_latitude", "lat"), "longitude": ("longitude", "_longitude", "lon", "long"),
    "depth_km": ("depth_km", "_depth", "depth", "profoundity"), "magnitude": ("magnitude", "_magnitude", "mag"),
    "magnitude_type": ("magnitude_type", "mag_type", "magtype"), "seismic_moment_n_m": ("seismic_moment_n_m", "moment", "m0"),
    "tsunami_flag": ("tsunami_flag", "tsunami"), "mechanism": ("mechanism", "focal_mechanism"), "source": ("source", "agency", "network"),
    "event_uid_source": ("event_uid_source", "event_id", "id", "eventid"), "revision_status": ("revision_status", "status"),
    "mmi": ("mmi", "intensity"), "station_distance_km": ("station_distance_km", "distance_km", "delta"),
    "rupture_length_km": ("rupture_length_km", "rupture_length"), "rupture_area_km2": ("rupture_area_km2", "rupture_area"),
    "rupture_displacement_m": ("rupture_displacement_m", "displacement"), "azimuthal_gap_deg": ("azimuthal_gap_deg", "gap", "azimuthal_gap"),
}
# Header spellings of dates and of clock times that stand apart.
DATE_HEADERS = ("date", "date_utc", "utc_date", "event_date", "eventdate", "origin_date", "occurrence_date", "quake_date")
TIME_HEADERS = ("time", "time_utc", "utc_time", "origin_time_of_day", "occurrence_time", "quake_time", "hour")


def plain_name(name: str) -> str:
    """A header in lower case with letters and digits only."""
    return re.sub("[^a-z0-9]", "", name.lower())


def detect_columns(columns: list[str]) -> tuple[dict[str, str], tuple[str, str] | None]:
    """(canonical column to header, date and time headers or None) from header spellings.

    A pair of a date and a time column beats a lone match of origin_time when that match is the pair's time half.
    """
    have = {}
    for c in columns:
        have.setdefault(plain_name(c), c)
    first = lambda names: next((have[plain_name(n)] for n in names if plain_name(n) in have), None)
    found = {c: h for c, names in HEADERS.items() if (h := first(names)) is not None}
    date, time = first(DATE_HEADERS), first(TIME_HEADERS)
    pair = (date, time) if date and time and date != time else None
    if pair and found.get("origin_time") not in (None, time):
        pair = None
    if pair:
        found.pop("origin_time", None)
    return found, pair


def prepare(raw: DataFrame, catalog_id: str | Column, overrides: dict[str, str] | None = None, date_time: tuple[str, str] | None = None) -> DataFrame:
    """A raw text table in canonical columns: headers detected (overrides win), values parsed, rows with gaps kept.

    Depths in miles become km; magnitudes may carry their type ("5.6 Mw"), an explicit non-blank type wins. Required
    columns that can't be found are an error that lists them. Every row is a record of its own, numbered as in read_csv.
    """
    found, pair = detect_columns(raw.columns)
    found |= overrides or {}
    pair = None if overrides and "origin_time" in overrides else date_time or pair
    if missing := [c for c in REQUIRED if c not in found and not (c == "origin_time" and pair)]:
        raise ValueError(f"no column was found for {missing}; name them in overrides")
    text = lambda c: clean_text(F.col(f"`{found[c]}`"))
    when = F.concat_ws("T", *(clean_text(F.col(f"`{c}`")) for c in pair)) if pair else text("origin_time")
    magnitude, kind = parse_magnitude(text("magnitude"))
    out = {"origin_time": parse_time(when), "latitude": number_or_null(text("latitude")), "longitude": number_or_null(text("longitude")), "depth_km": parse_depth(text("depth_km")), "magnitude": magnitude, "magnitude_type": kind}
    if "magnitude_type" in found:
        out["magnitude_type"] = F.coalesce(F.nullif(text("magnitude_type"), F.lit("")), kind)
    for c in found:
        if c not in out:
            out[c] = number_or_null(text(c)) if c in NUMBERS else F.nullif(text(c), F.lit(""))
    cid = F.lit(catalog_id) if isinstance(catalog_id, str) else catalog_id
    return canonical(raw.select(cid.alias("catalog_id"), F.monotonically_increasing_id().alias("record_id"), *(v.alias(k) for k, v in out.items())), repeated=False)


def earthquakes_only(raw: DataFrame, column: str = "Type") -> DataFrame:
    """rows whose type is an earthquake."""
    return raw.where(F.col(column) == "Earthquake")


_EVENTS = "features array<struct<id: string, properties: struct<mag: double, magType: string, time: bigint, status: string, net: string, tsunami: double>, geometry: struct<coordinates: array<double>>>>"


def read_geojson_events(spark: SparkSession, path, catalog_id: str, multi_line: bool = True) -> DataFrame:
    """S3: events of FeatureCollection files (one a file, or one a line); times are milliseconds since 1970."""
    f = spark.read.schema(_EVENTS).json(path, multiLine=multi_line).select(F.explode("features").alias("f"))
    xyz = lambda i: F.get("f.geometry.coordinates", F.lit(i))
    rows = f.select(
        F.lit(catalog_id).alias("catalog_id"), F.xxhash64("f.id", "f.properties.time").alias("record_id"), F.timestamp_millis("f.properties.time").cast("timestamp_ntz").alias("origin_time"),
        xyz(1).alias("latitude"), xyz(0).alias("longitude"), xyz(2).alias("depth_km"), F.col("f.properties.mag").alias("magnitude"), F.col("f.properties.magType").alias("magnitude_type"),
        F.col("f.id").alias("event_uid_source"), F.col("f.properties.net").alias("source"), F.col("f.properties.status").alias("revision_status"), F.col("f.properties.tsunami").alias("tsunami_flag"),
    )
    return canonical(rows)


def read_geojson_faults(spark: SparkSession, path) -> DataFrame:
    """Vertices (line, i, latitude, longitude) of LineString and MultiLineString traces; other shapes are skipped.

    A file that isn't JSON gives no line.
    """
    schema = "features array<struct<geometry: struct<type: string, coordinates: string>>>"
    g = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("features").alias("k", "f"), F.col("_metadata.file_path").alias("file")).select("file", "k", "f.geometry.*")
    one = F.when(F.col("type") == "LineString", F.array(F.from_json("coordinates", "array<array<double>>"))).when(F.col("type") == "MultiLineString", F.from_json("coordinates", "array<array<array<double>>>"))
    lines = g.select("file", "k", F.posexplode(one).alias("j", "line"))
    return lines.select(F.concat_ws("/", "file", "k", "j").alias("line"), F.posexplode("line").alias("i", "v")).select("line", "i", F.get("v", F.lit(1)).alias("latitude"), F.get("v", F.lit(0)).alias("longitude"))


_QUAKEML = """_publicID string, preferredOriginID string, preferredMagnitudeID string,
 origin array<struct<_publicID: string, time: struct<value: string>, latitude: struct<value: double>, longitude: struct<value: double>, depth: struct<value: double>>>,
 magnitude array<struct<_publicID: string, mag: struct<value: double>, type: string>>"""
# Magnitude types that count as moment magnitudes.
MOMENT_TYPES = ("mw", "mww", "mwc", "mwb", "mwp", "mw(mwp)")


def read_quakeml(spark: SparkSession, path, catalog_id: str) -> DataFrame:
    """One row an event: its preferred origin, else the first; its preferred magnitude, else the first moment magnitude, else the largest.

    Elements may carry a namespace prefix; events without an origin time are skipped, malformed ones too.
    """
    raw = spark.read.format("xml").option("rowTag", "event").option("ignoreNamespace", True).option("mode", "DROPMALFORMED").schema(_QUAKEML).load(path)
    first = lambda xs, test: F.get(F.filter(xs, test), F.lit(0))
    o = F.coalesce(first("origin", lambda x: x["_publicID"] == F.col("preferredOriginID")), F.get("origin", F.lit(0)))
    largest = F.get(F.reverse(F.array_sort(F.transform(F.filter("magnitude", lambda x: x["mag"]["value"].isNotNull()), lambda x: F.struct(x["mag"]["value"].alias("v"), x["type"].alias("type"))))), F.lit(0))
    plain = lambda x: F.struct(x["mag"]["value"].alias("v"), x["type"].alias("type"))
    m = F.coalesce(
        F.get(F.transform(F.filter("magnitude", lambda x: x["_publicID"] == F.col("preferredMagnitudeID")), plain), F.lit(0)),
        F.get(F.transform(F.filter("magnitude", lambda x: F.lower(x["type"]).isin(*MOMENT_TYPES)), plain), F.lit(0)), largest,
    )
    got = raw.select("_publicID", o.alias("o"), m.alias("m")).where("o.time.value IS NOT NULL")
    return canonical(got.select(
        F.lit(catalog_id).alias("catalog_id"), F.xxhash64("_publicID", "o.time.value").alias("record_id"), parse_time("o.time.value").alias("origin_time"), F.col("o.latitude.value").alias("latitude"),
        F.col("o.longitude.value").alias("longitude"), (F.col("o.depth.value") / 1000.0).alias("depth_km"), F.col("m.v").alias("magnitude"), F.col("m.type").alias("magnitude_type"), F.col("_publicID").alias("event_uid_source"),
    ))


# --- sinks ------------------------------------------------------------------------------------------------------------


def write_csv(cat: DataFrame, path: str, by_catalog: bool = False) -> None:
    """K1: canonical CSV; missing values are blank. by_catalog writes a folder for each catalog."""
    out = cat.select(*(F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(f.name) if f.name == "origin_time" else F.col(f.name) for f in SCHEMA))
    w = out.write.mode("overwrite")
    (w.partitionBy("catalog_id") if by_catalog else w).csv(path, header=True, nullValue="", emptyValue="", escape='"')


def as_json(df: DataFrame) -> DataFrame:
    """K2: one JSON text a row, nulls kept, non-finite numbers as null."""
    safe = [F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("value"))


def append_new(scores: DataFrame, path: str, key: str = "dataset_id") -> int:
    """K4: appends the rows whose key isn't stored yet, so that a broken-off run goes on; returns how many."""
    spark = scores.sparkSession
    try:
        done = spark.read.parquet(path).select(key).distinct()
        new = scores.join(done, key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        new = scores
    new = new.persist()
    n = new.count()
    new.write.mode("append").parquet(path)
    new.unpersist()
    return n


def report_text(documents: DataFrame) -> DataFrame:
    """K3: (catalog_id, value): each audit document in words, one text a catalog."""
    d = lambda f: F.col(f"document.{f}")
    number = lambda c, digits=3: F.coalesce(F.format_number(c, digits), F.lit("-"))
    axes = F.concat_ws(", ", *(F.concat(F.lit(f"{a} "), number(d(f"axes.{a}"))) for a in "APCI"))
    head = F.concat(d("catalog_id"), F.lit(": "), d("decision"), F.lit(" (trust "), number(d("trust")), F.lit(", "), d("n").cast("string"), F.lit(" records)"))
    body = F.concat(F.lit("  axes: "), axes, F.lit("; evidence "), number(d("evidence_coverage")), F.lit(", sufficiency "), number(d("sample_sufficiency")), F.lit(f", tests "), d("n_tests").cast("string"))
    gate = lambda p: F.concat(F.lit(f"{p} "), d(f"gates.{p}.violations").cast("string"))
    gates = F.concat(F.lit("  out of bounds: "), F.concat_ws(", ", gate("P1"), gate("P2"), gate("P3")))
    tests = F.concat_ws("\n", F.transform(d("tests"), lambda t: F.concat(F.lit("  "), t["test"], F.lit(" "), F.when(t["applicable"], number(t["score"])).otherwise("does not apply"))))
    caveats = F.concat_ws("\n", F.transform(d("caveats"), lambda c: F.concat(F.lit("  ! "), c)))
    lines = (head, body, gates, F.nullif(tests, F.lit("")), F.nullif(caveats, F.lit("")))
    return documents.select("catalog_id", F.concat_ws("\n", *lines).alias("value"))
