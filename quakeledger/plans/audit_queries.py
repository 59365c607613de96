"""Queries of the audit's operators on event_records, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeledger.audit import Audit
from quakeledger.catalog import CATALOG_SQL, canonical, load, seconds
from quakeledger.operators import subtests as st
from quakeledger.operators.interval import densify, positive_gaps, ranked
from quakeledger.operators.decision import AXIS_WEIGHTS, RELIABLE_N, WITHIN, audit_verdicts
from quakeledger.runtime import checkpoint, present, table, written
from quakeledger.sources.files import as_json


def catalog(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The canonical catalog, with t where the time is among the columns."""
    got = load(spark, sf_dir, *columns)
    return got.withColumn("t", seconds()) if "origin_time" in got.columns else got


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reference_events as reference sources; longitudes brought into +-180."""
    lon = present("longitude")
    return table(spark, sf_dir, "reference_events").select("ref_id", "source_id", seconds().alias("t"), present("latitude").alias("latitude"), (F.pmod(lon + 180.0, F.lit(360.0)) - 180.0).alias("longitude"), present("magnitude").alias("magnitude"))


def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The borders of the zones as lines, densified to 10 km: the reference points of the proximity test."""
    rings = table(spark, sf_dir, "zones").select("zone_id", F.posexplode(F.concat("ring", F.slice("ring", 1, 1))).alias("i", "v"))
    return densify(rings.select("zone_id", "i", F.col("v.lat").alias("latitude"), F.col("v.lon").alias("longitude")), "zone_id", "i")


def _r(df: DataFrame, *keep: str) -> DataFrame:
    """The shared columns, numbers rounded for comparison."""
    doubles = {c for c, t in df.dtypes if t == "double"}
    return df.select("catalog_id", *(F.round(c, 6).alias(c) if c in doubles else F.col(c) for c in ("score", "applicable", *keep)))


ROW = ("latitude", "longitude", "depth_km", "magnitude", "seismic_moment_n_m", "tsunami_flag", "mmi", "station_distance_km", "rupture_length_km", "mechanism", "revision_status", "origin_time")


def _stats(spark, sf_dir):
    return st.row_stats(catalog(spark, sf_dir, *ROW))


def bulletin(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """local_bulletin as catalogs, one a network: the catalogs that the reference sources can know."""
    rows = table(spark, sf_dir, "local_bulletin").select(
        F.col("network").alias("catalog_id"), F.col("report_id").alias("record_id"), "origin_time", *(present(c).alias(c) for c in ("latitude", "longitude", "depth_km", "magnitude")), "magnitude_type"
    )
    got = (canonical(rows) if not columns else rows.select("catalog_id", "record_id", *columns).dropDuplicates())
    return got.withColumn("t", seconds())


def _votes(spark, sf_dir):
    return st.source_votes(bulletin(spark, sf_dir, *T4), references(spark, sf_dir))


def flat(verdicts: DataFrame) -> DataFrame:
    """Verdicts with rounded numbers and lists as texts."""
    plain = {"double": lambda c: F.round(c, 6), "array<string>": lambda c: F.concat_ws(",", c)}
    return verdicts.select(*(plain[t](c).alias(c) if t in plain else F.col(c) for c, t in verdicts.dtypes))


def audit_referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict for every network of local_bulletin, held against the external reference sources."""
    return flat(Audit(references(spark, sf_dir), faults(spark, sf_dir)).verdicts(bulletin(spark, sf_dir)))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict for every catalog on its own evidence alone."""
    return flat(Audit(faults=faults(spark, sf_dir)).verdicts(catalog(spark, sf_dir)))


def stage1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest whole query: bounds, their tail probabilities and whether a gate fires."""
    got = st.gates(_stats(spark, sf_dir))
    return got.select("catalog_id", "n", "p1_k", "p2_k", "p3_k", *(F.round(f"{p}_p", 9).alias(f"{p}_p") for p in ("p1", "p2", "p3")), "fired")


def subtest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sub-tests of all catalogs in long form."""
    return Audit(faults=faults(spark, sf_dir)).subtest_rows(written(catalog(spark, sf_dir))).withColumn("score", F.round("score", 6))


def _fixed_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of all sources with an error of mc of 0.3 each, which SQL can tell (the bootstrap's error it can't)."""
    refs = references(spark, sf_dir)
    mc = st.magnitude_bins(refs.select(F.col("source_id").alias("catalog_id"), "magnitude")).select(
        F.col("catalog_id").alias("source_id"), F.greatest("mc", F.lit(st.LEAST_REFERENCE_MC)).alias("mc"), F.lit(st.DEFAULT_MC_ERROR).alias("mc_se"), F.lit(False).alias("is_default")
    )
    return st.source_votes(bulletin(spark, sf_dir, *T4), refs, mc)


def a6_vote_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By network the sources that cover, match and corroborate its records, and the weighted votes."""
    n = [F.sum(c).alias(c) for c in ("n_queried", "n_matched", "n_corroborating")]
    return _fixed_votes(spark, sf_dir).groupBy("catalog_id").agg(*n, F.round(F.sum("weighted"), 6).alias("weighted"))


def blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts from a table of sub-test rows that arithmetic makes of each catalog's size, alike in SQL."""
    n = F.col("n")
    facts = checkpoint(catalog(spark, sf_dir).groupBy("catalog_id").agg(F.count("*").alias("n")))
    h = lambda i: F.pmod(n * (7919 + 104 * i) + 31 * i, F.lit(1000))
    tests = F.array(*(F.struct(F.lit(t).alias("test"), h(i).alias("h")) for i, t in enumerate(sorted(WITHIN), 1)))
    rows = facts.select("catalog_id", "n", F.explode(tests).alias("x")).select("catalog_id", "n", "x.*")
    score = F.when(F.col("h") % 7 != 0, F.col("h") / 1000.0)
    results = rows.select("catalog_id", "test", score.alias("score"), score.isNotNull().alias("applicable"), F.when(score.isNotNull(), F.pmod(F.col("h"), F.lit(60))).alias("n_used"))
    gate = facts.select("catalog_id", (n % 17 == 0).alias("fired"))
    a6 = facts.where(n % 3 == 0).select("catalog_id", ((n % 10) / 10.0).alias("score"), (n % 6 == 0).alias("applicable"), F.floor(n / 3).alias("n_used"), (n % 12 == 0).alias("confirmed"))
    got = audit_verdicts(results, facts, gate, a6).withColumn("missing", F.concat_ws(",", "missing")).withColumn("insufficient", F.concat_ws(",", "insufficient"))
    return got.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes))


def audit_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: the whole audit of every catalog as one JSON document each, with sub-tests, gates, missing evidence and caveats."""
    return as_json(Audit(faults=faults(spark, sf_dir)).documents(catalog(spark, sf_dir)).select("document.*"))


T4 = ("origin_time", "latitude", "longitude", "magnitude")
QUERIES = {
    "audit": audit,
    "audit_referenced": audit_referenced,
    "audit_documents": audit_documents,
    "verdict_blend": blend,
    "a6_vote_sums": a6_vote_sums,
    "a6_states": lambda s, d: _r(st.a6_external(_fixed_votes(s, d)), "n_used", "n_stratum", "n_corroborated", "n_eligible", "confirmed", "p_value"),
    "subtest_scores": subtest_scores,
    "stage1_gates": stage1,
    "gate_counts": lambda s, d: _stats(s, d).select("catalog_id", "n", "p1_k", "p2_k", "p3_k"),
    "quarantine": lambda s, d: st.quarantine(catalog(s, d, "latitude", "longitude", "depth_km", "magnitude")),
    "a1_benford": lambda s, d: _r(st.a1_benford(catalog(s, d, "origin_time", "seismic_moment_n_m", "depth_km")), "n_used", "n_fields"),
    "a2_gutenberg_richter": lambda s, d: _r(st.a2_gutenberg_richter(st.b_values(catalog(s, d, "magnitude"))), "n_used", "b", "mc"),
    "a3_clusters": lambda s, d: st.aftershock_pairs(catalog(s, d, *T4)).groupBy("catalog_id", "main_id").agg(F.count("*").alias("n"), F.round(F.sum("dt"), 5).alias("days")).where("n >= 5"),
    "a3_omori": lambda s, d: _r(st.a3_omori(catalog(s, d, *T4)), "n_used", "n_valid"),
    "a4_fractal": lambda s, d: _r(st.a4_fractal(catalog(s, d, "latitude", "longitude")), "n_used", "dimension"),
    "a5_near_duplicates": lambda s, d: _r(st.a5_duplicates(catalog(s, d, *T4)), "n_flagged"),
    "a6_source_mc": lambda s, d: st.reference_mc(references(s, d)).select("source_id", F.round("mc", 6).alias("mc"), "is_default"),
    "a6_matches": lambda s, d: st.reference_matches(bulletin(s, d, *T4), references(s, d)),
    "a6_votes": lambda s, d: _votes(s, d).where("n_queried > 0").withColumn("weighted", F.round("weighted", 6)),
    "a6_external": lambda s, d: _r(st.a6_external(_votes(s, d)), "n_stratum", "n_corroborated", "n_eligible", "confirmed"),
    "subtest_p4_tsunami": lambda s, d: _r(st.p4_tsunami(_stats(s, d)), "n_used", "n_violations"),
    "subtest_p5_rupture": lambda s, d: _r(st.share_kept(_stats(s, d), "p5"), "n_used", "n_violations"),
    "subtest_p6_moment": lambda s, d: _r(st.share_kept(_stats(s, d), "p6"), "n_used", "n_violations"),
    "subtest_p7_timestamps": lambda s, d: _r(st.p7_timestamps(catalog(s, d, "origin_time")), "n_used", "n_repeated"),
    "subtest_p8_proximity": lambda s, d: _r(st.p8_proximity(catalog(s, d, "latitude", "longitude"), faults(s, d)), "n_used", "mean_km"),
    "subtest_p9_intensity": lambda s, d: _r(st.share_kept(_stats(s, d), "p9"), "n_used", "n_violations"),
    "c1_missingness": lambda s, d: _r(st.c1_missingness(_stats(s, d)), "n_used"),
    "c1_little": lambda s, d: st.c1_little(catalog(s, d, "origin_time", "latitude", "longitude", "depth_km", "magnitude")).select("catalog_id", F.round("d2", 4).alias("d2"), "df", F.round("p_value", 6).alias("p_value"), "n_patterns", "mcar"),
    "c2_mc_adequacy": lambda s, d: _r(st.c2_mc_adequacy(catalog(s, d, "magnitude")), "n_used", "sigma"),
    "c3_coverage": lambda s, d: _r(st.c3_coverage(catalog(s, d, "origin_time", "latitude", "longitude")), "n_used", "n_flagged"),
    "c4_strata": lambda s, d: _r(st.c4_strata(catalog(s, d, "latitude", "longitude", "magnitude")), "n_used", "n_strata", "n_sufficient"),
    "i1_drift": lambda s, d: _r(st.i1_drift(catalog(s, d, "origin_time", "magnitude")), "n_used", "s", "z", "slope"),
    "i2_clipping": lambda s, d: _r(st.i2_clipping(catalog(s, d, "magnitude"), st.b_values(catalog(s, d, "magnitude"))), "n_used", "observed"),
    "i3_revision": lambda s, d: _r(st.i3_revision(_stats(s, d)), "n_used"),
    "i4_levels": lambda s, d: st.cross_source_pairs(catalog(s, d, *T4, "source")).groupBy("catalog_id", "l1", "l2", "l3").agg(F.sum(F.col("own") * F.col("other")).alias("n_pairs")),
    "i4_dedup": lambda s, d: _r(st.i4_dedup(catalog(s, d, *T4, "source")), "n_used", "n_pairs"),
    "i5_drift": lambda s, d: _r(st.i5_ks(catalog(s, d, "origin_time", "magnitude")), "n_used"),
    "mc_and_b": lambda s, d: st.b_values(catalog(s, d, "magnitude")).select("catalog_id", "n", F.round("mc", 6).alias("mc"), "n_above", F.round("b", 6).alias("b"), F.round("shi_bolt", 6).alias("shi_bolt"), F.round("aki_error", 6).alias("aki_error")),
    "waiting_times": lambda s, d: positive_gaps(catalog(s, d, "origin_time"), "catalog_id", "t").groupBy("catalog_id").agg(F.count("*").alias("n_gaps"), F.round(F.max("gap"), 5).alias("longest"), F.round(F.sum("gap"), 3).alias("total")),
    "time_ranks": lambda s, d: ranked(catalog(s, d, "origin_time").where("t IS NOT NULL").select("catalog_id", "record_id", "t"), "catalog_id", ["t", "record_id"]).select("catalog_id", "record_id", F.col("rn").cast("long").alias("rn"), "n"),
}

_D = "2e0 * 6371.0088e0 * asin(sqrt(least(1e0, pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2))))"
DIST = _D.format(a="a", b="b")
_CAT = "WITH " + CATALOG_SQL + " "
_OOB = ("coalesce(abs(latitude) > 90, false) OR coalesce(abs(longitude) > 180, false)", "coalesce(NOT (depth_km BETWEEN -5 AND 750), false)", "coalesce(NOT (magnitude BETWEEN -2.5e0 AND 9.5e0), false)")


def _share(n: str, k: str) -> str:
    return _CAT + f"""SELECT catalog_id, round(CASE WHEN n > 0 THEN 1e0 - k / n END, 6) AS score, n > 0 AS applicable, n AS n_used, k AS n_violations FROM (
      SELECT catalog_id, count(*) FILTER ({n}) AS n, count(*) FILTER (({n}) AND ({k})) AS k FROM cat GROUP BY catalog_id)"""


_MC = """, m AS (SELECT catalog_id, magnitude FROM cat WHERE magnitude IS NOT NULL),
ends AS (SELECT catalog_id, min(magnitude) AS low, max(magnitude) AS high, count(*) AS n FROM m GROUP BY catalog_id),
bins AS (SELECT m.catalog_id, CAST(floor((magnitude - low) / 0.1e0 + 1e-9) AS BIGINT) AS bin, count(*) AS c FROM m JOIN ends USING (catalog_id) GROUP BY ALL),
mode AS (SELECT catalog_id, bin FROM bins QUALIFY row_number() OVER (PARTITION BY catalog_id ORDER BY c DESC, bin) = 1),
mc AS (SELECT catalog_id, n, low, high, CASE WHEN n < 2 THEN NULL WHEN low = high THEN low ELSE low + bin * 0.1e0 END AS mc FROM ends JOIN mode USING (catalog_id)),
bv AS (SELECT catalog_id, n, mc, count(*) AS n_above, avg(magnitude) AS mean, var_samp(magnitude) AS var, max(magnitude) AS top FROM m JOIN mc USING (catalog_id) WHERE magnitude >= mc GROUP BY ALL),
b AS (SELECT *, CASE WHEN mean > mc - 0.05e0 THEN log10(exp(1e0)) / (mean - (mc - 0.05e0)) END AS b FROM bv)
"""


def _cell(x: str, k: int) -> str:
    return f"CASE WHEN z_{x} > a_{x} THEN least(CAST(floor(({x} - a_{x}) / ((z_{x} - a_{x}) / {k})) AS BIGINT), {k - 1}) ELSE {k - 1} END"


_REF = """, ref AS (SELECT ref_id, source_id, epoch_us(origin_time) / 1e6 AS t, CASE WHEN isfinite(latitude) THEN latitude END AS latitude,
  CASE WHEN isfinite(longitude) THEN ((longitude + 180 + 720) % 360) - 180 END AS longitude, CASE WHEN isfinite(magnitude) THEN magnitude END AS magnitude FROM reference_events)"""
_MATCH = _REF + f""", hit AS (SELECT DISTINCT a.catalog_id, a.record_id, b.source_id FROM cat a JOIN ref b ON b.t BETWEEN a.t - 30 AND a.t + 30 AND abs(a.magnitude - b.magnitude) <= 0.5e0 + 1e-9
  WHERE {DIST} <= 50)"""

_BULLETIN = "WITH cat AS (SELECT DISTINCT network AS catalog_id, report_id AS record_id, epoch_us(origin_time) / 1e6 AS t, CASE WHEN isfinite(latitude) THEN latitude END AS latitude, CASE WHEN isfinite(longitude) THEN longitude END AS longitude, CASE WHEN isfinite(magnitude) THEN magnitude END AS magnitude FROM local_bulletin)"
_FIXED = _BULLETIN + _MATCH + """, rm AS (SELECT source_id, magnitude FROM ref WHERE magnitude IS NOT NULL), re AS (SELECT source_id, min(magnitude) AS low, max(magnitude) AS high, count(*) AS n FROM rm GROUP BY 1),
  rb AS (SELECT source_id, CAST(floor((magnitude - low) / 0.1e0 + 1e-9) AS BIGINT) AS bin, count(*) AS c FROM rm JOIN re USING (source_id) GROUP BY ALL),
  src AS (SELECT source_id, greatest(4.5e0, CASE WHEN low = high THEN low ELSE low + bin * 0.1e0 END) AS mc FROM re JOIN (SELECT source_id, bin FROM rb QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY c DESC, bin) = 1) USING (source_id)),
  wsrc AS (SELECT *, (1e0 / mc) / sum(1e0 / mc) OVER () AS w FROM src),
  v AS (SELECT c.catalog_id, c.record_id, c.magnitude, count(*) FILTER (coalesce(c.magnitude >= mc + 0.3e0, false)) AS nq, count(*) FILTER (coalesce(c.magnitude >= mc + 0.3e0, false) AND h.source_id IS NOT NULL) AS nm,
    count(h.source_id) AS nc, coalesce(sum(w) FILTER (h.source_id IS NOT NULL), 0) AS wt FROM cat c CROSS JOIN wsrc LEFT JOIN hit h ON h.catalog_id = c.catalog_id AND h.record_id = c.record_id AND h.source_id = wsrc.source_id GROUP BY c.catalog_id, c.record_id, c.t, c.latitude, c.longitude, c.magnitude)"""
_TAIL = """greatest(0e0, 1e0 - coalesce((SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1e0 - {p}))) FROM range(0, {k}) r(i)), 0e0))"""
_GATES = f"g AS (SELECT catalog_id, count(*) AS n, count(*) FILTER ({_OOB[0]}) AS p1_k, count(*) FILTER ({_OOB[1]}) AS p2_k, count(*) FILTER ({_OOB[2]}) AS p3_k FROM cat GROUP BY catalog_id)"
_TAILS = ", ".join(f"{_TAIL.format(p='0.001e0', k=f'{p}_k')} AS {p}_p" for p in ("p1", "p2", "p3"))
_FAULTS = """v AS (SELECT zone_id, i, ring[i].lat AS y, ring[i].lon AS x, ring[i + 1].lat AS y2, ring[i + 1].lon AS x2, len(ring) AS m FROM (SELECT zone_id, list_concat(ring, [ring[1]]) AS ring FROM zones), LATERAL (SELECT unnest(range(1, len(ring) + 1)) AS i)),
s AS (SELECT *, ((x2 - x + 180 + 720) % 360) - 180 AS dx, CASE WHEN y2 IS NULL THEN 1 ELSE greatest(1, CAST(ceil(2e0 * 6371.0088e0 * asin(sqrt(least(1e0, pow(sin(radians(y2 - y) / 2), 2) + cos(radians(y)) * cos(radians(y2)) * pow(sin(radians(x2 - x) / 2), 2)))) / 10) AS BIGINT)) END AS parts FROM v),
fp AS (SELECT zone_id, y + coalesce(y2 - y, 0) * k / parts AS latitude, ((x + coalesce(dx, 0) * k / parts + 180 + 720) % 360) - 180 AS longitude FROM s, LATERAL (SELECT unnest(range(0, parts)) AS k))"""
SQL = {
    "stage1_gates": _CAT + f", {_GATES}, t AS (SELECT *, {_TAILS} FROM g) SELECT catalog_id, n, p1_k, p2_k, p3_k, round(p1_p, 9) AS p1_p, round(p2_p, 9) AS p2_p, round(p3_p, 9) AS p3_p, least(p1_p, p2_p, p3_p) < 0.01e0 / 3 AS fired FROM t",
    "subtest_p8_proximity": _CAT + f""", {_FAULTS}, f AS (SELECT latitude, longitude, CAST(floor(latitude) AS INT) AS cy, (CAST(floor(longitude) AS INT) + 720) % 360 AS cx FROM fp),
      a AS (SELECT catalog_id, record_id, latitude, longitude, CAST(floor(latitude) AS INT) AS cy, (CAST(floor(longitude) AS INT) + 720) % 360 AS cx FROM cat WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND abs(latitude) <= 90),
      ring AS (SELECT p.cy, p.cx, q.cy AS fy, q.cx AS fx, greatest(abs(p.cy - q.cy), least(abs(p.cx - q.cx), 360 - abs(p.cx - q.cx))) AS ring FROM (SELECT DISTINCT cy, cx FROM a) p, (SELECT DISTINCT cy, cx FROM f) q),
      near AS (SELECT * FROM (SELECT *, min(ring) OVER (PARTITION BY cy, cx) AS first FROM ring WHERE ring <= 25) WHERE ring <= first + 1),
      best AS (SELECT a.catalog_id, a.record_id, min({DIST}) AS km FROM a JOIN near ON a.cy = near.cy AND a.cx = near.cx JOIN f b ON b.cy = near.fy AND b.cx = near.fx GROUP BY ALL),
      d AS (SELECT catalog_id, coalesce(km, 5000e0) AS km FROM a LEFT JOIN best USING (catalog_id, record_id))
      SELECT catalog_id, round(avg(exp(-km / 300e0)), 6) AS score, true AS applicable, count(*) AS n_used, round(avg(km), 6) AS mean_km FROM d GROUP BY catalog_id""",
    "i1_drift": _CAT + """, r AS (SELECT catalog_id, t / 86400e0 AS t, magnitude AS m, row_number() OVER w AS rn, count(*) OVER (PARTITION BY catalog_id) AS n FROM cat WHERE magnitude IS NOT NULL AND t IS NOT NULL WINDOW w AS (PARTITION BY catalog_id ORDER BY cat.t, record_id)),
      x AS (SELECT * FROM r WHERE n >= 30 AND (n <= 2000 OR floor(ceil((rn - 1) * 1999e0 / (n - 1)) * (n - 1) / 1999e0) = rn - 1)), k AS (SELECT catalog_id, n, count(*) AS k FROM x GROUP BY ALL),
      ties AS (SELECT catalog_id, sum(c * (c - 1) * (2 * c + 5)) AS tie FROM (SELECT catalog_id, count(*) AS c FROM x GROUP BY catalog_id, m) GROUP BY 1),
      p AS (SELECT a.catalog_id, CAST(sum(sign(b.m - a.m)) AS DOUBLE) AS s, median((b.m - a.m) / (b.t - a.t)) FILTER (b.t <> a.t) * 3652.5e0 AS slope FROM x a JOIN x b ON a.catalog_id = b.catalog_id AND b.rn > a.rn GROUP BY 1),
      z AS (SELECT catalog_id, n, s, slope, CASE WHEN s = 0 OR k * (k - 1) * (2 * k + 5) - tie <= 0 THEN 0e0 ELSE (s - sign(s)) / sqrt((k * (k - 1) * (2 * k + 5) - tie) / 18e0) END AS z FROM k JOIN ties USING (catalog_id) JOIN p USING (catalog_id))
      SELECT catalog_id, round(CASE WHEN slope IS NOT NULL THEN CASE WHEN abs(z) > 1.96e0 THEN least(1e0, greatest(0e0, 1e0 - abs(slope) / 0.05e0)) ELSE 1e0 END END, 6) AS score, slope IS NOT NULL AS applicable, n AS n_used, s, round(z, 6) AS z, round(slope, 6) AS slope FROM z""",
    "verdict_blend": _CAT + f""", facts AS (SELECT catalog_id, count(*) AS n FROM cat GROUP BY 1),
      w(i, test, axis, aw, iw, reliable) AS (VALUES {", ".join(f"({i}, '{t}', '{t[0]}', {AXIS_WEIGHTS[t[0]]!r}::DOUBLE, {WITHIN[t]!r}::DOUBLE, {RELIABLE_N.get(t, 0)})" for i, t in enumerate(sorted(WITHIN), 1))}),
      f6 AS (SELECT catalog_id, n, CASE WHEN n % 6 = 0 THEN (n % 10) / 10e0 END AS a6, CASE WHEN n % 6 = 0 THEN n // 3 ELSE 0 END AS n6, n % 12 = 0 AS contradicted, n % 17 = 0 AS fired FROM facts),
      r AS (SELECT *, (n * (7919 + 104 * i) + 31 * i) % 1000 AS h FROM f6, w), q AS (SELECT *, CASE WHEN h % 7 <> 0 THEN h / 1000e0 END AS score, h % 60 AS used, aw * iw * CASE WHEN axis = 'A' THEN 1e0 - n6 / n ELSE 1e0 END AS ew FROM r),
      g AS (SELECT catalog_id, n, a6, n6, contradicted, fired,
        {", ".join(f"sum(iw * score) FILTER (axis = '{a}') / nullif(sum(iw) FILTER (axis = '{a}' AND score IS NOT NULL), 0) AS x{a}" for a in "APCI")},
        sum(ew) AS w_all, coalesce(sum(ew) FILTER (score IS NOT NULL), 0) AS w_cov, coalesce(sum(ew) FILTER (score IS NOT NULL AND used >= reliable), 0) AS w_fou, count(score) AS tests,
        array_to_string((list(test ORDER BY ew DESC, test) FILTER (score IS NULL))[1:3], ',') AS missing, array_to_string((list(test ORDER BY ew DESC, test) FILTER (score IS NOT NULL AND used < reliable))[1:3], ',') AS insufficient FROM q GROUP BY ALL),
      b AS (SELECT *, CASE WHEN a6 IS NULL THEN xA WHEN xA IS NOT NULL AND n6 < n THEN (n6 * a6 + (n - n6) * xA) / n ELSE a6 END AS A, {AXIS_WEIGHTS['A']!r}::DOUBLE * n6 / n AS w6 FROM g),
      c AS (SELECT *, (w_cov + w6) / nullif(w_all + w6, 0) AS ec, (w_fou + w6) / nullif(w_cov + w6, 0) AS ss, tests + (a6 IS NOT NULL)::INT AS nt,
        ({" + ".join(f"coalesce({v} * {AXIS_WEIGHTS[a]!r}::DOUBLE, 0)" for a, v in zip("APCI", ("A", "xP", "xC", "xI")))}) / nullif({" + ".join(f"CASE WHEN {v} IS NOT NULL THEN {AXIS_WEIGHTS[a]!r}::DOUBLE ELSE 0 END" for a, v in zip("APCI", ("A", "xP", "xC", "xI")))}, 0) AS t FROM b),
      d AS (SELECT *, CASE WHEN NOT (fired OR contradicted) THEN t END AS trust FROM c),
      e AS (SELECT *, CASE WHEN fired OR contradicted THEN 'REJECT' WHEN trust >= 0.75e0 THEN 'ADMIT' WHEN trust >= 0.2e0 THEN 'CONDITIONAL' ELSE 'REJECT' END AS d0,
        CASE WHEN ec < 0.5e0 THEN 'coverage' WHEN ss < 0.5e0 THEN 'sufficiency' WHEN n < 50 THEN 'records' WHEN nt < 8 THEN 'tests' END AS cap FROM d)
      SELECT catalog_id, n, round(A, 6) AS A, round(xP, 6) AS P, round(xC, 6) AS C, round(xI, 6) AS I, round(trust, 6) AS trust, round(ec, 6) AS evidence_coverage, round(ss, 6) AS sample_sufficiency, nt AS n_tests, fired, contradicted,
        CASE WHEN d0 = 'ADMIT' THEN cap END AS capped_by, CASE WHEN d0 = 'ADMIT' AND cap IS NOT NULL THEN 'CONDITIONAL' ELSE d0 END AS decision, coalesce(missing, '') AS missing, coalesce(insufficient, '') AS insufficient FROM e""",
    "gate_counts": _CAT + f"SELECT catalog_id, count(*) AS n, count(*) FILTER ({_OOB[0]}) AS p1_k, count(*) FILTER ({_OOB[1]}) AS p2_k, count(*) FILTER ({_OOB[2]}) AS p3_k FROM cat GROUP BY catalog_id",
    "quarantine": _CAT + f"SELECT catalog_id, record_id, {_OOB[0]} AS p1, {_OOB[1]} AS p2, {_OOB[2]} AS p3 FROM cat WHERE ({_OOB[0]}) OR ({_OOB[1]}) OR ({_OOB[2]})",
    "a1_benford": _CAT + """, v AS (
      SELECT catalog_id, 'moment' AS field, seismic_moment_n_m AS x FROM cat WHERE seismic_moment_n_m > 0 UNION ALL SELECT catalog_id, 'depth', depth_km FROM cat WHERE depth_km > 0
      UNION ALL SELECT catalog_id, 'gap', gap / 86400e0 FROM (SELECT catalog_id, t - lag(t) OVER (PARTITION BY catalog_id ORDER BY t) AS gap FROM cat WHERE t IS NOT NULL) WHERE gap > 0
    ), d AS (SELECT catalog_id, field, CAST(floor(CASE WHEN m >= 10 THEN m / 10 WHEN m < 1 THEN m * 10 ELSE m END) AS INT) AS d FROM (SELECT catalog_id, field, x / pow(10e0, floor(log10(x))) AS m FROM v)),
    k AS (SELECT catalog_id, field, d, count(*) AS c FROM d GROUP BY ALL),
    f AS (SELECT catalog_id, field, CAST(sum(c) AS BIGINT) AS n, sum(c * c / log10(1e0 + 1e0 / d)) AS s FROM k GROUP BY ALL HAVING sum(c) >= 30),
    g AS (SELECT catalog_id, avg(least(1e0, greatest(0e0, 1e0 - (s / n - n) / 31.02e0))) AS score, min(n) AS n_used, count(*) AS n_fields FROM f GROUP BY catalog_id)
    SELECT catalog_id, round(score, 6) AS score, score IS NOT NULL AS applicable, n_used, coalesce(n_fields, 0) AS n_fields FROM (SELECT DISTINCT catalog_id FROM cat) LEFT JOIN g USING (catalog_id)""",
    "a2_gutenberg_richter": _CAT + _MC + """SELECT catalog_id, round(CASE WHEN ok THEN least(1e0, greatest(0e0, 1e0 - (abs(b - 1e0) - 0.5e0))) END, 6) AS score, ok AS applicable, n_above AS n_used, round(b, 6) AS b, round(mc, 6) AS mc
      FROM (SELECT *, n >= 30 AND n_above >= 10 AND b IS NOT NULL AS ok FROM b)""",
    "a3_clusters": _CAT + f"""SELECT a.catalog_id, a.record_id AS main_id, count(*) AS n, round(sum((b.t - a.t) / 86400e0), 5) AS days
      FROM cat a JOIN cat b ON a.catalog_id = b.catalog_id AND b.t > a.t AND b.t - a.t <= 2592000e0 AND b.magnitude < a.magnitude
      WHERE a.magnitude >= 5.5e0 AND a.latitude + a.longitude + b.latitude + b.longitude IS NOT NULL AND {DIST} <= pow(10e0, 0.1238e0 * a.magnitude + 0.983e0) GROUP BY ALL HAVING count(*) >= 5""",
    "a5_near_duplicates": _CAT + f""", e AS (SELECT row_number() OVER () AS e, * FROM (SELECT catalog_id, t, latitude, longitude, magnitude, count(*) AS copies FROM cat
        WHERE t IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL AND magnitude IS NOT NULL GROUP BY ALL)),
      near AS (SELECT DISTINCT a.e FROM e a JOIN e b ON a.catalog_id = b.catalog_id AND a.e <> b.e AND abs(a.t - b.t) <= 5 AND abs(a.magnitude - b.magnitude) <= 0.05e0 + 1e-9 WHERE {DIST} <= 2),
      fl AS (SELECT catalog_id, CAST(sum(copies) AS BIGINT) AS n_flagged FROM e WHERE copies > 1 OR e IN (SELECT e FROM near) GROUP BY catalog_id)
      SELECT catalog_id, round(CASE WHEN n < 2 THEN 1e0 ELSE 1e0 - coalesce(n_flagged, 0) / n END, 6) AS score, true AS applicable, coalesce(n_flagged, 0) AS n_flagged FROM (SELECT catalog_id, count(*) AS n FROM cat GROUP BY 1) LEFT JOIN fl USING (catalog_id)""",
    "a6_source_mc": "WITH " + _REF[2:] + ", cat AS (SELECT source_id AS catalog_id, magnitude FROM ref)" + _MC + "SELECT s.source_id, round(CASE WHEN mc IS NULL THEN 4.5e0 ELSE greatest(mc, 4.5e0) END, 6) AS mc, mc IS NULL AS is_default FROM (SELECT DISTINCT source_id FROM ref) s LEFT JOIN mc ON mc.catalog_id = s.source_id",
    "a6_matches": "WITH cat AS (SELECT DISTINCT network AS catalog_id, report_id AS record_id, epoch_us(origin_time) / 1e6 AS t, CASE WHEN isfinite(latitude) THEN latitude END AS latitude, CASE WHEN isfinite(longitude) THEN longitude END AS longitude, CASE WHEN isfinite(magnitude) THEN magnitude END AS magnitude FROM local_bulletin)" + _MATCH + " SELECT * FROM hit",
    "a6_vote_sums": _FIXED + " SELECT catalog_id, CAST(sum(nq) AS BIGINT) AS n_queried, CAST(sum(nm) AS BIGINT) AS n_matched, CAST(sum(nc) AS BIGINT) AS n_corroborating, round(sum(wt), 6) AS weighted FROM v GROUP BY 1",
    "a6_states": _FIXED + """, g AS (SELECT catalog_id, count(*) AS n_stratum, count(*) FILTER (nm >= 1) AS co, count(*) FILTER (nm = 0 AND nq >= 2) AS el FROM v WHERE nq > 0 GROUP BY 1),
      p AS (SELECT *, CASE WHEN co + el >= 20 THEN (SELECT sum(exp(lgamma(co + el + 1) - lgamma(i + 1) - lgamma(co + el - i + 1) + (co + el) * ln(0.5e0))) FROM range(0, co + 1) r(i)) END AS p FROM g),
      z AS (SELECT *, coalesce(p < 0.01e0, false) AS confirmed, co + CASE WHEN coalesce(p < 0.01e0, false) THEN el ELSE 0 END AS ne FROM p)
      SELECT catalog_id, round(CASE WHEN ne > 0 THEN co / ne END, 6) AS score, ne > 0 AS applicable, ne AS n_used, n_stratum, co AS n_corroborated, el AS n_eligible, confirmed, round(p, 6) AS p_value FROM z""",
    "subtest_p4_tsunami": _CAT + """SELECT catalog_id, round(CASE WHEN known > 0 THEN CASE WHEN n = 0 THEN 1e0 ELSE 1e0 - k / n END END, 6) AS score, known > 0 AS applicable, n AS n_used, k AS n_violations FROM (
      SELECT catalog_id, count(tsunami_flag) AS known, count(*) FILTER (tsunami_flag > 0.5e0) AS n, count(*) FILTER (tsunami_flag > 0.5e0 AND magnitude IS NOT NULL AND depth_km IS NOT NULL AND NOT (magnitude >= 6.5e0 AND depth_km <= 100)) AS k FROM cat GROUP BY catalog_id)""",
    "subtest_p5_rupture": _share("rupture_length_km IS NOT NULL AND magnitude IS NOT NULL", """abs(log10(greatest(rupture_length_km, 1e-6)) - (CASE mechanism WHEN 'strike-slip' THEN -3.55e0 + 0.74e0 * magnitude WHEN 'reverse' THEN -2.86e0 + 0.63e0 * magnitude
      WHEN 'normal' THEN -2.01e0 + 0.50e0 * magnitude ELSE -3.22e0 + 0.69e0 * magnitude END)) > 3e0 * CASE mechanism WHEN 'strike-slip' THEN 0.23e0 WHEN 'reverse' THEN 0.20e0 WHEN 'normal' THEN 0.21e0 ELSE 0.22e0 END"""),
    "subtest_p6_moment": _share("seismic_moment_n_m > 0 AND magnitude IS NOT NULL", "abs((2e0 / 3e0) * log10(seismic_moment_n_m) - 6.07e0 - magnitude) > 0.3e0"),
    "subtest_p7_timestamps": _CAT + """SELECT catalog_id, round(CASE WHEN n >= 2 THEN d / n END, 6) AS score, n >= 2 AS applicable, n AS n_used, n - d AS n_repeated FROM (
      SELECT catalog_id, count(origin_time) AS n, count(DISTINCT origin_time) AS d FROM cat WHERE origin_time IS NOT NULL GROUP BY catalog_id)""",
    "subtest_p9_intensity": _share("mmi IS NOT NULL AND station_distance_km IS NOT NULL AND magnitude IS NOT NULL", "abs((mmi + 3.29e0 + 0.0206e0 * station_distance_km) / 1.68e0 - magnitude) > 0.75e0"),
    "c1_missingness": _CAT + """SELECT catalog_id, round(1e0 - ((1e0 - count(origin_time) / count(*)) + (1e0 - count(latitude) / count(*)) + (1e0 - count(longitude) / count(*)) + (1e0 - count(depth_km) / count(*)) + (1e0 - count(magnitude) / count(*))) / 5e0, 6) AS score,
      true AS applicable, count(*) AS n_used FROM cat GROUP BY catalog_id""",
    "c3_coverage": _CAT + f""", r AS (SELECT * FROM cat WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND t IS NOT NULL),
      x AS (SELECT catalog_id, min(latitude) AS a_latitude, max(latitude) AS z_latitude, min(longitude) AS a_longitude, max(longitude) AS z_longitude, min(t) AS a_t, max(t) AS z_t, count(*) AS n FROM r GROUP BY 1 HAVING count(*) >= 30),
      c AS (SELECT catalog_id, n, {_cell('latitude', 5)} AS i, {_cell('longitude', 5)} AS j, {_cell('t', 10)} AS k, count(*) AS c FROM r JOIN x USING (catalog_id) GROUP BY ALL),
      f AS (SELECT catalog_id, n, count(*) AS filled, count(*) FILTER ((c - n / 250e0) / sqrt(n / 250e0) < -1.96e0) AS few FROM c GROUP BY ALL),
      g AS (SELECT catalog_id, n, few + CASE WHEN -sqrt(n / 250e0) < -1.96e0 THEN 250 - filled ELSE 0 END AS fl FROM f)
      SELECT catalog_id, round(1e0 - fl / 250e0, 6) AS score, true AS applicable, n AS n_used, CAST(fl AS BIGINT) AS n_flagged FROM g""",
    "c4_strata": _CAT + f""", r AS (SELECT * FROM cat WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND magnitude IS NOT NULL),
      x AS (SELECT catalog_id, min(latitude) AS a_latitude, max(latitude) AS z_latitude, min(longitude) AS a_longitude, max(longitude) AS z_longitude, count(*) AS n FROM r GROUP BY 1 HAVING count(*) >= 30),
      c AS (SELECT catalog_id, n, {_cell('latitude', 4)} AS i, {_cell('longitude', 4)} AS j, count(*) AS c FROM r JOIN x USING (catalog_id) GROUP BY ALL)
      SELECT catalog_id, round(count(*) FILTER (c >= 30) / count(*), 6) AS score, true AS applicable, n AS n_used, count(*) AS n_strata, count(*) FILTER (c >= 30) AS n_sufficient FROM c GROUP BY catalog_id, n""",
    "i2_clipping": _CAT + _MC + """, w AS (SELECT *, mc + 0.75e0 * (top - mc) AS fl, n >= 50 AND n_above >= 20 AND b > 0 AS ok FROM b),
      o AS (SELECT catalog_id, count(*) FILTER (magnitude >= fl AND magnitude >= mc) AS observed FROM m JOIN w USING (catalog_id) GROUP BY 1)
      SELECT catalog_id, round(CASE WHEN ok THEN CASE WHEN fl >= top THEN 1e0 ELSE 1e0 - least(1e0, greatest(0e0, 1e0 - observed / (n_above * pow(10e0, -b * (fl - mc))))) END END, 6) AS score, coalesce(ok, false) AS applicable, n_above AS n_used, observed FROM w JOIN o USING (catalog_id)""",
    "i3_revision": _CAT + "SELECT catalog_id, round(count(*) FILTER (coalesce(revision_status, '') <> '') / count(*), 6) AS score, true AS applicable, count(*) AS n_used FROM cat GROUP BY catalog_id",
    "i4_levels": _CAT + f""", e AS (SELECT * REPLACE (coalesce(source, '') AS source) FROM cat WHERE t IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL),
      p AS (SELECT a.catalog_id, abs(a.t - b.t) AS dt, {DIST} AS km, abs(a.magnitude - b.magnitude) AS dm FROM e a JOIN e b ON a.catalog_id = b.catalog_id AND a.source <> b.source AND abs(a.t - b.t) <= 120 WHERE {DIST} <= 100)
      SELECT catalog_id, (dt >= 30)::INT + (dt >= 72)::INT + (dt >= 120)::INT AS l1, (km >= 25)::INT + (km >= 60)::INT + (km >= 100)::INT AS l2,
        CASE WHEN dm IS NULL THEN 4 ELSE (dm >= 0.25e0 * 0.6e0)::INT + (dm >= 0.6e0 * 0.6e0)::INT + (dm >= 0.6e0)::INT END AS l3, count(*) AS n_pairs FROM p GROUP BY ALL""",
    "i5_drift": _CAT + """, r AS (SELECT catalog_id, magnitude, row_number() OVER (PARTITION BY catalog_id ORDER BY t, record_id) AS rn, count(*) OVER (PARTITION BY catalog_id) AS n FROM cat WHERE magnitude IS NOT NULL AND t IS NOT NULL),
      v AS (SELECT catalog_id, n, magnitude, count(*) FILTER (rn <= n // 2) AS a, count(*) FILTER (rn > n // 2) AS b FROM r WHERE n >= 40 GROUP BY ALL),
      g AS (SELECT catalog_id, n, abs(sum(a) OVER w / (n // 2) - sum(b) OVER w / (n - n // 2)) AS gap FROM v WINDOW w AS (PARTITION BY catalog_id ORDER BY magnitude))
      SELECT catalog_id, round(1e0 - max(gap), 6) AS score, true AS applicable, n AS n_used FROM g GROUP BY ALL""",
    "mc_and_b": _CAT + _MC + "SELECT catalog_id, n, round(mc, 6) AS mc, n_above, round(b, 6) AS b, round(2.30e0 * b * b * sqrt(var / n_above), 6) AS shi_bolt, round(b / sqrt(n_above), 6) AS aki_error FROM b",
    "waiting_times": _CAT + "SELECT catalog_id, count(*) AS n_gaps, round(max(gap), 5) AS longest, round(sum(gap), 3) AS total FROM (SELECT catalog_id, t - lag(t) OVER (PARTITION BY catalog_id ORDER BY t) AS gap FROM cat WHERE t IS NOT NULL) WHERE gap > 0 GROUP BY catalog_id",
    "time_ranks": _CAT + "SELECT catalog_id, record_id, row_number() OVER (PARTITION BY catalog_id ORDER BY t, record_id) AS rn, count(*) OVER (PARTITION BY catalog_id) AS n FROM cat WHERE t IS NOT NULL",
}
