"""The sub-tests of the audit. Each takes the catalogs together and gives a row for each catalog_id.

Inputs are canonical catalogs (see quakeledger.catalog) with ``t``, seconds since 1970. Results have score (null where the
test doesn't apply), applicable, n_used and the figures behind them. A catalog is never gathered in one task: row-local
tests are pre-aggregated sums, pairs come from bucketed joins, and what goes to a numeric kernel is bounded (a sample, a
histogram, or sums by pattern).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quakeledger.functions.estimators import correlation_dimension, fit_binned, fit_omori, linkage_fits, little_tests, mann_kendall_z, mc_bootstrap_se, omori_edges, sen_slope
from quakeledger.functions.scalars import AUDIT_RADIUS_KM, aftershock_radius_km, comparison_level, haversine_km, leading_digit
from quakeledger.functions.tails import binomial_lower, binomial_upper
from quakeledger.operators.interval import exact_median, hash_sample, interval_join, nearest_km, positive_gaps, ranked
from quakeledger.runtime import checkpoint, fetch_bounded, spread

# Fixed values of the audit.
DEPTH_KM, MAGNITUDE = (-5.0, 750.0), (-2.5, 9.5)
GATE_TOLERANCE, GATE_ALPHA, GATE_FAMILY = 0.001, 0.01, 3
RUPTURE_BY_MECHANISM = {"all": (-3.22, 0.69, 0.22), "strike-slip": (-3.55, 0.74, 0.23), "reverse": (-2.86, 0.63, 0.20), "normal": (-2.01, 0.50, 0.21)}
BENFORD_CRITICAL = 15.51
MC_TOLERANCE, DRIFT_TOLERANCE = 0.3, 0.05
LEAST_REFERENCE_MC, DEFAULT_MC_ERROR = 4.5, 0.3
AUTHENTIC_SHARE, LEAST_SOURCES, LEAST_STRATUM, CONTRADICTED_ALPHA = 0.50, 2, 20, 0.01
MOST_CLUSTERS, DIMENSION_POINTS, TREND_POINTS = 2_000, 1_500, 2_000


def clip01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def ratio(a, b) -> Column:
    return F.try_divide(a, b)


# --- row-local tests: one aggregation ---------------------------------------------------------------------------------


def place_out_of_bounds() -> Column:
    return F.coalesce(F.abs("latitude") > 90, F.lit(False)) | F.coalesce(F.abs("longitude") > 180, F.lit(False))


def depth_out_of_bounds() -> Column:
    return F.coalesce(~F.col("depth_km").between(*DEPTH_KM), F.lit(False))


def magnitude_out_of_bounds() -> Column:
    return F.coalesce(~F.col("magnitude").between(*MAGNITUDE), F.lit(False))


def _rupture_off() -> Column:
    """Beyond three deviations of the length expected for the magnitude and mechanism (unknown mechanisms: all)."""
    pick = lambda i: F.coalesce(*(F.when(F.col("mechanism") == m, F.lit(v[i])) for m, v in RUPTURE_BY_MECHANISM.items() if m != "all"), F.lit(RUPTURE_BY_MECHANISM["all"][i]))
    expected = pick(0) + pick(1) * F.col("magnitude")
    return F.abs(F.log10(F.greatest(F.col("rupture_length_km"), F.lit(1e-6))) - expected) > 3.0 * pick(2)


def row_stats(cat: DataFrame) -> DataFrame:
    """Counts of all row-local tests for each catalog, in one pass with partial aggregation."""
    both = lambda *c: F.expr(" AND ".join(f"{x} IS NOT NULL" for x in c))
    flagged = F.col("tsunami_flag") > 0.5
    moment = both("magnitude") & (F.col("seismic_moment_n_m") > 0)
    predicted = (2.0 / 3.0) * F.log10("seismic_moment_n_m") - 6.07
    intensity = (F.col("mmi") + 3.29 + 0.0206 * F.col("station_distance_km")) / 1.68
    return cat.groupBy("catalog_id").agg(
        F.count("*").alias("n"),
        F.count_if(place_out_of_bounds()).alias("p1_k"), F.count_if(depth_out_of_bounds()).alias("p2_k"), F.count_if(magnitude_out_of_bounds()).alias("p3_k"),
        F.count("tsunami_flag").alias("p4_known"), F.count_if(flagged).alias("p4_n"),
        F.count_if(flagged & both("magnitude", "depth_km") & ~((F.col("magnitude") >= 6.5) & (F.col("depth_km") <= 100.0))).alias("p4_k"),
        F.count_if(both("rupture_length_km", "magnitude")).alias("p5_n"), F.count_if(both("rupture_length_km", "magnitude") & _rupture_off()).alias("p5_k"),
        F.count_if(moment).alias("p6_n"), F.count_if(moment & (F.abs(predicted - F.col("magnitude")) > 0.3)).alias("p6_k"),
        F.count("origin_time").alias("p7_n"),
        F.count_if(both("mmi", "station_distance_km", "magnitude")).alias("p9_n"), F.count_if(F.abs(intensity - F.col("magnitude")) > 0.75).alias("p9_k"),
        *(F.count(c).alias(f"c1_{c}") for c in ("origin_time", "latitude", "longitude", "depth_km", "magnitude")),
        F.count_if(F.coalesce(F.col("revision_status"), F.lit("")) != "").alias("i3_k"),
    )


def gates(stats: DataFrame) -> DataFrame:
    """Stage 1: for each bound k, n and P(X >= k); fired where a probability is below alpha / family."""
    out = stats.select("catalog_id", "n", "p1_k", "p2_k", "p3_k", *(binomial_upper(F.col(f"{p}_k"), F.col("n"), F.lit(GATE_TOLERANCE)).alias(f"{p}_p") for p in ("p1", "p2", "p3")))
    return out.withColumn("fired", F.least("p1_p", "p2_p", "p3_p") < GATE_ALPHA / GATE_FAMILY)


def quarantine(cat: DataFrame) -> DataFrame:
    """Records out of bounds in place, depth or magnitude, listed whether or not a gate fires."""
    return cat.where(place_out_of_bounds() | depth_out_of_bounds() | magnitude_out_of_bounds()).select("catalog_id", "record_id", place_out_of_bounds().alias("p1"), depth_out_of_bounds().alias("p2"), magnitude_out_of_bounds().alias("p3"))


def share_kept(stats: DataFrame, test: str) -> DataFrame:
    """The share of checked records without a violation."""
    k, n = F.col(f"{test}_k"), F.col(f"{test}_n")
    return stats.select("catalog_id", F.when(n > 0, 1.0 - k / n).alias("score"), (n > 0).alias("applicable"), n.alias("n_used"), k.alias("n_violations"))


def p4_tsunami(stats: DataFrame) -> DataFrame:
    """Flagged events must be at least of magnitude 6.5 and at most 100 km deep; missing values stay in the denominator."""
    score = F.when(F.col("p4_known") > 0, F.when(F.col("p4_n") == 0, 1.0).otherwise(1.0 - ratio(F.col("p4_k"), F.col("p4_n"))))
    return stats.select("catalog_id", score.alias("score"), (F.col("p4_known") > 0).alias("applicable"), F.col("p4_n").alias("n_used"), F.col("p4_k").alias("n_violations"))


def p7_timestamps(cat: DataFrame) -> DataFrame:
    """The share of distinct clocks among all; distinct clocks are counted in two steps, so hot clocks and catalogs do no harm."""
    by_t = cat.where("origin_time IS NOT NULL").groupBy("catalog_id", "origin_time").agg(F.count("*").alias("c"))
    got = by_t.groupBy("catalog_id").agg(F.sum("c").alias("n"), F.count("*").alias("d"))
    return got.select("catalog_id", F.when(F.col("n") >= 2, F.col("d") / F.col("n")).alias("score"), (F.col("n") >= 2).alias("applicable"), F.col("n").alias("n_used"), (F.col("n") - F.col("d")).alias("n_repeated"))


def c1_missingness(stats: DataFrame) -> DataFrame:
    rates = [1.0 - F.col(f"c1_{c}") / F.col("n") for c in ("origin_time", "latitude", "longitude", "depth_km", "magnitude")]
    return stats.select("catalog_id", (1.0 - sum(rates[1:], rates[0]) / 5.0).alias("score"), F.lit(True).alias("applicable"), F.col("n").alias("n_used"))


def i3_revision(stats: DataFrame) -> DataFrame:
    return stats.select("catalog_id", (F.col("i3_k") / F.col("n")).alias("score"), F.lit(True).alias("applicable"), F.col("n").alias("n_used"))


# --- distributions ----------------------------------------------------------------------------------------------------


def a1_benford(cat: DataFrame) -> DataFrame:
    """Leading digits of moments, depths and waiting times (days) against Benford's law; the mean over fields with 30 values."""
    gaps = positive_gaps(cat, "catalog_id", "t").select("catalog_id", F.lit("gap").alias("field"), (F.col("gap") / 86_400.0).alias("x"))
    values = cat.select("catalog_id", F.explode(F.array(F.struct(F.lit("moment").alias("field"), F.col("seismic_moment_n_m").alias("x")), F.struct(F.lit("depth").alias("field"), F.col("depth_km").alias("x")))).alias("v")).select("catalog_id", "v.*").where("x > 0")
    digits = values.unionByName(gaps).withColumn("d", leading_digit("x")).groupBy("catalog_id", "field", "d").agg(F.count("*").alias("c"))
    counted = digits.groupBy("catalog_id", "field").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c") / F.log10(1.0 + 1.0 / F.col("d"))).alias("s")).where("n >= 30")
    # Sum of (o - e)^2 / e over nine digits is sum of o^2 / e minus n.
    score = clip01(1.0 - (F.col("s") / F.col("n") - F.col("n")) / (2 * BENFORD_CRITICAL))
    got = counted.groupBy("catalog_id").agg(F.avg(score).alias("score"), F.min("n").alias("n_used"), F.count("*").alias("n_fields"))
    return cat.select("catalog_id").distinct().join(got, "catalog_id", "left").select("catalog_id", "score", F.col("score").isNotNull().alias("applicable"), "n_used", F.coalesce("n_fields", F.lit(0)).alias("n_fields"))


def magnitude_bins(cat: DataFrame, width: float = 0.1) -> DataFrame:
    """(catalog_id, n, low, mc): the lower edge of the fullest bin, the lowest on ties; the value itself without spread."""
    m = cat.where("magnitude IS NOT NULL").groupBy("catalog_id", "magnitude").agg(F.count("*").alias("c"))
    ends = m.groupBy("catalog_id").agg(F.min("magnitude").alias("low"), F.max("magnitude").alias("high"), F.sum("c").alias("n"))
    bins = m.join(ends, "catalog_id").groupBy("catalog_id", "low", "high", "n", F.floor((F.col("magnitude") - F.col("low")) / width + 1e-9).alias("bin")).agg(F.sum("c").alias("c"))
    best = bins.groupBy("catalog_id", "low", "high", "n").agg(F.max_by("bin", F.struct("c", -F.col("bin"))).alias("bin"))
    mc = F.when(F.col("n") < 2, None).when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") + F.col("bin") * width)
    return best.select("catalog_id", "n", "low", "high", mc.alias("mc"))


def b_values(cat: DataFrame, mc: DataFrame | None = None) -> DataFrame:
    """B by Aki above mc, with Shi and Bolt's and Aki's errors."""
    mc = magnitude_bins(cat) if mc is None else mc
    above = cat.where("magnitude IS NOT NULL").join(mc, "catalog_id").where(F.col("magnitude") >= F.col("mc"))
    got = above.groupBy("catalog_id", "n", "mc").agg(F.count("*").alias("n_above"), F.avg("magnitude").alias("mean"), F.var_samp("magnitude").alias("var"), F.max("magnitude").alias("top"))
    b = F.when(F.col("mean") > F.col("mc") - 0.05, F.log10(F.exp(F.lit(1.0))) / (F.col("mean") - (F.col("mc") - 0.05)))
    got = got.withColumn("b", b)
    return got.withColumn("shi_bolt", 2.30 * F.col("b") * F.col("b") * F.sqrt(ratio(F.col("var"), F.col("n_above")))).withColumn("aki_error", F.col("b") / F.sqrt("n_above"))


def a2_gutenberg_richter(b: DataFrame) -> DataFrame:
    ok = (F.col("n") >= 30) & (F.col("n_above") >= 10) & F.col("b").isNotNull()
    return b.select("catalog_id", F.when(ok, clip01(1.0 - (F.abs(F.col("b") - 1.0) - 0.5))).alias("score"), ok.alias("applicable"), F.col("n_above").alias("n_used"), "b", "mc")


def i2_clipping(cat: DataFrame, b: DataFrame) -> DataFrame:
    """Events in the upper quarter of the magnitudes above mc against what the fitted b predicts there."""
    b = b.withColumn("floor", F.col("mc") + 0.75 * (F.col("top") - F.col("mc")))
    tail = cat.where("magnitude IS NOT NULL").join(b.select("catalog_id", "mc", "floor"), "catalog_id").groupBy("catalog_id").agg(F.count_if((F.col("magnitude") >= F.col("floor")) & (F.col("magnitude") >= F.col("mc"))).alias("observed"))
    got = b.join(tail, "catalog_id")
    predicted = F.col("n_above") * F.pow(F.lit(10.0), -F.col("b") * (F.col("floor") - F.col("mc")))
    ok = (F.col("n") >= 50) & (F.col("n_above") >= 20) & (F.col("b") > 0)
    score = F.when(F.col("floor") >= F.col("top"), 1.0).otherwise(1.0 - clip01(1.0 - ratio(F.col("observed"), predicted)))
    return got.select("catalog_id", F.when(ok, score).alias("score"), F.coalesce(ok, F.lit(False)).alias("applicable"), F.col("n_above").alias("n_used"), "observed", predicted.alias("predicted"))


def mc_errors(mags: DataFrame) -> DataFrame:
    """(catalog_id, n, sigma): R1, the bootstrap error of mc. mags: catalog_id, magnitude.

    The kernel gets each catalog's magnitudes in steps of 0.01 with their counts, so a catalog's size doesn't matter.
    """
    m = mags.where("magnitude IS NOT NULL").groupBy("catalog_id", F.round("magnitude", 2).alias("v")).agg(F.count("*").alias("c"))
    lists = m.groupBy("catalog_id").agg(F.array_sort(F.collect_list(F.struct("v", "c"))).alias("x"), F.sum("c").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sigma = [mc_bootstrap_se(np.asarray(v, float), np.asarray(c, float)) for v, c in zip(b["v"], b["c"])]
            yield pd.DataFrame({"catalog_id": b["catalog_id"], "n": b["n"], "sigma": pd.Series(sigma, index=b.index, dtype=float)})

    got = spread(lists.select("catalog_id", "n", F.col("x.v").alias("v"), F.col("x.c").alias("c")), "catalog_id").mapInPandas(run, "catalog_id string, n long, sigma double")
    return got.withColumn("sigma", F.nanvl("sigma", F.lit(None)))


def c2_mc_adequacy(cat: DataFrame) -> DataFrame:
    """One minus the bootstrap error of mc over 0.3."""
    got = mc_errors(cat.select("catalog_id", "magnitude"))
    ok = (F.col("n") >= 30) & F.col("sigma").isNotNull()
    return got.select("catalog_id", F.when(ok, clip01(1.0 - F.col("sigma") / MC_TOLERANCE)).alias("score"), ok.alias("applicable"), F.col("n").alias("n_used"), "sigma")


def _grid(x: str, low: str, high: str, k: int) -> Column:
    """Number of the equal-width cell of a value between low and high; without spread all are in one."""
    w = (F.col(high) - F.col(low)) / k
    return F.when(w > 0, F.least(F.floor((F.col(x) - F.col(low)) / w), F.lit(k - 1))).otherwise(F.lit(k - 1)).cast("int")


def c3_coverage(cat: DataFrame) -> DataFrame:
    """Cells of a 5 x 5 x 10 grid of place and time with significantly few events; empty cells count."""
    rows = cat.where("latitude IS NOT NULL AND longitude IS NOT NULL AND t IS NOT NULL")
    ends = rows.groupBy("catalog_id").agg(*(f(c).alias(f"{c}_{s}") for c in ("latitude", "longitude", "t") for f, s in ((F.min, "a"), (F.max, "z"))), F.count("*").alias("n")).where("n >= 30")
    cells = rows.join(ends, "catalog_id").groupBy("catalog_id", "n", _grid("latitude", "latitude_a", "latitude_z", 5).alias("i"), _grid("longitude", "longitude_a", "longitude_z", 5).alias("j"), _grid("t", "t_a", "t_z", 10).alias("k")).agg(F.count("*").alias("c"))
    rate = F.col("n") / 250.0
    low = lambda c: (c - rate) / F.sqrt(rate) < -1.96
    got = cells.groupBy("catalog_id", "n").agg(F.count("*").alias("filled"), F.count_if(low(F.col("c"))).alias("few"))
    flagged = F.col("few") + F.when(low(F.lit(0.0)), 250 - F.col("filled")).otherwise(0)
    return got.select("catalog_id", (1.0 - flagged / 250.0).alias("score"), F.lit(True).alias("applicable"), F.col("n").alias("n_used"), flagged.cast("long").alias("n_flagged"))


def c4_strata(cat: DataFrame, least: int = 30) -> DataFrame:
    """The share of filled cells of a 4 x 4 grid with at least 30 events."""
    rows = cat.where("latitude IS NOT NULL AND longitude IS NOT NULL AND magnitude IS NOT NULL")
    ends = rows.groupBy("catalog_id").agg(*(f(c).alias(f"{c}_{s}") for c in ("latitude", "longitude") for f, s in ((F.min, "a"), (F.max, "z"))), F.count("*").alias("n")).where(F.col("n") >= least)
    cells = rows.join(ends, "catalog_id").groupBy("catalog_id", "n", _grid("latitude", "latitude_a", "latitude_z", 4).alias("i"), _grid("longitude", "longitude_a", "longitude_z", 4).alias("j")).agg(F.count("*").alias("c"))
    return cells.groupBy("catalog_id", "n").agg(F.count("*").alias("n_strata"), F.count_if(F.col("c") >= least).alias("n_sufficient")).select("catalog_id", (F.col("n_sufficient") / F.col("n_strata")).alias("score"), F.lit(True).alias("applicable"), F.col("n").alias("n_used"), "n_strata", "n_sufficient")


def magnitude_ranks(cat: DataFrame) -> DataFrame:
    """The magnitudes of each catalog with their ranks in order of time (rn, n), which I1 and I5 share."""
    rows = cat.where("magnitude IS NOT NULL AND t IS NOT NULL").select("catalog_id", "record_id", "t", "magnitude")
    return ranked(rows, "catalog_id", ["t", "record_id"])


def i5_ks(cat: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """One minus the two-sample statistic between the earlier and the later half of the magnitudes (the odd one is late)."""
    halves = (magnitude_ranks(cat) if ranks is None else ranks).withColumn("early", F.col("rn") <= F.floor(F.col("n") / 2))
    by_value = halves.groupBy("catalog_id", "n", "magnitude").agg(F.count_if("early").alias("a"), F.count_if(~F.col("early")).alias("b"))
    run = Window.partitionBy("catalog_id").orderBy("magnitude")
    gap = F.abs(F.sum("a").over(run) / F.floor(F.col("n") / 2) - F.sum("b").over(run) / (F.col("n") - F.floor(F.col("n") / 2)))
    got = by_value.where("n >= 40").withColumn("gap", gap).groupBy("catalog_id", "n").agg(F.max("gap").alias("d"))
    return got.select("catalog_id", (1.0 - F.col("d")).alias("score"), F.lit(True).alias("applicable"), F.col("n").alias("n_used"))


def i1_drift(cat: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """Trend of the magnitudes in order of time, on at most 2 000 evenly spaced ranks of each catalog."""
    got = (magnitude_ranks(cat) if ranks is None else ranks).where("n >= 30")
    # Rank r (from 0) is taken if it is the floor of i (n - 1) / (k - 1) for some i, which the smallest such i decides.
    k, r, n = TREND_POINTS, F.col("rn") - 1, F.col("n")
    i = F.ceil(r * (k - 1) / (n - 1))
    taken = (n <= k) | (F.floor(i * (n - 1) / (k - 1)) == r)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            trends = [mann_kendall_z(np.asarray(m)) for m in b["m"]]
            slopes = [sen_slope(np.asarray(t) / 86_400.0, np.asarray(m)) * 3_652.5 for t, m in zip(b["t"], b["m"])]
            yield b[["catalog_id", "n"]].assign(s=[s for s, _ in trends], z=[z for _, z in trends], slope=slopes)

    series = got.where(taken).groupBy("catalog_id", "n").agg(F.array_sort(F.collect_list(F.struct("rn", "t", "magnitude"))).alias("x"))
    series = series.select("catalog_id", "n", F.col("x.t").alias("t"), F.col("x.magnitude").alias("m"))
    fit = spread(series, "catalog_id").mapInPandas(run, "catalog_id string, n long, s double, z double, slope double").withColumn("slope", F.nanvl("slope", F.lit(None)))
    score = F.when(F.abs("z") > 1.96, clip01(1.0 - F.abs("slope") / DRIFT_TOLERANCE)).otherwise(1.0)
    return fit.select("catalog_id", F.when(F.col("slope").isNotNull(), score).alias("score"), F.col("slope").isNotNull().alias("applicable"), F.col("n").alias("n_used"), "s", "z", "slope")


def c1_little(cat: DataFrame) -> DataFrame:
    """Little's test on days, place, depth and magnitude: rows become sums by pattern, centred and scaled by catalog."""
    cols = ["t", "latitude", "longitude", "depth_km", "magnitude"]
    ends = cat.groupBy("catalog_id").agg(*(f(c).alias(f"{c}_{s}") for c in cols for f, s in ((F.avg, "m"), (F.stddev_pop, "s"))), F.count("*").alias("n")).where("n >= 20")
    z = [((F.col(c) - F.col(f"{c}_m")) / F.when(F.col(f"{c}_s") > 0, F.col(f"{c}_s")).otherwise(1.0)).alias(c) for c in cols]
    rows = cat.select("catalog_id", *cols).join(ends, "catalog_id").select("catalog_id", *z)
    mask = sum((F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(cols)), F.lit(0))
    x = [F.coalesce(c, F.lit(0.0)) for c in cols]
    pairs = [(i, j) for i in range(5) for j in range(i, 5)]
    sums = rows.withColumn("mask", mask).groupBy("catalog_id", "mask").agg(F.count("*").alias("n"), *(F.sum(x[i]).alias(f"s{i}") for i in range(5)), *(F.sum(x[i] * x[j]).alias(f"q{i}{j}") for i, j in pairs))

    numbers = ["n", *(f"s{i}" for i in range(5)), *(f"q{i}{j}" for i, j in pairs)]
    lists = sums.groupBy("catalog_id").agg(*(F.collect_list(c).alias(c) for c in ("mask", *numbers)))  # at most 32 patterns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            row = np.repeat(np.arange(len(b)), [len(x) for x in b["mask"]])
            if not len(row):
                continue
            mask = np.concatenate(list(b["mask"])).astype(int)
            flat = {c: np.concatenate([np.asarray(x, float) for x in b[c]]) for c in numbers}
            n, s, q = np.zeros((len(b), 32)), np.zeros((len(b), 32, 5)), np.zeros((len(b), 32, 5, 5))
            n[row, mask] = flat["n"]
            for i in range(5):
                s[row, mask, i] = flat[f"s{i}"]
            for i, j in pairs:
                q[row, mask, i, j] = q[row, mask, j, i] = flat[f"q{i}{j}"]
            r = little_tests(n, s, q)
            yield pd.DataFrame({"catalog_id": b["catalog_id"].to_numpy(), **{k: r[k] for k in ("d2", "df", "p_value", "n_patterns", "mcar")}})

    return spread(lists, "catalog_id").mapInPandas(run, "catalog_id string, d2 double, df long, p_value double, n_patterns long, mcar boolean")


# --- pairs ------------------------------------------------------------------------------------------------------------


def near_duplicates(cat: DataFrame, seconds: float = 5.0, km: float = 2.0, magnitudes: float = 0.05) -> DataFrame:
    """(catalog_id, t, latitude, longitude, magnitude, copies, flagged) of distinct events.

    An event is flagged if it has copies or another event within all three tolerances (bounds included). Copies are
    counted, not paired.
    """
    cols = ["catalog_id", "t", "latitude", "longitude", "magnitude"]
    events = cat.where(" AND ".join(f"{c} IS NOT NULL" for c in cols[1:])).groupBy(*cols).agg(F.count("*").alias("copies")).withColumn("e", F.xxhash64(*cols))
    other = events.select("catalog_id", *(F.col(c).alias(f"{c}_2") for c in ("t", "latitude", "longitude", "magnitude", "e")))
    pairs = interval_join(events, other, ["catalog_id"], "t", seconds, "t_2", "e", ("latitude", "latitude_2"), km)
    close = (F.col("e") != F.col("e_2")) & (F.abs(F.col("magnitude") - F.col("magnitude_2")) <= magnitudes + 1e-9) & (haversine_km("latitude", "longitude", "latitude_2", "longitude_2") <= km)
    near = pairs.where(close).select("catalog_id", "e").distinct().withColumn("near", F.lit(True))
    return events.join(near, ["catalog_id", "e"], "left").select(*cols, "copies", (F.coalesce("near", F.lit(False)) | (F.col("copies") > 1)).alias("flagged"))


def a5_duplicates(cat: DataFrame) -> DataFrame:
    """One minus flagged records over all records; a catalog of fewer than two scores 1."""
    flagged = near_duplicates(cat).where("flagged").groupBy("catalog_id").agg(F.sum("copies").alias("n_flagged"))
    got = cat.groupBy("catalog_id").agg(F.count("*").alias("n")).join(flagged, "catalog_id", "left").withColumn("n_flagged", F.coalesce("n_flagged", F.lit(0)))
    return got.select("catalog_id", F.when(F.col("n") < 2, 1.0).otherwise(1.0 - F.col("n_flagged") / F.col("n")).alias("score"), F.lit(True).alias("applicable"), F.when(F.col("n") >= 2, F.col("n")).alias("n_used"), "n_flagged")


def aftershock_pairs(cat: DataFrame, least: float = 5.5, days: float = 30.0) -> DataFrame:
    """(catalog_id, main_id, dt days): later, smaller events within 30 days and the mainshock's radius."""
    cols = ["catalog_id", "record_id", "t", "latitude", "longitude", "magnitude"]
    rows = cat.where(" AND ".join(f"{c} IS NOT NULL" for c in cols)).select(*cols)
    mains = rows.where(F.col("magnitude") >= least).select("catalog_id", *(F.col(c).alias(f"{c}_1") for c in cols[1:]))
    # At the largest valid magnitude the radius is 145 km, so pairs also share a band of latitude. The few mainshocks of a
    # wrong, larger magnitude reach farther and are joined by time alone.
    span = days * 86_400.0
    valid = F.col("magnitude_1") <= MAGNITUDE[1]
    pairs = interval_join(rows, mains.where(valid), ["catalog_id"], "t", span, "t_1", "record_id", ("latitude", "latitude_1"), AFTERSHOCK_KM)
    pairs = pairs.unionByName(interval_join(rows, mains.where(~valid), ["catalog_id"], "t", span, "t_1", "record_id"))
    dt = F.col("t") - F.col("t_1")
    inside = (dt > 0) & (dt <= span) & (F.col("magnitude") < F.col("magnitude_1")) & (haversine_km("latitude", "longitude", "latitude_1", "longitude_1") <= aftershock_radius_km("magnitude_1"))
    return pairs.where(inside).select("catalog_id", F.col("record_id_1").alias("main_id"), (dt / 86_400.0).alias("dt"))


#: More than the radius at the largest valid magnitude.
AFTERSHOCK_KM = 146.0
#: Aftershocks of a cluster that a task fits from the rows; larger ones are first reduced by aggregation, with the same result.
CLUSTER_EVENTS = 20_000
#: Equal slices of a large cluster's bin, in each of which times are ranked.
SLICES = 64


def large_fits(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """(catalog_id, main_id, p, degenerate) of clusters (with size, low, high: their first and last dt), from all their rows.

    A cluster is reduced to the counts of its bins and its distance from uniform. For that each distinct time is ranked
    within its slice of a bin; the slices before it, few to a cluster, give the rest of its rank. Clusters are large and
    so few enough to be broadcast.
    """
    key = ["catalog_id", "main_id"]

    def edged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x.assign(edges=[omori_edges(n, a, z).tolist() for n, a, z in zip(x["size"], x["low"], x["high"])])

    spread = clusters.where("low < high").select(*key, "size", "low", "high").mapInPandas(edged, "catalog_id string, main_id long, size long, low double, high double, edges array<double>")
    spread = checkpoint(spread)
    times = pairs.join(F.broadcast(spread.select(*key)), key).groupBy(*key, "dt").agg(F.count("*").alias("c")).join(F.broadcast(spread), key)
    inner = F.slice("edges", 2, F.size("edges") - 2)
    times = times.withColumn("bin", F.size(F.filter(inner, lambda e: e <= F.col("dt"))))
    lower, upper = F.get("edges", F.col("bin")), F.get("edges", F.col("bin") + 1)
    part = F.least(F.lit(SLICES - 1), F.greatest(F.lit(0), F.floor((F.col("dt") - lower) / (upper - lower) * SLICES))).cast("int")
    times = checkpoint(times.withColumn("part", part).select(*key, "size", "high", "dt", "c", "bin", "part"))
    sums = times.groupBy(*key, "bin", "part").agg(F.sum("c").alias("held"))
    before = F.sum("held").over(Window.partitionBy(*key).orderBy("bin", "part").rowsBetween(Window.unboundedPreceding, -1))
    sums = checkpoint(sums.withColumn("before", F.coalesce(before, F.lit(0))))
    upto = F.sum("c").over(Window.partitionBy(*key, "bin", "part").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0))
    ranks = times.withColumn("upto", upto).join(F.broadcast(sums), [*key, "bin", "part"]).withColumn("rank", F.col("before") + F.col("upto"))
    off = lambda rank: F.abs(rank / F.col("size") - F.col("dt") / F.col("high"))
    far = ranks.groupBy(*key).agg(F.max(F.greatest(off(F.col("rank")), off(F.col("rank") - F.col("c") + 1))).alias("far"))
    counts = sums.groupBy(*key, "bin").agg(F.sum("held").alias("n")).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("held"))
    bins = F.transform(F.sequence(F.lit(0), F.size("edges") - 2), lambda k: F.coalesce(F.element_at("held", k), F.lit(0)))
    figures = spread.join(far, key).join(counts, key).select(*key, "size", "edges", "far", bins.alias("counts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            fits = [fit_binned(int(n), np.asarray(e), np.asarray(c), far) for n, e, c, far in zip(x["size"], x["edges"], x["counts"], x["far"])]
            yield x[key].assign(p=[f["p"] for f in fits], degenerate=[f["degenerate"] for f in fits])

    schema = "catalog_id string, main_id long, p double, degenerate boolean"
    flat = clusters.where("low >= high").select(*key, F.lit(float("nan")).alias("p"), F.lit(True).alias("degenerate"))
    return figures.mapInPandas(run, schema).unionByName(flat)


def a3_omori(cat: DataFrame) -> DataFrame:
    """Fits the decay of clusters of at least 5 aftershocks; at most 2 000 clusters of a catalog, chosen by hash."""
    pairs = checkpoint(aftershock_pairs(cat))
    sizes = pairs.groupBy("catalog_id", "main_id").agg(F.count("*").alias("size"), F.min("dt").alias("low"), F.max("dt").alias("high")).where("size >= 5")
    found = sizes.groupBy("catalog_id").agg(F.count("*").alias("n_found"))
    kept = checkpoint(hash_sample(sizes, "catalog_id", ["main_id"], MOST_CLUSTERS))
    members = pairs.join(kept.where(F.col("size") <= CLUSTER_EVENTS), ["catalog_id", "main_id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fits = [fit_omori(np.asarray(x)) for x in b["dt"]]
            yield b[["catalog_id", "main_id"]].assign(p=[f["p"] for f in fits], degenerate=[f["degenerate"] for f in fits])

    lists = members.groupBy("catalog_id", "main_id").agg(F.collect_list("dt").alias("dt"))  # at most CLUSTER_EVENTS each
    fits = spread(lists, "catalog_id", "main_id").mapInPandas(run, "catalog_id string, main_id long, p double, degenerate boolean")
    large = kept.where(F.col("size") > CLUSTER_EVENTS)
    if large.limit(1).count():
        fits = fits.unionByName(large_fits(pairs, large))
    good = ~F.col("degenerate")
    got = fits.groupBy("catalog_id").agg(F.count("*").alias("n_fits"), F.count_if(good).alias("n_valid"), F.avg(F.when(good, 1.0 - F.least(F.lit(1.0), F.abs(F.col("p") - 1.2) / 1.2))).alias("fit")).join(found, "catalog_id")
    score = 0.5 * F.col("n_valid") / F.col("n_fits") + 0.5 * F.coalesce("fit", F.lit(0.0))
    return cat.select("catalog_id").distinct().join(got, "catalog_id", "left").select("catalog_id", score.alias("score"), F.col("n_fits").isNotNull().alias("applicable"), F.col("n_found").alias("n_used"), "n_valid")


def projection_centres(cat: DataFrame) -> DataFrame:
    """(catalog_id, n, pivot, lat0, lon0): each catalog's places, the circular mean of their longitudes and their exact medians,

    longitudes unwrapped around the pivot.
    """
    rows = cat.where("latitude IS NOT NULL AND longitude IS NOT NULL").select("catalog_id", "latitude", "longitude")
    mean = lambda f: F.avg(f(F.radians("longitude")))
    pivot = checkpoint(rows.groupBy("catalog_id").agg(F.count("*").alias("n"), F.degrees(F.atan2(mean(F.sin), mean(F.cos))).alias("pivot")))
    both = F.array(F.struct(F.lit("lat0").alias("axis"), F.col("latitude").alias("x")), F.struct(F.lit("lon0").alias("axis"), unwrapped("longitude", "pivot").alias("x")))
    long = rows.join(pivot, "catalog_id").select("catalog_id", F.explode(both).alias("a")).select("catalog_id", "a.*")
    medians = exact_median(long, ["catalog_id", "axis"], "x").groupBy("catalog_id").pivot("axis", ["lat0", "lon0"]).agg(F.first("median"))
    return pivot.join(medians, "catalog_id")


def unwrapped(lon: str, around: str) -> Column:
    """A longitude within 180 degrees of another one."""
    return F.pmod(F.col(lon) - F.col(around) + 180.0, F.lit(360.0)) - 180.0 + F.col(around)


def projected_km(cat: DataFrame, centres: DataFrame | None = None) -> DataFrame:
    """(catalog_id, record_id, x_km, y_km): places on a local plane around the median place, longitudes unwrapped."""
    centres = projection_centres(cat) if centres is None else centres
    rows = cat.where("latitude IS NOT NULL AND longitude IS NOT NULL").select("catalog_id", "record_id", "latitude", "longitude").join(centres, "catalog_id")
    x = AUDIT_RADIUS_KM * F.radians(unwrapped("longitude", "lon0") - F.col("lon0")) * F.cos(F.radians("lat0"))
    return rows.select("catalog_id", "record_id", x.alias("x_km"), (AUDIT_RADIUS_KM * F.radians(F.col("latitude") - F.col("lat0"))).alias("y_km"))


def a4_fractal(cat: DataFrame, reference: float | None = None) -> DataFrame:
    """Correlation dimension of at most 1 500 places of each catalog, chosen by hash; 1 is full credit, 2 none."""
    centres = checkpoint(projection_centres(cat).where("n >= 50"))
    counts = centres.select("catalog_id", "n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fits = [correlation_dimension(np.column_stack([np.asarray(x), np.asarray(y)])) for x, y in zip(b["x"], b["y"])]
            yield b[["catalog_id"]].assign(dimension=pd.Series(fits, index=b.index, dtype=float))

    located = cat.where("latitude IS NOT NULL AND longitude IS NOT NULL").select("catalog_id", "record_id", "latitude", "longitude")
    drawn = projected_km(hash_sample(located.join(counts.select("catalog_id"), "catalog_id"), "catalog_id", ["record_id"], DIMENSION_POINTS), centres)
    lists = drawn.groupBy("catalog_id").agg(F.array_sort(F.collect_list(F.struct("record_id", "x_km", "y_km"))).alias("p"))
    lists = lists.select("catalog_id", F.col("p.x_km").alias("x"), F.col("p.y_km").alias("y"))
    fit = spread(lists, "catalog_id").mapInPandas(run, "catalog_id string, dimension double").withColumn("dimension", F.nanvl("dimension", F.lit(None)))
    score = clip01(2.0 - F.col("dimension")) if reference is None else clip01(1.0 - F.abs(F.col("dimension") - reference) / 0.5)
    got = fit.join(counts, "catalog_id")
    return got.select("catalog_id", score.alias("score"), F.col("dimension").isNotNull().alias("applicable"), F.col("n").alias("n_used"), "dimension")


def p8_proximity(cat: DataFrame, faults: DataFrame, decay_km: float = 300.0) -> DataFrame:
    """Mean of exp(-d / 300 km) over the distance to the nearest fault point."""
    got = nearest_km(cat.where("latitude IS NOT NULL AND longitude IS NOT NULL AND abs(latitude) <= 90").select("catalog_id", "latitude", "longitude"), faults)
    return got.groupBy("catalog_id").agg(F.avg(F.exp(-F.col("nearest_km") / decay_km)).alias("score"), F.lit(True).alias("applicable"), F.count("*").alias("n_used"), F.avg("nearest_km").alias("mean_km"))


def cross_source_pairs(cat: DataFrame, seconds: float = 120.0, km: float = 100.0) -> DataFrame:
    """Ordered pairs of distinct events of different sources within both tolerances, with their comparison levels.

    Events equal in all compared fields are one row with their number of copies (own, other), so that copies aren't
    paired one by one. A blank source is a source of its own.
    """
    cols = ["catalog_id", "t", "latitude", "longitude", "magnitude", "source"]
    events = cat.where("t IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL").withColumn("source", F.coalesce("source", F.lit(""))).groupBy(*cols).agg(F.count("*").alias("own")).withColumn("e", F.xxhash64(*cols))
    other = events.select("catalog_id", *(F.col(c).alias(f"{c}_2") for c in ("t", "latitude", "longitude", "magnitude", "source", "e")), F.col("own").alias("other"))
    pairs = interval_join(events, other, ["catalog_id"], "t", seconds, "t_2", "e", ("latitude", "latitude_2"), km)
    d = haversine_km("latitude", "longitude", "latitude_2", "longitude_2")
    pairs = pairs.where(F.col("source") != F.col("source_2")).withColumn("km", d).where(F.col("km") <= km)
    return pairs.select("catalog_id", "e", "own", "other", comparison_level(F.col("t") - F.col("t_2"), seconds).alias("l1"), comparison_level("km", km).alias("l2"), comparison_level(F.col("magnitude") - F.col("magnitude_2"), 0.6).alias("l3"))


def i4_dedup(cat: DataFrame) -> DataFrame:
    """The expected share of records with a counterpart of another source, by a linkage model fitted to level counts.

    The model sees each catalog's counts by level triple (at most 125 rows); the posteriors go back to the events.
    """
    pairs = checkpoint(cross_source_pairs(cat))  # the few that are near; read twice
    triple = (F.col("l1") * 25 + F.col("l2") * 5 + F.col("l3")).cast("int")
    triples = pairs.groupBy("catalog_id", triple.alias("k")).agg(F.sum(F.col("own") * F.col("other")).alias("c"))
    lists = triples.groupBy("catalog_id").agg(F.collect_list("k").alias("k"), F.collect_list("c").alias("c"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            row = np.repeat(np.arange(len(x)), [len(k) for k in x["k"]])
            w = np.zeros((len(x), 125))
            if len(row):
                w[row, np.concatenate(list(x["k"])).astype(int)] = np.concatenate([np.asarray(c, float) for c in x["c"]])
            yield pd.DataFrame({"catalog_id": x["catalog_id"].to_numpy(), "post": list(linkage_fits(w)[0])})

    post = spread(lists, "catalog_id").mapInPandas(run, "catalog_id string, post array<double>")
    pairs = pairs.join(post, "catalog_id").withColumn("p", F.get("post", triple)).drop("post")
    # One minus the product of (1 - p) over all counterparts, as a sum of logarithms.
    odds = F.sum(F.col("other") * F.log(F.greatest(F.lit(1e-300), 1.0 - F.col("p"))))
    owners = pairs.groupBy("catalog_id", "e", "own").agg((1.0 - F.exp(odds)).alias("dup"))
    dup = owners.groupBy("catalog_id").agg(F.sum(F.col("own") * F.col("dup")).alias("expected"))
    n_pairs = triples.groupBy("catalog_id").agg(F.sum("c").alias("n_pairs"))
    named = cat.where(F.coalesce(F.col("source"), F.lit("")) != "").groupBy("catalog_id", "source").agg(F.count("*")).groupBy("catalog_id").agg(F.count("*").alias("n_sources"))
    got = cat.groupBy("catalog_id").agg(F.count("*").alias("n")).join(named, "catalog_id", "left").join(dup, "catalog_id", "left").join(n_pairs, "catalog_id", "left")
    ok = F.coalesce(F.col("n_sources"), F.lit(0)) >= 2
    return got.select("catalog_id", F.when(ok, 1.0 - F.coalesce("expected", F.lit(0.0)) / F.col("n")).alias("score"), ok.alias("applicable"), F.col("n").alias("n_used"), F.when(ok, F.coalesce("n_pairs", F.lit(0))).alias("n_pairs"))


# --- the external reference -------------------------------------------------------------------------------------------


def reference_mc(refs: DataFrame) -> DataFrame:
    """(source_id, mc, mc_se, is_default) of each reference source: fitted, not below 4.5; 4.5 and 0.3 where it can't be."""
    m = refs.where("magnitude IS NOT NULL").select(F.col("source_id").alias("catalog_id"), "magnitude")

    se = mc_errors(m).select("catalog_id", F.col("sigma").alias("se"))
    got = refs.select(F.col("source_id").alias("catalog_id")).distinct().join(magnitude_bins(m), "catalog_id", "left").join(se, "catalog_id", "left")
    default = F.col("mc").isNull()
    return got.select(F.col("catalog_id").alias("source_id"), F.when(default, LEAST_REFERENCE_MC).otherwise(F.greatest("mc", F.lit(LEAST_REFERENCE_MC))).alias("mc"), F.when(default, DEFAULT_MC_ERROR).otherwise(F.col("se")).alias("mc_se"), default.alias("is_default"))


def reference_matches(cat: DataFrame, refs: DataFrame, seconds: float = 30.0, km: float = 50.0, magnitudes: float = 0.5) -> DataFrame:
    """(catalog_id, record_id, source_id) with a reference event within all three tolerances, each once."""
    rows = cat.where("t IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL AND magnitude IS NOT NULL").select("catalog_id", "record_id", "t", "latitude", "longitude", "magnitude")
    refs = refs.where("t IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL AND magnitude IS NOT NULL").select("source_id", *(F.col(c).alias(f"{c}_2") for c in ("t", "latitude", "longitude", "magnitude")))
    pairs = interval_join(rows, refs, [], "t", seconds, "t_2", "record_id", ("latitude", "latitude_2"), km)
    near = (F.abs(F.col("magnitude") - F.col("magnitude_2")) <= magnitudes + 1e-9) & (haversine_km("latitude", "longitude", "latitude_2", "longitude_2") <= km)
    return pairs.where(near).select("catalog_id", "record_id", "source_id").distinct()


def source_votes(cat: DataFrame, refs: DataFrame, mc: DataFrame | None = None) -> DataFrame:
    """For each record the sources that cover its magnitude, those that match it, and the weighted vote.

    A source covers magnitudes from its mc plus error; sources are few (bounded, held as an array), so records are not
    multiplied. Weights are 1 / mc, halved for a default mc, and sum to 1.
    """
    sources = fetch_bounded((reference_mc(refs) if mc is None else mc).orderBy("source_id"), 1_000, "the list of reference sources")
    raw = {r["source_id"]: (0.5 if r["is_default"] else 1.0) / r["mc"] for r in sources}
    weight = {s: w / sum(raw.values()) for s, w in raw.items()}
    matched = reference_matches(cat, refs).groupBy("catalog_id", "record_id").agg(F.collect_set("source_id").alias("by"))
    got = cat.select("catalog_id", "record_id", "magnitude").join(matched, ["catalog_id", "record_id"], "left")
    covers = {r["source_id"]: F.coalesce(F.col("magnitude") >= float(r["mc"] + r["mc_se"]), F.lit(False)) if r["mc_se"] == r["mc_se"] and r["mc_se"] is not None else F.lit(False) for r in sources}
    hit = {s: F.coalesce(F.array_contains("by", s), F.lit(False)) for s in covers}
    total = lambda cs: sum((c.cast("int") for c in cs), F.lit(0))
    return got.select(
        "catalog_id", "record_id", total(covers.values()).alias("n_queried"), total(covers[s] & hit[s] for s in covers).alias("n_matched"), total(hit.values()).alias("n_corroborating"),
        sum((F.when(hit[s], weight[s]).otherwise(0.0) for s in covers), F.lit(0.0)).alias("weighted"),
    )


def a6_external(votes: DataFrame) -> DataFrame:
    """The three states by catalog: corroborated, contradicted-eligible, unverifiable; score, verdict and counts.

    The stratum is what any source covers. Contradiction is confirmed where at least 20 records were queried and the
    matched share is significantly below one half.
    """
    corroborated, eligible = F.col("n_matched") >= 1, (F.col("n_matched") == 0) & (F.col("n_queried") >= LEAST_SOURCES)
    got = votes.where("n_queried > 0").groupBy("catalog_id").agg(F.count("*").alias("n_stratum"), F.count_if(corroborated).alias("n_corroborated"), F.count_if(eligible).alias("n_eligible"))
    got = got.withColumn("n_asked", F.col("n_corroborated") + F.col("n_eligible"))
    got = got.withColumn("p_value", F.when(F.col("n_asked") >= LEAST_STRATUM, binomial_lower(F.col("n_corroborated"), F.col("n_asked"), F.lit(AUTHENTIC_SHARE))))
    got = got.withColumn("confirmed", F.coalesce(F.col("p_value") < CONTRADICTED_ALPHA, F.lit(False)))
    n = F.col("n_corroborated") + F.when(F.col("confirmed"), F.col("n_eligible")).otherwise(0)
    return got.withColumn("n_effective", n).select("catalog_id", ratio(F.col("n_corroborated"), F.col("n_effective")).alias("score"), (F.col("n_effective") > 0).alias("applicable"), F.col("n_effective").alias("n_used"), "n_stratum", "n_corroborated", "n_eligible", "confirmed", "p_value")


def effective_records(votes: DataFrame, a6: DataFrame) -> DataFrame:
    """(catalog_id, record_id) of the records that A6 decides; the others are intrinsic."""
    got = votes.where("n_queried > 0").join(a6.select("catalog_id", "confirmed"), "catalog_id")
    return got.where((F.col("n_matched") >= 1) | (F.col("confirmed") & (F.col("n_queried") >= LEAST_SOURCES))).select("catalog_id", "record_id")
