"""From sub-test rows to a verdict for each catalog: axis scores, weights, evidence, gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Weights of the axes, and of the tests within each axis.
AXIS_WEIGHTS = {"A": 0.6894844988460549, "P": 0.16836943659202896, "C": 0.028258588896277272, "I": 0.11388747566563887}
AXIS_PRIORS = {"A": 0.514, "P": 0.216, "C": 0.073, "I": 0.197}
WITHIN = {
    "A1": 0.3761270287081997, "A2": 0.008668999147779084, "A3": 0.42246229044903777, "A4": 0.18974276547380506, "A5": 0.002998916221178312,
    "P4": 0.002239068172281027, "P5": 0.7657437676196038, "P6": 2.450103053546287e-15, "P7": 0.12608347509535475, "P8": 0.04993368911275801, "P9": 0.056,
    "C1": 0.0012354172361284206, "C2": 0.3372086862465165, "C3": 0.2280560865324849, "C4": 0.43349980998487014,
    "I1": 0.48778188493130464, "I2": 0.2689926977757587, "I3": 0.19954635267409818, "I4": 0.003980451893249224, "I5": 0.03969861272558927,
}
WITHIN_PRIORS = {
    "A1": 0.303, "A2": 0.165, "A3": 0.165, "A4": 0.303, "A5": 0.065, "P4": 0.143, "P5": 0.143, "P6": 0.368, "P7": 0.235, "P8": 0.056, "P9": 0.056,
    "C1": 0.144, "C2": 0.320, "C3": 0.391, "C4": 0.144, "I1": 0.156, "I2": 0.295, "I3": 0.083, "I4": 0.156, "I5": 0.311,
}
#: Records an authenticity test needs to count as sufficiently founded.
RELIABLE_N = {"A1": 30, "A2": 10, "A3": 2, "A4": 50, "A5": 2}


@dataclass(frozen=True)
class Thresholds:
    admit: float = 0.75
    reject: float = 0.20
    least_coverage: float = 0.5
    least_sufficiency: float = 0.5
    least_records: int = 50
    least_tests: int = 8

    def __post_init__(self):
        if not 0 <= self.reject <= self.admit <= 1:
            raise ValueError("thresholds need 0 <= reject <= admit <= 1")


def weights_table(spark: SparkSession, axes: dict = AXIS_WEIGHTS, within: dict = WITHIN) -> DataFrame:
    """(test, axis, axis_weight, within): one row a test."""
    rows = [(t, t[0], float(axes[t[0]]), float(w), int(RELIABLE_N.get(t, 0))) for t, w in within.items()]
    return spark.createDataFrame(rows, "test string, axis string, axis_weight double, within double, reliable_n int")


def weighted_mean(value: Column, weight: Column) -> Column:
    """Over rows that have a value; null where none has."""
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def audit_verdicts(results: DataFrame, facts: DataFrame, gates: DataFrame, a6: DataFrame | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    """One row for each catalog with its axis scores, composite, evidence and decision.

    results: long sub-test rows (A1-A5 on the records A6 doesn't decide). facts: catalog_id, n. gates: catalog_id, fired.
    a6: catalog_id, score, applicable, n_used, confirmed. Catalogs without records are not in facts; the caller reports
    them as REJECT. A fired gate or a confirmed contradiction rejects and leaves trust null; the evidence is given even so.
    """
    weights = F.broadcast(weights_table(results.sparkSession))  # 20 rows
    rows = results.join(weights, "test").join(facts, "catalog_id")
    if a6 is None:
        extra = facts.select("catalog_id", F.lit(None).cast("double").alias("a6"), F.lit(0).cast("long").alias("n6"), F.lit(False).alias("contradicted"))
    else:
        ok = F.coalesce("applicable", F.lit(False))
        got = a6.select("catalog_id", F.when(ok, F.col("score")).alias("a6"), F.when(ok, F.col("n_used")).otherwise(0).alias("n6"), (ok & F.col("confirmed")).alias("contradicted"))
        extra = facts.select("catalog_id").join(got, "catalog_id", "left").fillna({"n6": 0, "contradicted": False})
    rows = rows.join(extra, "catalog_id")
    share6 = F.col("n6") / F.col("n")
    effective = F.col("axis_weight") * F.col("within") * F.when(F.col("axis") == "A", 1.0 - share6).otherwise(1.0)
    covered = F.col("score").isNotNull()
    founded = F.when(covered, (F.coalesce("n_used", F.lit(0)) >= F.col("reliable_n")) & ((F.col("reliable_n") == 0) | F.col("n_used").isNotNull()))
    axis_score = lambda a: weighted_mean(F.when(F.col("axis") == a, F.col("score")), F.col("within"))
    listed = lambda c: F.transform(  # the heaviest three, of at most 20 tests
        F.slice(F.array_sort(F.collect_list(F.when(c, F.struct((-F.col("w")).alias("w"), "test")))), 1, 3), lambda x: x["test"]
    )
    got = (
        rows.withColumn("w", effective).withColumn("covered", covered).withColumn("founded", founded)
        .groupBy("catalog_id", "n", "a6", "n6", "contradicted")
        .agg(
            axis_score("A").alias("intrinsic"), axis_score("P").alias("P"), axis_score("C").alias("C"), axis_score("I").alias("I"),
            F.sum("w").alias("w_all"), F.sum(F.when(covered, F.col("w"))).alias("w_covered"), F.sum(F.when(F.col("founded"), F.col("w"))).alias("w_founded"), F.count_if("covered").alias("tests"),
            listed(~F.col("covered")).alias("missing"), listed(F.col("covered") & ~F.col("founded")).alias("insufficient"),
        )
    )
    w6 = F.lit(AXIS_WEIGHTS["A"]) * F.col("n6") / F.col("n")
    has6 = F.col("a6").isNotNull()
    mixed = F.when(F.col("intrinsic").isNotNull() & (F.col("n6") < F.col("n")), (F.col("n6") * F.col("a6") + (F.col("n") - F.col("n6")) * F.col("intrinsic")) / F.col("n")).otherwise(F.col("a6"))
    got = got.withColumn("A", F.when(has6, mixed).otherwise(F.col("intrinsic")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    got = got.withColumn("evidence_coverage", F.try_divide(zero("w_covered") + w6, F.col("w_all") + w6)).withColumn("sample_sufficiency", F.try_divide(zero("w_founded") + w6, zero("w_covered") + w6)).withColumn("n_tests", F.col("tests") + has6.cast("int"))
    total = sum((F.coalesce(F.col(a) * w, F.lit(0.0)) for a, w in AXIS_WEIGHTS.items()), F.lit(0.0))
    used = sum((F.when(F.col(a).isNotNull(), w).otherwise(0.0) for a, w in AXIS_WEIGHTS.items()), F.lit(0.0))
    got = got.withColumn("composite", F.try_divide(total, used)).join(gates.select("catalog_id", "fired"), "catalog_id")
    stopped = F.col("fired") | F.col("contradicted")
    got = got.withColumn("trust", F.when(~stopped, F.col("composite")))
    return with_decision(got.withColumn("stopped", stopped), t).select(
        "catalog_id", "n", "A", "P", "C", "I", "trust", "evidence_coverage", "sample_sufficiency", "n_tests", "fired", "contradicted", "capped_by", "decision", "missing", "insufficient"
    )


def stage2(trust: Column, t: Thresholds) -> Column:
    return F.when(trust >= t.admit, "ADMIT").when(trust >= t.reject, "CONDITIONAL").otherwise("REJECT")


def with_decision(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """decision and capped_by (the first gate that holds an ADMIT back) from trust, stopped, evidence and counts."""
    first = (
        F.when(F.col("evidence_coverage") < t.least_coverage, "coverage").when(F.col("sample_sufficiency") < t.least_sufficiency, "sufficiency")
        .when(F.col("n") < t.least_records, "records").when(F.col("n_tests") < t.least_tests, "tests")
    )
    ungated = F.when(F.col("stopped"), "REJECT").otherwise(stage2(F.col("trust"), t))
    got = df.withColumn("__d", ungated).withColumn("capped_by", F.when(F.col("__d") == "ADMIT", first))
    return got.withColumn("decision", F.when(F.col("capped_by").isNotNull(), "CONDITIONAL").otherwise(F.col("__d"))).drop("__d")


def documents(verdicts: DataFrame, results: DataFrame, gates: DataFrame) -> DataFrame:
    """(catalog_id, document): each verdict with its axes, gates, sub-tests and caveats as one struct, for JSON or text.

    results: long sub-test rows, at most 20 a catalog. A caveat is a sentence for every reason to read the verdict with care.
    """
    tests = results.groupBy("catalog_id").agg(F.array_sort(F.collect_list(F.struct("test", "score", "applicable", "n_used"))).alias("tests"))
    gate = lambda p: F.struct(F.col(f"{p}_k").alias("violations"), F.col(f"{p}_p").alias("probability")).alias(p.upper())
    bounds = gates.select("catalog_id", F.struct(gate("p1"), gate("p2"), gate("p3")).alias("gates"))
    says = lambda c, *words: F.when(c, F.concat(*(F.lit(w) if isinstance(w, str) else w for w in words)))
    caveats = F.array_compact(F.array(
        says(F.col("fired"), "Values out of bounds are more than errors of measurement explain; the catalog is rejected."),
        says(F.col("contradicted"), "Outside sources contradict the catalog."),
        says(F.col("capped_by").isNotNull(), "Trust would admit the catalog, but it is held back by its ", F.col("capped_by"), "."),
        says(F.size("missing") > 0, "Tests that could not be applied, by weight: ", F.concat_ws(", ", "missing"), "."),
        says(F.size("insufficient") > 0, "Tests on few records: ", F.concat_ws(", ", "insufficient"), "."),
    ))
    axes = F.struct("A", "P", "C", "I")
    got = verdicts.join(tests, "catalog_id", "left").join(bounds, "catalog_id", "left")
    document = F.struct(
        "catalog_id", "n", "decision", "trust", axes.alias("axes"), "evidence_coverage", "sample_sufficiency", "n_tests", "gates", "fired", "contradicted",
        "capped_by", "missing", "insufficient", "tests", caveats.alias("caveats"),
    )
    return got.select("catalog_id", document.alias("document"))


def empty_catalog(spark: SparkSession, name: str) -> DataFrame:
    """The verdict on a catalog without records: rejected, with nothing to go by."""
    schema = "catalog_id string, n long, A double, P double, C double, I double, trust double, evidence_coverage double, sample_sufficiency double, n_tests long, fired boolean, contradicted boolean, capped_by string, decision string, missing array<string>, insufficient array<string>"
    return spark.createDataFrame([(name, 0, None, None, None, None, None, 0.0, 0.0, 0, False, False, None, "REJECT", [], [])], schema)
