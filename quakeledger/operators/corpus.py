"""Analyses over a corpus of scored catalogs: weights, decisions, error rates, curves, thresholds, resampling.

Inputs: ``scores`` in long form (dataset_id, test, score) and ``facts`` (dataset_id, grp, corruption_type, n_records,
fired, evidence_coverage, sample_sufficiency, n_tests). grp is known_good or the kind of a bad catalog. Everything is
joins and aggregations on these; nothing depends on the corpus fitting in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quakeledger.functions.scalars import wilson_interval
from quakeledger.operators.interval import ranked
from quakeledger.runtime import fetch_bounded
from quakeledger.operators.decision import AXIS_PRIORS, AXIS_WEIGHTS, WITHIN, WITHIN_PRIORS, Thresholds, stage2, with_decision

KNOWN_BAD = ("corrupted_real", "fabricated", "held_out_adversarial", "merged")
TESTS = tuple(WITHIN)
# Weights from the entropy method alone.
AXIS_ENTROPY = {"A": 0.4337278921451253, "P": 0.25275089882110274, "C": 0.12454699784338152, "I": 0.18897421119039043}
WITHIN_ENTROPY = {
    "A1": 0.27454028484348325, "A2": 0.010497008715000478, "A3": 0.5662629802750339, "A4": 0.1384958508806923, "A5": 0.01020387528579014,
    "P4": 0.0023030581512116922, "P5": 0.7876278389323359, "P6": 9.792873794610396e-16, "P7": 0.07891579440474965, "P8": 0.1311533085117018, "P9": 0.0,
    "C1": 0.0018492166619663568, "C2": 0.22355359705696048, "C3": 0.12571918123117626, "C4": 0.6488780050498969,
    "I1": 0.47317068488816616, "I2": 0.13983489032774285, "I3": 0.3638165596475651, "I4": 0.003861219956453243, "I5": 0.019316645180072686,
}


def weight_variants() -> list[tuple[str, str, str, float, float]]:
    """(variant, test, axis, axis weight, weight within): blended, prior, entropy, equal, and each axis alone."""
    sizes = {a: sum(t[0] == a for t in TESTS) for a in "APCI"}
    equal = {t: 1.0 / sizes[t[0]] for t in TESTS}
    variants = {
        "blended": (AXIS_WEIGHTS, WITHIN), "prior": (AXIS_PRIORS, WITHIN_PRIORS), "entropy": (AXIS_ENTROPY, WITHIN_ENTROPY), "equal": (dict.fromkeys("APCI", 0.25), equal),
        **{f"{a}_only": ({x: float(x == a) for x in "APCI"}, WITHIN) for a in "APCI"},
    }
    return [(v, t, t[0], float(axes[t[0]]), float(within[t])) for v, (axes, within) in variants.items() for t in TESTS]


def variants_table(spark: SparkSession, *names: str) -> DataFrame:
    rows = [r for r in weight_variants() if not names or r[0] in names]
    return F.broadcast(spark.createDataFrame(rows, "variant string, test string, axis string, axis_weight double, within double"))  # at most 160 rows


def composite(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """(variant, dataset_id, A, P, C, I, t): renormalised weighted means over the tests and axes that have a score."""
    rows = scores.where("score IS NOT NULL").join(weights, "test")
    mean = lambda a: F.try_divide(F.sum(F.when(F.col("axis") == a, F.col("within") * F.col("score"))), F.sum(F.when(F.col("axis") == a, F.col("within"))))
    got = rows.groupBy("variant", "dataset_id").agg(*(mean(a).alias(a) for a in "APCI"), *(F.max(F.when(F.col("axis") == a, F.col("axis_weight"))).alias(f"w{a}") for a in "APCI"))
    have = lambda a: F.col(a).isNotNull()
    total = sum((F.when(have(a), F.col(f"w{a}") * F.col(a)).otherwise(0.0) for a in "APCI"), F.lit(0.0))
    used = sum((F.when(have(a), F.col(f"w{a}")).otherwise(0.0) for a in "APCI"), F.lit(0.0))
    return got.select("variant", "dataset_id", *"APCI", F.when(used > 0, total / used).alias("t"))


def decisions(comp: DataFrame, facts: DataFrame, gated: bool = True, respect_gates: bool = True, t: Thresholds = Thresholds()) -> DataFrame:
    """comp with facts and the decision of each dataset. gated: whether the evidence gates hold an ADMIT back."""
    rows = comp.join(facts, "dataset_id")
    stopped = F.col("fired") if respect_gates else F.lit(False)
    if not gated:
        return rows.withColumn("decision", F.when(stopped, "REJECT").otherwise(stage2(F.col("t"), t)))
    rows = rows.withColumn("stopped", stopped).withColumn("trust", F.when(~stopped, F.col("t"))).withColumn("n", F.col("n_records"))
    return with_decision(rows, t).drop("stopped", "trust", "n")


def good() -> Column:
    return F.col("grp") == "known_good"


def bad() -> Column:
    return F.col("grp").isin(*KNOWN_BAD)


def arm_metrics(decided: DataFrame, *by: str) -> DataFrame:
    """False rejects and admits, bad ones not rejected, good ones admitted, and decisions, by arm."""
    n_good, n_bad = F.count_if(good()), F.count_if(bad())
    k = lambda c, d: F.count_if(c & (F.col("decision") == d))
    return decided.groupBy(*by).agg(
        n_good.alias("n_good"), n_bad.alias("n_bad"), k(good(), "REJECT").alias("false_rejects"), k(bad(), "ADMIT").alias("false_admits"),
        F.try_divide(k(bad(), "ADMIT"), n_bad).alias("false_admit_rate"), F.try_divide(F.count_if(bad() & (F.col("decision") != "REJECT")), n_bad).alias("not_rejected_rate"),
        F.try_divide(k(good(), "ADMIT"), n_good).alias("admitted_rate"), *(F.count_if(F.col("decision") == d).alias(f"n_{d.lower()}") for d in ("ADMIT", "CONDITIONAL", "REJECT")),
    )


def size_bucket(n: Column) -> Column:
    return F.when(n < 100, "under 100").when(n < 1_000, "100 to 999").when(n < 10_000, "1000 to 9999").otherwise("10000 and more")


def three_way(decided: DataFrame) -> DataFrame:
    """Decision counts and rates with Wilson's intervals by group, by corruption type and by group and size, in one pass."""
    rows = decided.withColumn("bucket", size_bucket(F.col("n_records"))).withColumn("corruption", F.coalesce("corruption_type", F.lit("none")))
    sets = [["grp"], ["corruption"], ["grp", "bucket"]]
    cube = rows.groupingSets([[F.col(c) for c in s] for s in sets], "grp", "corruption", "bucket").agg(
        F.grouping_id().alias("level"), F.count("*").alias("n"), *(F.count_if(F.col("decision") == d).alias(d.lower()) for d in ("ADMIT", "CONDITIONAL", "REJECT")), F.count_if("fired").alias("fired")
    )
    low, high = wilson_interval("admit", "n")
    return cube.select("level", "grp", "corruption", "bucket", "n", "admit", "conditional", "reject", "fired", F.round(F.col("admit") / F.col("n"), 6).alias("admit_rate"), F.round(low, 6).alias("admit_low"), F.round(high, 6).alias("admit_high"))


def operating_point(decided: DataFrame) -> DataFrame:
    """Of the datasets decided without review, the share of wrong ones, overall (grp null) and by group."""
    sure = F.col("decision") != "CONDITIONAL"
    wrong = (good() & (F.col("decision") == "REJECT")) | (bad() & (F.col("decision") == "ADMIT"))
    return decided.rollup("grp").agg(F.count("*").alias("n"), F.count_if(sure).alias("covered"), F.count_if(sure & wrong).alias("wrong")).withColumn("risk", F.round(F.try_divide("wrong", "covered"), 6))


def risk_coverage(decided: DataFrame, levels: int = 41) -> DataFrame:
    """The risk of the most confident datasets at each of 41 levels from all to a twentieth: coverage, n_covered, risk.

    A dataset that a gate stops is a sure rejection and comes first; the others go by the distance of t from the middle of
    the thresholds, a missing t standing at the middle. t at or above the middle counts as admitted. A level of f covers
    exactly max(1, round(f n)) datasets, halves to even; equal confidences go by dataset_id. Merged datasets are neither
    good nor bad here. Ranks are taken over ranges, so no task orders all datasets.
    """
    mid = (Thresholds().admit + Thresholds().reject) / 2
    t, fired = F.coalesce("t", F.lit(mid)), F.coalesce("fired", F.lit(False))
    admitted = ~fired & (t >= mid)
    known_bad = F.col("grp").isin("corrupted_real", "fabricated", "held_out_adversarial")
    wrong = F.coalesce((admitted & known_bad) | (~admitted & good()), F.lit(False)).cast("int")
    rows = decided.select(F.lit(0).alias("all"), "dataset_id", F.when(fired, -1e9).otherwise(-F.round(F.abs(t - mid), 9)).alias("rank_by"), wrong.alias("wrong"))
    run = ranked(rows, "all", ["rank_by", "dataset_id"])
    step = (1.0 - 0.05) / (levels - 1)
    k = [F.greatest(F.lit(1), F.bround((1.0 - i * step) * F.col("n"))).cast("long") for i in range(levels)]
    sums = run.groupBy("n").agg(*(F.sum(F.when(F.col("rn") <= k[i], F.col("wrong")).otherwise(0)).alias(f"w{i}") for i in range(levels)))
    level = F.explode(F.array(*(F.struct(F.lit(i).alias("level"), k[i].alias("n_covered"), F.col(f"w{i}").alias("w")) for i in range(levels))))
    got = sums.select("n", level.alias("x")).select("n", "x.*")
    return got.select("level", F.round(F.col("n_covered") / F.col("n"), 9).alias("coverage"), "n_covered", F.round(F.col("w") / F.col("n_covered"), 9).alias("risk"))


def area_under(curve: DataFrame, x: str, y: str) -> DataFrame:
    """Trapezoid area under a curve of few points."""
    w = Window.partitionBy(F.lit(0)).orderBy(x)
    part = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return curve.select(part.alias("a")).agg(F.round(F.sum("a"), 6).alias("area"))


# Cost scenarios (false admit, false reject, review).
COSTS = ((1.0, 1.0, 0.0), (5.0, 1.0, 0.1), (10.0, 1.0, 0.2), (20.0, 1.0, 0.3), (50.0, 1.0, 0.5))


def utilities(decided_by_policy: DataFrame) -> DataFrame:
    """Cost of each policy under five cost scenarios, and which is cheapest. Input has a column policy."""
    m = arm_metrics(decided_by_policy, "policy").select("policy", "false_admits", "false_rejects", "n_conditional", (F.col("n_admit") + F.col("n_conditional") + F.col("n_reject")).alias("n"))
    costs = F.array(*(F.struct(F.lit(i).alias("scenario"), F.lit(a).alias("fa"), F.lit(r).alias("fr"), F.lit(v).alias("review")) for i, (a, r, v) in enumerate(COSTS)))
    rows = m.withColumn("c", F.explode(costs)).select("*", "c.*").withColumn("cost", F.col("fa") * F.col("false_admits") + F.col("fr") * F.col("false_rejects") + F.col("review") * F.col("n_conditional"))
    best = F.min_by("policy", F.struct("cost", "policy")).over(Window.partitionBy("scenario"))
    return rows.select("scenario", "policy", "false_admits", "false_rejects", "n_conditional", F.round("cost", 6).alias("cost"), F.round(F.col("cost") / F.col("n"), 6).alias("cost_per_dataset"), best.alias("best"))


def threshold_sweep(comp: DataFrame, facts: DataFrame, step: float = 0.05) -> DataFrame:
    """C11: confusion counts at each candidate of the admit threshold."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(int(round(1 / step)))), lambda i: F.round(i * step, 6))
    rows = comp.join(facts, "dataset_id").withColumn("theta", F.explode(grid))
    ok = F.coalesce(F.col("t") >= F.col("theta"), F.lit(False)) & ~F.col("fired")
    return rows.groupBy("theta").agg(F.count_if(good() & ok).alias("true_admits"), F.count_if(good() & ~ok).alias("missed"), F.count_if(bad() & ok).alias("false_admits"), F.count_if(bad() & ~ok).alias("held"))


def pick_thresholds(comp: DataFrame, facts: DataFrame, step: float = 0.005) -> DataFrame:
    """The least grid value above all bad datasets that no gate stops, and the largest below all good ones."""
    rows = comp.join(facts, "dataset_id")
    got = rows.agg(F.max(F.when(bad() & ~F.col("fired"), F.col("t"))).alias("top"), F.min(F.when(good(), F.col("t"))).alias("low"))
    admit = F.least(F.lit(1.0), F.coalesce((F.floor(F.col("top") / step + 1e-9) + 1) * step, F.lit(0.0)))
    reject = F.greatest(F.lit(0.0), (F.ceil(F.coalesce("low", F.lit(1.0)) / step - 1e-9) - 1) * step)
    return got.select(F.round(admit, 6).alias("theta_admit"), F.round(F.least(reject, admit), 6).alias("theta_reject"))


# --- weights from the data --------------------------------------------------------------------------------------------


def entropy_sums(scores: DataFrame, *by: str) -> DataFrame:
    """What entropy weights need of each test: m, sum x and sum x ln x. Sums of groups add and subtract."""
    x = F.col("score")
    return scores.where("score IS NOT NULL").groupBy(*by, "test").agg(F.count("*").alias("m"), F.sum("score").alias("s"), F.sum(F.when(x > 0, x * F.log(x)).otherwise(0.0)).alias("sl"))


def entropy_weights(sums: DataFrame, *by: str) -> DataFrame:
    """M7: (by, axis, test, m, weight): normalised over the tests of an axis; equal where no test carries information.

    The axes' own scores (A, P, C, I) are normalised among themselves.
    """
    e = -(F.col("sl") / F.col("s") - F.log("s")) / F.log("m")
    d = F.when((F.col("m") >= 2) & (F.col("s") > 0), 1.0 - e).otherwise(0.0)
    over = Window.partitionBy(*by, "axis")
    rows = sums.withColumn("axis", F.when(F.length("test") == 1, "axes").otherwise(F.substring("test", 1, 1))).withColumn("d", d)
    whole = F.sum("d").over(over)
    return rows.select(*by, "axis", "test", "m", F.when(whole > 0, F.col("d") / whole).otherwise(1.0 / F.count("*").over(over)).alias("weight"))


def blended_weights(entropy: DataFrame, *by: str, least: int = 20) -> DataFrame:
    """M8: priors times entropy weights; tests with fewer than 20 scores keep their prior, the others share what is left."""
    prior = F.element_at(F.create_map(*(F.lit(x) for kv in (WITHIN_PRIORS | AXIS_PRIORS).items() for x in kv)), F.col("test"))
    over = Window.partitionBy(*by, "axis")
    rows = entropy.withColumn("prior", prior).withColumn("kept", F.col("m") < least)
    raw = F.when(~F.col("kept"), F.col("prior") * F.col("weight"))
    budget = 1.0 - F.coalesce(F.sum(F.when(F.col("kept"), F.col("prior"))).over(over), F.lit(0.0))
    return rows.select(*by, "axis", "test", "m", F.when(F.col("kept"), F.col("prior")).otherwise(budget * F.try_divide(raw, F.sum(raw).over(over))).alias("weight"))


def leave_one_out(scores: DataFrame, facts: DataFrame, group: str = "grp") -> DataFrame:
    """Entropy weights without each group in turn, from totals minus the group's own sums (one pass, no refit)."""
    rows = entropy_sums(scores.join(facts.select("dataset_id", F.col(group).alias("left_out")), "dataset_id"), "left_out")
    total = rows.groupBy("test").agg(F.sum("m").alias("tm"), F.sum("s").alias("ts"), F.sum("sl").alias("tl"))
    rest = rows.join(total, "test").select("left_out", "test", (F.col("tm") - F.col("m")).alias("m"), (F.col("ts") - F.col("s")).alias("s"), (F.col("tl") - F.col("sl")).alias("sl"))
    return entropy_weights(rest, "left_out")


def refit_agreement(scores: DataFrame, facts: DataFrame, group: str = "grp", least: int = 50) -> DataFrame:
    """For each group left out, the blended weights of the others applied to it: rows, decisions as in production, their share.

    A fold whose complement has fewer than ``least`` datasets is skipped. All folds are one plan: the complements' sums are
    totals minus the group's own.
    """
    weights = blended_weights(leave_one_out(scores, facts, group), "left_out").withColumnRenamed("weight", "within")
    axis_weight = F.element_at(F.create_map(*(F.lit(x) for kv in AXIS_WEIGHTS.items() for x in kv)), F.col("axis"))
    own = facts.select("dataset_id", F.col(group).alias("left_out"))
    rows = scores.where("score IS NOT NULL").join(own, "dataset_id").join(F.broadcast(weights.withColumn("axis_weight", axis_weight)), ["left_out", "test"])  # 20 rows a group
    part = rows.groupBy("left_out", "dataset_id", "axis", "axis_weight").agg(F.try_divide(F.sum(F.col("within") * F.col("score")), F.sum("within")).alias("v"))
    held = F.col("v").isNotNull()
    refit = part.groupBy("left_out", "dataset_id").agg(F.try_divide(F.sum(F.col("axis_weight") * F.col("v")), F.sum(F.when(held, F.col("axis_weight")))).alias("t"))
    production = composite(scores, variants_table(scores.sparkSession, "blended")).select("dataset_id", F.col("t").alias("t0"))
    both = refit.join(production, "dataset_id").join(facts.select("dataset_id", "fired"), "dataset_id")
    call = lambda c: F.when(F.col("fired"), "REJECT").otherwise(stage2(F.col(c), Thresholds()))
    sizes = facts.groupBy(F.col(group).alias("left_out")).agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("n_train", F.sum("n").over(Window.partitionBy(F.lit(0))) - F.col("n")).where(F.col("n_train") >= least)  # a row a group
    got = both.groupBy("left_out").agg(F.count("*").alias("n_rows"), F.count_if(call("t") == call("t0")).alias("n_same"))
    return got.join(sizes.select("left_out", "n_train"), "left_out").withColumn("agreement", F.col("n_same") / F.col("n_rows"))


def merged_manifest(scores: DataFrame, manifest: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Scores with their manifest rows, one to one; a key that occurs twice on a side or has no manifest row is an error."""
    for name, side in (("scores", scores), ("the manifest", manifest)):
        if twice := side.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(5).collect():
            raise ValueError(f"{name} name {[r[key] for r in twice]} more than once")
    if lost := scores.join(manifest.select(key), key, "left_anti").select(key).limit(5).collect():
        raise ValueError(f"the manifest doesn't list {[r[key] for r in lost]}")
    return scores.join(manifest, key)


def labelled(rows: DataFrame, manifest: DataFrame, key: str = "dataset_id", label: str = "label") -> DataFrame:
    """Rows with the manifest's label; the rows' own label stands where the manifest has none."""
    known = manifest.select(key, F.col(label).alias("__label")).dropDuplicates([key])
    return rows.join(known, key, "left").withColumn(label, F.coalesce("__label", label)).drop("__label")


def resolved_parents(manifest: DataFrame, real: Column, parent: str = "parent_catalog", key: str = "dataset_id") -> tuple[DataFrame, DataFrame]:
    """(rows with a parent among the datasets that ``real`` marks, rows whose parent is none of them)."""
    known = manifest.where(real).select(F.col(key).alias(parent)).distinct()
    derived = manifest.where(F.col(parent).isNotNull())
    return derived.join(known, parent, "left_semi"), derived.join(known, parent, "left_anti")


def same_members(left: DataFrame, right: DataFrame, key: str) -> bool:
    """Whether both tables have the same set of keys (null among them or not)."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def grouped_split(groups: DataFrame, targets=(("train", 0.70), ("calibration", 0.15), ("test", 0.15)), seed: int = 0) -> DataFrame:
    """Groups (parent, n) with a split: in seeded order each goes to the split with the largest deficit.

    The order matters, so all groups pass through one task in that order; they are sorted on disk where memory is short, and
    the task holds no more than a batch of them and the deficits. Datasets join the result by their parent.
    """
    total = groups.agg(F.sum("n").alias("n")).first()["n"] or 0

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lacking = {s: share * total for s, share in targets}
        for x in batches:
            to = []
            for n in x["n"].tolist():
                to.append(max(lacking, key=lacking.get))
                lacking[to[-1]] -= n
            yield x.assign(split=to)

    rows = groups.select("parent", F.col("n").cast("long").alias("n")).repartition(1).sortWithinPartitions(F.xxhash64("parent", F.lit(seed)), "parent")
    return rows.mapInPandas(deal, "parent string, n long, split string")


def extremes(scores: DataFrame) -> DataFrame:
    """Of each test the dataset with the lowest and with the highest score (the first id on ties)."""
    rows = scores.where("score IS NOT NULL")
    return rows.groupBy("test").agg(
        F.min_by("dataset_id", F.struct("score", "dataset_id")).alias("worst"), F.min("score").alias("worst_score"),
        F.min_by("dataset_id", F.struct((-F.col("score")).alias("s"), "dataset_id")).alias("best"), F.max("score").alias("best_score"),
    )


def least_stable(stability: DataFrame, k: int = 20) -> DataFrame:
    """The k datasets whose decision changes most often."""
    return stability.orderBy("agreement", "dataset_id").limit(k)


def predictive_values(rates: DataFrame, prevalences=(0.01, 0.05, 0.1, 0.25, 0.5)) -> DataFrame:
    """C19x: by prevalence of bad datasets, what a rejection and an admission are worth, by Bayes' rule.

    rates: sensitivity (bad ones not admitted) and specificity (good ones not rejected), one row.
    """
    p = F.col("prevalence")
    hit, clear = F.col("sensitivity") * p, F.col("specificity") * (1 - p)
    rows = rates.withColumn("prevalence", F.explode(F.array(*(F.lit(x) for x in prevalences))))
    return rows.select("prevalence", F.try_divide(hit, hit + (1 - F.col("specificity")) * (1 - p)).alias("ppv"), F.try_divide(clear, clear + (1 - F.col("sensitivity")) * p).alias("npv"))


def _seeded(ids: pd.Series, seed: int) -> list[np.random.Generator]:
    return [np.random.default_rng([seed, int.from_bytes(str(i).encode()[-8:].rjust(8, b"\0"), "big"), len(str(i))]) for i in ids]


#: Draws of the resampling analyses.
DRAWS = 2_000
AXES = tuple("APCI")


def with_prior_axes(wide: DataFrame) -> DataFrame:
    """wide (dataset_id and tests) with the axis scores that the prior weights give."""
    def mean(a: str) -> Column:
        mine = [t for t in TESTS if t[0] == a]
        up = sum((F.coalesce(F.col(t) * WITHIN_PRIORS[t], F.lit(0.0)) for t in mine), F.lit(0.0))
        return F.try_divide(up, sum((F.when(F.col(t).isNotNull(), WITHIN_PRIORS[t]).otherwise(0.0) for t in mine), F.lit(0.0)))

    return wide.select("*", *(mean(a).alias(a) for a in AXES))


def bootstrap_weights(wide: DataFrame, facts: DataFrame, draws: int = DRAWS, seed: int = 12) -> DataFrame:
    """Spread of the blended weights of tests (within axes) and of axes over resamples of datasets, stratified by group.

    Every dataset counts a Poisson number of times in a draw, and each group's counts are scaled to its size, so every draw
    has each group at its full weight. A batch gives the sums of all draws at once (one matrix product), which Spark
    adds up. Gives test (axes by their letter), mean, sd, cv, low, median, high (2.5, 50 and 97.5 %).
    """
    columns = (*TESTS, *AXES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for grp, g in b.groupby("grp", dropna=False):
                w = np.stack([r.poisson(1.0, draws) for r in _seeded(g["dataset_id"], seed)], axis=1).astype(float)
                x = g[list(columns)].to_numpy(float)
                have = np.isfinite(x)
                v = np.where(have, x, 0.0)
                vl = np.where(v > 0, v * np.log(np.where(v > 0, v, 1.0)), 0.0)
                k = len(columns)
                yield pd.DataFrame({
                    "grp": grp, "draw": np.repeat(np.arange(draws), k), "test": np.tile(columns, draws), "drawn": np.repeat(w.sum(1), k), "size": float(len(g)),
                    "m": (w @ have).ravel(), "s": (w @ v).ravel(), "sl": (w @ vl).ravel(),
                })

    rows = with_prior_axes(wide).join(facts.select("dataset_id", F.coalesce("grp", F.lit("")).alias("grp")), "dataset_id")
    numbers = ("drawn", "size", "m", "s", "sl")
    parts = rows.select("dataset_id", "grp", *columns).mapInPandas(run, "grp string, draw int, test string, drawn double, size double, m double, s double, sl double")
    parts = parts.groupBy("draw", "test", "grp").agg(*(F.sum(c).alias(c) for c in numbers))
    scaled = F.try_divide(F.col("size"), F.col("drawn"))
    sums = parts.groupBy("draw", "test").agg(*(F.sum(F.col(c) * F.coalesce(scaled, F.lit(0.0))).alias(c) for c in ("m", "s", "sl")))
    got = blended_weights(entropy_weights(sums, "draw"), "draw")
    q = lambda p: F.percentile("weight", p)
    return got.groupBy("test").agg(
        F.avg("weight").alias("mean"), F.stddev("weight").alias("sd"), F.try_divide(F.stddev("weight"), F.avg("weight")).alias("cv"),
        q(0.025).alias("low"), q(0.5).alias("median"), q(0.975).alias("high"),
    )


def decision_stability(wide: DataFrame, facts: DataFrame, bounds: DataFrame, draws: int = DRAWS, shift: float = 0.03, seed: int = 20) -> DataFrame:
    """How often each dataset keeps its decision when weights are drawn from their bounds (test, low, high; axes too)

    and renormalised within their axis, and both thresholds move by up to ``shift`` (exchanged where they cross). The
    draws are made once on the driver (draws x 24 numbers) and every dataset is judged under all of them.
    """
    rng = np.random.default_rng(seed)
    base = np.array([WITHIN[t] for t in TESTS])
    held = {r["test"]: (max(0.0, r["low"]), max(0.0, r["low"], r["high"])) for r in fetch_bounded(bounds, 100, "the bounds of weights")}
    drawn_of = lambda names: np.stack([rng.uniform(*held.get(t, (0.0, 0.0)), draws) for t in names], axis=1)
    within, axes = drawn_of(TESTS), drawn_of(AXES)
    axes = axes / axes.sum(1, keepdims=True)
    for a in AXES:
        at = [i for i, t in enumerate(TESTS) if t[0] == a]
        total = within[:, at].sum(1, keepdims=True)
        within[:, at] = np.where(total > 0, within[:, at] / np.where(total > 0, total, 1.0), 1.0 / len(at))
    admit, reject = 0.75 + rng.uniform(-shift, shift, draws), 0.20 + rng.uniform(-shift, shift, draws)
    admit, reject = np.maximum(admit, reject), np.minimum(admit, reject)

    def judged(x: np.ndarray, within: np.ndarray, axes: np.ndarray, admit, reject) -> np.ndarray:
        have = np.isfinite(x)
        total, used = np.zeros((len(within), len(x))), np.zeros((len(within), len(x)))
        for k, a in enumerate("APCI"):
            at = [i for i, t in enumerate(TESTS) if t[0] == a]
            weight = within[:, at] @ have[:, at].T
            with np.errstate(all="ignore"):
                mean = within[:, at] @ np.where(have, x, 0.0)[:, at].T / weight
            ok = weight > 0
            total += np.where(ok, axes[:, [k]] * mean, 0.0)
            used += np.where(ok, axes[:, [k]], 0.0)
        with np.errstate(all="ignore"):
            t = total / used
        return np.where(t >= admit, 2, np.where(t >= reject, 1, 0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[list(TESTS)].to_numpy(float)
            own = judged(x, base[None, :], np.array([[AXIS_WEIGHTS[a] for a in "APCI"]]), 0.75, 0.20)
            drawn = judged(x, within, axes, admit[:, None], reject[:, None])
            same = np.where(b["fired"].to_numpy(bool), 1.0, (drawn == own).mean(0)) if len(b) else np.zeros(0)
            yield pd.DataFrame({"dataset_id": b["dataset_id"], "agreement": same})

    return wide.join(facts.select("dataset_id", "fired"), "dataset_id").mapInPandas(run, "dataset_id string, agreement double")
