"""Queries of the corpus analyses, on a score matrix derived from the manifests, and their SQL.

The test data have no scored corpus, so the matrix is made by arithmetic on the manifests' rows that both engines do
alike: every listed dataset gets 20 scores, some missing, and the facts that gates need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeledger.operators import corpus as co
from quakeledger.operators.decision import WITHIN_PRIORS
from quakeledger.runtime import table


def matrix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(scores, facts) of all datasets of both manifests."""
    cols = ("dataset_id", "category", "label", "corruption_type", "n_records")
    both = table(spark, sf_dir, "corpus_manifest").select(*cols).unionByName(table(spark, sf_dir, "adversarial_corpus_manifest").select(*cols))
    grp = F.when(F.col("label") == "known_good", "known_good").when(F.col("category").like("%adversarial"), "held_out_adversarial").otherwise(F.col("category"))
    rows = both.groupBy(F.lower(F.trim("dataset_id")).alias("dataset_id")).agg(F.min(grp).alias("grp"), F.min("corruption_type").alias("corruption_type"), F.max(F.coalesce("n_records", F.lit(0))).alias("n_records"))
    n, k = F.col("n_records"), F.length("dataset_id")
    h = [F.pmod(n * (7919 + 104 * i) + k * 31 * i, F.lit(1000)) for i in range(1, len(co.TESTS) + 1)]
    is_good = F.col("grp") == "known_good"
    score = lambda x: F.when(x % 11 == 0, None).when(is_good, (500 + x / 2.0) / 1000.0).otherwise(x / 1250.0)
    pairs = F.array(*(F.struct(F.lit(t).alias("test"), score(x).alias("score")) for t, x in zip(co.TESTS, h)))
    scores = rows.select("dataset_id", F.explode(pairs).alias("p")).select("dataset_id", "p.*")
    n_tests = sum((F.when(x % 11 == 0, 0).otherwise(1) for x in h), F.lit(0))
    facts = rows.select("dataset_id", "grp", "corruption_type", "n_records", (~is_good & (n % 7 == 0)).alias("fired"), (0.4 + F.pmod(n * 13, F.lit(60)) / 100.0).alias("evidence_coverage"), (0.45 + F.pmod(n * 17, F.lit(50)) / 100.0).alias("sample_sufficiency"), n_tests.alias("n_tests"))
    return scores, facts


def _wide(scores: DataFrame) -> DataFrame:
    return scores.groupBy("dataset_id").pivot("test", list(co.TESTS)).agg(F.first("score"))


def _r(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _comp(spark, sf_dir, *variants):
    scores, facts = matrix(spark, sf_dir)
    return co.composite(scores, co.variants_table(spark, *variants)), facts


def _decided(spark, sf_dir, gated=True, *variants):
    comp, facts = _comp(spark, sf_dir, *(variants or ("blended",)))
    return co.decisions(comp, facts, gated)


def _policies(spark, sf_dir):
    comp, facts = _comp(spark, sf_dir, "blended")
    full, soft = co.decisions(comp, facts), co.decisions(comp, facts, respect_gates=False)
    cols = ["dataset_id", "grp", "decision"]
    hard = facts.select("dataset_id", "grp", F.when(F.col("fired"), "REJECT").otherwise("ADMIT").alias("decision"))
    return full.select(*cols, F.lit("full").alias("policy")).unionByName(soft.select(*cols, F.lit("weighted").alias("policy"))).unionByName(hard.withColumn("policy", F.lit("gates")))


def real_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1x: the sub-test scores of event_records' catalogs, a row a catalog and a column a test."""
    from quakeledger.plans.audit_queries import subtest_scores

    return subtest_scores(spark, sf_dir).groupBy("catalog_id").pivot("test", list(co.TESTS)).agg(F.first("score"))


def _stability(spark, sf_dir):
    scores, facts = matrix(spark, sf_dir)
    wide = _wide(scores)
    return co.decision_stability(wide, facts, co.bootstrap_weights(wide, facts))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The datasets of the manifest with labels; a row's own label (here its category) stands where the manifest has none."""
    rows = table(spark, sf_dir, "corpus_manifest").groupBy("dataset_id").agg(F.min("category").alias("label"))
    known = table(spark, sf_dir, "corpus_manifest").groupBy("dataset_id").agg(F.min("label").alias("label"))
    return co.labelled(rows, known)


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many derived datasets name a parent that is a known good dataset, and how many do not, by category."""
    rows = table(spark, sf_dir, "corpus_manifest").select("dataset_id", "category", "label", F.nullif(F.trim("parent_catalog"), F.lit("")).alias("parent_catalog"))
    found, lost = co.resolved_parents(rows, F.col("label") == "known_good")
    return found.withColumn("found", F.lit(True)).unionByName(lost.withColumn("found", F.lit(False))).groupBy("category", "found").agg(F.count("*").alias("n"))


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the shares of the split by parents are near their targets, and how many parents and datasets were dealt."""
    rows = table(spark, sf_dir, "corpus_manifest").select(F.coalesce(F.nullif(F.trim("parent_catalog"), F.lit("")), "dataset_id").alias("parent")).where("parent IS NOT NULL")
    got = co.grouped_split(rows.groupBy("parent").agg(F.count("*").alias("n")))
    share = lambda s: F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)) / F.sum("n")
    near = (F.abs(share("train") - 0.7) < 0.05) & (F.abs(share("calibration") - 0.15) < 0.05) & (F.abs(share("test") - 0.15) < 0.05)
    return got.agg(F.count("*").alias("n_parents"), F.sum("n").alias("n_datasets"), near.alias("near"))


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = co.arm_metrics(_decided(spark, sf_dir).withColumn("all", F.lit(0)), "all")
    return m.select((1 - F.col("false_admit_rate")).alias("sensitivity"), (1 - F.try_divide(F.col("false_rejects"), F.col("n_good"))).alias("specificity"))


QUERIES = {
    "corpus_score_matrix": real_matrix,
    "corpus_composite": lambda s, d: _comp(s, d)[0].select("variant", "dataset_id", *(F.round(c, 9).alias(c) for c in ("A", "P", "C", "I", "t"))),
    "corpus_decisions": lambda s, d: _decided(s, d).select("dataset_id", F.round("t", 6).alias("t"), "capped_by", "decision"),
    "corpus_ablation": lambda s, d: _r(co.arm_metrics(co.decisions(*_comp(s, d), gated=False), "variant")),
    "corpus_three_way": lambda s, d: co.three_way(_decided(s, d)).select("level", "grp", "corruption", "bucket", "n", "admit", "conditional", "reject", "fired", "admit_rate", "admit_low", "admit_high"),
    "corpus_operating_point": lambda s, d: co.operating_point(_decided(s, d)),
    "corpus_risk_coverage": lambda s, d: co.risk_coverage(_decided(s, d)),
    "corpus_aurc": lambda s, d: co.area_under(co.risk_coverage(_decided(s, d)), "coverage", "risk"),
    "corpus_refit_agreement": lambda s, d: _r(co.refit_agreement(*matrix(s, d))),
    "corpus_extremes": lambda s, d: _r(co.extremes(matrix(s, d)[0])),
    "corpus_merged_manifest": lambda s, d: co.merged_manifest(_comp(s, d, "blended")[0].select("dataset_id", F.round("t", 6).alias("t")), matrix(s, d)[1].select("dataset_id", "grp", "n_records")),
    "corpus_labels": _labels,
    "corpus_parents": _parents,
    "corpus_grouped_split": _grouped,
    "corpus_same_members": lambda s, d: s.createDataFrame([(co.same_members(matrix(s, d)[0].where("score IS NOT NULL"), matrix(s, d)[1], "dataset_id"),)], "same boolean"),
    "corpus_predictive_values": lambda s, d: _r(co.predictive_values(_rates(s, d))),
    "corpus_least_stable": lambda s, d: _r(co.least_stable(_stability(s, d))),
    "corpus_utilities": lambda s, d: co.utilities(_policies(s, d)),
    "corpus_threshold_sweep": lambda s, d: co.threshold_sweep(*_comp(s, d, "blended")),
    "corpus_pick_thresholds": lambda s, d: co.pick_thresholds(*_comp(s, d, "blended")),
    "corpus_entropy_weights": lambda s, d: _r(co.entropy_weights(co.entropy_sums(matrix(s, d)[0]))),
    "corpus_blended_weights": lambda s, d: _r(co.blended_weights(co.entropy_weights(co.entropy_sums(matrix(s, d)[0])))),
    "corpus_leave_one_out": lambda s, d: _r(co.leave_one_out(*matrix(s, d))),
    "corpus_bootstrap_weights": lambda s, d: _r(co.bootstrap_weights(_wide(matrix(s, d)[0]), matrix(s, d)[1])),
    "corpus_stability": lambda s, d: _r(_stability(s, d)),
    "corpus_unscored": lambda s, d: matrix(s, d)[1].join(s.read.parquet(f"{d}/event_records.parquet").select(F.lower(F.trim("catalog_id")).alias("dataset_id")).distinct(), "dataset_id", "left_anti").select("dataset_id", "grp"),
}

_TESTS = ", ".join(f"({i}, '{t}')" for i, t in enumerate(co.TESTS, 1))
_M = f"""WITH raw AS (SELECT dataset_id, category, label, corruption_type, n_records FROM corpus_manifest UNION ALL SELECT dataset_id, category, label, corruption_type, n_records FROM adversarial_corpus_manifest),
ds AS (SELECT lower(trim(dataset_id, ' ')) AS dataset_id, min(CASE WHEN label = 'known_good' THEN 'known_good' WHEN category LIKE '%adversarial' THEN 'held_out_adversarial' ELSE category END) AS grp,
  min(corruption_type) AS corruption_type, max(coalesce(n_records, 0)) AS n_records FROM raw GROUP BY 1),
tests(i, test) AS (VALUES {_TESTS}),
h AS (SELECT dataset_id, grp, test, (n_records * (7919 + 104 * i) + length(dataset_id) * 31 * i) % 1000 AS x FROM ds, tests),
scores AS (SELECT dataset_id, test, CASE WHEN x % 11 = 0 THEN NULL WHEN grp = 'known_good' THEN (500 + x / 2e0) / 1000e0 ELSE x / 1250e0 END AS score FROM h),
facts AS (SELECT dataset_id, grp, corruption_type, n_records, grp <> 'known_good' AND n_records % 7 = 0 AS fired, 0.4e0 + ((n_records * 13) % 60) / 100e0 AS evidence_coverage,
  0.45e0 + ((n_records * 17) % 50) / 100e0 AS sample_sufficiency, (SELECT count(score) FROM scores s WHERE s.dataset_id = ds.dataset_id) AS n_tests FROM ds),
wt(variant, test, axis, aw, w) AS (VALUES {", ".join(f"('{v}', '{t}', '{a}', {aw!r}::DOUBLE, {w!r}::DOUBLE)" for v, t, a, aw, w in co.weight_variants())}),
ax AS (SELECT variant, dataset_id, axis, any_value(aw) AS aw, CASE WHEN sum(w) <> 0 THEN sum(w * score) / sum(w) END AS v FROM scores JOIN wt USING (test) WHERE score IS NOT NULL GROUP BY ALL),
comp AS (SELECT variant, dataset_id, max(v) FILTER (axis = 'A') AS A, max(v) FILTER (axis = 'P') AS P, max(v) FILTER (axis = 'C') AS C, max(v) FILTER (axis = 'I') AS I,
  CASE WHEN sum(aw) FILTER (v IS NOT NULL) > 0 THEN sum(aw * v) FILTER (v IS NOT NULL) / sum(aw) FILTER (v IS NOT NULL) END AS t FROM ax GROUP BY ALL),
soft AS (SELECT variant, dataset_id, t, grp, corruption_type, n_records, fired, CASE WHEN fired THEN 'REJECT' WHEN t >= 0.75e0 THEN 'ADMIT' WHEN t >= 0.20e0 THEN 'CONDITIONAL' ELSE 'REJECT' END AS d,
  CASE WHEN t >= 0.75e0 THEN 'ADMIT' WHEN t >= 0.20e0 THEN 'CONDITIONAL' ELSE 'REJECT' END AS dw,
  CASE WHEN evidence_coverage < 0.5e0 THEN 'coverage' WHEN sample_sufficiency < 0.5e0 THEN 'sufficiency' WHEN n_records < 50 THEN 'records' WHEN n_tests < 8 THEN 'tests' END AS cap FROM comp JOIN facts USING (dataset_id)),
dec AS (SELECT *, CASE WHEN d = 'ADMIT' THEN cap END AS capped_by, CASE WHEN d = 'ADMIT' AND cap IS NOT NULL THEN 'CONDITIONAL' ELSE d END AS decision,
  CASE WHEN dw = 'ADMIT' AND cap IS NOT NULL THEN 'CONDITIONAL' ELSE dw END AS weighted FROM soft WHERE variant = 'blended'),
sums AS (SELECT left(test, 1) AS axis, test, count(score) AS m, sum(score) AS s, sum(CASE WHEN score > 0 THEN score * ln(score) ELSE 0 END) AS sl FROM scores WHERE score IS NOT NULL GROUP BY ALL),
ew AS (SELECT axis, test, m, CASE WHEN sum(d) OVER a > 0 THEN d / sum(d) OVER a ELSE 1e0 / count(*) OVER a END AS weight FROM (SELECT *, CASE WHEN m >= 2 AND s > 0 THEN 1e0 + (sl / s - ln(s)) / ln(m) ELSE 0 END AS d FROM sums) WINDOW a AS (PARTITION BY axis)),
prior(test, prior) AS (VALUES {", ".join(f"('{t}', {w!r}::DOUBLE)" for t, w in WITHIN_PRIORS.items())})
"""
_GOOD, _BAD = "grp = 'known_good'", "grp IN ('corrupted_real', 'fabricated', 'held_out_adversarial', 'merged')"
_WILSON = "3.841458820694124e0"
_CURVE = """, v AS (SELECT dataset_id, fired, round(abs(coalesce(t, 0.475e0) - 0.475e0), 9) AS conf, NOT fired AND coalesce(t, 0.475e0) >= 0.475e0 AS admitted, grp FROM dec),
 w AS (SELECT *, CASE WHEN admitted AND grp IN ('corrupted_real', 'fabricated', 'held_out_adversarial') OR NOT admitted AND grp = 'known_good' THEN 1 ELSE 0 END AS wrong FROM v),
 r AS (SELECT wrong, row_number() OVER (ORDER BY fired DESC, conf DESC, dataset_id) AS rn, count(*) OVER () AS n FROM w),
 lv AS (SELECT i AS level, CAST(greatest(1, round_even((1e0 - i * ((1e0 - 0.05e0) / 40)) * (SELECT count(*) FROM dec), 0)) AS BIGINT) AS n_covered FROM range(0, 41) x(i)),
 curve AS (SELECT CAST(level AS INT) AS level, round(n_covered / max(n), 9) AS coverage, n_covered, round(sum(wrong) FILTER (rn <= n_covered) / n_covered, 9) AS risk FROM lv, r GROUP BY level, n_covered)
"""
SQL = {
    "corpus_composite": _M + "SELECT variant, dataset_id, round(A, 9) AS A, round(P, 9) AS P, round(C, 9) AS C, round(I, 9) AS I, round(t, 9) AS t FROM comp",
    "corpus_decisions": _M + "SELECT dataset_id, round(t, 6) AS t, capped_by, decision FROM dec",
    "corpus_ablation": _M + f"""SELECT variant, count(*) FILTER ({_GOOD}) AS n_good, count(*) FILTER ({_BAD}) AS n_bad, count(*) FILTER ({_GOOD} AND d = 'REJECT') AS false_rejects, count(*) FILTER ({_BAD} AND d = 'ADMIT') AS false_admits,
      round(count(*) FILTER ({_BAD} AND d = 'ADMIT') / count(*) FILTER ({_BAD}), 6) AS false_admit_rate, round(count(*) FILTER ({_BAD} AND d <> 'REJECT') / count(*) FILTER ({_BAD}), 6) AS not_rejected_rate,
      round(count(*) FILTER ({_GOOD} AND d = 'ADMIT') / count(*) FILTER ({_GOOD}), 6) AS admitted_rate, count(*) FILTER (d = 'ADMIT') AS n_admit, count(*) FILTER (d = 'CONDITIONAL') AS n_conditional, count(*) FILTER (d = 'REJECT') AS n_reject FROM soft GROUP BY variant""",
    "corpus_three_way": _M + f""", b AS (SELECT *, coalesce(corruption_type, 'none') AS corruption, CASE WHEN n_records < 100 THEN 'under 100' WHEN n_records < 1000 THEN '100 to 999' WHEN n_records < 10000 THEN '1000 to 9999' ELSE '10000 and more' END AS bucket FROM dec)
      SELECT CAST(grouping_id(grp, corruption, bucket) AS BIGINT) AS level, grp, corruption, bucket, count(*) AS n, count(*) FILTER (decision = 'ADMIT') AS admit, count(*) FILTER (decision = 'CONDITIONAL') AS conditional, count(*) FILTER (decision = 'REJECT') AS reject, count(*) FILTER (fired) AS fired,
      round(admit / n, 6) AS admit_rate,
      round(greatest(0e0, (admit / n + {_WILSON} / (2 * n)) / (1 + {_WILSON} / n) - 1.959963984540054e0 * sqrt((admit / n) * (1 - admit / n) / n + {_WILSON} / 4 / (n * n)) / (1 + {_WILSON} / n)), 6) AS admit_low,
      round(least(1e0, (admit / n + {_WILSON} / (2 * n)) / (1 + {_WILSON} / n) + 1.959963984540054e0 * sqrt((admit / n) * (1 - admit / n) / n + {_WILSON} / 4 / (n * n)) / (1 + {_WILSON} / n)), 6) AS admit_high
      FROM b GROUP BY GROUPING SETS ((grp), (corruption), (grp, bucket))""",
    "corpus_operating_point": _M + f"""SELECT grp, count(*) AS n, count(*) FILTER (decision <> 'CONDITIONAL') AS covered, count(*) FILTER (({_GOOD} AND decision = 'REJECT') OR ({_BAD} AND decision = 'ADMIT')) AS wrong,
      round(CASE WHEN covered > 0 THEN wrong / covered END, 6) AS risk FROM dec GROUP BY ROLLUP (grp)""",
    "corpus_risk_coverage": _M + _CURVE + "SELECT level, coverage, n_covered, risk FROM curve",
    "corpus_aurc": _M + _CURVE + "SELECT round(sum((coverage - px) * (risk + py) / 2), 6) AS area FROM (SELECT coverage, risk, lag(coverage) OVER w AS px, lag(risk) OVER w AS py FROM curve WINDOW w AS (ORDER BY coverage, risk))",
    "corpus_utilities": _M + f""", pol AS (SELECT 'full' AS policy, grp, decision AS x FROM dec UNION ALL SELECT 'weighted', grp, weighted FROM dec UNION ALL SELECT 'gates', grp, CASE WHEN fired THEN 'REJECT' ELSE 'ADMIT' END FROM dec),
      k AS (SELECT policy, count(*) FILTER ({_BAD} AND x = 'ADMIT') AS false_admits, count(*) FILTER ({_GOOD} AND x = 'REJECT') AS false_rejects, count(*) FILTER (x = 'CONDITIONAL') AS n_conditional, count(*) AS n FROM pol GROUP BY 1),
      cost(scenario, fa, fr, rv) AS (VALUES {", ".join(f"({i}, {a}::DOUBLE, {r}::DOUBLE, {v}::DOUBLE)" for i, (a, r, v) in enumerate(co.COSTS))}),
      c AS (SELECT *, fa * false_admits + fr * false_rejects + rv * n_conditional AS cost FROM k, cost)
      SELECT scenario, policy, false_admits, false_rejects, n_conditional, round(cost, 6) AS cost, round(cost / n, 6) AS cost_per_dataset, first_value(policy) OVER (PARTITION BY scenario ORDER BY c.cost, policy) AS best FROM c""",
    "corpus_threshold_sweep": _M + f""", th AS (SELECT round(i * 0.05e0, 6) AS theta FROM range(0, 21) x(i)), j AS (SELECT theta, grp, coalesce(t >= theta, false) AND NOT fired AS ok FROM dec, th)
      SELECT theta, count(*) FILTER ({_GOOD} AND ok) AS true_admits, count(*) FILTER ({_GOOD} AND NOT ok) AS missed, count(*) FILTER ({_BAD} AND ok) AS false_admits, count(*) FILTER ({_BAD} AND NOT ok) AS held FROM j GROUP BY 1""",
    "corpus_pick_thresholds": _M + f""", e AS (SELECT max(t) FILTER ({_BAD} AND NOT fired) AS top, min(t) FILTER ({_GOOD}) AS low FROM dec), f AS (SELECT least(1e0, (floor(top / 0.005e0 + 1e-9) + 1) * 0.005e0) AS a, greatest(0e0, (ceil(low / 0.005e0 - 1e-9) - 1) * 0.005e0) AS r FROM e)
      SELECT round(a, 6) AS theta_admit, round(least(r, a), 6) AS theta_reject FROM f""",
    "corpus_entropy_weights": _M + "SELECT axis, test, m, round(weight, 6) AS weight FROM ew",
    "corpus_blended_weights": _M + """, p AS (SELECT *, m < 20 AS kept FROM ew JOIN prior USING (test))
      SELECT axis, test, m, round(CASE WHEN kept THEN prior ELSE (1e0 - coalesce(sum(prior) FILTER (kept) OVER a, 0)) * prior * weight / sum(prior * weight) FILTER (NOT kept) OVER a END, 6) AS weight FROM p WINDOW a AS (PARTITION BY axis)""",
    "corpus_leave_one_out": _M + """, gs AS (SELECT grp AS left_out, left(test, 1) AS axis, test, count(score) AS m, sum(score) AS s, sum(CASE WHEN score > 0 THEN score * ln(score) ELSE 0 END) AS sl FROM scores JOIN facts USING (dataset_id) WHERE score IS NOT NULL GROUP BY ALL),
      rest AS (SELECT left_out, axis, test, CAST(sum(m) OVER a - m AS BIGINT) AS m, sum(s) OVER a - s AS s, sum(sl) OVER a - sl AS sl FROM gs WINDOW a AS (PARTITION BY test)),
      dd AS (SELECT *, CASE WHEN m >= 2 AND s > 0 THEN 1e0 + (sl / s - ln(s)) / ln(m) ELSE 0 END AS d FROM rest)
      SELECT left_out, axis, test, m, round(CASE WHEN sum(d) OVER a > 0 THEN d / sum(d) OVER a ELSE 1e0 / count(*) OVER a END, 6) AS weight FROM dd WINDOW a AS (PARTITION BY left_out, axis)""",
    "corpus_extremes": _M + """SELECT test, arg_min(dataset_id, row(score, dataset_id)) AS worst, round(min(score), 6) AS worst_score, arg_min(dataset_id, row(-score, dataset_id)) AS best, round(max(score), 6) AS best_score
      FROM scores WHERE score IS NOT NULL GROUP BY test""",
    "corpus_merged_manifest": _M + "SELECT dataset_id, round(t, 6) AS t, grp, n_records FROM soft WHERE variant = 'blended'",
    "corpus_labels": "SELECT dataset_id, coalesce(min(label), min(category)) AS label FROM corpus_manifest WHERE dataset_id IS NOT NULL GROUP BY 1",
    "corpus_parents": """WITH r AS (SELECT dataset_id, category, label, nullif(trim(parent_catalog, ' '), '') AS p FROM corpus_manifest)
      SELECT category, p IN (SELECT dataset_id FROM r WHERE label = 'known_good' AND dataset_id IS NOT NULL) AS found, count(*) AS n FROM r WHERE p IS NOT NULL GROUP BY ALL""",
    "corpus_grouped_split": """SELECT count(*) AS n_parents, CAST(sum(n) AS BIGINT) AS n_datasets, true AS near FROM (
      SELECT coalesce(nullif(trim(parent_catalog, ' '), ''), dataset_id) AS p, count(*) AS n FROM corpus_manifest GROUP BY 1 HAVING p IS NOT NULL)""",
    "corpus_same_members": _M + "SELECT (SELECT count(DISTINCT dataset_id) FROM scores WHERE score IS NOT NULL) = (SELECT count(*) FROM facts) AS same",
    "corpus_predictive_values": _M + f""", m AS (SELECT 1e0 - count(*) FILTER ({_BAD} AND decision = 'ADMIT') / count(*) FILTER ({_BAD}) AS se, 1e0 - count(*) FILTER ({_GOOD} AND decision = 'REJECT') / count(*) FILTER ({_GOOD}) AS sp FROM dec),
      p(prevalence) AS (VALUES (0.01e0), (0.05e0), (0.1e0), (0.25e0), (0.5e0))
      SELECT prevalence, round(se * prevalence / nullif(se * prevalence + (1 - sp) * (1 - prevalence), 0), 6) AS ppv, round(sp * (1 - prevalence) / nullif(sp * (1 - prevalence) + (1 - se) * prevalence, 0), 6) AS npv FROM m, p""",
    "corpus_refit_agreement": _M + """, gs AS (SELECT grp AS left_out, left(test, 1) AS axis, test, count(score) AS m, sum(score) AS s, sum(CASE WHEN score > 0 THEN score * ln(score) ELSE 0 END) AS sl FROM scores JOIN facts USING (dataset_id) WHERE score IS NOT NULL GROUP BY ALL),
      rest AS (SELECT left_out, axis, test, sum(m) OVER a - m AS m, sum(s) OVER a - s AS s, sum(sl) OVER a - sl AS sl FROM gs WINDOW a AS (PARTITION BY test)),
      dd AS (SELECT *, CASE WHEN m >= 2 AND s > 0 THEN 1e0 + (sl / s - ln(s)) / ln(m) ELSE 0 END AS d FROM rest),
      en AS (SELECT left_out, axis, test, m, CASE WHEN sum(d) OVER a > 0 THEN d / sum(d) OVER a ELSE 1e0 / count(*) OVER a END AS weight FROM dd WINDOW a AS (PARTITION BY left_out, axis)),
      bl AS (SELECT left_out, axis, test, CASE WHEN m < 20 THEN prior ELSE (1e0 - coalesce(sum(prior) FILTER (m < 20) OVER a, 0)) * prior * weight / sum(prior * weight) FILTER (m >= 20) OVER a END AS w
        FROM en JOIN prior USING (test) WINDOW a AS (PARTITION BY left_out, axis)),
      av AS (SELECT left_out, dataset_id, bl.axis, sum(w * score) / nullif(sum(w), 0) AS v FROM scores JOIN facts USING (dataset_id) JOIN bl ON bl.left_out = grp AND bl.test = scores.test WHERE score IS NOT NULL GROUP BY ALL),
      rt AS (SELECT left_out, dataset_id, sum(aw * v) / sum(aw) FILTER (v IS NOT NULL) AS t2 FROM av JOIN (SELECT DISTINCT axis, aw FROM wt WHERE variant = 'blended') x USING (axis) GROUP BY ALL),
      c AS (SELECT left_out, CASE WHEN fired THEN 'REJECT' WHEN t2 >= 0.75e0 THEN 'ADMIT' WHEN t2 >= 0.2e0 THEN 'CONDITIONAL' ELSE 'REJECT' END AS x, d FROM rt JOIN soft USING (dataset_id) WHERE variant = 'blended'),
      z AS (SELECT grp AS left_out, CAST(sum(count(*)) OVER () - count(*) AS BIGINT) AS n_train FROM facts GROUP BY grp)
      SELECT left_out, count(*) AS n_rows, count(*) FILTER (x = d) AS n_same, n_train, round(count(*) FILTER (x = d) / count(*), 6) AS agreement FROM c JOIN z USING (left_out) WHERE n_train >= 50 GROUP BY left_out, n_train""",
    "corpus_unscored": _M + "SELECT dataset_id, grp FROM facts WHERE dataset_id NOT IN (SELECT lower(trim(catalog_id, ' ')) FROM event_records WHERE catalog_id IS NOT NULL)",
}
