from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeledger.audit import Audit
from quakeledger.catalog import canonical, seconds
from quakeledger.functions.estimators import fit_omori
from quakeledger.operators import generators as gen
from quakeledger.operators import studies
from quakeledger.operators import subtests as st
from quakeledger.operators.decision import Thresholds, with_decision
from quakeledger.operators.interval import densify, hash_sample, nearest_km, positive_gaps, ranked
from quakeledger.operators.spatial import near_pairs

START = datetime(2020, 1, 1)
COLS = "catalog_id string, record_id long, origin_time timestamp_ntz, latitude double, longitude double, depth_km double, magnitude double, source string, n long"


def make(spark, rows):
    """rows: catalog, id, day or None, lat, lon, depth, magnitude, source."""
    data = [(c, i, None if d is None else START + timedelta(days=d), la, lo, de, m, s, 1) for c, i, d, la, lo, de, m, s in rows]
    return canonical(spark.createDataFrame(data, COLS)).withColumn("t", seconds())


@pytest.fixture(scope="module")
def ladder(spark):
    out = gen.fabricate(spark, "made", 400, 5).unionByName(gen.fabricate(spark, "crude", 400, 1))
    return out.withColumn("t", seconds()).cache()


def test_bounds_are_inclusive_and_missing_is_no_violation(spark):
    c = make(spark, [("a", 1, 0, 90.0, 180.0, 750.0, 9.5, "x"), ("a", 2, 0, -90.5, 0.0, -5.1, 9.6, "x"), ("a", 3, None, None, float("nan"), None, float("inf"), "x"), ("a", 2, 0, -90.5, 0.0, -5.1, 9.6, "x")])
    r = st.row_stats(c).first()
    assert (r["n"], r["p1_k"], r["p2_k"], r["p3_k"], r["c1_magnitude"]) == (3, 1, 1, 1, 2)
    assert [q["record_id"] for q in st.quarantine(c).collect()] == [2]


def test_gate_fires_on_concentrated_violations(spark):
    rows = [("few", i, i, 0.0, 0.0, 900.0 if i < 1 else 10.0, 4.0, "x") for i in range(2000)] + [("many", i, i, 0.0, 0.0, 900.0 if i < 30 else 10.0, 4.0, "x") for i in range(2000)]
    got = {r["catalog_id"]: r["fired"] for r in st.gates(st.row_stats(make(spark, rows))).collect()}
    assert got == {"few": False, "many": True}


def test_near_duplicates_across_the_antimeridian(spark):
    rows = [("a", 1, 0, 0.0, 179.999, 1.0, 4.0, "x"), ("a", 2, 0.00001, 0.0, -179.999, 1.0, 4.0, "x"), ("a", 3, 5, 0.0, 0.0, 1.0, 4.0, "x"), ("a", 4, 9, 1.0, 1.0, 1.0, 4.0, "x"), ("a", 5, 9, 1.0, 1.0, 1.0, 4.0, "x"), ("b", 6, 0, 0.0, 179.999, 1.0, 4.0, "x")]
    got = {r["catalog_id"]: r for r in st.a5_duplicates(make(spark, rows)).collect()}
    assert got["a"]["n_flagged"] == 4 and got["a"]["score"] == pytest.approx(0.2) and got["b"]["score"] == 1.0


def test_three_states(spark):
    rows = [("true", i, i, 10.0, 10.0, 5.0, 5.5, "x") for i in range(40)] + [("false", i, i, -40.0, 10.0, 5.0, 5.5, "x") for i in range(40)] + [("small", i, i, -40.0, 10.0, 5.0, 3.0, "x") for i in range(40)]
    c = make(spark, rows)
    base = make(spark, [("r", i, i, 10.01, 10.0, 5.0, 5.4, "x") for i in range(40)]).select("t", "latitude", "longitude", "magnitude")
    refs = base.withColumn("source_id", F.lit("r1")).unionByName(base.withColumn("source_id", F.lit("r2")))
    mc = spark.createDataFrame([("r1", 4.5, 0.1, False), ("r2", 4.5, 0.1, True)], "source_id string, mc double, mc_se double, is_default boolean")
    votes = st.source_votes(c, refs, mc)
    got = {r["catalog_id"]: r for r in st.a6_external(votes).collect()}
    assert got["true"]["score"] == 1.0 and not got["true"]["confirmed"]
    assert got["false"]["score"] == 0.0 and got["false"]["confirmed"] and "small" not in got
    assert st.effective_records(votes, st.a6_external(votes)).count() == 80
    assert votes.where("catalog_id = 'true'").first()["weighted"] == pytest.approx(1.0)


def test_decision_gates_in_order(spark):
    rows = [(0.9, False, 0.4, 0.4, 10, 1), (0.9, False, 0.6, 0.4, 10, 1), (0.9, False, 0.6, 0.6, 10, 1), (0.9, False, 0.6, 0.6, 90, 1), (0.9, False, 0.6, 0.6, 90, 9), (0.5, False, 0.1, 0.1, 1, 1), (0.1, False, 0.9, 0.9, 90, 9), (0.9, True, 0.9, 0.9, 90, 9), (None, False, 0.9, 0.9, 90, 9)]
    df = spark.createDataFrame(rows, "trust double, stopped boolean, evidence_coverage double, sample_sufficiency double, n long, n_tests int")
    got = [(r["decision"], r["capped_by"]) for r in with_decision(df).collect()]
    assert got == [("CONDITIONAL", "coverage"), ("CONDITIONAL", "sufficiency"), ("CONDITIONAL", "records"), ("CONDITIONAL", "tests"), ("ADMIT", None), ("CONDITIONAL", None), ("REJECT", None), ("REJECT", None), ("REJECT", None)]
    with pytest.raises(ValueError):
        Thresholds(admit=0.1, reject=0.5)


def test_another_catalog_changes_nothing(spark, ladder):
    both = {r["catalog_id"]: r for r in Audit().verdicts(ladder).collect()}
    alone = Audit().verdicts(ladder.where("catalog_id = 'made'").repartition(3)).collect()
    assert len(alone) == 1
    for c, v in alone[0].asDict().items():
        assert v == (pytest.approx(both["made"][c], abs=1e-9) if isinstance(v, float) else both["made"][c])
    assert both["crude"]["A"] < both["made"]["A"]


def test_subtests_are_not_held_in_one_plan(spark, ladder):
    rows = Audit().subtest_rows(ladder)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 10 and rows.select("test").distinct().count() == 20


def test_degenerate_catalogs_pass_through(spark):
    rows = [("one", 1, 0, 1.0, 1.0, 1.0, 1.0, None)] + [("same", i, 0, 1.0, 1.0, 1.0, 4.0, "") for i in range(60)] + [("none", i, None, None, None, None, None, None) for i in range(60)]
    got = {r["catalog_id"]: r for r in Audit().verdicts(make(spark, rows)).collect()}
    assert set(got) == {"one", "same", "none"} and got["one"]["decision"] != "ADMIT"
    assert Audit().verdicts(make(spark, rows).limit(0)).count() == 0


def test_ranks_gaps_and_samples(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), (F.col("id") % 10).cast("double").alias("t"), "id")
    got = ranked(df, "k", ["t", "id"]).toPandas()
    for _, g in got.groupby("k"):
        g = g.sort_values(["t", "id"])
        assert list(g["rn"]) == list(range(1, len(g) + 1)) and set(g["n"]) == {len(g)}
    gaps = positive_gaps(df.withColumn("t", F.col("t") * 40 * 86_400), "k", "t").groupBy("k").agg(F.count("*").alias("n"), F.sum("gap").alias("s")).collect()
    assert all(r["s"] <= 9 * 40 * 86_400 and r["n"] <= 9 for r in gaps)
    a, b = (hash_sample(d, "k", ["id"], 20).select("id").orderBy("id").collect() for d in (df, df.repartition(7)))
    assert a == b and len(a) == 8 * 20


def test_nearest_equals_brute_force_and_wraps(spark):
    import random

    rng = random.Random(1)
    refs = [(rng.uniform(-50, 50), rng.uniform(-180, 180)) for _ in range(200)] + [(0.0, 179.9)]
    pts = [(i, rng.uniform(-50, 50), rng.uniform(-180, 180)) for i in range(150)] + [(900, 0.0, -179.9), (901, None, 1.0)]
    got = {r["id"]: r["nearest_km"] for r in nearest_km(spark.createDataFrame(pts, "id long, latitude double, longitude double"), spark.createDataFrame(refs, "latitude double, longitude double")).collect()}
    from math import asin, cos, radians, sin, sqrt

    def km(a, b, c, d):
        return 2 * 6371.0088 * asin(sqrt(sin(radians(c - a) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin(radians(d - b) / 2) ** 2))

    exact = {i: min(km(la, lo, *r) for r in refs) for i, la, lo in pts if la is not None}
    assert got[901] is None and got[900] == pytest.approx(exact[900])
    assert all(got[i] >= d - 1e-6 for i, d in exact.items()) and sum(got[i] == pytest.approx(d) for i, d in exact.items()) > 0.9 * len(exact)
    line = spark.createDataFrame([("l", 0, 0.0, 179.5), ("l", 1, 0.0, -179.5), ("p", 0, 5.0, 5.0)], "line string, i int, latitude double, longitude double")
    dense = densify(line, "line", "i").collect()
    assert sum(r["line"] == "l" for r in dense) == 13 and all(abs(r["longitude"]) >= 179.49 for r in dense if r["line"] == "l")


def test_corruptions_hit_their_share(spark, ladder):
    cat = ladder.where("catalog_id = 'made'").drop("t")
    for kind in gen.CORRUPTIONS:
        a, b = (gen.corrupt(d, kind, 0.5).orderBy("record_id").collect() for d in (cat, cat.repartition(5)))
        assert a == b
        changed = sum(x != y for x, y in zip(sorted(cat.collect()), a))
        assert len(a) == 400 + (180 if kind == "inject_duplicates" else 0)
        assert kind == "inject_duplicates" or changed > 60
    with pytest.raises(ValueError):
        gen.corrupt(cat, "nothing", 0.5)
    with pytest.raises(ValueError):
        gen.fabricate(spark, "x", 10, 11)


def test_one_to_one_takes_the_nearest(spark):
    cols = "id long, t double, latitude double, longitude double, magnitude double"
    a = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 4.0), (2, 10.0, 0.0, 0.0, 4.0), (3, 500.0, 0.0, 0.0, 4.0)], cols)
    b = spark.createDataFrame([(11, 9.0, 0.0, 0.0, 4.0), (12, 12.0, 0.0, 0.0, 4.0), (13, 500.0, 9.0, 0.0, 4.0)], cols)
    got = {(r["id"], r["id_2"]) for r in studies.one_to_one(a, b).collect()}
    assert got == {(2, 11), (1, 12)}
    assert studies.one_to_one(a.limit(0), b).count() == 0
    assert near_pairs(a, None, "id", "latitude", "longitude", 1.0).count() == 3


def test_large_clusters_are_fitted_from_all_rows(spark, monkeypatch):
    # Decaying times with ties, uniform ones, and times that are all equal, each after one large shock.
    rng = np.random.default_rng(4)
    days = {"decay": np.round(0.01 * (3_000 ** rng.uniform(0, 1, 900)), 3), "even": rng.uniform(0.5, 29, 400), "equal": np.full(60, 3.0)}
    rows = []
    for c, times in days.items():
        rows += [(c, 1, 0, 10.0, 10.0, 5.0, 8.0, "x")] + [(c, 2 + i, float(d), 10.0 + i * 1e-5, 10.0, 5.0, 4.0, "x") for i, d in enumerate(times)]
    cat = make(spark, rows)
    monkeypatch.setattr(st, "CLUSTER_EVENTS", 50)
    got = {r["catalog_id"]: r for r in st.a3_omori(cat).collect()}
    pairs = st.aftershock_pairs(cat).toPandas()
    for c in days:
        fit = fit_omori(pairs[pairs["catalog_id"] == c]["dt"].to_numpy())
        score = 0.0 if fit["degenerate"] else 0.5 + 0.5 * (1 - min(1.0, abs(fit["p"] - 1.2) / 1.2))
        assert got[c]["n_valid"] == (not fit["degenerate"]) and got[c]["score"] == pytest.approx(score, abs=1e-12)
    assert got["decay"]["n_valid"] == 1 and got["even"]["n_valid"] == got["equal"]["n_valid"] == 0
