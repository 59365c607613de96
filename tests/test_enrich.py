import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quakeledger.operators.enrich import fetch_status, fill_missing, looked_up, ruptures
from quakeledger.sources.boundaries import first_existing, plate_boundary

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_present_values_stay(spark):
    rows = spark.createDataFrame([("a", 1.0, None), ("a", None, "x"), ("b", None, None), (None, None, None)], "uid string, depth double, kind string")
    known = spark.createDataFrame([("a", 5.0, "k"), ("a", 7.0, None), (None, 9.0, "n")], "uid string, depth double, kind string")
    got = sorted(map(tuple, fill_missing(rows, known, "uid", ["depth", "kind"]).collect()), key=str)
    assert got == sorted([("a", 1.0, "k"), ("a", 7.0, "x"), ("b", None, None), (None, None, None)], key=str)
    assert fill_missing(rows.limit(0), known, "uid", ["depth"]).count() == 0


def test_answers_are_stored_and_failures_asked_again(spark, tmp_path):
    def fetch(broken):
        def get(k):
            if k in broken:
                raise OSError("no answer")
            return {"m0": 1.0 * len(k)} if k != "miss" else None

        return get

    keys = spark.createDataFrame([("aa",), ("aa",), ("miss",), ("bad",), (None,)], "uid string")
    store = str(tmp_path / "answers")
    first = {r["uid"]: (r["found"], r["m0"]) for r in looked_up(keys, "uid", "m0 double", fetch({"bad"}), store).collect()}
    assert first == {"aa": (True, 2.0), "miss": (False, None), "bad": (False, None)}
    again = {r["uid"]: (r["found"], r["m0"]) for r in looked_up(keys, "uid", "m0 double", fetch({"aa", "miss"}), store).collect()}
    assert again == {"aa": (True, 2.0), "miss": (False, None), "bad": (True, 3.0)}
    assert spark.read.parquet(store).count() == 3


def test_small_operators(spark, tmp_path):
    got = ruptures(spark.createDataFrame([(90.0, 10.0, 4.0)], "rake double, l double, w double"), F.col("rake"), F.col("l"), F.col("w")).first()
    assert (got["mechanism"], got["rupture_area_km2"]) == ("reverse", 40.0)
    status = fetch_status(spark.createDataFrame([("a", 0), ("b", 3), ("c", 20), ("d", None)], "file string, n_rows long"))
    assert {r["file"]: r["status"] for r in status.collect()} == {"a": "EMPTY", "b": "SPARSE", "c": "OK", "d": "EMPTY"}
    (tmp_path / "x").write_text("")
    assert first_existing(None, str(tmp_path / "none"), str(tmp_path / "x")) == str(tmp_path / "x") and first_existing(None) is None
    assert plate_boundary(spark).count() >= 30


def test_manifest_joins(spark):
    from quakeledger.operators import corpus as co

    scores = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "dataset_id string, t double")
    manifest = spark.createDataFrame([("a", "x"), ("b", None), ("c", "y")], "dataset_id string, label string")
    assert co.merged_manifest(scores, manifest).count() == 2
    with pytest.raises(ValueError, match="more than once"):
        co.merged_manifest(scores.unionByName(scores), manifest)
    with pytest.raises(ValueError, match="doesn't list"):
        co.merged_manifest(scores.unionByName(spark.createDataFrame([("z", 1.0)], scores.schema)), manifest)
    own = co.labelled(scores.withColumn("label", F.lit("own")), manifest)
    assert {r["dataset_id"]: r["label"] for r in own.collect()} == {"a": "x", "b": "own"}
    assert co.same_members(scores, scores, "dataset_id") and not co.same_members(scores, manifest, "dataset_id")


def test_nearest_points_agree_however_many_there_are(spark):
    import random

    from quakeledger.operators.interval import exact_median, nearest_km

    rng = random.Random(4)
    refs = spark.createDataFrame([(rng.uniform(-80, 80), rng.uniform(-180, 180)) for _ in range(150)], "latitude double, longitude double")
    rows = [(i, rng.choice([None, rng.uniform(-90, 90)]), rng.uniform(-180, 180)) for i in range(400)] + [(500, 89.9, 10.0), (501, 0.0, 180.0), (502, 0.0, -180.0)]
    points = spark.createDataFrame(rows, "id long, latitude double, longitude double")
    one, two = ({r["id"]: r["nearest_km"] for r in nearest_km(points, refs, most_points=m).collect()} for m in (1_000, 10))
    assert one.keys() == two.keys() and all((one[k] is None) == (two[k] is None) and (one[k] is None or abs(one[k] - two[k]) < 1e-6) for k in one)
    none = {r["nearest_km"] for r in nearest_km(points.where("latitude IS NOT NULL"), refs.limit(0)).collect()}
    assert none == {5000.0}
    values = [(k, rng.choice([rng.uniform(-5, 5), 1.0, None])) for k in "ab" for _ in range(201 if k == "a" else 50)]
    import statistics

    got = {r["k"]: r["median"] for r in exact_median(spark.createDataFrame(values, "k string, v double"), ["k"], "v").collect()}
    assert got == {k: statistics.median([v for x, v in values if x == k and v is not None]) for k in "ab"}
