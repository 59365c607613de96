import random
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quakeledger.llm import q_matching as q
from quakeledger.llm.matching import bucket_keys, calibrate, combined, dealt_into_parts, matched_pairs, part_pairs, skip_gram, walk_contexts

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the callables below run in Python workers
SCHEMA = "side int, id long, at double, names array<long>"


def test_walks_stay_in_their_component_and_vectors_come_together():
    # Records 0-3 share tokens 0-2, records 4-6 share tokens 3-4; record 7 has none.
    rec = np.array([0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6])
    tok = np.array([0, 1, 0, 1, 1, 2, 0, 2, 3, 4, 3, 4, 3, 4])
    seeds = combined(np.arange(8))
    records, contexts = walk_contexts(rec, tok, 8, seeds)
    assert records.tolist() == list(range(7))
    assert all((r < 4) == (c < 3).all() for r, c in zip(records, contexts))
    v = skip_gram(contexts, combined(np.arange(5)), seeds[records])
    cos = v @ v.T
    assert cos[0, 1] > cos[0, 4] + 0.2 and cos[4, 5] > 0.8
    assert np.array_equal(walk_contexts(rec, tok, 8, seeds)[1], contexts)
    start = skip_gram(contexts, combined(np.arange(5)), seeds[records], rounds=0)
    assert abs((start @ start.T)[0, 1]) < 0.6
    assert bucket_keys(v).shape == (7, 32)


def _twins(n=3_000, seed=1):
    """n twins: they share four tokens of their own and have one at random."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = rng.uniform(0, 40 * 86_400)
        names = [i * 10 + k for k in range(4)]
        rows += [(1, i, t, names + [rng.randrange(2**40)]), (2, i, t + rng.choice([0.0, 1.0]), names + [rng.randrange(2**40)])]
    return rows


def _tokens(b):
    lens = [len(x) for x in b["names"]]
    return np.repeat(np.arange(len(b)), lens), combined(np.array([y for x in b["names"] for y in x], np.int64))


def _possible(a, b):
    return np.abs(a - b) <= 5




def _all(one, two):
    return np.arange(len(one)), {"x": np.zeros(len(one))}


def _run(spark, rows, part=6_000, possible=_possible):
    parts = dealt_into_parts(spark.createDataFrame(rows, SCHEMA), 5.0, 3600, 600, 5.0, part)
    got = matched_pairs(parts.select("part", "side", "id", "at", "names"), _tokens, 5.0, possible, _all, "x double")
    return [(r["id1"], r["id2"]) for r in got.drop("x").collect()]


@pytest.mark.parametrize("part", [6_000, 200])
def test_twins_are_found_once_across_parts(spark, part):
    pairs = _run(spark, _twins(), part)
    assert len(pairs) == len(set(pairs))
    assert sum(i == j for i, j in pairs) >= 0.99 * 3_000


def test_training_is_what_finds_them():
    b = pd.DataFrame(_twins(), columns=["side", "id", "at", "names"]).sort_values(["side", "id"]).reset_index(drop=True)
    found = {}
    for rounds in (0, 6):
        p = part_pairs(b, _tokens, 5.0, _possible, _all, rounds)
        found[rounds] = int((p["id1"] == p["id2"]).sum())
    assert found[6] >= 0.99 * 3_000 and found[0] < 0.3 * 3_000


def test_a_crowded_day_is_divided_and_loses_nothing(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        t = rng.uniform(0, 86_390)
        rows += [(1, i, t, [i, i + 10_000, i + 20_000]), (2, i, t + rng.choice([-4.0, 0.0, 4.0]), [i, i + 10_000, i + 20_000])]
    pairs = _run(spark, [r for r in rows if r[2] >= 0], 100)
    assert len(pairs) == len(set(pairs)) and sum(i == j for i, j in pairs) >= 0.97 * 600
    same = [(s, i, 1000.0, [7, 8, 9]) for i in range(120) for s in (1, 2)]
    got = _run(spark, same, 40)
    assert len(got) == len(set(got)) >= 0.95 * 120**2  # every block is searched; buckets find all but a few


def test_empty_null_and_without_tokens(spark):
    assert _run(spark, []) == []
    assert _run(spark, [(1, 1, 0.0, []), (2, 1, 0.0, [])]) == []
    assert _run(spark, [(1, 1, None, [1]), (2, 1, 0.0, [1])]) == []


def test_calibration_rises_with_the_cosine(spark):
    rng = random.Random(3)
    rows = [(i, i, c := rng.random(), None if rng.random() < 0.1 else float(rng.random() < c)) for i in range(2000)]
    schema = "id1 long, id2 long, cos double, sure double"
    a, _ = calibrate(spark.createDataFrame(rows, schema), "cos", "sure")
    assert a > 1
    assert calibrate(spark.createDataFrame([], schema), "cos", "sure") == (0.0, 0.0)


def _tables(spark, folder, reports, refs):
    spark.createDataFrame(reports, "report_id long, origin_time timestamp_ntz, latitude double, longitude double, magnitude double, place string").write.parquet(f"{folder}/local_bulletin.parquet")
    spark.createDataFrame(
        refs, "ref_id long, source_id string, origin_time timestamp_ntz, latitude double, longitude double, magnitude double, region_text string, revision_status string"
    ).write.parquet(f"{folder}/reference_events.parquet")


def test_quakes_with_faults_are_matched(spark, tmp_path):
    """Clocks 13 hours off, signs mistaken, clocks rounded to minutes, missing values; nulls and repeated rows."""
    from datetime import datetime, timedelta

    rng = random.Random(8)
    reports, refs = [], []
    for i in range(300):
        at = datetime(2020, 1, 1) + timedelta(seconds=round(rng.uniform(0, 60 * 86_400), 2))
        lat, lon, mag = rng.uniform(-60, 60), rng.uniform(-170, 170), rng.uniform(3, 6)
        refs.append((1000 + i, "a", at, lat + 0.02, lon - 0.02, mag + 0.1, f"Qworld{i} region", "final"))
        when, y, x, m, place = at + timedelta(seconds=1), lat, lon, mag, f"near Qworld{i}"
        kind = i % 5
        if kind == 1:
            when += timedelta(hours=13)
        elif kind == 2:
            y = -y
        elif kind == 3:
            when = when.replace(second=0, microsecond=0)
        elif kind == 4:
            m = place = None
        reports.append((i, when, y, x, m, place))
    reports += [reports[0], (900, None, 1.0, 1.0, 4.0, None), (None, datetime(2020, 1, 2), 1.0, 1.0, 4.0, None)]
    _tables(spark, str(tmp_path), reports, refs)
    got = {(r["report_id"], r["ref_id"]) for r in q.p3_found(spark, str(tmp_path)).collect()}
    right = {(i, 1000 + i) for i in range(300)}
    assert len(got & right) >= 0.97 * 300 and len(got - right) <= 6
    by_kind = [sum((i, 1000 + i) in got for i in range(k, 300, 5)) for k in range(5)]
    assert min(by_kind) >= 54
    conf = q.p3_confidence(spark, str(tmp_path)).agg(F.min("confidence").alias("a"), F.max("confidence").alias("b")).first()
    assert 0 <= conf["a"] <= conf["b"] <= 1


def test_empty_tables_give_nothing(spark, tmp_path):
    _tables(spark, str(tmp_path), [], [])
    assert q.p3_found(spark, str(tmp_path)).collect() == [] and q.p3_confidence(spark, str(tmp_path)).collect() == []
