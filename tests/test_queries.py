"""Queries against their SQL on the smallest test data, where these are there."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from quakeledger.plans import registry, study_queries
from quakeledger.runtime import checkpoint, written
from quakeledger.streaming.incremental import daily_gate_counts
from tools.compare import canonical

DATA = Path("/root/testdata/sf0.001")
CHECKED = (
    "stage1_gates", "verdict_blend", "a6_states", "subtest_p8_proximity", "i1_drift", "source_csv_duplicates", "corpus_risk_coverage", "corpus_refit_agreement",
    "gate_counts", "a1_benford", "a5_near_duplicates", "a6_matches", "c3_coverage", "i5_drift", "corpus_three_way", "corpus_leave_one_out", "stream_daily_gates", "ingest_prepare", "p1_found", "p6_found")


def test_every_sql_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.skipif(not DATA.is_dir(), reason="the test data are not here")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    got = canonical(registry.queries()[name](spark, str(DATA)).toPandas())
    want = canonical(con.execute(registry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and got.equals(want)


def test_late_state_is_dropped_only_on_request(spark):
    schema = "catalog_id string, record_id long, origin_time timestamp_ntz, ingested_at timestamp_ntz, latitude double, longitude double, depth_km double, magnitude double"
    rows = spark.createDataFrame([], schema)
    assert daily_gate_counts(rows).count() == 0


@pytest.mark.skipif(not DATA.is_dir(), reason="the test data are not here")
def test_uncertainty_audits_a_hundred_replicates_of_both_tables(spark, monkeypatch):
    asked = []

    class Spy:
        def __init__(self, references=None, faults=None):
            self.given = (references is not None, faults is not None)

        def verdicts(self, cat):
            asked.append((self.given, cat))
            return cat.groupBy("catalog_id").agg(F.lit(0.5).alias("trust"), F.lit(False).alias("fired"), F.lit("ADMIT").alias("decision"))

    monkeypatch.setattr(study_queries, "Audit", Spy)
    got = study_queries.uncertainty(spark, str(DATA)).groupBy("table").agg(F.max("n_replicates").alias("n"), F.count("*").alias("catalogs")).collect()
    assert {r["table"]: r["n"] for r in got} == {"local_bulletin": 100, "event_records": 100}
    assert [given for given, _ in asked] == [(True, True), (False, True)]
    assert "record_id" in asked[1][1].columns and all(r["catalogs"] > 1 for r in got)


@pytest.mark.skipif(not DATA.is_dir(), reason="the test data are not here")
def test_replicates_audited_in_runs_are_those_of_one_run(spark, monkeypatch):
    folders = []

    class Spy:
        def __init__(self, references=None, faults=None):
            pass

        def verdicts(self, cat):
            kept = written(checkpoint(cat))
            folders.append(kept.inputFiles()[0].removeprefix("file:").rpartition("/")[0])
            return kept.groupBy("catalog_id").agg(F.avg("magnitude").alias("trust"), (F.count("*") > 20).alias("fired"), F.lit("ADMIT").alias("decision"))

    monkeypatch.setattr(study_queries, "Audit", Spy)
    results = []
    for most, runs in ((1_000_000, 2), (30_000, 5)):
        monkeypatch.setattr(study_queries, "RESAMPLED_ROWS", most)
        results.append(canonical(study_queries.uncertainty(spark, str(DATA)).toPandas()))
        assert len(folders) >= runs and not any(Path(x).exists() for x in folders)
        folders.clear()
    assert results[0].equals(results[1]) and set(results[1]["n_replicates"]) == {"100"}


def test_all_sources_are_merged_pairwise(spark, monkeypatch):
    # Three sources report event 0, two of them event 1; 2 and 3 are far apart and stand in the last one alone.
    rows = [(i, s, t, 10.0, 10.0, 5.0) for i, s, t in ((1, "a", 0.0), (2, "b", 1.0), (3, "c", 2.0), (4, "b", 9_000.0), (5, "c", 9_001.0), (6, "c", 50_000.0), (7, "c", 90_000.0))]
    refs = spark.createDataFrame(rows, "ref_id long, source_id string, t double, latitude double, longitude double, magnitude double")
    monkeypatch.setattr(study_queries, "references", lambda s, d: refs)
    assert sorted(r["id"] for r in study_queries.agencies_merged(spark, "").collect()) == [1, 4, 6, 7]


@pytest.mark.skipif(not DATA.is_dir(), reason="the test data are not here")
def test_b_values_are_compared_at_three_severities(spark):
    got = study_queries.corrupted_audit(spark, str(DATA)).select("kind", "severity").distinct().collect()
    assert len({r["kind"] for r in got}) == 6 and len({r["severity"] for r in got}) == 3 and len(got) == 18
