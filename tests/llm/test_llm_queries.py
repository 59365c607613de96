"""Queries of the training-data operators against their SQL on the smallest test data, where these are there."""

from pathlib import Path

import duckdb
import pytest

from quakeledger.llm import q_splits
from quakeledger.llm.queries import QUERIES, SQL
from tools.compare import canonical

DATA = Path("/root/testdata/sf0.001")


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.skipif(not DATA.is_dir(), reason="the test data are not here")
@pytest.mark.parametrize("name", sorted(set(SQL) - {"p2_kept", "p8_kept"}))  # shares need more rows than these tables have
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    got, want = canonical(QUERIES[name](spark, str(DATA)).toPandas()), canonical(con.execute(SQL[name]).df())
    assert list(got.columns) == list(want.columns) and got.equals(want)


@pytest.mark.skipif(not DATA.is_dir(), reason="the test data are not here")
def test_related_sets_come_from_the_updated_component_table(spark, monkeypatch):
    stores = []

    class Spy(q_splits.ComponentTable):
        def __init__(self, *given):
            super().__init__(*given)
            stores.append(self)

    monkeypatch.setattr(q_splits, "ComponentTable", Spy)
    got = canonical(q_splits.p2_found(spark, str(DATA)).toPandas())
    con = duckdb.connect()
    for name in ("corpus_manifest", "adversarial_corpus_manifest"):
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    want = canonical(con.execute(q_splits.P2_FOUND_SQL).df())
    assert list(got.columns) == list(want.columns) and got.equals(want)
    assert [s.version for s in stores] == [2]
