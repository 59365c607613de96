from pyspark.sql import functions as F

from quakeledger.operators import corpus as co


def test_grouped_split_of_more_parents_than_a_driver_holds(spark):
    groups = spark.range(120_000).select(F.format_string("p%06d", "id").alias("parent"), (F.pmod(F.xxhash64("id"), F.lit(9)) + 1).alias("n"))
    got = {r["parent"]: r["split"] for r in co.grouped_split(groups).collect()}
    rows = groups.orderBy(F.xxhash64("parent", F.lit(0)), "parent").collect()
    lacking = {s: share * sum(r["n"] for r in rows) for s, share in (("train", 0.70), ("calibration", 0.15), ("test", 0.15))}
    for r in rows:
        to = max(lacking, key=lacking.get)
        lacking[to] -= r["n"]
        assert got[r["parent"]] == to
    assert len(got) == 120_000 and not co.grouped_split(groups.limit(0)).collect()
