import random

from pyspark.sql import functions as F

from quakeledger.llm.survivor import FieldPolicy, compared_uid, field_survivors, record_survivors

SCHEMA = "uid string, id long, at long, m double, kind string, trust int, magnitude_best string"


def rows(seed, n=600):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    out = [(pick(None, *"abcdefgh"), rng.randrange(200), pick(None, *range(20)), pick(None, 1.0, 2.0, 99.0), pick(None, "", "ml"), pick(1, 2, 3), "clash") for _ in range(n)]
    return out + out[:40]


def test_field_survivors_equal_the_policy(spark):
    data = rows(1)
    df = spark.createDataFrame(data, SCHEMA)
    typed = (F.coalesce("kind", F.lit("")) != "").cast("int")
    got = {r["uid"]: r["best"] for r in field_survivors(df, "uid", "id", "at", (FieldPolicy("best", F.col("m") < 50, (typed, -F.col("trust")), ("m",)),)).collect()}
    groups = {}
    for u, i, at, m, kind, trust, _ in data:
        if u is not None:
            groups.setdefault(u, []).append((m is not None and m < 50, bool(kind), -trust, -1 if at is None else at, i, m))
    want = {u: max(g) for u, g in groups.items() if len({x[4] for x in g}) > 1}
    assert set(got) == set(want)
    for u, w in want.items():
        assert (got[u]["record_id"], got[u]["m"]) == (w[4], w[5]) if w[0] else got[u] is None


def test_record_survivors_fill_from_later_layers(spark):
    data = [("a", 1, 9, 5.0, None, 1, ""), ("a", 2, 5, None, "ml", 2, ""), ("a", 3, 1, None, "mb", 3, ""), ("b", 4, 1, None, None, 1, ""), ("b", 5, 1, None, None, 1, ""), ("c", 6, 1, 1.0, "x", 1, "")]
    got = {r["uid"]: r for r in record_survivors(spark.createDataFrame(data, SCHEMA), "uid", "id", "at", -F.col("trust"), ("m", "kind")).collect()}
    assert set(got) == {"a", "b"}  # c has one record only
    assert got["a"]["base_from"] == 1 and got["a"]["m"] == 5.0 and got["a"]["kind"] == "ml" and got["a"]["kind_from"] == 2 and got["a"]["kind_layer"] == 2
    assert got["b"]["base_from"] == 5 and got["b"]["m"] is None and got["b"]["m_layer"] is None


def test_a_hot_group_is_reduced_before_it_is_gathered(spark):
    df = spark.range(50_000).select(F.lit("hot").alias("uid"), "id", (F.col("id") % 1000).alias("at"), F.lit(1.0).alias("m"), F.lit("ml").alias("kind"), (F.col("id") % 3).cast("int").alias("trust"))
    got = field_survivors(df, "uid", "id", "at", (FieldPolicy("best", F.col("m") < 50, (-F.col("trust"),)),)).first()
    assert got["n_cells"] == 3 and got["best"]["record_id"] == max(i for i in range(50_000) if i % 3 == 0 and i % 1000 == 999)


def test_empty_and_uids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert field_survivors(empty, "uid", "id", "at", (FieldPolicy("best", F.lit(True), ()),)).count() == 0
    assert record_survivors(empty, "uid", "id", "at", F.col("trust"), ("m",)).count() == 0
    got = spark.createDataFrame([(" Ab-1 ",), ("000",), ("none",), (None,)], "x string").select(compared_uid("x").alias("y")).collect()
    assert [r["y"] for r in got] == ["ab1", None, None, None]
