import random
import string

import pytest

from quakeledger.llm import splits
from quakeledger.llm.q_splits import compared_name
from quakeledger.llm.splits import QUARANTINE, ComponentTable, connected_components, fill_deficits
from pyspark.sql import functions as F


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), set()).add(x)
    return {x: min(g) for g in groups.values() for x in g}


@pytest.mark.parametrize("residue", [0, 300, 10_000])
def test_components_of_chains_stars_and_noise(spark, residue):
    rng = random.Random(1)
    chain = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(300)]
    star = [("hub", f"s{i}") for i in range(200)]
    noise = [tuple("n" + "".join(rng.choice(string.ascii_lowercase) for _ in range(2)) for _ in range(2)) for _ in range(150)]
    edges = chain + star + star + noise + [("self", "self"), (None, "x"), ("y", None)]
    rng.shuffle(edges)
    got = {r["name"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a string, b string"), residue).collect()}
    assert got == brute(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_shares_and_whole_groups(spark):
    rng = random.Random(2)
    groups = [(f"g{i}", rng.choice([1, 1, 1, 2, 3, 8])) for i in range(3000)] + [("big", 4000)]
    got = fill_deficits(spark.createDataFrame(groups, "group_id string, n long"), {}).collect()
    assert len(got) == len(groups) == len({r["group_id"] for r in got})
    total = sum(n for _, n in groups)
    for split, share in (("train", 0.7), ("validation", 0.15), ("test", 0.15)):
        assert abs(sum(r["n"] for r in got if r["split"] == split) / total - share) < 0.01


def test_updates_keep_grow_merge_and_quarantine(spark, tmp_path):
    names = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    links = lambda xs: spark.createDataFrame(xs, "a string, b string")
    store = ComponentTable(spark, str(tmp_path / "store"))
    first = [f"d{i:03d}" for i in range(200)] + [None]
    store.update(names(first), links([(f"d{i:03d}", f"p{i // 2:03d}") for i in range(200)]))
    before = {r["group_id"]: r for r in store.groups().collect()}
    split = lambda g: before[g]["split"]
    groups = sorted(before)
    a, b = next((x, y) for x in groups for y in groups if x < y and split(x) != split(y))
    c, d = next((x, y) for x in groups for y in groups if x < y and split(x) == split(y) and not {x, y} & {a, b})
    store.update(names(["new1", "new2", "lone"]), links([("new1", a), ("new1", b), ("new2", c), ("new2", d)]))
    after = {r["group_id"]: r for r in store.groups().collect()}
    assert after[a]["split"] == QUARANTINE and after[a]["status"] == "conflict" and b not in after
    assert after[c]["split"] == split(c) and after[c]["status"] == "merged" and after["lone"]["status"] == "new"
    assert all(after[g]["split"] == split(g) and after[g]["status"] == "kept" for g in groups if g not in (a, b, c, d))
    members = {r["name"]: r["group_id"] for r in store.members().where("listed").collect()}
    assert members["new1"] == a and members["new2"] == c and len(members) == 203
    store.update(names([]), links([]))
    assert {r["group_id"]: r["split"] for r in store.groups().collect()} == {g: r["split"] for g, r in after.items()}


def test_an_opened_folder_goes_on_from_its_latest_complete_version(spark, tmp_path):
    names = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    links = lambda xs: spark.createDataFrame(xs, "a string, b string")
    folder = str(tmp_path / "store")
    first = ComponentTable(spark, folder)
    first.update(names([f"d{i:03d}" for i in range(100)]), links([]))
    before = {r["group_id"]: r["split"] for r in first.groups().collect()}
    again = ComponentTable(spark, folder)
    assert again.version == 1 and {r["group_id"]: r["split"] for r in again.groups().collect()} == before
    a, b = next((x, y) for x in sorted(before) for y in sorted(before) if x < y and before[x] != before[y])
    again.members().write.parquet(f"{folder}/members/v2")  # an update broke off here
    again.update(names(["new"]), links([("new", a), ("new", b)]))
    after = {r["group_id"]: r for r in ComponentTable(spark, folder).groups().collect()}
    assert again.version == 3 and after[a]["split"] == QUARANTINE and after[a]["status"] == "conflict"
    assert all(after[g]["split"] == before[g] for g in before if g not in (a, b))
    assert {r["group_id"]: r["split"] for r in first.groups().collect()} == before


def test_an_update_writes_only_what_it_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(splits, "WHOLE_EVERY", 4)
    names = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    links = lambda xs: spark.createDataFrame(xs, "a string, b string")
    folder = str(tmp_path / "store")
    store = ComponentTable(spark, folder)
    store.update(names([f"d{i:03d}" for i in range(100)]), links([]))
    store.update(names(["a000", "x"]), links([("a000", "d050"), ("d051", "d052")]))
    written = {r["name"] for r in spark.read.parquet(f"{folder}/members/v2").collect()}
    assert written == {"a000", "x", "d050", "d052"}
    groups = {r["group_id"]: r["status"] for r in spark.read.parquet(f"{folder}/groups/v2").collect()}
    assert groups == {"a000": "grown", "d050": "gone", "x": "new", "d051": groups["d051"], "d052": "gone"} and groups["d051"] in ("merged", "conflict")
    rows = [f"n{k:02d}" for k in range(3)]
    for k in range(3):  # past the version that is written whole again
        store.update(names([rows[k]]), links([(rows[k], rows[k - 1])] if k else []))
    again = ComponentTable(spark, folder)
    members = {r["name"]: r["group_id"] for r in again.members().collect()}
    assert len(members) == 105 and all(members[n] == "n00" for n in rows) and members["d050"] == "a000"
    got = {r["group_id"]: r for r in again.groups().collect()}
    assert got["n00"]["n"] == 3 and got["n00"]["status"] == "grown" and got["d003"]["status"] == "kept" and sum(r["n"] for r in got.values()) == 105


def test_compared_name(spark):
    got = spark.createDataFrame([("  Real--A b\t",), ("__",), (None,)], "x string").select(compared_name(F.col("x")).alias("y")).collect()
    assert [r["y"] for r in got] == ["real_a_b", None, None]
