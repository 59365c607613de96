"""Train, validation and test splits that keep related records together.

Relation is carried by connected components, found by hooking every name to its least neighbour and jumping pointers
until all point to roots, over contracted edges. Components live in a persisted table: an update links new names to the
stored components, keeps their split, fills the splits' deficits with new ones and quarantines merges of components
that stand in different splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quakeledger.runtime import checkpoint

TARGETS = (("train", 0.70), ("validation", 0.15), ("test", 0.15))
QUARANTINE = "quarantine"
#: Groups assigned one by one on the driver: those of at least 1/LARGE_SHARE of all records, so at most LARGE_SHARE groups.
#: With it goes who is placed one by one; the totals meet the targets either way.
LARGE_SHARE = 1_000
#: Buckets of the line along which the other groups are laid; a bucket is ordered by one task.
BUCKETS = 1_024
#: Edges that one task may merge at the end (some tens of bytes each).
RESIDUE = 200_000
#: After so many versions the component table is written whole again.
WHOLE_EVERY = 16


def _jumped(parents: DataFrame) -> DataFrame:
    """Parents (v, p) shortened until each p is a root: p of p, again and again; two jumps between checkpoints."""
    while True:
        of = parents.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        once = parents.join(of, "p", "left").select("v", F.coalesce("pp", "p").alias("p"))
        nxt = checkpoint(once.join(of, "p", "left").select("v", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")))
        parents = nxt.select("v", "p")
        if nxt.where("moved").limit(1).count() == 0:
            return parents


def _merged_here(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(v, p) of all names on the edges (a, b) of one task, p the least name of v's component: hooks and jumps on arrays."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    edges = pd.concat(held)
    names, at = np.unique(edges[["a", "b"]].to_numpy(object).astype(str).ravel(), return_inverse=True)
    a, b = at.reshape(-1, 2).T
    root = np.arange(len(names))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)  # a root hooks to the least root it meets
        while (root[root] != root).any():
            root = root[root]
    yield pd.DataFrame({"v": names.astype(object), "p": names[root].astype(object)})


def connected_components(edges: DataFrame, residue: int = RESIDUE) -> DataFrame:
    """(name, root) for every name on an edge (a, b); root is the least name, in code point order, of its component.

    Each round hooks every name to the least of its neighbours and itself (a pre-aggregated minimum, so that a name
    with a third of all edges is no burden), jumps pointers to roots and contracts the edges: at least half of the names
    leave in a round, whatever the graph's shape. All steps are joins and aggregations cut by checkpoints; nothing but
    numbers of edges is asked by the driver. Once at most ``residue`` edges are left, one task hooks and jumps to the end
    by itself, with the same result. Null ends are no edges; an edge from a name to itself makes it a component.
    """
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    live = checkpoint(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    names = live.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    live = live.where("a <> b")
    steps = []
    while (n := live.count()) > residue:
        both = live.select(F.explode(F.array(F.struct(F.col("b").alias("v"), F.col("a").alias("p")), F.struct(F.col("a").alias("v"), F.col("b").alias("p")))).alias("e")).select("e.*")
        least = both.groupBy("v").agg(F.min("p").alias("p")).where("p < v")
        roots = _jumped(checkpoint(least))
        steps.append(roots)
        a, b = roots.select(F.col("v").alias("a"), F.col("p").alias("pa")), roots.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = live.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y"))
        live = checkpoint(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if n:
        steps.append(checkpoint(live.repartition(1).mapInPandas(_merged_here, "v string, p string").where("p < v")))
    labels = names.select("name", F.col("name").alias("root"))
    for roots in steps:
        labels = labels.join(roots.select(F.col("v").alias("root"), "p"), "root", "left").select("name", F.coalesce("p", "root").alias("root"))
    return labels


def fill_deficits(groups: DataFrame, held: dict[str, int], targets=TARGETS, seed: int = 20) -> DataFrame:
    """groups (group_id, n) with a split that brings the totals near their targets.

    ``held`` has the records each split holds already. Groups of at least 1/LARGE_SHARE of all records (at most
    LARGE_SHARE of them) go largest first to the split with the largest deficit. The others are laid in seeded order
    along the line of all their records; the remaining deficits, in proportion, are intervals of that line and a group
    goes where its start lies. Positions are prefix sums in BUCKETS buckets, so no task sees more than its bucket.
    """
    names = [s for s, _ in targets]
    sizes = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    total = sizes + sum(held.get(s, 0) for s in names)
    floor = max(2, -(-sizes // LARGE_SHARE))
    large = groups.where(F.col("n") >= floor).orderBy(F.desc("n"), "group_id").collect()
    lacking = {s: share * total - held.get(s, 0) for s, share in targets}
    placed = []
    for g in large:
        to = max(names, key=lambda s: lacking[s])
        lacking[to] -= g["n"]
        placed.append((g["group_id"], g["n"], to))
    spark = groups.sparkSession
    schema = "group_id string, n long, split string"
    out = spark.createDataFrame(placed, schema)
    room = {s: max(0.0, lacking[s]) for s in names}
    whole = sum(room.values()) or 1.0
    if sum(room.values()) == 0:
        room = dict(targets)
        whole = sum(room.values())
    small = groups.where(F.col("n") < floor).select("group_id", F.col("n").cast("long").alias("n"))
    order = F.xxhash64("group_id", F.lit(seed))
    small = checkpoint(small.withColumn("at", order).withColumn("bucket", F.pmod(F.shiftright("at", 20), F.lit(BUCKETS)).cast("int")))
    sums = {r["bucket"]: r["n"] for r in small.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # at most BUCKETS rows
    starts, run = [], 0
    for k in range(BUCKETS):
        starts.append(run)
        run += sums.get(k, 0)
    within = F.sum("n").over(Window.partitionBy("bucket").orderBy("at", "group_id").rowsBetween(Window.unboundedPreceding, -1))
    position = (F.get(F.array(*(F.lit(float(s)) for s in starts)), F.col("bucket")) + F.coalesce(within, F.lit(0)) + F.col("n") / 2) / F.lit(float(run or 1))
    split, upto = F.lit(names[-1]), 1.0
    for s in reversed(names[:-1]):
        upto = sum(room[x] for x in names[: names.index(s) + 1]) / whole
        split = F.when(F.col("position") < upto, F.lit(s)).otherwise(split)
    return out.unionByName(small.withColumn("position", position).select("group_id", "n", split.alias("split")))


class ComponentTable:
    """Components and their splits, kept as Parquet under a folder; each update adds a version with what it changes.

    A version holds the members and groups that are new or differ from before; a row stands until a later version has
    one of its name, and a group that has become part of another is marked gone. Every WHOLE_EVERY-th version, and the
    first, holds all. Opening a folder takes up its latest complete version: one whose marker, written after its members
    and groups, is there. What an update that broke off has left is passed over, and no version is written over. One
    writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.version = max(self._versions("complete"), default=0)

    def _fs(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _versions(self, what: str) -> list[int]:
        """The numbers of the versions under a subfolder."""
        fs, path = self._fs(f"{self.folder}/{what}")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return [int(x[1:]) for x in names if x[:1] == "v" and x[1:].isdigit()]

    def _mark(self, what: str, version: int) -> None:
        fs, path = self._fs(self._path(what, version))
        if not fs.createNewFile(path):
            raise FileExistsError(f"version {version} of {self.folder} is there already")

    def _commit(self, version: int) -> None:
        self._mark("complete", version)
        self.version = version

    def _path(self, what: str, version: int | None = None) -> str:
        return f"{self.folder}/{what}/v{self.version if version is None else version}"

    def _current(self, what: str, key: str, schema: str) -> DataFrame:
        """The rows that stand: of each name the one of its latest version."""
        whole = max((v for v in self._versions("whole") if v <= self.version), default=1)
        complete = sorted(v for v in self._versions("complete") if whole <= v <= self.version)
        if not complete:
            return self.spark.createDataFrame([], f"{schema}, __v int")
        parts = [self.spark.read.schema(schema).parquet(self._path(what, v)).withColumn("__v", F.lit(v)) for v in complete]
        if len(parts) == 1:
            return parts[0]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        rest = [c for c in parts[0].columns if c not in (key, "__v")]
        return rows.groupBy(key).agg(F.max(F.struct("__v", *rest)).alias("r")).select(key, "r.*")

    def members(self) -> DataFrame:
        """name, group_id, listed (whether the name is a record, not only named by one)."""
        return self._current("members", "name", "name string, group_id string, listed boolean").drop("__v")

    def groups(self) -> DataFrame:
        """group_id, n (records), split, status (new, kept, grown, merged, conflict): what the latest update did to it."""
        rows = self._current("groups", "group_id", "group_id string, n long, split string, status string").where("status <> 'gone'")
        untouched = (F.col("__v") < self.version) & (F.col("status") != "conflict")
        return rows.select("group_id", "n", "split", F.when(untouched, "kept").otherwise(F.col("status")).alias("status"))

    def update(self, records: DataFrame, edges: DataFrame, targets=TARGETS) -> None:
        """Take in records (name) and edges (a, b); see the module's words for what becomes of their splits.

        Only names on new edges and groups they touch take part in the search; a name's group is its least name, and
        can change when a lesser name joins. A merge of groups of one split keeps it; one of different splits goes to
        quarantine as a whole, and stays there. Null names are left out.
        """
        nxt = max(self.version, *(max(self._versions(what), default=0) for what in ("members", "groups", "complete", "whole"))) + 1
        whole = self.version == 0 or nxt % WHOLE_EVERY == 0
        old = self.members()
        stored = old.select("name", "group_id")
        records = records.select("name").where(F.col("name").isNotNull()).distinct()
        to = lambda side: stored.select(F.col("name").alias(side), F.col("group_id").alias(f"g{side}"))
        # A stored name stands for its group, so the search runs over groups and new names.
        linked = edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("ga", "a").alias("a"), F.coalesce("gb", "b").alias("b"))
        alone = records.join(stored, "name", "left").select(F.coalesce("group_id", "name").alias("a"), F.coalesce("group_id", "name").alias("b"))
        found = checkpoint(connected_components(linked.unionByName(alone)))
        moved = found.select(F.col("name").alias("group_id"), "root")
        kept = old.join(moved, "group_id", "left").select("name", F.coalesce("root", "group_id").alias("group_id"), "listed", F.col("group_id").alias("was_in"))
        fresh = found.join(stored.select("name"), "name", "left_anti").join(stored.select(F.col("group_id").alias("name")).distinct(), "name", "left_anti")
        fresh = fresh.select("name", F.col("root").alias("group_id"), F.lit(False).alias("listed"), F.lit(None).cast("string").alias("was_in"))
        now = F.col("listed") | F.coalesce("now", F.lit(False))
        after = kept.unionByName(fresh).join(records.withColumn("now", F.lit(True)), "name", "left")
        changed = F.col("was_in").isNull() | (F.col("was_in") != F.col("group_id")) | (now != F.col("listed"))
        delta = (after if whole else after.where(changed)).select("name", "group_id", now.alias("listed"), (F.col("was_in").isNotNull() & F.col("listed")).alias("before"), "was_in")
        delta = checkpoint(delta)
        delta.select("name", "group_id", "listed").write.mode("errorifexists").parquet(self._path("members", nxt))
        # Groups: what was, moved to its root, and the records that have come in or been listed.
        groups = self.groups().join(moved, "group_id", "left").withColumn("to", F.coalesce("root", "group_id"))
        gain = delta.groupBy(F.col("group_id").alias("to")).agg(F.sum((F.col("listed") & ~F.col("before")).cast("long")).alias("gain"))
        before = groups.groupBy("to").agg(F.min("split").alias("low"), F.max("split").alias("high"), F.count("*").alias("parts"), F.sum("n").alias("was"), F.max("status").alias("last"), F.max(F.col("group_id") != F.col("to")).alias("renamed"))
        state = checkpoint(before.join(gain, "to", "full").withColumn("n", F.coalesce("was", F.lit(0)) + F.coalesce("gain", F.lit(0))))
        conflict = (F.col("low") != F.col("high")) | (F.col("low") == QUARANTINE)
        touched = F.coalesce(F.col("gain") > 0, F.lit(False)) | (F.col("parts") > 1) | F.col("renamed")
        status = F.when(conflict & (touched | (F.col("last") == "conflict")), "conflict").when(F.col("parts") > 1, "merged").when(F.col("n") > F.col("was"), "grown").otherwise("kept")
        settled = state.where(F.col("low").isNotNull()).select(F.col("to").alias("group_id"), "n", F.when(conflict, F.lit(QUARANTINE)).otherwise(F.col("low")).alias("split"), status.alias("status"), touched.alias("touched"))
        held = {r["split"]: r["n"] for r in settled.groupBy("split").agg(F.sum("n").alias("n")).collect()}  # one row a split
        new = fill_deficits(state.where(F.col("low").isNull()).select(F.col("to").alias("group_id"), "n"), held, targets)
        gone = groups.where(F.col("group_id") != F.col("to")).join(state.select(F.col("to").alias("group_id")), "group_id", "left_anti")
        gone = gone.select("group_id", F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("split"), F.lit("gone").alias("status"))
        out = (settled if whole else settled.where("touched")).drop("touched").unionByName(new.withColumn("status", F.lit("new")))
        (out if whole else out.unionByName(gone)).write.mode("errorifexists").parquet(self._path("groups", nxt))
        if whole:
            self._mark("whole", nxt)
        self._commit(nxt)
