"""Filling containers of fixed capacity with items of varying length: vector best-fit in bounded shards."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeledger.runtime import checkpoint

#: Items packed together by one task; the loss from packing apart is at most some underfull containers a shard, and
#: those are packed again over MERGED shards.
SHARD_ITEMS, MERGED, REPACK_BELOW = 4_096, 16, 0.98


@dataclass(frozen=True)
class Rules:
    """Capacities beside the tokens, relative to a container's token capacity, and how the containers are compared.

    documents: documents a container holds at most, as a share of its token capacity (at least 1).
    attention: its attention cost (sum of squared lengths) at most, as a share of the squared token capacity; an item
    above it stands alone, since only an item above the token capacity may be divided.
    At the defaults a container of 2,048 tokens holds at most 32 documents, and none beside one of more than 95 % of it.
    choice: 'norm' takes the container with the least weighted residual norm, 'dot' the one whose residuals have the
    largest weighted product with the item's needs. weights: of tokens, documents and attention cost.
    """

    documents: float = 1 / 64
    attention: float = 0.9
    choice: str = "norm"
    weights: tuple[float, float, float] = (1.0, 0.05, 0.1)


def best_fit(sizes: np.ndarray, capacity: int, rules: Rules = Rules()) -> np.ndarray:
    """The container number of each item (sizes 1 to capacity), items taken by decreasing size.

    Every constraint holds for every container: tokens, documents and attention cost. Ties go to the first container.
    """
    most = max(1, int(capacity * rules.documents))
    limit = np.array([1.0, 1.0, rules.attention])
    w = np.array(rules.weights)
    out = np.empty(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    least = float(sizes.min()) / capacity if len(sizes) else 0.0
    room = np.empty((len(sizes), 3))  # residuals as shares
    number = np.empty(len(sizes), np.int64)
    live = made = 0
    for i in order:
        share = sizes[i] / capacity
        need = np.array([share, 1.0 / most, share * share])
        left = room[:live] - need
        fits = (left >= -1e-12).all(axis=1)
        at = -1
        if fits.any():
            if rules.choice == "dot":
                score = np.where(fits, -(room[:live] * need * w).sum(axis=1), np.inf)
            else:
                score = np.where(fits, (left * left * w).sum(axis=1), np.inf)
            at = int(np.argmin(score))
        if at < 0:
            at, live = live, live + 1
            room[at], number[at] = np.maximum(limit - need, [0, 0, 0]), made
            if need[2] > limit[2]:
                room[at] = 0.0
            made += 1
        else:
            room[at] = left[at]
        out[i] = number[at]
        if room[at, 0] < least - 1e-12 or room[at, 1] < 1.0 / most - 1e-12:  # full: the last open one takes its place
            live -= 1
            room[at], number[at] = room[live], number[live]
    return out


def _packed(capacity_of: dict[str, int], rules: Rules, stage: str):
    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        kind, shard = key
        items = items.sort_values(["n_tokens", "id", "part"], ascending=[False, True, True], kind="stable")
        bins = best_fit(items["n_tokens"].to_numpy(np.int64), capacity_of[kind], rules)
        names = np.array([f"{kind}-{stage}{shard}-{b}" for b in range(bins.max() + 1 if len(bins) else 0)], object)
        return items.assign(container_id=names[bins], filled=np.bincount(bins, items["n_tokens"]).astype("int64")[bins])

    return run


def pack(items: DataFrame, key: str, size: str, capacities: dict[str, int], rules: Rules = Rules(), shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(container_kind, container_id, id, part, first_token, n_tokens): every item in a container of every kind.

    An item larger than the capacity is divided into full containers and a rest; no other item is. Full pieces fill a
    container of their own without search. The rest is dealt by hash into shards of about ``shard_items`` items, which
    are packed by best_fit; containers below REPACK_BELOW are opened again and packed over MERGED shards. No task holds
    more than a bounded number of items, and work grows in proportion to the items.

    Items of size 0 or null size need no container (container_id null, part 0). An item delivered several times counts
    once; null ids are left out; an empty table gives an empty result. Capacities must be above 0.
    """
    if any(c < 1 for c in capacities.values()):
        raise ValueError("a container needs a capacity above 0")
    schema = "container_kind string, shard int, id long, part int, first_token long, n_tokens long, container_id string, filled long"
    base = checkpoint(items.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.coalesce(F.max(size), F.lit(0)).cast("long").alias("size")))
    shards = max(1, -(-base.count() // shard_items))
    kinds = F.explode(F.create_map(*(x for k, c in sorted(capacities.items()) for x in (F.lit(k), F.lit(c))))).alias("container_kind", "cap")
    whole = base.select("id", "size", kinds)
    tail = F.when(F.col("size") > F.col("cap"), F.col("size") % F.col("cap")).otherwise(F.col("size"))
    full = (
        whole.where("size > cap").select("container_kind", "id", "cap", F.explode(F.sequence(F.lit(0), (F.floor(F.col("size") / F.col("cap")) - 1).cast("int"))).alias("part"))
        .select("container_kind", F.concat_ws("-", "container_kind", F.lit("whole"), "id", "part").alias("container_id"), "id", "part", (F.col("part") * F.col("cap")).alias("first_token"), F.col("cap").cast("long").alias("n_tokens"))
    )
    shard = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(shards)).cast("int")
    loose = whole.withColumn("n_tokens", tail).where("n_tokens > 0").select(
        "container_kind", shard.alias("shard"), "id", F.when(F.col("size") > F.col("cap"), F.floor(F.col("size") / F.col("cap"))).otherwise(0).cast("int").alias("part"),
        (F.col("size") - F.col("n_tokens")).alias("first_token"), "n_tokens",
    )
    empty = whole.where("size = 0").select("container_kind", F.lit(None).cast("string").alias("container_id"), "id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("first_token"), F.lit(0).cast("long").alias("n_tokens"))
    once = checkpoint(loose.groupBy("container_kind", "shard").applyInPandas(_packed(capacities, rules, "a"), schema))
    caps = F.create_map(*(x for k, c in sorted(capacities.items()) for x in (F.lit(k), F.lit(c))))
    under = F.col("filled") < F.element_at(caps, F.col("container_kind")) * REPACK_BELOW
    again = once.where(under).select("container_kind", F.floor(F.col("shard") / MERGED).cast("int").alias("shard"), "id", "part", "first_token", "n_tokens")
    twice = again.groupBy("container_kind", "shard").applyInPandas(_packed(capacities, rules, "b"), schema)
    columns = ["container_kind", "container_id", "id", "part", "first_token", "n_tokens"]
    return once.where(~under).select(columns).unionByName(twice.select(columns)).unionByName(full.select(columns)).unionByName(empty.select(columns))
