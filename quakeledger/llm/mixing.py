"""Mixing sources to target shares: seats by highest quotients (divisors 1, 3, 5, ...), then seeded choice of blocks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quakeledger.runtime import checkpoint, fetch_bounded, spread

BLOCK_TOKENS = 512
SHARD_TOKENS = 4_000_000
#: Shards over all sources, whose quotas pass through the driver. From 80 thousand million tokens on shards grow instead of
#: getting more: which blocks are chosen then depends on the total too, but shares, caps and repeats do not.
MOST_SHARDS = 20_000


def apportion(shares: np.ndarray, caps: np.ndarray, seats: int) -> np.ndarray:
    """Seats by the highest quotients share / (2 k + 1), no party above its cap; ties go to the first party.

    The quotient at which the seats run out is found by bisection and the last seats are given one by one, so the work
    doesn't depend on the number of seats.
    """
    shares, caps = np.asarray(shares, float), np.asarray(caps, np.int64)
    caps = np.where(shares > 0, caps, 0)
    seats = int(min(seats, caps.sum()))
    if seats <= 0:
        return np.zeros(len(shares), np.int64)

    def at(q: float) -> np.ndarray:
        return np.minimum(caps, np.floor((shares / q + 1) / 2).astype(np.int64)) if q > 0 else caps

    low, high = 0.0, shares.max() * 1.0000001  # at(low) seats everybody, at(high) at most one each
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if at(mid).sum() >= seats else (low, mid)
    won = at(high)
    if won.sum() > seats:
        won = np.zeros(len(shares), np.int64)
    while won.sum() < seats:
        quotient = np.where(won < caps, shares / (2 * won + 1), -1.0)
        won[int(np.argmax(quotient))] += 1
    return won


def reachable_seats(shares: np.ndarray, caps: np.ndarray) -> int:
    """The most seats at which every party that has blocks can still take its share (shares of the others fall away)."""
    have = (caps > 0) & (shares > 0)
    if not have.any():
        return 0
    s = shares[have] / shares[have].sum()
    return int(math.floor(min(caps[have] / s) + 1e-9))


def mix(docs: DataFrame, key: str, source: str, tokens: str, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 8, most_shards: int = MOST_SHARDS) -> tuple[DataFrame, DataFrame]:
    """(chosen, report) for targets (source, target_share, max_repeats).

    Each source's documents are laid end to end in seeded order, in shards of about SHARD_TOKENS tokens, and cut into
    blocks of ``block_tokens`` (a shard's last block may be shorter). Seats go to sources by highest quotients, none
    above its blocks times max_repeats; a source's seats that don't repeat all its blocks are apportioned in the same
    way to its shards, where the blocks of lowest seeded hash are chosen. Without ``total_tokens`` the total is the
    largest at which every source with documents reaches its share.

    chosen: source, doc_id, shard, block, first_token, n_tokens, repeats - the slice of a document in a chosen block.
    report: source, target_share, reached_share, n_tokens, max_repeats, repeats, tokens_available, for all targets.
    Documents without tokens, source or id, and of sources without a target, aren't used; a target without documents
    reports 0; documents delivered several times count once; targets named twice add up (the larger cap holds).
    """
    targets = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    wanted = sorted(fetch_bounded(targets, 100_000, "the table of targets"), key=lambda r: r["source"])
    spark = docs.sparkSession
    plan0 = spark.createDataFrame([(r["source"],) for r in wanted], "source string")
    used = docs.where((F.col(tokens) > 0) & F.col(key).isNotNull()).groupBy(F.col(key).alias("doc_id"), F.col(source).alias("source")).agg(F.max(tokens).cast("long").alias("size"))
    used = checkpoint(used.join(F.broadcast(plan0), "source"))  # plan0 is bounded above
    have = {r["source"]: r["n"] for r in used.groupBy("source").agg(F.sum("size").alias("n")).collect()}  # a row a target
    shard_tokens = max(SHARD_TOKENS, -(-sum(have.values()) // most_shards))
    shards = {s: -(-n // shard_tokens) for s, n in have.items()}
    counts = spark.createDataFrame(sorted(shards.items()), "source string, shards long")
    dealt = used.join(F.broadcast(counts), "source").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("shards")).cast("int"))
    sizes = dealt.groupBy("source", "shard").agg(F.sum("size").alias("n")).collect()  # at most MOST_SHARDS and a few
    blocks: dict[str, list[tuple[int, int]]] = {}
    for r in sorted(sizes, key=lambda r: (r["source"], r["shard"])):
        blocks.setdefault(r["source"], []).append((r["shard"], -(-r["n"] // block_tokens)))
    names = [r["source"] for r in wanted]
    share = np.array([max(0.0, r["target_share"] or 0.0) for r in wanted])
    n_blocks = np.array([sum(b for _, b in blocks.get(s, ())) for s in names], np.int64)
    caps = n_blocks * np.array([max(0, r["max_repeats"] or 0) for r in wanted], np.int64)
    seats = reachable_seats(share, caps) if total_tokens is None else -(-total_tokens // block_tokens)
    won = apportion(share, caps, seats)
    quotas = []
    for s, k in zip(names, won):
        mine = blocks.get(s, [])
        if k and mine:
            n = np.array([b for _, b in mine], np.int64)
            each, rest = divmod(int(k), int(n.sum()))
            extra = apportion(n.astype(float), n, rest)
            quotas += [(s, shard, int(b), each, int(x)) for (shard, b), x in zip(mine, extra)]
    quota = spark.createDataFrame(quotas, "source string, shard int, n_blocks long, each int, extra long")
    rank = F.row_number().over(Window.partitionBy("source", "shard").orderBy(F.xxhash64("source", "shard", "block", F.lit(seed)), "block"))
    chosen = (
        spread(quota, "source", "shard").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
        .withColumn("repeats", (F.col("each") + (rank <= F.col("extra")).cast("int")).cast("int")).where("repeats > 0").select("source", "shard", "block", "repeats")
    )
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id")
    start = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first, last = F.floor(F.col("start") / block_tokens), F.floor((F.col("start") + F.col("size") - 1) / block_tokens)
    slices = (
        dealt.withColumn("start", start).select("source", "shard", "doc_id", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
        .withColumn("first_token", F.greatest(F.lit(0).cast("long"), F.col("block") * block_tokens - F.col("start")))
        .withColumn("n_tokens", F.least("size", (F.col("block") + 1) * block_tokens - F.col("start")) - F.col("first_token"))
    )
    picked = slices.join(chosen, ["source", "shard", "block"]).select("source", "doc_id", "shard", "block", "first_token", "n_tokens", "repeats")
    given = picked.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.max("repeats").alias("repeats"))
    facts = spark.createDataFrame(
        [(r["source"], float(t), int(r["max_repeats"] or 0), int(have.get(r["source"], 0))) for r, t in zip(wanted, share)],
        "source string, target_share double, max_repeats int, tokens_available long",
    )
    report = facts.join(given, "source", "left").select(
        "source", "target_share", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "max_repeats", F.coalesce("repeats", F.lit(0)).alias("repeats"), "tokens_available"
    )
    report = report.withColumn("reached_share", F.round(F.try_divide(F.col("n_tokens"), F.sum("n_tokens").over(Window.partitionBy(F.lit(0)))), 6))  # a row a target
    return picked, report
