"""Matching records of two tables without a common key.

A graph joins records with the tokens of their attributes. It is walked at random, skip-gram vectors of its records are
trained on the walks with negative sampling, and records of the two sides meet where they share a bucket in one of
several tables of random hyperplanes. An exact check of the attributes reranks what has met, and the cosines of the
vectors are calibrated to confidences.

The graph is walked and trained in parts, runs of consecutive days with about PART_RECORDS records each, whatever the
size of the tables: a day is one of a token's ingredients, the parts hold many of them, and the number of hyperplanes
goes with a part's records. So buckets are as narrow, and recall is the same, in small tables and in large ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quakeledger.runtime import checkpoint

DIMENSIONS = 32
#: Random walks from each record, and steps from record to token to record in each.
WALKS, HOPS = 16, 2
#: Rounds of training over all walks, learning rate, negatives of a round, visits of a token in a round, steepness of the log odds.
ROUNDS, RATE, NEGATIVES, VISITS, STEEP = 6, 3.0, 32, 4, 3.0
#: Tables of hyperplanes, and records that a bucket gets on average.
TABLES, PER_BUCKET = 32, 16
#: Records of a part, on average; parts of more (crowded days) are divided by the clock and then dealt into blocks.
PART_RECORDS = 6_000
DAY = 86_400
_SPLIT = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A hash of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((salt * _SPLIT) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def combined(*columns: np.ndarray) -> np.ndarray:
    """One hash for rows of whole numbers."""
    out = np.zeros(len(columns[0]), np.uint64)
    for i, c in enumerate(columns):
        out = mixed(out ^ mixed(np.asarray(c).astype(np.int64).view(np.uint64), i + 1), 40 + i)
    return out


def uniform(x: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on x and salt alone, so that a task done again gives the same."""
    return (mixed(x, salt) >> np.uint64(11)).astype(np.float64) / 2.0**53


def sign_vectors(x: np.ndarray) -> np.ndarray:
    """A random vector of length 1 for each number: its signs are the bits of a hash."""
    bits = np.unpackbits(np.ascontiguousarray(mixed(x, 1)[..., None]).view(np.uint8), axis=-1)
    return (bits[..., :DIMENSIONS].astype(np.float32) * 2 - 1) / np.float32(DIMENSIONS**0.5)


def walk_contexts(rec: np.ndarray, tok: np.ndarray, n_rec: int, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(records, contexts): the records with tokens, and for each the tokens that its WALKS walks of HOPS hops visit.

    The graph has edges (rec, tok), which ascend by record. A record steps to one of its tokens, in proportion to one over
    the token's records; a token steps to any of its records. Tokens of one record lead nowhere and must be left out
    beforehand.
    """
    n_tok = int(tok.max()) + 1 if len(tok) else 0
    by_tok = np.argsort(tok, kind="stable")
    count = np.bincount(tok, minlength=n_tok)
    start = np.concatenate([[0], np.cumsum(count)])
    cum = np.cumsum(1.0 / count[tok])
    first = np.searchsorted(rec, np.arange(n_rec + 1))
    base = np.concatenate([[0.0], cum])[first]
    records = np.nonzero(np.diff(first))[0]
    walkers = np.repeat(records, WALKS)
    salt = mixed(seeds[walkers].view(np.uint64) ^ mixed(np.tile(np.arange(WALKS, dtype=np.uint64), len(records)), 5), 6)
    at, seen = walkers, []
    for hop in range(HOPS):
        edge = np.searchsorted(cum, base[at] + uniform(salt, 10 + hop) * (base[at + 1] - base[at]), side="right")
        t = tok[np.clip(edge, first[at], first[at + 1] - 1)]
        seen.append(t.reshape(len(records), WALKS))
        at = rec[by_tok[start[t] + (uniform(salt, 20 + hop) * count[t]).astype(np.int64)]]
    return records, np.concatenate(seen, axis=1) if len(records) else np.zeros((0, WALKS * HOPS), np.int64)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in slabs so small that the linear algebra library stays on the task's own core."""
    rows = max(1, 200_000 // max(1, b.size))
    out = np.empty((len(a), b.shape[1]), np.float32)
    whole = len(a) - len(a) % rows
    np.matmul(a[:whole].reshape(-1, rows, a.shape[1]), b, out=out[:whole].reshape(-1, rows, b.shape[1]))
    out[whole:] = a[whole:] @ b
    return out


def _toward(own: np.ndarray, other: np.ndarray, seen: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """The gradient of the log odds of each row's seen rows of ``other`` against the rows of noise."""
    near = np.take(other, seen, axis=0)
    pull = 1 / (1 + np.exp(STEEP * np.matmul(near, own[:, :, None])[:, :, 0]))
    push = 1 / (1 + np.exp(-STEEP * _product(own, np.ascontiguousarray(noise.T))))
    return np.matmul(pull[:, None, :], near)[:, 0] / np.float32(seen.shape[1]) - _product(push, noise) / np.float32(len(noise))


def skip_gram(contexts: np.ndarray, tokens: np.ndarray, seeds: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Vectors of length 1 for records from the contexts (n, visits) of their walks, trained with negative sampling.

    tokens and seeds name the contexts and the records. Both start at random vectors, the records' much shorter. In each
    round a record moves along the gradient of the log odds of its visited contexts against NEGATIVES tokens drawn by
    their visits to the power of 3/4; a context along that of VISITS of its visits, drawn anew, against as many
    records. The result depends on names alone, so that a task done again gives the same. rounds=0 leaves the start.
    """
    n, n_tok = len(contexts), len(tokens)
    u, v = sign_vectors(tokens), sign_vectors(mixed(seeds.view(np.uint64), 2)) * np.float32(0.05)
    if not n:
        return v
    flat = contexts.ravel()
    order = np.argsort(flat, kind="stable") // contexts.shape[1]
    count = np.bincount(flat, minlength=n_tok)
    start = np.concatenate([[0], np.cumsum(count)[:-1]])
    visited = (count > 0)[:, None]
    weight = np.cumsum(count**0.75)
    name = mixed(seeds[:1].view(np.uint64), 4) ^ np.arange(NEGATIVES, dtype=np.uint64)
    ticket = mixed(tokens[:, None], 5) ^ np.arange(VISITS, dtype=np.uint64)
    for k in range(rounds):
        drawn = np.minimum(np.searchsorted(weight, uniform(name, 30 + k) * weight[-1], side="right"), n_tok - 1)
        visits = order[np.minimum(start[:, None] + (uniform(ticket, 50 + k) * count[:, None]).astype(np.int64), len(order) - 1)]
        others = (uniform(name, 70 + k) * n).astype(np.int64)
        dv, du = _toward(v, u, contexts, u[drawn]), _toward(u, v, visits, v[others])
        v, u = v + np.float32(RATE) * dv, u + np.float32(RATE) * du * visited
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), np.float32(1e-9))


def bucket_keys(v: np.ndarray, seed: int = 3) -> np.ndarray:
    """(n, TABLES) bucket numbers: the signs of as many random projections as leave PER_BUCKET records in a bucket."""
    bits = int(np.clip(np.round(np.log2(max(1, len(v)) / PER_BUCKET)), 1, 24))
    planes = np.random.default_rng(seed).standard_normal((DIMENSIONS, TABLES * bits)).astype(np.float32)
    return ((_product(v, planes) > 0).reshape(len(v), TABLES, bits) * (1 << np.arange(bits))).sum(2)


#: Pairs of a table of buckets that are looked at together.
SLICE = 2_000_000


def _met(one: np.ndarray, two: np.ndarray, key: np.ndarray, at: np.ndarray, reach: float, possible: Callable) -> Iterator[np.ndarray]:
    """Pairs of rows (one, two) with equal keys that are possible, as one * len(at) + two, in slices of bounded size."""
    two = two[np.argsort(key[two], kind="stable")]
    sorted_keys = key[two]
    low, high = np.searchsorted(sorted_keys, key[one], "left"), np.searchsorted(sorted_keys, key[one], "right")
    size = high - low
    cuts = np.unique(np.concatenate([np.searchsorted(np.cumsum(size), np.arange(0, size.sum() + 1, SLICE)), [len(one)]]))
    for a, z in zip(np.concatenate([[0], cuts]), cuts):
        k = size[a:z]
        if not k.sum():
            continue
        i = np.repeat(one[a:z], k)
        j = two[np.repeat(low[a:z], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
        ok = np.nonzero(np.abs(at[j] - at[i]) <= reach)[0]
        i, j = i[ok], j[ok]
        ok = possible(at[i], at[j])
        yield i[ok] * len(at) + j[ok]


def part_vectors(b: pd.DataFrame, tokens: Callable, rounds: int = ROUNDS) -> np.ndarray:
    """The records' vectors of one part (0 for a record that shares no token with the other side).

    tokens(b) gives (row, token) of the graph's edges. A token that only one side has can join nothing and is left out.
    """
    n, side = len(b), b["side"].to_numpy()
    rec, name = tokens(b)
    names, tok = np.unique(name, return_inverse=True)
    linked = (np.bincount(tok, side[rec] == 1, minlength=len(names)) > 0) & (np.bincount(tok, side[rec] == 2, minlength=len(names)) > 0)
    keep = linked[tok]
    edge = np.unique(rec[keep] * max(1, len(names)) + tok[keep])
    rec, tok = edge // max(1, len(names)), edge % max(1, len(names))
    used, tok = np.unique(tok, return_inverse=True)
    seeds = combined(b["id"].to_numpy(), side)
    walkers, contexts = walk_contexts(rec, tok, n, seeds)
    v = np.zeros((n, DIMENSIONS), np.float32)
    v[walkers] = skip_gram(contexts, names[used], seeds[walkers], rounds)
    return v


def part_pairs(b: pd.DataFrame, tokens: Callable, reach: float, possible: Callable, rerank: Callable, rounds: int = ROUNDS) -> pd.DataFrame:
    """(id1, id2, cosine, ...) of one part: pairs of sides 1 and 2 that meet in a bucket and pass ``rerank``.

    reach is the most that ``at`` may differ, possible(at, at) a cheap necessary condition beside it; rerank(one, two) takes the attributes of both and gives, for the
    pairs it keeps, their rows and further columns. met is the number of possible pairs that met.
    """
    v = part_vectors(b, tokens, rounds)
    keys, at, side = bucket_keys(v), b["at"].to_numpy(), b["side"].to_numpy()
    live = (v != 0).any(1)
    one, two = np.nonzero(live & (side == 1))[0], np.nonzero(live & (side == 2))[0]
    out = [np.zeros(0, int)]
    for table in range(TABLES):
        out.extend(_met(one, two, keys[:, table], at, reach, possible))
    i, j = np.divmod(np.unique(np.concatenate(out)), max(1, len(b)))
    kept, columns = rerank(b.iloc[i].reset_index(drop=True), b.iloc[j].reset_index(drop=True))
    i, j, ids = i[kept], j[kept], b["id"].to_numpy()
    return pd.DataFrame({"id1": ids[i], "id2": ids[j], "cosine": (v[i] * v[j]).sum(1).astype(float), **columns})


def dealt_into_parts(records: DataFrame, reach: float, period: int, width: int, phase_reach: float, part_records: int = PART_RECORDS) -> DataFrame:
    """records (side, id, at, ...) with ``part``: two records that can match stand in one part together.

    Side 1 stands in the part of its day; side 2 also in the parts that lie within ``reach`` seconds. A day of more than
    ``part_records`` records is a part of its own and is divided by the clock's place in a ``period``, in pieces of
    ``width`` seconds whose neighbours within phase_reach side 2 joins as well; what is still larger is dealt into blocks,
    each piece of side 1 meeting each of side 2, so nothing is capped. The table of days has a row a day at most, which
    the calendar bounds; it is joined by broadcast only while it is small.
    """
    day = F.floor(F.col("at") / DAY).alias("day")
    days = records.groupBy(day).agg(F.count("*").alias("n"))
    crowded = F.col("n") > part_records
    along = Window.orderBy("day")  # over pre-aggregated days
    before = F.sum(F.when(crowded, 0).otherwise(F.col("n"))).over(along.rowsBetween(Window.unboundedPreceding, -1))
    days = days.withColumn("part", F.when(crowded, -2 - F.abs(F.col("day")) * 2 - (F.col("day") < 0).cast("long")).otherwise(F.floor(F.coalesce(before, F.lit(0)) / part_records)))
    beside = lambda f, step: F.when(f("day").over(along) == F.col("day") + step, f("part").over(along))
    days = checkpoint(days.select("day", "part", beside(F.lag, -1).alias("left"), beside(F.lead, 1).alias("right")))
    got = records.withColumn("day", F.floor(F.col("at") / DAY)).join(days, "day")
    two, inside = F.col("side") == 2, F.col("at") - F.col("day") * DAY
    homes = F.array("part", F.when(two & (inside < reach), F.col("left")), F.when(two & (inside >= DAY - reach), F.col("right")))
    got = got.withColumn("part", F.explode(F.array_distinct(F.array_compact(homes)))).drop("day", "left", "right")
    if days.where("part < 0").limit(1).count() == 0:
        return got
    k = lambda s: F.floor(F.pmod(F.col("at") + s, F.lit(float(period))) / width).cast("int")
    pieces = F.when(F.col("part") >= 0, F.array(F.lit(-1))).when(two, F.array_distinct(F.array(k(0.0), k(-phase_reach), k(phase_reach)))).otherwise(F.array(k(0.0)))
    cut = got.withColumn("piece", F.explode(pieces))
    half = part_records // 2
    many = lambda s: F.ceil(F.greatest(F.count_if(F.col("side") == s), F.lit(1)) / half).cast("int")
    still = cut.where("part < 0").groupBy("part", "piece").agg(many(1).alias("p1"), many(2).alias("p2"), F.count("*").alias("n")).where(F.col("n") > part_records)
    dealt = cut.join(still.drop("n"), ["part", "piece"], "left").withColumn("p1", F.coalesce("p1", F.lit(1))).withColumn("p2", F.coalesce("p2", F.lit(1)))
    own = F.pmod(F.xxhash64("id", F.lit(4)), F.when(two, F.col("p2")).otherwise(F.col("p1")))
    others = F.sequence(F.lit(0), F.when(two, F.col("p1")).otherwise(F.col("p2")) - 1)
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(others))
    first, second = F.when(two, F.col("other")).otherwise(F.col("own")), F.when(two, F.col("own")).otherwise(F.col("other"))
    part = F.when(F.col("part") >= 0, F.col("part")).otherwise(F.xxhash64("part", "piece", first, second))
    return dealt.withColumn("part", part).drop("piece", "p1", "p2", "own", "other")


def matched_pairs(parts: DataFrame, tokens: Callable, reach: float, possible: Callable, rerank: Callable, columns: str, rounds: int = ROUNDS) -> DataFrame:
    """(id1, id2, cosine, ``columns``) of the pairs of each part (see part_pairs). A pair of two parts comes out of each.

    Parts are dealt to tasks by one shuffle and sorted, so that a task done again walks alike; a task holds one part at
    a time. Records without any token match nothing; an empty table gives an empty result.
    """
    parts = parts.repartition("part").sortWithinPartitions("part", "side", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            p = b["part"].to_numpy()
            ends = [*(np.nonzero(p[1:] != p[:-1])[0] + 1), len(p)]
            start = 0
            for end in ends:
                piece = b.iloc[start:end]
                if held and len(piece) and held[-1]["part"].iloc[0] != piece["part"].iloc[0]:
                    yield part_pairs(pd.concat(held, ignore_index=True), tokens, reach, possible, rerank, rounds)
                    held = []
                if len(piece):
                    held.append(piece)
                start = end
        if held:
            yield part_pairs(pd.concat(held, ignore_index=True), tokens, reach, possible, rerank, rounds)

    return parts.mapInPandas(run, f"id1 long, id2 long, cosine double, {columns}")


#: Pairs a calibration is fitted on.
CALIBRATED_ON = 50_000


def calibrate(labelled: DataFrame, cosine: str, label: str) -> tuple[float, float]:
    """(a, b) of confidence = 1 / (1 + exp(-(a cosine + b))), by logistic regression.

    Fitted on at most CALIBRATED_ON pairs of lowest hash among those with a label (1 or 0). Labels must not come from
    the cosine. Without pairs of both labels nothing is known and (0, 0) gives one half.
    """
    sample = labelled.where(F.col(label).isNotNull()).select(F.col(cosine).alias("x"), F.col(label).cast("double").alias("y"), F.xxhash64("id1", "id2").alias("h"))
    got = sample.orderBy("h").limit(CALIBRATED_ON).toPandas()
    y = got["y"].to_numpy()
    if not len(y) or y.min() == y.max():
        return 0.0, 0.0
    x = np.column_stack([got["x"], np.ones(len(got))])
    w = np.zeros(2)
    for _ in range(50):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2)
        step = np.linalg.solve(h, x.T @ (y - p) - w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])
