import random
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest

from quakeledger.llm.mixing import apportion, mix, reachable_seats
from quakeledger.llm.packing import Rules, best_fit, pack
from quakeledger.llm.tokens import LONG, VOCABULARY, count_tokens, encoder, with_tokens


def test_containers_hold_their_constraints():
    rng = np.random.default_rng(1)
    for choice in ("norm", "dot"):
        sizes = rng.integers(1, 513, 1500)
        rules = Rules(documents=6 / 512, attention=0.5, choice=choice)
        at = best_fit(sizes, 512, rules)
        for b in range(at.max() + 1):
            s = sizes[at == b]
            assert len(s) and s.sum() <= 512 and len(s) <= 6 and (len(s) == 1 or (s.astype(float) ** 2).sum() <= 0.5 * 512**2 + 1e-6)
        assert at.max() + 1 >= -(-sizes.sum() // 512)


def test_pack_places_every_token_once(spark):
    rng = random.Random(2)
    items = [(i, rng.choice([0, 1, 5, 60, 100, 101, 199, 200, 201, 1000])) for i in range(500)] + [(900, None), (None, 7)]
    rows = [(i, n, "x") for i, n in items] + [(*items[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, tokens long, container_id string")
    caps = {"small": 100, "large": 1000}
    for shard in (4_096, 50):
        got = pack(df, "doc_id", "tokens", caps, shard_items=shard).collect()
        for kind, cap in caps.items():
            mine = [r for r in got if r["container_kind"] == kind]
            filled = {}
            for r in mine:
                if r["container_id"] is not None:
                    filled[r["container_id"]] = filled.get(r["container_id"], 0) + r["n_tokens"]
            assert max(filled.values()) <= cap
            for i, n in items:
                parts = sorted((r["part"], r["first_token"], r["n_tokens"], r["container_id"]) for r in mine if r["id"] == i)
                if i is None:
                    continue
                if not n:
                    assert [p[3] for p in parts] == [None]
                else:
                    assert len(parts) == -(-n // cap) and sum(p[2] for p in parts) == n and [p[1] for p in parts] == [k * cap for k in range(len(parts))]
    assert pack(df.limit(0), "doc_id", "tokens", caps).count() == 0
    with pytest.raises(ValueError):
        pack(df, "doc_id", "tokens", {"none": 0})


def test_fill_is_close_to_the_least(spark):
    rng = np.random.default_rng(3)
    sizes = np.minimum(rng.lognormal(4.5, 1, 9000).astype(int) + 1, 2000)
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "doc_id long, tokens long")
    got = pack(df, "doc_id", "tokens", {"c": 1024}, Rules(documents=1 / 8, attention=1.0), shard_items=1000)  # tokens alone bind
    used = got.select("container_id").distinct().count()
    assert used <= 1.02 * -(-sizes.sum() // 1024)


def test_every_constraint_binds():
    """Taking any one constraint away, or the other choice, changes the packing of texts of the usual sizes."""
    sizes = np.minimum(np.random.default_rng(5).lognormal(4.9, 1.1, 4_000).astype(int) + 1, 512)
    count = lambda r: int(best_fit(sizes, 512, r).max()) + 1
    all_bind = Rules()
    assert count(all_bind) > count(replace(all_bind, documents=1.0)) and count(all_bind) > count(replace(all_bind, attention=1.0))
    assert not np.array_equal(best_fit(sizes, 512, all_bind), best_fit(sizes, 512, replace(all_bind, choice="dot")))
    for choice in ("norm", "dot"):
        at = best_fit(sizes, 512, replace(all_bind, choice=choice))
        held, cost = np.bincount(at), np.bincount(at, (sizes / 512) ** 2)
        assert held.max() == 8 and np.bincount(at, sizes).max() <= 512 and (cost[held > 1] <= 0.9 + 1e-9).all()


def slow_apportion(shares, caps, seats):
    won = [0] * len(shares)
    for _ in range(seats):
        q = [s / (2 * w + 1) if w < c and s > 0 else -1 for s, w, c in zip(shares, won, caps)]
        if max(q) < 0:
            break
        won[q.index(max(q))] += 1
    return won


def test_apportion_equals_seat_by_seat():
    rng = random.Random(4)
    for _ in range(300):
        k = rng.randrange(1, 8)
        shares = [rng.choice([0, 0.1, 0.1, rng.random()]) for _ in range(k)]
        caps = [rng.randrange(0, 60) for _ in range(k)]
        seats = rng.randrange(0, 150)
        assert list(apportion(shares, caps, seats)) == slow_apportion(shares, caps, seats)
    assert apportion([0.3, 0.7], [10**9, 10**9], 10**8).tolist() == [30_000_000, 70_000_000]
    assert reachable_seats(np.array([0.5, 0.5, 0.1]), np.array([100, 40, 0])) == 80


def test_mix_keeps_caps_and_shares(spark):
    rng = random.Random(5)
    docs = [(i, rng.choice(["a", "a", "a", "b", "c", "other", None]), rng.choice([0, 10, 300, 2000])) for i in range(1500)] + [(None, "a", 10)]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 2), ("c", 0.2, 3), ("none", 0.1, 4), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mix(df, "doc_id", "source", "tokens", targets, block_tokens=100)
    rep = {r["source"]: r for r in report.collect()}
    assert set(rep) == {"a", "b", "c", "none"} and rep["none"]["n_tokens"] == 0
    for s, share in (("a", 0.3), ("b", 0.4), ("c", 0.2)):
        assert abs(rep[s]["reached_share"] - share / 0.9) < 0.01 and rep[s]["repeats"] <= rep[s]["max_repeats"]
    rows = chosen.collect()
    size = {d[0]: d[2] for d in docs}
    seen = {}
    for r in rows:
        assert 0 <= r["first_token"] and r["first_token"] + r["n_tokens"] <= size[r["doc_id"]] and r["n_tokens"] > 0
        seen.setdefault((r["source"], r["shard"], r["block"]), []).append(r)
    assert all(sum(x["n_tokens"] for x in b) <= 100 and len({x["repeats"] for x in b}) == 1 for b in seen.values())
    empty_chosen, empty_report = mix(df.limit(0), "doc_id", "source", "tokens", targets)
    assert empty_chosen.count() == 0 and empty_report.count() == 4


def test_long_texts_count_as_a_whole(spark):
    rng = random.Random(6)
    text = "".join(rng.choice(["quake ", "\n", "\n\n", " 12", "é", "\n  ", "."]) for _ in range(60_000))
    assert len(text) > 2 * LONG
    blank_lines = "\n\n".join("quake of size 4.5\n\n\n  felt" for _ in range(6_000))
    for vocabulary in sorted(Path(VOCABULARY).parent.glob("*.tiktoken")):
        enc = encoder(str(vocabulary))
        for t in (text, blank_lines, "x" * 200_000, "a\n" * 80_000, "\n" * 120_000):
            assert count_tokens(t, enc) == len(enc.encode_ordinary(t)), vocabulary.name
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "<|endoftext|>")], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in with_tokens(df, ("doc_id",), "text").collect()}
    assert got[2] == got[3] == 0 and got[1] == 2 and got[4] > 1
