"""Matching local_bulletin with reference_events: queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quakeledger.llm.matching import ROUNDS, calibrate, combined, dealt_into_parts, matched_pairs
from quakeledger.runtime import checkpoint, present, table

HOUR = 3_600.0
#: Whole hours by which a clock may be off, the seconds two clocks may differ otherwise, and the least evidence of a match.
MOST_HOURS, MOST_SECONDS, LEAST_EVIDENCE = 13, 12.0, 3.0
#: Of several candidates from one source (early and final solutions apart), those this close to the best are kept.
NEAR_BEST = 2.5
# Words of place texts that name no place.
NO_PLACE = ("near", "off", "region", "nne", "ene", "ese", "sse", "ssw", "wsw", "wnw", "nnw", "from", "the", "coast")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both tables as (side, id, at seconds, lat, lon, mag, words as hashes, source, early), one row for each id."""

    def shaped(name: str, side: int, key: str, place: str, source: Column, early: Column) -> DataFrame:
        lon = present("longitude")
        words = F.array_except(F.regexp_extract_all(F.lower(F.coalesce(place, F.lit(""))), F.lit(r"(\p{L}{3,})"), F.lit(1)), F.array(*map(F.lit, NO_PLACE)))
        got = table(spark, sf_dir, name).where(F.col(key).isNotNull()).select(
            F.col(key).alias("id"), (F.unix_micros(F.col("origin_time").cast("timestamp")) / 1e6).alias("at"), present("latitude").alias("lat"),
            (F.pmod(lon + 180.0, F.lit(360.0)) - 180.0).alias("lon"), present("magnitude").alias("mag"),
            F.array_sort(F.transform(words, lambda w: F.xxhash64(w))).alias("words"), source.alias("source"), early.alias("early"),
        )
        one = got.groupBy("id").agg(F.max(F.struct("at", "lat", "lon", "mag", "words", "source", "early")).alias("r"))
        return one.select(F.lit(side).alias("side"), "id", "r.*")

    early = F.coalesce(F.lower(F.trim("revision_status")).isin("automatic", "preliminary", "prelim"), F.lit(False))
    return shaped("local_bulletin", 1, "report_id", "place", F.lit(""), F.lit(False)), shaped("reference_events", 2, "ref_id", "region_text", F.coalesce("source_id", F.lit("")), early)


#: Width of the windows of days that are part of a token; two grids, half a window apart, so that clocks up to
#: MOST_HOURS apart share one.
WINDOW = (2 * MOST_HOURS + 1) * HOUR


def _lists(of: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a column of lists."""
    n = np.array([len(x) for x in of], dtype=np.int64)
    return np.repeat(np.arange(len(of)), n), np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in of)])


def tokens(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of records: hashes of attributes, made so that the usual faults leave most of them alike.

    Within a window of days: the time within the hour in steps of 16 s, which a wrong zone doesn't change; the cell of the
    coordinates without signs and order; both, with the time in steps of 144 s, for clocks rounded to minutes; the words
    of the place text, alone and with the time. Without a window: cell, words, and the magnitude in halves. Times and
    cells come in two grids, so that a border divides no pair.
    """
    t, lat, lon, mag = (b[c].to_numpy(float) for c in ("at", "lat", "lon", "mag"))
    named, word = _lists(b["words"])
    every = np.arange(len(b))
    located, sized = np.nonzero(~np.isnan(lat) & ~np.isnan(lon))[0], np.nonzero(~np.isnan(mag))[0]
    low, high = np.minimum(np.abs(lat), np.abs(lon)), np.maximum(np.abs(lat), np.abs(lon))
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def add(rows: np.ndarray, kind: int, *columns: np.ndarray) -> None:
        out.append((rows, combined(np.full(len(rows), kind), *columns)))

    for grid in (0, 1):
        window = np.floor((t + grid * WINDOW / 2) / WINDOW) * 2 + grid
        add(named, 5, window[named], word)
        for half in (0, 1):
            fine, coarse = np.floor(np.mod(t + 8 * half, HOUR) / 16), np.floor(np.mod(t + 72 * half, HOUR) / 144)
            cell = [np.floor(x[located] + half / 2) for x in (low, high)]
            add(every, 1 + half, window, fine)
            add(located, 3 + half, window[located], *cell)
            add(named, 10 + half, window[named], coarse[named], word)
            add(located, 12 + half, window[located], coarse[located], *cell)
    add(named, 6, word)
    add(sized, 7, np.round(mag[sized] * 2))
    add(located, 8, *(np.floor(x[located]) for x in (low, high)))
    return np.concatenate([r for r, _ in out]), np.concatenate([x for _, x in out])


def clocks_can_agree(t1: np.ndarray, t2: np.ndarray) -> np.ndarray:
    """The necessary condition of a match: clocks apart by seconds, after whole hours, or by rounding to minutes."""
    dt = t2 - t1
    hours = np.round(dt / HOUR)
    whole = (t1 % 60 == 0) | (t2 % 60 == 0)
    return (np.abs(hours) <= MOST_HOURS) & ((np.abs(dt - hours * HOUR) <= MOST_SECONDS) | (whole & (np.abs(dt) <= 60 + MOST_SECONDS)))


def _tail(x: np.ndarray, scale: float) -> np.ndarray:
    return -2.0 * np.log1p((x / scale) ** 2)


def _places_apart(one: pd.DataFrame, two: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Degrees between the places as written, and at the least with signs or order of the first mistaken; NaN if missing."""
    (lat1, lon1), (lat2, lon2) = ((x["lat"].to_numpy(float), x["lon"].to_numpy(float)) for x in (one, two))

    def apart(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        dl = np.abs(np.mod(lon2 - lon + 180.0, 360.0) - 180.0) * np.cos(np.radians(lat2))
        return np.hypot(lat2 - lat, dl)

    return apart(lat1, lon1), np.minimum.reduce([apart(-lat1, lon1), apart(lat1, -lon1), apart(-lat1, -lon1), apart(lon1, lat1)])


def evidence(one: pd.DataFrame, two: pd.DataFrame) -> np.ndarray:
    """The sum of the attributes' log likelihood ratios for pairs of rows; missing values add 0."""
    t1, t2 = one["at"].to_numpy(float), two["at"].to_numpy(float)
    dt = t2 - t1
    hours = np.round(dt / HOUR)
    never = np.full(len(dt), -np.inf)
    clock = np.maximum.reduce([
        6.0 + _tail(dt, 2.0),
        np.where((hours != 0) & (np.abs(hours) <= MOST_HOURS), 2.0 + _tail(dt - hours * HOUR, 2.0), never),
        np.where(t1 % 60 == 0, 3.0 + _tail(np.maximum(0.0, np.maximum(-dt, dt - 60.0)), 2.0), never),
        np.where(t2 % 60 == 0, 3.0 + _tail(np.maximum(0.0, np.abs(dt) - 30.0), 2.0), never),
    ])
    written, turned = _places_apart(one, two)
    place = np.maximum.reduce([np.full(len(dt), -6.0), 5.0 + _tail(written, 0.12), 2.0 + _tail(turned, 0.12)])
    size = np.maximum(-5.0, 1.5 - (two["mag"].to_numpy(float) - one["mag"].to_numpy(float) - 0.15) ** 2 / 0.18)
    (r1, w1), (r2, w2) = _lists(one["words"]), _lists(two["words"])
    has1, has2, shared = (np.zeros(len(dt), bool) for _ in range(3))
    has1[r1], has2[r2] = True, True
    shared[r1[np.isin(combined(r1, w1), combined(r2, w2))]] = True
    words = np.where(has1 & has2, np.where(shared, 2.5, -1.0), 0.0)
    return clock + np.nan_to_num(place) + np.nan_to_num(size) + words


def strong(one: pd.DataFrame, two: pd.DataFrame) -> tuple[np.ndarray, dict]:
    """The pairs with enough evidence: rows, and their evidence, source and whether the solution is early."""
    e = evidence(one, two)
    kept = np.nonzero(e >= LEAST_EVIDENCE)[0]
    return kept, {"evidence": e[kept], "source": two["source"].to_numpy()[kept], "early": two["early"].to_numpy()[kept]}


def labelled(one: pd.DataFrame, two: pd.DataFrame) -> tuple[np.ndarray, dict]:
    """strong, and beside them the pairs that can't be one event; with label.

    The label comes from the attributes alone, never from vectors or evidence: 1 where clocks, places and magnitudes agree
    closely, 0 where the places lie more than a degree apart however they are read, null else.
    """
    e = evidence(one, two)
    written, turned = _places_apart(one, two)
    dt = np.abs(two["at"].to_numpy(float) - one["at"].to_numpy(float))
    with np.errstate(invalid="ignore"):
        same = (dt <= 3) & (written <= 0.15) & (np.abs(two["mag"].to_numpy(float) - one["mag"].to_numpy(float)) <= 0.5)
        other = np.minimum(written, turned) > 1
    label = np.where(same, 1.0, np.where(other, 0.0, np.nan))
    kept = np.nonzero((e >= LEAST_EVIDENCE) | other)[0]
    return kept, {"evidence": e[kept], "source": two["source"].to_numpy()[kept], "early": two["early"].to_numpy()[kept], "label": label[kept]}


#: Sub-windows of the hour, in seconds, that divide crowded days.
SUB = 150


def met_pairs(spark: SparkSession, sf_dir: str, rerank=strong, columns: str = "", rounds: int = ROUNDS) -> DataFrame:
    """Pairs that meet in a bucket and are kept by ``rerank``: id1, id2, cosine, evidence, source, early."""
    reports, refs = _sides(spark, sf_dir)
    both = checkpoint(reports.unionByName(refs).where("at IS NOT NULL"))
    reach = MOST_HOURS * HOUR + MOST_SECONDS
    parts = dealt_into_parts(both, reach, int(HOUR), SUB, 60 + MOST_SECONDS)
    return matched_pairs(parts, tokens, reach, clocks_can_agree, rerank, f"evidence double, source string, early boolean{columns}", rounds)


def _best(pairs: DataFrame) -> DataFrame:
    """Of a report's candidates from one source, those near the best."""
    best = F.max("evidence").over(Window.partitionBy("id1", "source", "early"))
    return pairs.withColumn("best", best).where(F.col("evidence") >= F.col("best") - NEAR_BEST)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a report and a reference row of one earthquake."""
    return _best(met_pairs(spark, sf_dir)).select(F.col("id1").alias("report_id"), F.col("id2").alias("ref_id"))


def p3_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches with the cosine of their vectors and the confidence that the cosine is calibrated to."""
    pairs = checkpoint(met_pairs(spark, sf_dir, labelled, ", label double").withColumn("label", F.nanvl("label", F.lit(None))))
    a, b = calibrate(pairs, "cosine", "label")
    confidence = 1 / (1 + F.exp(-(F.lit(a) * F.col("cosine") + F.lit(b))))
    return _best(pairs.where(F.col("evidence") >= LEAST_EVIDENCE)).select(
        F.col("id1").alias("report_id"), F.col("id2").alias("ref_id"), F.round("cosine", 4).alias("cosine"),
        F.round("evidence", 4).alias("evidence"), F.round(confidence, 4).alias("confidence"),
    )


QUERIES = {"p3_found": p3_found, "p3_confidence": p3_confidence}
SQL: dict[str, str] = {}
