"""Equi-joins whose hot keys are split among many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hot keys that may be broadcast.
HOT_LISTED = 100_000


def split_join(left: DataFrame, right: DataFrame, on: list[str], left_id: str, hot_rows: int = 4_000) -> DataFrame:
    """Inner join on ``on``, with keys of more than ``hot_rows`` left rows dealt into parts.

    Hot keys are found by one pre-aggregated count. Their left rows are dealt by hash of ``left_id`` and their right
    rows repeated for each part, so no task gets more than about hot_rows left rows of a key. Without hot keys it is a
    plain join. Up to HOT_LISTED hot keys are broadcast; more are joined by shuffle. Null keys join nothing.
    """
    hot = left.groupBy(*on).agg(F.count("*").alias("__n")).where(F.col("__n") > hot_rows).select(*on, F.ceil(F.col("__n") / hot_rows).cast("int").alias("__parts"))
    listed = hot.limit(HOT_LISTED + 1).collect()
    if not listed:
        return left.join(right, on)
    if len(listed) <= HOT_LISTED:
        hot = F.broadcast(left.sparkSession.createDataFrame(listed, hot.schema))
    parts = F.coalesce("__parts", F.lit(1))
    left = left.join(hot, on, "left").withColumn("__part", F.pmod(F.xxhash64(left_id, F.lit(7)), parts).cast("int")).drop("__parts")
    right = right.join(hot, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return left.join(right, [*on, "__part"]).drop("__part")
