"""The catalog as a stream: deliveries deduplicated, gate counts by catalog and day kept up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeledger.operators.subtests import depth_out_of_bounds, magnitude_out_of_bounds, place_out_of_bounds
from quakeledger.runtime import ensure_checkpoint_dir, present


def read_deliveries(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    """A folder (or file, as a glob) of Parquet deliveries as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def daily_gate_counts(deliveries: DataFrame, lateness: str | None = None) -> DataFrame:
    """(catalog_id, day, n, p1_k, p2_k, p3_k) over distinct records, by day of the event.

    With ``lateness`` (e.g. "30 days") state is dropped for records ingested that much before the latest one, which a
    stream that never ends needs; without it a backfill is exact whatever the order of arrival.
    """
    rows = deliveries.select("catalog_id", "record_id", "origin_time", "ingested_at", *(present(c).alias(c) for c in ("latitude", "longitude", "depth_km", "magnitude")))
    if lateness:
        rows = rows.withColumn("ingested_at", F.col("ingested_at").cast("timestamp")).withWatermark("ingested_at", lateness).dropDuplicatesWithinWatermark(["catalog_id", "record_id"])
    else:
        rows = rows.dropDuplicates(["catalog_id", "record_id"])
    day = F.to_date("origin_time")
    return rows.groupBy("catalog_id", day.alias("day")).agg(F.count("*").alias("n"), F.count_if(place_out_of_bounds()).alias("p1_k"), F.count_if(depth_out_of_bounds()).alias("p2_k"), F.count_if(magnitude_out_of_bounds()).alias("p3_k"))


def run_to_end(stream: DataFrame, key: list[str]) -> DataFrame:
    """All that is available now, processed in batches; the latest state of each key, as a table in the shared folder."""
    spark = stream.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    versions: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/state/v{number}")
        versions.append(number)

    query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if not versions:
        return spark.createDataFrame([], stream.schema)
    return spark.read.parquet(f"{folder}/state/v{versions[-1]}")
