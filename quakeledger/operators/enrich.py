"""Filling gaps of records from tables and services that know them by an identifier."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fill_missing(rows: DataFrame, known: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows whose missing values of ``columns`` come from ``known`` (key and the same columns); present ones stay.

    known is reduced to one row a key (the largest value of each column); null keys find nothing; rows keep their number.
    """
    best = known.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.max(c).alias(f"__{c}") for c in columns))
    got = rows.join(best, key, "left")
    return got.select(*(F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in rows.columns))


def looked_up(keys: DataFrame, key: str, schema: str, fetch: Callable[[str], dict | None], store: str) -> DataFrame:
    """What a service says of each key, with a store of answers that lasts: key, found and the columns of ``schema``.

    fetch(key) gives a dict for a hit and None for a confirmed miss, both of which are stored, and raises where the
    service fails; such a key isn't stored, so that it is asked for again next time, and comes out as not found.
    Only keys that the store lacks are asked for, each once. Null keys are left out.
    """
    spark = keys.sparkSession
    full = f"`{key}` string, found boolean, {schema}"
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    known = spark.read.schema(full).parquet(store) if there else spark.createDataFrame([], full)
    wanted = keys.select(F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull()).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k in b[key]:
                try:
                    answer = fetch(k)
                except Exception:
                    continue
                out.append({key: k, "found": answer is not None, **(answer or {})})
            if out:
                yield pd.DataFrame(out, columns=names)

    names = [key, "found", *spark.createDataFrame([], schema).columns]
    wanted.join(known, key, "left_anti").mapInPandas(run, full).write.mode("append").parquet(store)
    return wanted.join(spark.read.schema(full).parquet(store), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def ruptures(products: DataFrame, rake: Column, length_km: Column, width_km: Column) -> DataFrame:
    """products with mechanism (by the rake), rupture_length_km and rupture_area_km2 = length times width."""
    from quakeledger.functions.scalars import mechanism_of_rake

    return products.withColumn("mechanism", mechanism_of_rake(rake)).withColumn("rupture_length_km", length_km).withColumn("rupture_area_km2", length_km * width_km)


def fetch_status(files: DataFrame, sparse: int = 15) -> DataFrame:
    """(file, n_rows, status) of fetched files: EMPTY, SPARSE (fewer than ``sparse`` rows) or OK. files: file, n_rows."""
    n = F.coalesce("n_rows", F.lit(0))
    return files.select("file", n.alias("n_rows"), F.when(n == 0, "EMPTY").when(n < sparse, "SPARSE").otherwise("OK").alias("status"))
