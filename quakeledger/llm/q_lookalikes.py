"""Visually identical texts: queries on documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeledger.llm.lookalikes import lookalike_pairs, with_one_form
from quakeledger.runtime import table


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that differ in their characters but not to the eye."""
    return lookalike_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in one form, and whether that changed it."""
    got = with_one_form(table(spark, sf_dir, "documents"), "text", "form", ("doc_id",))
    return got.select("doc_id", F.col("form").alias("text"), (F.col("form") != F.col("text")).alias("changed"))


QUERIES = {"p9_found": p9_found, "p9_normalised": p9_normalised}
SQL: dict[str, str] = {}
