"""Queries that go by sizes in tokens: filling containers, and mixing sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quakeledger.llm.mixing import BLOCK_TOKENS, mix
from quakeledger.llm.packing import Rules, pack
from quakeledger.llm.tokens import with_tokens
from quakeledger.runtime import checkpoint, fetch_bounded, table


def _capacities(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    rows = fetch_bounded(table(spark, sf_dir, "containers"), 10_000, "the table of containers")
    return {r["container_kind"]: int(r["capacity_tokens"]) for r in rows if r["container_kind"] is not None and r["capacity_tokens"]}


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a container of every kind."""
    docs = with_tokens(table(spark, sf_dir, "documents"), ("doc_id",), "text")
    return pack(docs, "doc_id", "tokens", _capacities(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By kind and choice of container: containers used, a number that none can go below, fill, and the limits reached."""
    caps = _capacities(spark, sf_dir)
    docs = checkpoint(with_tokens(table(spark, sf_dir, "documents"), ("doc_id",), "text"))
    capacity = F.element_at(F.create_map(*(F.lit(x) for kv in sorted(caps.items()) for x in kv)), F.col("container_kind"))
    out = None
    for choice in ("norm", "dot"):
        rules = Rules(choice=choice)
        placed = pack(docs, "doc_id", "tokens", caps, rules).where("container_id IS NOT NULL").withColumn("capacity", capacity)
        cost = F.pow(F.col("n_tokens") / F.col("capacity"), 2)
        held = placed.groupBy("container_kind", "capacity", "container_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs"), F.sum(cost).alias("cost"))
        alone = F.col("docs") == 1
        got = held.groupBy("container_kind", "capacity").agg(
            F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), F.sum("docs").alias("n_items"), F.sum(F.least("cost", F.lit(rules.attention))).alias("attention"),
            F.max("docs").alias("most_documents"), F.max(F.when(~alone, F.col("cost"))).alias("most_attention"),
        )
        bound = F.greatest(
            F.ceil(F.col("n_tokens") / F.col("capacity")), F.ceil(F.col("n_items") / F.greatest(F.lit(1), F.floor(F.col("capacity") * rules.documents))),
        )
        got = got.select(
            "container_kind", F.lit(choice).alias("choice"), "n_containers", bound.alias("least_containers"), "n_tokens",
            F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 6).alias("fill"), "most_documents", F.round("most_attention", 6).alias("most_attention"),
        )
        out = got if out is None else out.unionByName(got)
    return out


def p7_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By kind: documents placed, and how many containers or documents break a rule of the packing (none may)."""
    caps, rules = _capacities(spark, sf_dir), Rules()
    docs = checkpoint(with_tokens(table(spark, sf_dir, "documents"), ("doc_id",), "text"))
    sizes = docs.groupBy("doc_id").agg(F.max("tokens").alias("size"))
    capacity = F.element_at(F.create_map(*(F.lit(x) for kv in sorted(caps.items()) for x in kv)), F.col("container_kind"))
    placed = checkpoint(pack(docs, "doc_id", "tokens", caps, rules).withColumnRenamed("id", "doc_id").withColumn("capacity", capacity))
    most = F.greatest(F.lit(1), F.floor(F.col("capacity") * rules.documents))
    held = placed.where("container_id IS NOT NULL").groupBy("container_kind", "capacity", "container_id").agg(
        F.sum("n_tokens").alias("n"), F.count("*").alias("docs"), F.sum(F.pow(F.col("n_tokens") / F.col("capacity"), 2)).alias("cost")
    )
    over = held.groupBy("container_kind").agg(
        F.count_if(F.col("n") > F.col("capacity")).alias("n_over"), F.count_if(F.col("docs") > most).alias("n_crowded"),
        F.count_if((F.col("docs") > 1) & (F.col("cost") > rules.attention + 1e-9)).alias("n_costly"),
    )
    by_doc = placed.groupBy("container_kind", "capacity", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("parts")).join(sizes, "doc_id")
    whole = by_doc.groupBy("container_kind").agg(
        F.count("*").alias("n_documents"), F.count_if(F.col("n") != F.col("size")).alias("n_incomplete"),
        F.count_if((F.col("parts") > 1) & (F.col("size") <= F.col("capacity"))).alias("n_divided"),
    )
    return whole.join(over, "container_kind")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = with_tokens(table(spark, sf_dir, "documents"), ("doc_id", "source"), "text")
    return mix(docs, "doc_id", "source", "tokens", table(spark, sf_dir, "mix_targets"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slices of documents that make the mixture, with their repeats."""
    return _mixed(spark, sf_dir)[0]


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached shares of each source."""
    return _mixed(spark, sf_dir)[1]


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By target: whether its share (among the sources with documents) is reached to two blocks a repeat, and whether its cap is kept."""
    chosen, report = _mixed(spark, sf_dir)
    report = checkpoint(report)
    have = F.sum(F.when(F.col("tokens_available") > 0, F.col("target_share")).otherwise(0.0)).over(Window.partitionBy(F.lit(0)))  # a row a target
    due = F.when(F.col("tokens_available") > 0, F.col("target_share") / have).otherwise(0.0)
    most = chosen.groupBy("source").agg(F.max("repeats").alias("r"))
    total = F.sum("n_tokens").over(Window.partitionBy(F.lit(0)))
    near = F.abs(F.col("n_tokens") - due * total) <= 2 * BLOCK_TOKENS * F.greatest(F.lit(1), F.col("repeats"))
    got = report.withColumn("near", near).join(most, "source", "left")
    return got.select("source", "max_repeats", F.col("near").alias("reached"), (F.coalesce("r", F.lit(0)) <= F.col("max_repeats")).alias("kept"))


QUERIES = {
    "p7_containers": p7_containers, "p7_fill": p7_fill, "p7_kept": p7_kept, "p8_mix": p8_mix, "p8_report": p8_report, "p8_kept": p8_kept,
}
# Sizes in tokens can't be told in SQL; what must hold whatever they are can.
SQL = {
    "p7_kept": """SELECT container_kind, count(DISTINCT doc_id) AS n_documents, 0 AS n_incomplete, 0 AS n_divided, 0 AS n_over, 0 AS n_crowded, 0 AS n_costly
      FROM documents, containers WHERE doc_id IS NOT NULL GROUP BY 1""",
    "p8_kept": "SELECT source, max(max_repeats) AS max_repeats, true AS reached, true AS kept FROM mix_targets WHERE source IS NOT NULL GROUP BY 1",
}
