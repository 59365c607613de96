"""Splits that keep related datasets together: queries on the two corpus manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quakeledger.llm.splits import QUARANTINE, TARGETS, ComponentTable
from quakeledger.runtime import checkpoint, ensure_checkpoint_dir, table


def compared_name(c: Column) -> Column:
    """Lower case, each run of other characters than a-z and 0-9 one underscore, none at the ends; null if nothing is left."""
    name = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_|_$", "")
    return F.when(name != "", name)


def manifest_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(name) and (a, b) of corpus_manifest."""
    rows = table(spark, sf_dir, "corpus_manifest").select(compared_name(F.col("dataset_id")).alias("a"), "parent_catalog", "notes")
    named = F.filter(F.transform(F.split(F.coalesce("parent_catalog", F.lit("")), "[;+|]"), compared_name), lambda p: p.isNotNull())
    noted = compared_name(F.nullif(F.regexp_extract(F.lower("notes"), r"derived from\s+([^;]+)", 1), F.lit("")))
    parents = F.when(F.size(named) > 0, named).when(noted.isNotNull(), F.array(noted))
    return rows.select(F.col("a").alias("name")), rows.select("a", F.explode(parents).alias("b"))


def adversarial_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(name) and (a, b) of adversarial_corpus_manifest."""
    rows = table(spark, sf_dir, "adversarial_corpus_manifest").select(compared_name(F.col("dataset_id")).alias("a"))
    base = F.regexp_extract("a", "^(.+)_adversarial_[0-9]+$", 1)
    return rows.select(F.col("a").alias("name")), rows.select("a", F.nullif(base, F.lit("")).alias("b")).where("b IS NOT NULL")


def _component_table(spark: SparkSession) -> ComponentTable:
    return ComponentTable(spark, f"{ensure_checkpoint_dir(spark)}/components-{uuid.uuid4().hex}")


def _stored(spark: SparkSession, sf_dir: str) -> ComponentTable:
    """The component table after corpus_manifest and, as an update, adversarial_corpus_manifest."""
    store = _component_table(spark)
    store.update(*manifest_links(spark, sf_dir))
    store.update(*adversarial_links(spark, sf_dir))
    return store


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each dataset whose related set holds at least two datasets, with the set's first name, from the stored components."""
    members = _stored(spark, sf_dir).members().where("listed").select("name", "group_id")
    many = members.groupBy("group_id").agg(F.count("*").alias("n")).where("n >= 2").select("group_id")
    return members.join(many, "group_id").select(F.col("name").alias("dataset_id"), "group_id")


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dataset's split; corpus_manifest comes first, adversarial_corpus_manifest as an update of the stored components."""
    store = _stored(spark, sf_dir)
    groups = store.groups().select("group_id", "split", "status")
    return store.members().where("listed").join(groups, "group_id").select(F.col("name").alias("dataset_id"), "group_id", "split", "status")


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets and groups of each split, with the shares reached."""
    got = p2_splits(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n_datasets"), F.countDistinct("group_id").alias("n_groups"))
    return got.withColumn("share", F.round(F.col("n_datasets") / F.sum("n_datasets").over(Window.partitionBy(F.lit(0))), 6))  # a row a split


def p2_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets and groups placed, groups that stand in more than one split (none may), and whether the shares are within 2 %."""
    got = checkpoint(p2_splits(spark, sf_dir))
    torn = got.groupBy("group_id").agg(F.countDistinct("split").alias("k")).agg(F.count("*").alias("n_groups"), F.count_if(F.col("k") > 1).alias("n_torn"))
    near = F.lit(True)
    for name, share in TARGETS:
        near = near & (F.abs(F.count_if(F.col("split") == name) / F.greatest(F.lit(1), F.count_if(F.col("split") != QUARANTINE)) - share) <= 0.02)
    return got.agg(F.count("*").alias("n_datasets"), near.alias("near"), F.lit(1).alias("one")).join(torn.withColumn("one", F.lit(1)), "one").drop("one")


_P2 = r"""
WITH RECURSIVE cleaned AS (
  SELECT trim(regexp_replace(lower(dataset_id), '[^a-z0-9]+', '_', 'g'), '_') AS name, parent_catalog, notes FROM corpus_manifest
), parent AS (
  SELECT name, list_filter(list_transform(regexp_split_to_array(coalesce(parent_catalog, ''), '[;+|]'),
    lambda p: trim(regexp_replace(lower(p), '[^a-z0-9]+', '_', 'g'), '_')), lambda p: p <> '') AS named,
    trim(regexp_replace(regexp_extract(lower(coalesce(notes, '')), 'derived from\s+([^;]+)', 1), '[^a-z0-9]+', '_', 'g'), '_') AS noted FROM cleaned
), adv AS (SELECT trim(regexp_replace(lower(dataset_id), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM adversarial_corpus_manifest),
listed AS (SELECT DISTINCT name FROM (SELECT name FROM cleaned UNION ALL SELECT name FROM adv) WHERE name <> ''),
edge AS (
  SELECT name AS a, unnest(CASE WHEN len(named) > 0 THEN named WHEN noted <> '' THEN [noted] ELSE [] END) AS b FROM parent
  UNION SELECT name, regexp_extract(name, '^(.+)_adversarial_[0-9]+$', 1) FROM adv WHERE regexp_matches(name, '^.+_adversarial_[0-9]+$')
), both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge UNION SELECT a, a FROM edge UNION SELECT b, b FROM edge),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
grp AS (SELECT a AS name, min(b) AS group_id FROM reach GROUP BY a),
big AS (SELECT group_id FROM grp JOIN listed USING (name) GROUP BY group_id HAVING count(*) >= 2)
"""
P2_FOUND_SQL = _P2 + "SELECT name AS dataset_id, group_id FROM grp JOIN listed USING (name) JOIN big USING (group_id)"
QUERIES = {"p2_found": p2_found, "p2_splits": p2_splits, "p2_shares": p2_shares, "p2_kept": p2_kept}
SQL = {
    "p2_found": P2_FOUND_SQL,
    "p2_kept": _P2 + """SELECT count(*) AS n_datasets, true AS near, count(DISTINCT coalesce(group_id, name)) AS n_groups, 0 AS n_torn
      FROM listed LEFT JOIN grp USING (name)""",
}
