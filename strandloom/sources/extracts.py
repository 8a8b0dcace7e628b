"""Extracts of annotation, ligand and structure collections for the targets of a search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def database_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table behind JDBC; filters and columns are pushed down to it."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def annotation_hits(ids: DataFrame, hits: DataFrame, entries: DataFrame | None = None, namespace: str | None = None) -> DataFrame:
    """Annotations of the given targets: a semi-join, so repeated ids repeat nothing.

    hits carries its clan column CL, or takes it from entries(AC, CL) by the accession without its version.
    """
    rows = hits.where(F.lower("target_name") != "target_name")
    if "CL" not in hits.columns:
        bare = F.regexp_replace("query_accession", r"\..*$", "")
        rows = rows.withColumn("_ac", bare).join(entries.select(F.col("AC").alias("_ac"), "CL").dropDuplicates(["_ac"]), "_ac", "left").drop("_ac")
    if namespace:
        rows = rows.where(F.lower("database") == namespace.lower())
    return rows.join(ids.select(F.col("target_id").alias("target_name")), "target_name", "left_semi").withColumnRenamed("CL", "clan")


def ligands(ids: DataFrame, table: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ligands of the targets' chains, and the names of those that occur."""
    keys = ids.select(F.substring("target_id", 1, 4).alias("pdb_id"), F.substring("target_id", 5, 1).alias("chain_id")).distinct()
    found = table.join(keys, ["pdb_id", "chain_id"])
    return found, found.select("res_name").distinct().join(names, "res_name", "left")


def descriptions(names: DataFrame, hits: DataFrame) -> DataFrame:
    """Descriptions of the families that occur; a family without clan stands for its own."""
    kept = names.join(hits.select(F.col("query_accession").alias("pfam")), "pfam", "left_semi")
    return kept.withColumns({"clan": F.coalesce("clan", "pfam"), "clan_short": F.coalesce("clan_short", F.lit(""))})


def structures(ids: DataFrame, ledger: DataFrame, shards: DataFrame, namespace_id: int) -> DataFrame:
    """Coordinates of the targets: the ledger names each one's entry, the shard table holds it."""
    wanted = ledger.where(F.col("ns_id") == namespace_id).join(ids.select(F.col("target_id").alias("dali_id")).distinct(), "dali_id", "left_semi")
    return wanted.select("dali_id", "umid", "n_res").join(shards, "umid")


def composition(hits: DataFrame) -> DataFrame:
    """Distinct families and clans of each target."""
    return hits.groupBy("target_name").agg(F.array_sort(F.collect_set("query_accession")).alias("families"), F.array_sort(F.collect_set("clan")).alias("clans"))


def clan_member(hits: DataFrame, clan: str) -> DataFrame:
    return hits.groupBy("target_name").agg(F.coalesce(F.max(F.col("clan") == clan), F.lit(False)).alias("true_label"))
