"""Where rows go before a step that makes many of few."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by the key over all shuffle partitions: few bytes here become many rows, which size-based coalescing cannot know."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def apart(spark: SparkSession, n: int) -> list[int]:
    """n numbers that dealing by hash sends to n partitions, one to each."""
    ids = spark.range(64 * n).select(F.col("id").cast("int").alias("id")).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p"))
    return [r["id"] for r in ids.groupBy("p").agg(F.min("id").alias("id")).orderBy("p").collect()]
