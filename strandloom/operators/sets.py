"""Overlaps of identifier sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def shared_matrix(members: DataFrame, view: str, target: str) -> DataFrame:
    """(a, b, shared): targets in common of every two views, the diagonal included.

    The self-join runs on the target, over distinct memberships.
    """
    m = members.select(F.col(view).alias("a"), F.col(target).alias("t")).distinct()
    pairs = m.join(m.select(F.col("a").alias("b"), "t"), "t")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))


def regions(sets: list[DataFrame], key: str) -> DataFrame:
    """(code, n): how many keys lie in exactly which of the sets; code has one digit a set."""
    rows = None
    for i, s in enumerate(sets):
        one = s.select(key).distinct().select(key, *(F.lit(int(i == j)).alias(f"_{j}") for j in range(len(sets))))
        rows = one if rows is None else rows.unionByName(one)
    flags = rows.groupBy(key).agg(*(F.max(f"_{j}").alias(f"_{j}") for j in range(len(sets))))
    return flags.groupBy(F.concat(*(F.col(f"_{j}").cast("string") for j in range(len(sets)))).alias("code")).agg(F.count("*").alias("n"))


def agreement(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs only in a, only in b and in both, and the share of both."""
    both = a.select(*keys).distinct().withColumn("_a", F.lit(1)).join(b.select(*keys).distinct().withColumn("_b", F.lit(1)), keys, "full")
    n = both.agg(F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"))
    return n.withColumn("pct_both", F.coalesce(100.0 * F.col("both") / F.nullif(F.col("only_a") + F.col("only_b") + F.col("both"), F.lit(0)), F.lit(0.0)))


def disjoint(members: DataFrame, cluster: str, item: str) -> DataFrame:
    """Items that more than one cluster claims: empty where the clusters are disjoint."""
    return members.select(cluster, item).distinct().groupBy(item).agg(F.count("*").alias("n")).where("n > 1")


def unclaimed(candidates: DataFrame, claimed: DataFrame, item: str) -> DataFrame:
    return candidates.join(claimed.select(item), item, "left_anti")


def first_rows(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row a key, the first in order."""
    kept = rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), order).alias("r"))
    return kept.select("r.*")
