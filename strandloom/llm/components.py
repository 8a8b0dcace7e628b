"""Connected components of link tables by alternating large-star and small-star rounds.

Every round is a handful of equi-joins and minima with partial aggregation; a node with very many
links is spread over tasks like any other. Rounds are written to the shared folder and earlier
ones deleted. Nothing is gathered on the driver but one count and one checksum a round. A link table
below a size that is checked each round stays in one partition, where the same steps need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import discard, gathered_if_small, narrow, written

ROUNDS = 60


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    root = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(root, "u").where("v != m").select(F.col("v"), "m")
    small = small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    return small.unionByName(root.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node of links(a, b): the smallest node it reaches.

    Self-links and repeated links are fine; nodes without links do not appear; an empty table gives an empty one.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(narrow(edges), "links")
    mark = _mark(edges)
    for _ in range(ROUNDS):
        if not mark[0]:
            break
        after = written(_stars(gathered_if_small(edges, mark[0])), "links")
        seen, mark = mark, _mark(after)
        discard(edges)
        edges = after
        if seen == mark:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
