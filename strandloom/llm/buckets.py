"""Bucketed comparison without unbounded buckets.

A bucket over `limit` rows is dealt into parts, and every pair of parts becomes a group of its own:
all pairs of the bucket are still compared, once each, but no group exceeds two parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Divided buckets are sent to all tasks only up to this many.
BROADCAST = 10_000


def dealt(rows: DataFrame, key: str, by: str, limit: int) -> DataFrame:
    """rows with columns `part` and `pair` for buckets over the limit, sorted for a streaming pass by (key, pair).

    pair is 0 for an undivided bucket. In a divided one it names two parts; rows of one part are
    compared with each other only in the pair of that part with itself.
    """
    big = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    many = big.count()
    if not many:
        out = rows.withColumns({"part": F.lit(0), "pair": F.lit(0).cast("long")})
        return out.repartition(F.col(key)).sortWithinPartitions(key)
    out = rows.join(F.broadcast(big) if many <= BROADCAST else big, key, "left").withColumn("_s", F.coalesce(F.ceil(F.col("_n") / limit), F.lit(1)).cast("int"))
    out = out.withColumn("part", F.pmod(F.xxhash64(F.col(by), F.lit(7)), F.col("_s")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_s") - 1))
    out = out.withColumn("_o", other).withColumn("pair", F.least("part", "_o").cast("long") * F.col("_s") + F.greatest("part", "_o"))
    out = out.drop("_n", "_s", "_o")
    return out.repartition(F.col(key), F.col("pair")).sortWithinPartitions(key, "pair")
