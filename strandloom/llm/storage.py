"""Lineage cuts in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Ids are below this; what has none gets a number from here on, from a hash of what it holds.
NAMELESS = 1 << 62


#: Folders that this process has written and not deleted.
_KEPT: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where that is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def nameless(content: str) -> Column:
    """A stand-in id above all ids for rows that have none."""
    return F.lit(NAMELESS) + F.shiftrightunsigned(F.xxhash64(content), 3)


def narrow(df: DataFrame) -> DataFrame:
    """df in an eighth of the shuffle partitions, for sums far smaller than what they sum: fewer, larger files."""
    return df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Later stages then neither recompute it nor depend on shuffle files of executors that may be lost.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _KEPT.add(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gathered_if_small(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """df in one partition where it holds no more than `limit` rows: its joins and sums then need no shuffle."""
    return df.coalesce(1) if rows <= limit else df


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _KEPT.discard(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table made by written(), once nothing reads it any more."""
    held = {p.rsplit("/", 1)[-1]: p for p in _KEPT}
    for name in {f.rsplit("/", 2)[-2] for f in df.inputFiles()}:
        if name in held:
            _delete(df.sparkSession, held[name])


def clear(spark: SparkSession) -> None:
    """Delete every table that this process has written; results that are still to be computed from them are lost."""
    for path in sorted(_KEPT):
        _delete(spark, path)
