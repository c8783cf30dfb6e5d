"""Helpers about data layout: spreading small scans, size checks, counters over hot keys."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PART_BYTES = 8 << 20     # of the files as stored


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a scan of fewer files than cores one partition per core, and more where the files are large.

    With as many files as cores or more (any large input) the scan is left as it is and nothing
    is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    stored = df.select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.sum("file_size").alias("b")).first()["b"] or 0
    return df.repartition(max(cores, -(-stored // PART_BYTES)), *keys)


def byte_size(df: DataFrame, *text_columns: str) -> int:
    """Measured bytes of the given columns plus a fixed charge per row."""
    parts = [F.coalesce(F.octet_length(F.col(c).cast("string")).cast("long"), F.lit(0)) for c in text_columns]
    total = F.lit(32).cast("long")
    for p in parts:
        total = total + p
    return df.agg(F.coalesce(F.sum(total), F.lit(0)).alias("b")).first()["b"]


def broadcast_if_small(df: DataFrame, measured: int, limit: int = 64 << 20) -> DataFrame:
    """Broadcast hint behind a measured size; beyond it Spark plans a shuffled join."""
    return F.broadcast(df) if measured <= limit else df


def blocked_position(df: DataFrame, key: str, order: str, out: str, keep: Column | None = None,
                     block: int = 4096) -> DataFrame:
    """1-based position of each row within ``key`` by an integer ``order`` column.

    Every key is cut into blocks of ``order`` values: rows are numbered inside a block, then
    shifted by the running total of the earlier blocks.  A key holding a large share of the
    table is thus numbered by many tasks; only one row per block meets the others.
    ``keep`` restricts what is counted (rows that fail it get the position of the last counted one).
    """
    counted = (F.lit(1) if keep is None else F.when(keep, 1).otherwise(0)).cast("long")
    blocked = (df.withColumn("_b", F.floor(F.col(order) / F.lit(block)).cast("long"))
                 .withColumn("_one", counted))
    inside = Window.partitionBy(key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (blocked.groupBy(key, "_b").agg(F.sum("_one").alias("_n"))
                      .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
                      .drop("_n"))
    return (blocked.withColumn("_in", F.sum("_one").over(inside))
                   .join(offsets, [key, "_b"])
                   .withColumn(out, F.col("_in") + F.col("_before"))
                   .drop("_b", "_one", "_in", "_before"))


def top_per_key(df: DataFrame, key: str | list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows per key; Spark cuts each partition to k rows before the shuffle."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
