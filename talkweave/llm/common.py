"""Small helpers that the operators of this folder share."""
from __future__ import annotations

import uuid

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir, ship

ASCII_SPACE = b" \t\n\x0b\x0c\r"


# Texts can be long: batches that go to Python are bounded by rows and by bytes, unless the session says otherwise.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", str(8 << 20))}


def bounded_batches(spark: SparkSession) -> None:
    for name, (usual, small) in BATCHES.items():
        if spark.conf.get(name, usual) == usual:
            spark.conf.set(name, small)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    bounded_batches(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stage(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Writes an intermediate table to the folder that all executors share and reads it back.

    It cuts lineage and fixes what tasks made (block numbers), so lost executors re-read the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage/{name}-{uuid.uuid4().hex[:12]}"
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join whose sides are both dealt by key.

    Spark sizes rows that an ``explode`` makes, and rows of well compressed files, by the bytes of the table before; what it takes for
    a small side may be many times the memory of the driver that would collect and broadcast it.
    """
    return df.hint("merge")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack(a: np.ndarray) -> bytes:
    """An integer array as compressed bytes, byte planes apart (small numbers leave the high planes empty)."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else np.zeros((a.dtype.itemsize, 0), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(a.dtype.char.encode() + np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(b)
    kind = np.dtype(raw[:1].decode())
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)
