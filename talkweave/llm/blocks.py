"""Documents as blocks of dictionary codes: what many documents share is looked up once per block instead of once per word.

``write`` reads documents where they lie and cuts them into blocks of bounded size.  A block lists its distinct units (words,
say) and holds its documents as positions in that list.  The units travel to the buckets of their hash, where each
distinct one is handled once per shard of ``SHARD`` blocks; answers travel back as one row per block and bucket, and
``join`` hands a block its answers.  Texts are not shuffled: the blocks are a table that is already bucketed by block.

No row grows with the corpus: a block is bounded by ``BLOCK_UNITS`` (or one document, if that is longer), a group of a bucket by the
units that ``SHARD`` blocks have in it.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import pack, partitions, unpack

BLOCK_UNITS = 1_500_000
BUCKETS = 4                # for each shuffle partition: small groups need little memory
SHARD = 512
BLOCKS = ("block long, ids array<long>, flags array<boolean>, n array<int>, codes binary, place binary, "
          "packs array<struct<bucket:int,units:binary>>")
_ARROW = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("flags", pa.list_(pa.bool_())), ("n", pa.list_(pa.int32())), ("codes", pa.binary()),
                    ("place", pa.binary()), ("packs", pa.list_(pa.struct([("bucket", pa.int32()), ("units", pa.binary())])))])


def pack_units(units: list[bytes]) -> bytes:
    size = np.fromiter(map(len, units), np.uint32, len(units))
    return zstandard.ZstdCompressor(level=3).compress(np.uint32(len(units)).tobytes() + size.tobytes() + b"".join(units))


def unpack_units(b: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(b)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    end = np.cumsum(np.frombuffer(raw, np.uint32, n, offset=4), dtype=np.int64) + 4 + 4 * n
    return [raw[a:b] for a, b in zip([4 + 4 * n, *end[:-1].tolist()], end.tolist())] if n else []


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs with the places where it does, in order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for at in np.split(order, cuts) if len(order) else []:
        yield int(bucket[at[0]]), at


def scatter(place: np.ndarray, answers: dict[int, np.ndarray], kind) -> np.ndarray:
    """The answers of all buckets in the order of the block's units."""
    out = np.zeros(len(place), kind)
    for b, at in by_bucket(place):
        out[at] = answers[b]
    return out


def _row(block: int, seen: dict, codes: list, ids: list, flags: list, n: list, buckets: int) -> pa.RecordBatch:
    units = [u.encode("utf-8", "surrogatepass") if isinstance(u, str) else u for u in seen]
    place = np.fromiter((xxhash.xxh64_intdigest(u) % buckets for u in units), np.uint16 if buckets <= 1 << 16 else np.uint32, len(units))
    packs = [{"bucket": b, "units": pack_units([units[i] for i in at])} for b, at in by_bucket(place)]
    return pa.RecordBatch.from_pylist([{"block": block, "ids": ids, "flags": flags, "n": n, "codes": pack(np.concatenate(codes)), "place": pack(place),
                                        "packs": packs}], _ARROW)


def _cut(split: Callable, buckets: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, have = TaskContext.get().partitionId() << 24, 0
        seen, codes, ids, flags, n = {}, [], [], [], []
        for b in batches:
            for doc, flag, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                u = split(text.as_py() or "")
                codes.append(np.fromiter((seen.setdefault(x, len(seen)) for x in u), np.uint32, len(u)))
                ids.append(doc)
                flags.append(flag)
                n.append(len(u))
                have += len(u)
                if have >= most:
                    yield _row(block, seen, codes, ids, flags, n, buckets)
                    block, have = block + 1, 0
                    seen, codes, ids, flags, n = {}, [], [], [], []
        if ids:
            yield _row(block, seen, codes, ids, flags, n, buckets)
        pa.default_memory_pool().release_unused()        # the worker waits for other stages
    return run


def write(docs: DataFrame, split: Callable[[str], list], most: int = BLOCK_UNITS) -> DataFrame:
    """The blocks of ``docs(doc_id, flag, text)`` as a table bucketed by block, kept in the folder that all executors share."""
    spark = docs.sparkSession
    name = f"blocks_{uuid.uuid4().hex[:12]}"
    (docs.select(F.col("doc_id").cast("long"), "flag", "text").mapInArrow(_cut(split, buckets(spark), most), BLOCKS)
     .write.option("compression", "zstd").bucketBy(partitions(spark), "block").saveAsTable(name, path=f"{shared_dir(spark)}/stage/{name}"))
    return spark.table(name)


def buckets(spark: SparkSession) -> int:
    return BUCKETS * partitions(spark)


def shards(blocks: DataFrame) -> int:
    return max(1, -(-blocks.count() // SHARD))


def packs(blocks: DataFrame) -> DataFrame:
    """(shard, bucket, block, units): the units of all blocks by bucket."""
    return (blocks.select(F.pmod("block", F.lit(shards(blocks))).alias("shard"), "block", F.explode("packs").alias("p"))
            .select("shard", "p.bucket", "block", "p.units"))


def join(blocks: DataFrame, answers: DataFrame, use: Callable[[dict, list[dict]], pa.Table], schema: str) -> DataFrame:
    """Calls ``use(block row, its answer rows)`` for each block of ``blocks``; ``answers(block, bucket, ...)``."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return use(left.to_pylist()[0], right.to_pylist())
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def pieces_of(rows: dict) -> tuple[np.ndarray, np.ndarray]:
    return unpack(rows["codes"]), unpack(rows["place"])
