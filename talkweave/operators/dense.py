"""Dense retrieval: the hashing embedder and exact top-k by cosine."""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.layout import byte_size, top_per_key
from .topk import prune, result_schema, scan_topk, score_rows, to_batch

BROADCAST_BYTES = 64 << 20
CELL_ROWS = 1 << 16


# ------------------------------------------------------------------ embedder (stand-in for a model)
def signed_bucket(term: str, dim: int) -> int:
    """Hash bucket 1..dim of a term, negative for half of the terms."""
    h = int.from_bytes(hashlib.md5(term.encode()).digest()[:2], "big")
    return (h % dim + 1) * (1 if h // dim % 2 == 0 else -1)


def embed_tokens(tokens, dim: int) -> Column:
    """Hashed term counts, array<float>; whole numbers, so exact.  Similarity divides by the norms.

    A neural encoder takes its place as any function from a text column to array<float>.
    """
    @F.arrow_udf("array<float>")
    def accumulate(tokens: pa.Array) -> pa.Array:
        return _vectors(tokens, dim)

    return accumulate(T._c(tokens))


def _vectors(tokens: pa.Array, dim: int) -> pa.ListArray:
    n = len(tokens)
    words = tokens.flatten().dictionary_encode()                # a term is hashed once a batch
    bucket = np.fromiter((signed_bucket(w, dim) for w in words.dictionary.to_pylist()), np.int64, len(words.dictionary))
    flat = bucket[words.indices.to_numpy()]
    row = np.repeat(np.arange(n), np.diff(tokens.offsets.to_numpy()))
    out = np.bincount(row * dim + np.abs(flat) - 1, weights=np.sign(flat), minlength=n * dim)
    offsets = pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(out.astype(np.float32)))


def tokens_and_vector(x: str, dim: int) -> Column:
    """struct<tokens, vec>: ``content_tokens`` and ``embed_tokens`` of a text in one pass over whole tables."""
    @F.arrow_udf("struct<tokens: array<string>, vec: array<float>>")
    def both(texts: pa.Array) -> pa.Array:
        tokens = T.content_lists(texts)
        return pa.StructArray.from_arrays([tokens, _vectors(tokens, dim)], ["tokens", "vec"])

    return both(F.expr(x))


def cosine(a, b) -> Column:
    """Cosine of two array<float> columns (for the few rows that survived the cuts)."""
    a, b = T._c(a), T._c(b)

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
                           F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


# ------------------------------------------------------------------ exact top-k
def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))
    norm = np.linalg.norm(m, axis=1, keepdims=True) if len(col) else m
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int, *, qkey: str = "qkey", ckey: str = "chunk_id",
               vec: str = "vec", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Exact k best corpus rows per query by cosine (6 decimals, ties by id): (qkey, ckey, score, rank).

    Only a partition's own best k per query ever leave it.  A query block whose measured size fits is
    broadcast and the corpus is read in place.  A larger one is cut, like the corpus, into hashed
    cells, and every pair of cells is scored by one task of bounded size.
    """
    ddl, schema = result_schema(queries, corpus, qkey, ckey)
    queries = queries.filter(F.exists(vec, lambda x: x != 0))     # a zero vector ranks nothing
    stats = queries.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size(vec)), F.lit(0)).alias("d")).first()
    size = byte_size(queries.select(qkey), qkey) + stats["n"] * stats["d"] * 8
    corpus = corpus.select(ckey, vec)
    if size <= broadcast_bytes:
        table = queries.select(qkey, vec).toArrow()            # bounded by the check above
        shared = corpus.sparkSession.sparkContext.broadcast((table.column(qkey).to_numpy(), _matrix(table.column(vec))))
        return scan_topk(corpus, shared, _scorer, k, ddl, schema)
    local = _grid(queries.select(qkey, vec), corpus, k, qkey, ckey, vec, ddl, schema, size, broadcast_bytes)
    return top_per_key(local, qkey, [F.desc("score"), F.asc(ckey)], k)


def _scorer(value):
    keys, q = value

    def batch(b: pa.RecordBatch):
        c = _matrix(b.column(1))
        return b.column(0).to_numpy(zero_copy_only=False), lambda part: q[part] @ c.T

    return keys, batch


def _grid(queries, corpus, k, qkey, ckey, vec, ddl, schema, size, limit) -> DataFrame:
    n_q = max(1, math.ceil(size / limit))
    n_c = max(1, math.ceil(corpus.count() / CELL_ROWS))
    q = (queries.withColumn("_q", F.pmod(F.xxhash64(qkey), F.lit(n_q)).cast("int"))
         .withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1)))))
    c = (corpus.withColumn("_c", F.pmod(F.xxhash64(ckey), F.lit(n_c)).cast("int"))
         .withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return schema.empty_table()
        keys, m, r = left.column(qkey).to_numpy(), _matrix(left.column(vec)), _matrix(right.column(vec))
        best = prune(score_rows(right.column(ckey).to_numpy(), lambda part: m[part] @ r.T, len(keys), k, None), k)
        return pa.Table.from_batches([to_batch(keys, best, schema)])

    return q.groupBy("_q", "_c").cogroup(c.groupBy("_q", "_c")).applyInArrow(cell, ddl)
