"""Rank fusion: two retrievers, query variants, and whole queries."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.layout import top_per_key


def rrf(bm25: DataFrame | None, dense: DataFrame | None, rrf_k: int = 60, keys=("qkey", "variant")) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (full-outer semantics by union and group)."""
    keys = list(keys)
    null = F.lit(None).cast("int")
    parts = []
    if bm25 is not None:
        parts.append(bm25.select(*keys, "chunk_id", F.col("rank").alias("bm25_rank"), null.alias("dense_rank")))
    if dense is not None:
        parts.append(dense.select(*keys, "chunk_id", null.alias("bm25_rank"), F.col("rank").alias("dense_rank")))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    fused = both.groupBy(*keys, "chunk_id").agg(F.max("bm25_rank").alias("bm25_rank"),
                                                F.max("dense_rank").alias("dense_rank"))
    def share(c):
        return F.coalesce(F.lit(1.0) / (F.lit(rrf_k) + F.col(c)), F.lit(0.0))
    return fused.withColumn("rrf", share("bm25_rank") + share("dense_rank"))


def best_variant(fused: DataFrame) -> DataFrame:
    """Per query and chunk keep the whole row of the variant with the larger score; the first variant on ties."""
    row = F.struct("rrf", (-F.col("variant")).alias("first"), "bm25_rank", "dense_rank")
    best = fused.groupBy("qkey", "chunk_id").agg(F.max(row).alias("b"))
    return best.select("qkey", "chunk_id", "b.rrf", "b.bm25_rank", "b.dense_rank")


def candidates(pool: DataFrame, k: int) -> DataFrame:
    return top_per_key(pool, "qkey", [F.desc("rrf"), F.asc("chunk_id")], k, "pool_rank")


def across_queries(hits: DataFrame, group: str, rrf_k: int = 60, per_query: int = 4) -> DataFrame:
    """Fuse the hit lists of one turn's sub-queries: a chunk is kept once, owned by its best query."""
    top = hits.filter(F.col("rank") <= per_query)
    owner = F.max(F.struct("score", (-F.col("rank")).alias("r"), "qkey")).alias("o")
    fused = (top.groupBy(group, "chunk_id")
             .agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 9).alias("fused"), F.count("*").alias("queries"), owner)
             .select(group, "chunk_id", "fused", "queries", F.col("o.qkey").alias("owner"),
                     F.col("o.score").alias("owner_score")))
    return fused
