"""Second-stage scoring.  The scorer is pluggable; the default is a lexical stand-in for a cross-encoder."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.layout import top_per_key
from .dense import cosine

# (query tokens, query vector, passage tokens, passage vector) -> logit
Scorer = Callable[[str, str, str, str], Column]


def lexical_scorer(q_tokens: str, q_vec: str, d_tokens: str, d_vec: str) -> Column:
    """Share of query terms present and cosine, scaled to the range of a cross-encoder logit (-6 .. 6)."""
    q = F.array_distinct(q_tokens)
    cover = F.when(F.size(q) > 0, F.size(F.array_intersect(q, F.col(d_tokens))) / F.size(q)).otherwise(F.lit(0.0))
    return F.round(8 * cover + 4 * cosine(q_vec, d_vec) - 6, 6)


def rerank(cands: DataFrame, variants: DataFrame, chunks: DataFrame, *, scorer: Scorer = lexical_scorer,
           hedge: int = 5, penalty: float = 4.0, keep: int = 8, small: bool = True) -> DataFrame:
    """``cands(qkey, chunk_id, rrf, ..., pool_rank)`` -> the best ``keep`` hits per query.

    The candidate list is queries x 10 rows: while the query block is small it is broadcast and the
    chunk table is read in place, beyond that both sides shuffle on the chunk id.
    The alternative reading of a query is scored for the first ``hedge`` candidates; the better one counts.
    """
    side = F.broadcast(cands) if small else cands
    texts = chunks.select("chunk_id", "label", "demote", F.col("tokens").alias("d_tokens"), F.col("vec").alias("d_vec"))
    pairs = (texts.join(side, "chunk_id")
             .join(F.broadcast(variants) if small else variants, "qkey")
             .filter((F.col("variant") == 0) | (F.col("pool_rank") <= hedge)))
    logit = pairs.withColumn("logit", scorer("q_tokens", "q_vec", "d_tokens", "d_vec"))
    scored = logit.groupBy("qkey", "chunk_id").agg(
        F.max("logit").alias("logit"), F.count("*").alias("pairs"),
        *[F.first(c).alias(c) for c in ("label", "demote", "rrf", "bm25_rank", "dense_rank")])
    scored = scored.withColumn("score", F.round(F.col("logit") - penalty * F.col("demote"), 6))
    return top_per_key(scored.drop("logit"), "qkey", [F.desc("score"), F.asc("chunk_id")], keep)


def without_rerank(cands: DataFrame, chunks: DataFrame, *, penalty: float = 4.0, keep: int = 8,
                   small: bool = True) -> DataFrame:
    side = F.broadcast(cands) if small else cands
    scored = (chunks.select("chunk_id", "label", "demote").join(side, "chunk_id")
              .withColumn("score", F.round(F.col("rrf") * 100 - 0.2 * penalty * F.col("demote"), 6))
              .withColumn("pairs", F.lit(0).cast("long")).drop("pool_rank"))
    return top_per_key(scored, "qkey", [F.desc("score"), F.asc("chunk_id")], keep)


def score_sentences(hits: DataFrame, queries: DataFrame, sentences: DataFrame, *, scorer: Scorer = lexical_scorer,
                    chunks_used: int = 3, per_chunk: int = 8, small: bool = True) -> DataFrame:
    """Scores the first sentences of the best chunks: (qkey, chunk_id, sent_idx, sentence, ce).

    ``queries(qkey, s_tokens, s_vec)`` holds the context-free reading where there is one.
    """
    top = hits.filter(F.col("rank") <= chunks_used).select("qkey", "chunk_id", "rank")
    pairs = (sentences.filter(F.col("sent_idx") < per_chunk)
             .join(F.broadcast(top) if small else top, "chunk_id")
             .join(F.broadcast(queries) if small else queries, "qkey"))
    return pairs.select("qkey", "chunk_id", "rank", "sent_idx", "sentence",
                        scorer("s_tokens", "s_vec", "tokens", "vec").alias("ce"))


def usable(hits: DataFrame, threshold: float = -99.0, keep: int = 4) -> DataFrame:
    """Hits above the floor; superseded ones only where no current one is left; the first ``keep``."""
    good = hits.filter(F.col("score") >= threshold)
    has_current = good.groupBy("qkey").agg(F.max(F.col("status") != "superseded").alias("has_current"))
    kept = (good.join(has_current, "qkey")
            .filter((F.col("status") != "superseded") | ~F.col("has_current")).drop("has_current"))
    return top_per_key(kept, "qkey", [F.desc("score"), F.asc("chunk_id")], keep, "use_rank")
