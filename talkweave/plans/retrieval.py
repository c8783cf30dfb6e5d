"""The retrieval plan: all queries of a workload in one set of joins."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fusion, lexical
from ..operators.dense import dense_topk, embed_tokens
from ..operators.rerank import Scorer, lexical_scorer, rerank, score_sentences, without_rerank
from ..settings import Settings
from ..sources.index_store import Index
from .layout import byte_size

SMALL_QUERY_BYTES = 8 << 20


@dataclass(frozen=True)
class QueryBlock:
    """Distinct queries with their two readings, and the way back to the callers' ids."""
    owners: DataFrame      # qid -> qkey
    readings: DataFrame    # qkey, variant (0 text, 1 alternative), q_tokens, kw (tokens), q_vec
    small: bool


def query_block(queries: DataFrame, settings: Settings, *, double_stem: bool = False) -> QueryBlock:
    """``queries(qid, text, keywords array|null, alt|null)``.

    Equal queries are searched once (the set-at-a-time form of a result cache).  Keywords are
    token arrays and are stemmed once; ``double_stem`` stems them again for comparison runs.
    """
    def norm(c):
        return F.lower(T.squeeze_ends(f"coalesce({c}, '')"))
    q = queries.select(
        "qid", "text", F.coalesce("alt", F.lit("")).alias("alt"),
        F.coalesce(F.col("keywords"), T.content_tokens("text")).alias("kw")).withColumn(
        "qkey", F.md5(F.concat_ws("\x01", norm("text"), F.array_join("kw", " "), norm("alt"))))
    small = byte_size(queries, "text", "alt") <= SMALL_QUERY_BYTES
    distinct = q.select("qkey", "text", "alt", "kw").dropDuplicates(["qkey"])
    main = distinct.select("qkey", F.lit(0).alias("variant"), F.col("text").alias("v"), "kw")
    other = distinct.filter(F.col("alt") != "").select(
        "qkey", F.lit(1).alias("variant"), F.col("alt").alias("v"), T.content_tokens("alt").alias("kw"))
    readings = main.unionByName(other).withColumn("q_tokens", T.content_tokens("v")).withColumn(
        "q_vec", embed_tokens("q_tokens", settings.embed_dim)).drop("v")
    if double_stem:
        readings = readings.withColumn("kw", F.when(F.col("variant") == 0, F.expr(f"transform(kw, t -> {T.stem_sql('t')})"))
                                       .otherwise(F.col("kw")))
    if small:
        readings = readings.persist()          # read by every stage below, at most a few megabytes
    return QueryBlock(q.select("qid", "qkey"), readings, small)


def _reading_key():
    return F.concat_ws("/", "qkey", "variant")


def bm25_lists(block: QueryBlock, index: Index, s: Settings) -> DataFrame:
    terms = block.readings.select(_reading_key().alias("qkey"), F.explode(F.array_distinct("kw")).alias("term"))
    known = index.terms.select("term", "idf").filter(F.col("idf").isNotNull()).join(
        F.broadcast(terms) if block.small else terms, "term")
    if block.small:
        return lexical.bm25_topk_scan(known, index.chunks, index.avgdl, s.first_stage_n, s.bm25_k1, s.bm25_b)
    return lexical.bm25_topk(known, index.postings, index.avgdl, s.first_stage_n, s.bm25_k1, s.bm25_b)


def dense_lists(block: QueryBlock, index: Index, s: Settings) -> DataFrame:
    q = block.readings.select(_reading_key().alias("qkey"), F.col("q_vec").alias("vec"))
    return dense_topk(q, index.chunks, s.first_stage_n)


def _split_key(df: DataFrame) -> DataFrame:
    return df.withColumn("variant", F.substring_index("qkey", "/", -1).cast("int")).withColumn(
        "qkey", F.substring_index("qkey", "/", 1))


def pool(block: QueryBlock, index: Index, s: Settings) -> DataFrame:
    """First-stage pool per query: both retrievers fused, the better reading of a query kept."""
    bm25 = _split_key(bm25_lists(block, index, s)) if s.retrieval_mode in ("hybrid", "bm25") else None
    dense = _split_key(dense_lists(block, index, s)) if s.retrieval_mode in ("hybrid", "dense") else None
    return fusion.best_variant(fusion.rrf(bm25, dense, s.rrf_k))


def retrieve(block: QueryBlock, index: Index, s: Settings, scorer: Scorer = lexical_scorer) -> DataFrame:
    """Ranked hits per distinct query: (qkey, chunk_id, label, score, rrf, bm25_rank, dense_rank, rank, pairs)."""
    cands = fusion.candidates(pool(block, index, s), s.rerank_candidates)
    if not s.rerank:
        return without_rerank(cands, index.chunks, penalty=s.superseded_penalty, keep=s.hits_kept, small=block.small)
    return rerank(cands, block.readings.select("qkey", "variant", "q_tokens", "q_vec"), index.chunks, scorer=scorer,
                  hedge=s.hedge_candidates, penalty=s.superseded_penalty, keep=s.hits_kept, small=block.small)


def sentence_scores(hits: DataFrame, block: QueryBlock, index: Index, s: Settings,
                    scorer: Scorer = lexical_scorer) -> DataFrame:
    """Sentence scores of the best hits; ``hits`` is read twice and should be a staged table."""
    free = block.readings.groupBy("qkey").agg(F.max_by(F.struct("q_tokens", "q_vec"), "variant").alias("r")).select(
        "qkey", F.col("r.q_tokens").alias("s_tokens"), F.col("r.q_vec").alias("s_vec"))
    sentences = index.sentences_of(hits.filter(F.col("rank") <= s.sentence_chunks)) if block.small else index.sentences
    return score_sentences(hits, free, sentences, scorer=scorer, chunks_used=s.sentence_chunks,
                           per_chunk=s.sentences_per_chunk, small=block.small)


def per_owner(hits: DataFrame, block: QueryBlock) -> DataFrame:
    """Hits of the distinct queries handed back to every caller that asked."""
    return block.owners.join(hits, "qkey").drop("qkey")


def baseline(block: QueryBlock, index: Index, k: int = 5) -> DataFrame:
    """Turn-based baseline: whole utterance, dense only, five hits, score scaled by ten."""
    q = block.readings.filter("variant = 0").select("qkey", F.col("q_vec").alias("vec"))
    hits = dense_topk(q, index.chunks, k)
    side = F.broadcast(hits) if block.small else hits
    return index.chunks.select("chunk_id", "label").join(side, "chunk_id").select(
        "qkey", "chunk_id", "label", F.round(F.col("score") * 10, 6).alias("score"), F.col("rank").alias("dense_rank"),
        "rank")
