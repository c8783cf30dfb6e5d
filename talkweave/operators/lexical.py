"""Lexical index tables and Okapi BM25 as joins and aggregations."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.layout import top_per_key
from .topk import QUERY_SLICE, result_schema, scan_topk


def token_table(chunks: DataFrame) -> DataFrame:
    """(chunk_id, dl, term): one row per content token; ``chunks`` carries ``tokens``."""
    return chunks.select("chunk_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))


def _repeated(chunks: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Chunks whose id no other row has, and the rest (None: there are none)."""
    ids = chunks.groupBy(F.col("chunk_id").alias("_id")).agg(F.count("*").alias("n")).filter("n > 1").select("_id")
    if ids.isEmpty():
        return chunks, None
    same = F.col("chunk_id").eqNullSafe(F.col("_id"))
    return chunks.join(ids, same, "left_anti"), chunks.join(ids, same, "left_semi")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tokens = b.column(1)
        dl = np.diff(tokens.offsets.to_numpy())
        words = tokens.flatten().dictionary_encode()
        owner = np.repeat(np.arange(len(tokens)), dl)
        key, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(tokens) + owner, return_counts=True)
        at = pa.array(key % len(tokens)) if len(tokens) else pa.array([], pa.int64())
        yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(key // max(1, len(tokens)))), b.column(0).take(at), pa.array(tf.astype(np.int32)),
                                          pa.array(dl[at.to_numpy()].astype(np.int32))], ["term", "chunk_id", "tf", "dl"])


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, tf, dl), counted where a chunk lies: its tokens are one row, so nothing is shuffled unless ids repeat."""
    ddl = "term string, chunk_id string, tf int, dl int"
    alone, shared = _repeated(chunks.select("chunk_id", "tokens"))
    out = alone.mapInArrow(_counted, ddl)
    if shared is None:
        return out
    return out.unionByName(shared.mapInArrow(_counted, ddl).groupBy("term", "chunk_id").agg(
        F.sum("tf").cast("int").alias("tf"), F.first("dl").alias("dl")))


def terms_of(chunks: DataFrame) -> DataFrame:
    """(chunk_id, term): the distinct terms of every chunk."""
    alone, shared = _repeated(chunks.select("chunk_id", "tokens"))
    def rows(c: DataFrame) -> DataFrame:
        return c.select("chunk_id", F.explode(F.array_distinct("tokens")).alias("term"))
    return rows(alone) if shared is None else rows(alone).unionByName(rows(shared).distinct())


def corpus_size(chunks: DataFrame) -> DataFrame:
    """One row: number of chunks and mean length."""
    return chunks.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_table(posting_rows: DataFrame, n_chunks: int) -> DataFrame:
    """(term, df, idf): document frequencies are counted map-side, so hot terms shuffle as one row per task."""
    return (posting_rows.groupBy("term").agg(F.count("*").alias("df"))
            .withColumn("idf", idf(F.lit(n_chunks), F.col("df"))))


def with_salience(terms: DataFrame) -> DataFrame:
    top = terms.agg(F.max("idf").alias("max_idf")).first()["max_idf"] or 1.0
    return terms.withColumn("salience", F.col("idf") / F.lit(float(top)))


CAPITALISED = r"(?<=[a-z,] )([A-Z][a-zA-Z]{2,})(?![\p{L}\p{N}_])"


def proper_terms(chunks: DataFrame) -> DataFrame:
    """Stems of words that are capitalised inside running text and never occur in another form."""
    capital = (chunks.select(F.explode(F.regexp_extract_all("text", F.lit(CAPITALISED), F.lit(1))).alias("w"))
               .groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("capital_n")))
    every = T.word_counts(chunks, "text").withColumnRenamed("n", "all_n")
    kept = (capital.filter(~T.is_stopword("word")).hint("merge").join(every, "word", "left")
            .filter(F.coalesce("all_n", F.lit(0)) <= F.col("capital_n")))
    return kept.select(T.stem("word").alias("term")).distinct()


def bm25_scores(query_terms: DataFrame, posting_rows: DataFrame, avgdl: float,
                k1: float = 1.4, b: float = 0.75) -> DataFrame:
    """``query_terms(qkey, term, idf)`` x postings -> (qkey, chunk_id, score > 0).

    The query side carries the idf, so the postings meet exactly one join.
    """
    norm = k1 * (1 - b + b * F.col("dl") / F.lit(avgdl))
    gain = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
    return (posting_rows.join(query_terms, "term").withColumn("gain", gain)
            .groupBy("qkey", "chunk_id").agg(F.round(F.sum("gain"), 6).alias("score"))
            .filter(F.col("score") > 0))


def bm25_topk(query_terms: DataFrame, posting_rows: DataFrame, avgdl: float, k: int, k1: float = 1.4,
              b: float = 0.75) -> DataFrame:
    """Top-k from the posting table: a join and a sum, for query blocks of any size."""
    scored = bm25_scores(query_terms, posting_rows, avgdl, k1, b)
    return top_per_key(scored, "qkey", [F.desc("score"), F.asc("chunk_id")], k)


def _query_block(query_terms: DataFrame):
    """Broadcast of a small block: query keys, the terms they hold with their idf, and each query's places among the terms."""
    table = query_terms.groupBy("qkey").agg(F.collect_list(F.struct("term", "idf")).alias("t")).toArrow()
    lists = table.column("t").combine_chunks()
    flat = lists.flatten()
    encoded = flat.field("term").dictionary_encode() if len(flat) else pa.array([], pa.string()).dictionary_encode()
    index = encoded.indices.to_numpy()
    weights = np.zeros(len(encoded.dictionary))
    weights[index] = flat.field("idf").to_numpy() if len(flat) else 0.0
    keys = table.column("qkey").combine_chunks()
    bounds = lists.offsets.to_numpy() if len(keys) else np.zeros(1, dtype=int)
    return query_terms.sparkSession.sparkContext.broadcast((keys, encoded.dictionary, weights, index, bounds))


def _batch_scores(value, avgdl: float, k1: float, b: float):
    """Function of a batch's token lists -> function of a query slice -> scores[slice, rows]."""
    _, vocabulary, weights, index, bounds = value

    def batch(tokens: pa.Array):
        n, dl = len(tokens), np.diff(tokens.offsets.to_numpy())
        found = pc.fill_null(pc.index_in(tokens.flatten(), value_set=vocabulary), -1).to_numpy()
        owner = np.repeat(np.arange(n), dl)
        hit = found >= 0
        pair, tf = np.unique(found[hit].astype(np.int64) * n + owner[hit], return_counts=True)
        term, row = pair // n, pair % n
        gain = weights[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / avgdl))
        start = np.searchsorted(term, np.arange(len(vocabulary) + 1))

        def score(part: slice) -> np.ndarray:
            out = np.zeros((part.stop - part.start, n))
            for i, q in enumerate(range(part.start, part.stop)):
                for t in index[bounds[q]:bounds[q + 1]]:
                    span = slice(start[t], start[t + 1])
                    out[i, row[span]] += gain[span]       # a chunk occurs once per term
            return out

        return score

    return batch


def _totals(scores: DataFrame) -> DataFrame:
    return scores.groupBy("qkey").agg(F.count("*").alias("chunks"), F.max("score").alias("best"), F.sum("score").alias("total"))


def bm25_totals(query_terms: DataFrame, chunks: DataFrame, avgdl: float, k1: float = 1.4, b: float = 0.75) -> DataFrame:
    """(qkey, chunks, best, total) of all positive scores of a small (measured) query block.

    A chunk's scores are complete inside its row, so a task leaves one row per query; as a join, every query would shuffle a
    row for each chunk that shares a term with it.  Only rows of repeated chunk ids meet by their postings.
    """
    alone, shared = _repeated(chunks.select("chunk_id", "tokens"))
    block = _query_block(query_terms)
    key = query_terms.schema["qkey"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = block.value[0]
        score = _batch_scores(block.value, avgdl, k1, b)
        n, best, total = np.zeros(len(keys), np.int64), np.zeros(len(keys)), np.zeros(len(keys))
        for rows in batches:
            if rows.num_rows == 0:
                continue
            of = score(rows.column(1))
            for start in range(0, len(keys), QUERY_SLICE):
                part = slice(start, min(start + QUERY_SLICE, len(keys)))
                s = np.round(of(part), 6)
                n[part] += (s > 0).sum(axis=1)
                best[part] = np.maximum(best[part], s.max(axis=1))
                total[part] += s.sum(axis=1)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(met)), pa.array(n[met]), pa.array(best[met]), pa.array(total[met])],
                                         ["qkey", "chunks", "best", "total"])

    every = alone.mapInArrow(scan, f"qkey {key}, chunks long, best double, total double")
    if shared is not None:
        every = every.unionByName(_totals(bm25_scores(query_terms, postings(shared), avgdl, k1, b)))
    return every.groupBy("qkey").agg(F.sum("chunks").alias("chunks"), F.max("best").alias("best"), F.sum("total").alias("total"))


def bm25_topk_scan(query_terms: DataFrame, chunks: DataFrame, avgdl: float, k: int, k1: float = 1.4,
                   b: float = 0.75) -> DataFrame:
    """The same result for a small (measured) query block, read from the chunk rows.

    A chunk's score is complete inside one row, so every task keeps only its own k best per query;
    the join above would shuffle a row for every chunk that shares any term with any query.
    """
    ddl, schema = result_schema(query_terms, chunks, "qkey", "chunk_id")
    shared = _query_block(query_terms)

    def scorer(value):
        score = _batch_scores(value, avgdl, k1, b)
        return value[0].to_numpy(zero_copy_only=False), lambda rows: (rows.column(0).to_numpy(zero_copy_only=False), score(rows.column(1)))

    return scan_topk(chunks.select("chunk_id", "tokens"), shared, scorer, k, ddl, schema, floor=0.0)
