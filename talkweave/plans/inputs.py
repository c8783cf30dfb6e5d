"""What the registered queries read: the given tables and views that Spark derives from them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.gate import Weights
from ..session import shared_dir, ship
from ..settings import Settings
from ..sources import corpus as C
from ..sources import gate_store
from ..sources import index_store as store
from .layout import read_table, spread

SETTINGS = Settings()


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read_table(spark, sf, "documents"), "doc_id")


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read_table(spark, sf, "conversations"), "conv_id")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The document table as a corpus: 180-word windows; documents labelled low quality are superseded."""
    return C.table_chunks(documents(spark, sf).select("doc_id", "text", "source"), read_table(spark, sf, "labels"))


def windows_only(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, section, section_title, doc_title, text) without sentence units."""
    return documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").cast("string").alias("doc_title"),
        F.explode_outer(T.windows("text", SETTINGS.window_words)).alias("w")).filter(F.col("w").isNotNull()).select(
        "doc_id", "doc_title", F.col("w.section").cast("string").alias("section"), "w.section_title", "w.text",
        F.concat("doc_id", F.lit("§"), F.col("w.section")).alias("chunk_id"))


def tokenised(spark: SparkSession, sf: str) -> DataFrame:
    return windows_only(spark, sf).select("chunk_id", "doc_id", "text", T.content_tokens(C.INDEX_TEXT).alias("tokens"))


def index(spark: SparkSession, sf: str) -> store.Index:
    """The stored index of the document table, built when this corpus has none yet."""
    ship(spark)
    return store.load_or_build(spark, chunks(spark, sf), fingerprint(spark, sf), shared_dir(spark), SETTINGS, chunked_ids(spark, sf))


def chunked_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that have a chunk: those with a word."""
    return read_table(spark, sf, "documents").filter(F.expr(T.has_words_sql("text"))).select(F.col("doc_id").cast("string").alias("doc_id"))


def fingerprint(spark: SparkSession, sf: str) -> str:
    """Of the tables that the index depends on; labels decide the status."""
    return "-".join(store.source_fingerprint(read_table(spark, sf, t), SETTINGS) for t in ("documents", "labels"))


def gate_weights(spark: SparkSession, sf: str) -> Weights:
    """The fitted gate stored for the document table, fitted when it has none yet."""
    return gate_store.load_or_train(spark, index(spark, sf), fingerprint(spark, sf), shared_dir(spark), SETTINGS.embed_dim)


def benchmark_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark passage as a query; its first sentence is the alternative reading."""
    return read_table(spark, sf, "benchmark").select(
        F.col("item_id").alias("qid"), "text", F.lit(None).cast("array<string>").alias("keywords"),
        F.regexp_extract("text", r"^([^.]*)\.", 1).alias("alt"))
