"""Cleans ``documents`` and encodes what is left: five stages, each written as Parquet and read again by the next.

Every stage but the last returns the columns of its input.  A stage sees only what its predecessor kept.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.llm import decontaminate, linededup, quality, sentencepiece, simhash
from talkweave.llm.common import stage, table
from talkweave.llm.queries import PIECE_MODEL, tokenizer
from talkweave.plans.layout import broadcast_if_small
from talkweave.session import ship

ORACLE_SQL = None        # fingerprints, the classifier and the piece fold can't be stated in SQL


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    ship(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut out of the texts; ``n_chars`` follows."""
    ship(spark)
    cut = linededup.dedup_lines(docs).select("row.*")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    ship(spark)
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    ship(spark)
    key = F.xxhash64("doc_id", "text")
    found = decontaminate.decontaminate(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = stage(found.filter("contaminated").select(F.col("doc_id").alias("key")).distinct(), "contaminated")
    bad = broadcast_if_small(bad, 16 * bad.count())
    return docs.withColumn("key of this stage", key).join(bad, F.col("key of this stage") == bad["key"], "left_anti").drop("key of this stage")


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the text, and the text decoded from them."""
    ship(spark)
    path = tokenizer(PIECE_MODEL)
    ids = sentencepiece.encode(docs.select("doc_id", "text"), path)
    return ids.withColumn("text", sentencepiece.decoded(F.col("ids"), path))


STAGES = [("quality classifier", quality_classifier), ("line dedup", line_dedup), ("SimHash near-dedup", simhash_dedup),
          ("benchmark decontamination", benchmark_decontamination), ("SentencePiece encoding and decoding", sentencepiece_encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, "pipeline")
    return docs
