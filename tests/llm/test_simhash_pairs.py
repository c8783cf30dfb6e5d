"""The pipeline's near-dedup takes the SimHash links as candidates."""
from pyspark.sql import functions as F

from talkweave.llm import simhash


def test_simhash_links_join_without_any_band(spark):
    base = [" ".join(f"t{i}w{k}" for k in range(400)) for i in range(6)]
    texts = base + [f"{t} end" for t in base]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signed = d.select("doc_id", F.xxhash64("text").alias("th"), simhash.signed_of(F.col("text"), 22).alias("s")).select("doc_id", "th", "s.*")
    near = {i for i in range(6) if bin((simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[i + 6])) & (1 << 64) - 1).count("1") <= 2}
    assert len(near) > 2
    blind = signed.withColumn("bands", F.array().cast("array<bigint>"))                  # no minimum hashes at all
    got = {r["component_id"] for r in simhash.similar_groups(blind, d.select(F.xxhash64("text").alias("th"), "text")).collect()}
    assert got == {*range(6), *(i + 6 for i in range(6) if i not in near)}


def test_simhash_links_are_checked_on_the_sets(spark):
    """Repeats outweigh the rest in a fingerprint: equal prints, unlike sets."""
    texts = ["a b c " * 60 + " ".join(f"{x}{k}" for k in range(30)) for x in "pq"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert bin((simhash.fingerprint(texts[0]) ^ simhash.fingerprint(texts[1])) & (1 << 64) - 1).count("1") <= 2
    assert simhash.keep_one(d).count() == 2
