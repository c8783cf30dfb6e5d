"""Importance resampling towards a target: how much more likely a document's word runs are in the target than in the corpus.

Texts are read as UTF-8 bytes.  One 256-byte table puts A-Z in lower case and blanks the separators, ``bytes.split`` gives the words,
and the bucket of a run of words is its CRC-32, carried on from word to word (``zlib.crc32(b" " + next, crc)``), so a run of n words costs one step
more than the run of n - 1.  ``Counter`` adds up what is equal before anything is hashed.  A task sends one row per bucket, so
what is shuffled does not grow with the texts.  The table of gains has ``buckets`` entries: that bound is what the driver and each
task hold.  A second pass over the texts sums the gains of each document.

The draw is the top of ``score = weight + Gumbel noise``.  Noise comes from the SHA-256 of the seed and the id, so it does not depend on
partitions.  Ranks are counted without bringing rows together: rows are range-partitioned by score, each one's rank is its place in its
partition plus the rows of the partitions before.

Defined cases: a null text has no features (weight 0); a null id counts as the text ``null`` and comes last among ties; repeated rows are
separate documents (ties of equal ids in the order of the rows); an empty target or corpus gives smoothed counts only; other columns,
whatever their names, are left out of the result (join it by id, or use ``drawn``).
"""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10


def _table() -> bytes:
    """Separators are 00-2F, 3A-60 and 7B-7F once A-Z are in lower case; all bytes above belong to words."""
    blank = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
    t = bytearray(range(256))
    for b in blank:
        t[b] = 0x20
    for b in range(0x41, 0x5B):
        t[b] = b + 0x20
    return bytes(t)


TABLE = _table()


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def features(w: list[bytes], runs: int, buckets: int) -> Counter:
    """How often each bucket is hit by the runs of 1 to ``runs`` words."""
    if runs == 1:
        out: Counter = Counter()
        for word, n in Counter(w).items():
            out[zlib.crc32(word) % buckets] += n
        return out
    crcs = [zlib.crc32(x) for x in w]
    out = Counter(crcs)
    for n in range(1, runs):
        crcs = [zlib.crc32(b" " + w[i + n], c) for i, c in enumerate(crcs[:len(w) - n])]
        out.update(crcs)
    folded: Counter = Counter()
    for c, n in out.items():
        folded[c % buckets] += n
    return folded


def _bytes(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column:
        yield x.as_py() or b""


def bucket_counts(texts: DataFrame, runs: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: an array of ``buckets`` numbers, however many texts there are."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for t in _bytes(b.column(0)):
                for k, n in features(words(t), runs, buckets).items():
                    total[k] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])
    out = np.zeros(buckets, np.int64)
    for k, n in texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():      # ``buckets`` rows at most
        out[k] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 ln(smoothed share in the target / smoothed share in the corpus)) of each bucket."""
    n = len(corpus)
    over, under = float(corpus.sum() + n), float(target.sum() + n)
    return [floor(1000 * log((float(t) + 1) * over / ((float(s) + 1) * under))) for s, t in zip(corpus.tolist(), target.tolist())]


def weights(docs: DataFrame, gain: list[int], runs: int = 1) -> DataFrame:
    """(rid, doc_id, n_words, n_features, weight) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n, weight = [], [], []
            for t in _bytes(b.column(1)):
                w = words(t)
                f = features(w, runs, len(gain))
                n_words.append(len(w))
                n.append(sum(f.values()))
                weight.append(sum(gain[k] * c for k, c in f.items()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n, weight))], ["doc_id", "n_words", "n_features", "weight"])
    out = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, n_words long, n_features long, weight long")
    return out.withColumn("rid", F.monotonically_increasing_id())


def noise(doc_id, seed: int) -> F.Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, *order: F.Column) -> DataFrame:
    """``rows`` with their rank from 1, without a single sorted partition."""
    placed = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33)
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())     # one row a partition
    before, rows_before = [], 0
    for p, n in sizes:
        before.append((p, rows_before))
        rows_before += n
    before = rows.sparkSession.createDataFrame(before, "p long, before long")
    return (placed.join(F.broadcast(before), part == F.col("p"))
            .withColumn("rank", F.col("before") + F.col("at") - F.shiftleft("p", 33) + 1).drop("at", "p", "before"))


def resample(docs: DataFrame, target: DataFrame, runs: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS,
             seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null where it is not drawn."""
    gain = gains(bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets))
    scored = stage(weights(docs, gain, runs).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    able = F.col("n_words") >= min_words
    draw = percent * scored.filter(able).count() // 100
    drawn = ranked(scored.filter(able), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("rid"))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = scored.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose id is drawn, with all their columns."""
    ids = resample(docs, target, **how).filter("rank is not null").select(F.col("doc_id").alias("id of a drawn row")).distinct()
    return docs.join(ids, docs["doc_id"] == ids["id of a drawn row"], "left_semi")
