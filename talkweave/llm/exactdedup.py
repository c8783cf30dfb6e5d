"""Exact deduplication with the frequent digests split off.

A text is named by the SHA-256 of its form with A-Z in lower case.  A Misra-Gries summary (Spark's ``approx_top_k`` sketch: a bounded
number of counters, decremented together when they run out, merged by adding) of all digests proposes the frequent ones.  Its estimates
decide nothing: the proposed digests are counted exactly over all rows, and the winners, those that reach the share the
summary can vouch for, are broadcast with their count and the row that stays.  A row with a winner's digest is settled where it lies.  All other
digests are shuffled; by the summary's bound none of them has more than ``BOUND / counters`` of the rows, so no group of the shuffle is hot.

Sizes: a sketch holds ``COUNTERS`` counters of 16 bytes whatever the input is, sketches merge in two levels, and at most ``COUNTERS``
winners are broadcast (about 100 bytes each, 1 MB in all).

Defined cases: a null text counts as empty; a null id is smaller than any other; of equal texts with equal ids (repeated rows) one row
stays; other columns, whatever their names, are kept; an empty table gives an empty result.

Everything is DataFrame expressions and SQL functions.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

COUNTERS = 8192
BOUND = 3.5          # the sketch's error is at most 3.5 / (its table's size, a power of two above COUNTERS) of the rows
GROUPS = 256         # sketches of tasks meet in so many places before all meet in one
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text) -> F.Column:
    """SHA-256 of the normalised text in lowercase hex."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER).cast("binary"), 256)


def numbered(docs: DataFrame, *keep: str) -> DataFrame:
    """(rid, doc_id, text_sha256, keep...): one small row for each document, written once because it is read three times."""
    return stage(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", digest(F.col("text")).alias("text_sha256"), *keep), "digests")


def proposed(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(key): at most ``counters`` 64-bit keys of digests, all those with a share above the sketch's error among them."""
    key = F.xxhash64("text_sha256").alias("key")
    tasks = digests.select(key, F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("g"))
    return (tasks.groupBy("g").agg(F.expr(f"approx_top_k_accumulate(key, {counters})").alias("s"))
            .groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(s, {counters})").alias("s"))       # grouped: an empty partition sends no sketch
            .select(F.expr(f"explode(approx_top_k_estimate(s, {counters}))").alias("x")).select(F.col("x.item").alias("key")))


def winners(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(text_sha256, group_size, last): the frequent digests with their exact count and the row that stays, counted over all rows."""
    rows = digests.count()
    least = max(2, int(rows * BOUND / counters))
    found = stage(proposed(digests, counters).filter("key is not null"), "proposed") if rows else digests.select(F.xxhash64("text_sha256").alias("key"))
    # A key is 64 bits of a digest and each row's full digest is counted: equal keys of different digests do no harm.
    exact = (digests.join(F.broadcast(found), F.xxhash64("text_sha256") == F.col("key"), "left_semi")
             .groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "rid")).alias("last")))
    return stage(exact.filter(F.col("group_size") >= least), "winners")


def classes(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``numbered`` with keep_id, group_size and kept."""
    won = F.broadcast(winners(digests, counters))
    rest = digests.join(won.select("text_sha256"), "text_sha256", "left_anti")
    same = Window.partitionBy("text_sha256")
    rest = rest.withColumn("group_size", F.count("*").over(same)).withColumn("last", F.max(F.struct("doc_id", "rid")).over(same))
    both = digests.join(won, "text_sha256").unionByName(rest)
    return both.select("*", F.col("last.doc_id").alias("keep_id"), (F.col("rid") == F.col("last.rid")).alias("kept")).drop("last")


def dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Whole rows go into the numbered table, so that the rows and what is decided on them can't drift apart; only the small columns are
    shuffled to decide, and later copies are taken off by an anti-join on the row number.
    """
    rows = stage(docs.select(F.monotonically_increasing_id().alias("rid"), digest(F.col("text")).alias("text_sha256"), F.struct("*").alias("row")), "rows")
    gone = classes(rows.select("rid", F.col("row.doc_id").alias("doc_id"), "text_sha256"), counters).filter("not kept")
    return rows.join(gone.select("rid"), "rid", "left_anti").select("row.*")
