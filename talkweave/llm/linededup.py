"""Line deduplication: repeated runs of lines are found by prefix doubling over line ids, later copies are deleted.

Every line gets an id (its rank among the lines that occur more than once), and a document becomes a sequence of ids.  Round k gives
each position the rank of the 2^k lines that start there among all such sequences: the ranks are those of a suffix
array sorted to depth 2^k, and the rows that share a rank are an interval of that array whose longest common prefix is at least
2^k lines.  Ranks that occur once are dropped, since nothing longer that starts there can repeat.

A run is deleted if it holds ``MIN_WORDS`` words or more and occurs earlier (by doc_id, nulls last, then row and line).  It is
enough to look at the shortest windows of that weight: those that start at a line and those that end at one.  Each line
of a maximal repeated run of that weight lies in such a window inside the run.  A line weighs its words, one at least, so a window has
at most ``MIN_WORDS`` lines and the rounds don't depend on the data.  A window of m lines is named by the ranks of its first and its
last 2^k lines (2^k <= m < 2^(k+1)); its first occurrence counts as the original and all others go.

An occurrence that overlaps the original is a later one too.  So a run that repeats itself without a break shrinks to what no later window
covers: of sixty equal lines of one word the first stays, not the first fifty; of fifteen equal lines of five words, the first.  No text is
lost by that, since every deleted line equals one that stays, but the weight of what stays may be below ``MIN_WORDS``.

Everything is DataFrame expressions.  The only rows that meet by document are its repeated lines; rows with a common
rank meet in partial aggregates and in joins that adaptive execution can split.

Defined cases: a null text stays null; a text whose lines all go becomes empty and its row stays; blank lines weigh one
word; equal rows are separate documents, the first of which stays; other columns, whatever their names, are kept.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffled, stage

MIN_WORDS = 50


def numbered(docs: DataFrame) -> DataFrame:
    """(rid, row): the rows with a number, fixed by writing them."""
    return stage(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row")), "rows")


def _lines(rows: DataFrame) -> DataFrame:
    line = F.col("line")
    n = F.regexp_count(line, F.lit(r"[^ \t\x0B\f\r]+"))
    return (rows.filter("row.text is not null")
            .select("rid", F.col("row.doc_id").alias("doc_id"), F.posexplode(F.split("row.text", "\n", -1)).alias("i", "line"))
            .select("rid", "doc_id", "i", F.xxhash64(line).alias("h"), F.xxhash64(F.lit("second"), line).alias("g"),
                    F.greatest(n, F.lit(1)).alias("w")))


def _ranked(keys: DataFrame, *by: str) -> DataFrame:
    """The distinct keys with a rank in their sort order (increasing, not dense)."""
    return stage(keys.repartitionByRange(*by).sortWithinPartitions(*by)
                 .withColumn("rank", F.monotonically_increasing_id()), "ranks")


def _level(at: DataFrame, a: str, b: str) -> DataFrame:
    """(rid, i, rank) where the pair (a, b) of a position occurs at least twice."""
    twice = at.groupBy(a, b).agg(F.count("*").alias("n")).filter("n > 1").select(a, b)
    return shuffled(at).join(_ranked(twice, a, b), [a, b]).select("rid", "i", "rank")


def _runs(lines: DataFrame, min_words: int) -> DataFrame:
    """The lines of unbroken runs of repeated lines that weigh enough."""
    by = Window.partitionBy("rid").orderBy("i")
    broken = F.when(F.col("i") == F.lag("i").over(by) + 1, 0).otherwise(1)
    run = lines.withColumn("broken", broken).withColumn("run", F.sum("broken").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return run.withColumn("weight", F.sum("w").over(Window.partitionBy("rid", "run"))).filter(F.col("weight") >= min_words).drop("broken", "weight")


def _windows(run_lines: DataFrame, min_words: int) -> DataFrame:
    """(rid, doc_id, p, m): the shortest windows of enough weight that start at a line or end at one, within a run."""
    by = Window.partitionBy("rid", "run").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    cum = run_lines.withColumn("c", F.sum("w").over(by))
    runs = cum.groupBy("rid", "doc_id", "run").agg(F.min("i").alias("i0"), F.sort_array(F.collect_list(F.struct("i", "c"))).alias("s"))
    runs = runs.select("rid", "doc_id", "i0", F.transform("s", lambda x: x["c"]).alias("c"))
    before = "coalesce(get(c, {} - 1), 0)"
    ahead = (f"get(filter(sequence(j, least(j + {min_words - 1}, size(c) - 1)), "
             f"e -> c[e] - {before.format('j')} >= {min_words}), 0)")
    behind = (f"get(filter(sequence(j, greatest(0, j - {min_words - 1}), -1), "
              f"b -> c[j] - {before.format('b')} >= {min_words}), 0)")
    return (runs.select("rid", "doc_id", "i0", F.explode(F.expr(
        f"array_distinct(filter(flatten(transform(sequence(0, size(c) - 1), j -> array("
        f"struct(j as p, {ahead} - j + 1 as m), struct({behind} as p, j - {behind} + 1 as m)))), x -> x.m is not null and x.p is not null))")).alias("x"))
        .select("rid", "doc_id", (F.col("i0") + F.col("x.p")).alias("p"), F.col("x.m").alias("m")))


def later_copies(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(rid, p, m): windows of lines that occur earlier; ``rows`` as from ``numbered``."""
    lines = stage(_lines(rows), "lines")
    twice = lines.groupBy("h", "g").agg(F.count("*").alias("n")).filter("n > 1").select("h", "g")
    repeated = stage(_runs(shuffled(lines).join(_ranked(twice, "h", "g"), ["h", "g"]).select("rid", "doc_id", "i", "w", "rank"), min_words), "repeated")
    level = repeated.select("rid", "i", "rank")
    levels = level.withColumn("k", F.lit(0))
    k = 0
    while 2 ** (k + 1) <= min_words:
        shifted = level.select("rid", (F.col("i") - 2 ** k).alias("i"), F.col("rank").alias("b"))
        level = stage(_level(shuffled(level).withColumnRenamed("rank", "a").join(shifted, ["rid", "i"]), "a", "b"), "level")
        k += 1
        levels = levels.unionByName(level.withColumn("k", F.lit(k)))
    w = _windows(repeated, min_words).withColumn("k", F.floor(F.log2("m") + 1e-9).cast("int"))
    w = w.withColumn("q", F.col("p") + F.col("m") - F.expr("shiftleft(1, k)"))
    named = stage(w.join(shuffled(levels.select("rid", "k", F.col("i").alias("p"), F.col("rank").alias("a"))), ["rid", "k", "p"])
                  .join(shuffled(levels.select("rid", "k", F.col("i").alias("q"), F.col("rank").alias("b"))), ["rid", "k", "q"])
                  .select("m", "a", "b", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "p").alias("place")), "windows")
    first = stage(named.groupBy("m", "a", "b").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "first")
    return shuffled(named).join(first, ["m", "a", "b"]).filter("place > first").select("place.rid", "place.p", "m")


def _islands(windows: DataFrame) -> DataFrame:
    """(rid, gone): the deleted stretches (s, e) of each row, merged and in order."""
    by = Window.partitionBy("rid").orderBy("p", "e")
    w = windows.select("rid", "p", (F.col("p") + F.col("m") - 1).alias("e")).distinct()
    w = w.withColumn("reach", F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    w = w.withColumn("island", F.sum(F.when(F.col("p") <= F.col("reach") + 1, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return (w.groupBy("rid", "island").agg(F.min("p").alias("s"), F.max("e").alias("e"))
            .groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("gone")))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, n_lines, n_deleted): every row of ``docs`` with the later copies of repeated line runs cut out of its ``text``."""
    rows = numbered(docs)
    gone = _islands(later_copies(rows, min_words))
    line = "split(row.text, '\\n', -1)"
    start, end = "coalesce(get(gone, j - 1).e, -1) + 1", "coalesce(get(gone, j).s, n_lines)"
    left = f"array_join(flatten(transform(sequence(0, size(gone)), j -> slice({line}, {start} + 1, {end} - ({start})))), '\\n')"
    cut = rows.join(gone, "rid", "left").withColumn("n_lines", F.coalesce(F.expr(f"size({line})"), F.lit(0)))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.expr(left))
    deleted = F.aggregate("gone", F.lit(0), lambda a, x: a + x["e"] - x["s"] + 1)
    return cut.select(F.col("row").withField("text", text).alias("row"), "n_lines", F.coalesce(deleted, F.lit(0)).alias("n_deleted"))
