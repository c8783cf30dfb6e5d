"""Live sessions: a stream of transcript chunks -> what has been heard -> early searches -> answered turns.

The stream is an ordinary streaming DataFrame ``(session_id, turn, seq, t, at, text, cumulative, is_end)`` from
files or a broker.  What is heard of a turn is streaming state with timers (``turns.py``).  The state of a session and the searches
that its open turns have started are rows of two stores (``session_store.py``) that each micro-batch reads for the sessions it touches, so
retrieval stays relational and as large as the index, and what a batch writes grows with the sessions that spoke.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import speculation as X
from ..operators.gate import Weights, choose
from ..plans.replay import KEY, STATE_COLUMNS, STATE_DDL, Spoken, advance, speak
from ..settings import Settings
from ..sources.index_store import Index
from ..sources.session_store import SessionStore
from .turns import heard

CHUNK_DDL = "session_id string, turn int, seq int, t double, at timestamp, text string, cumulative boolean, is_end boolean"


def read_chunks(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return spark.readStream.schema(CHUNK_DDL).options(**options).json(path)


def partial_transcripts(chunks: DataFrame) -> DataFrame:
    """Text heard per turn, of a batch of chunks: deltas in order after the latest cumulative chunk.

    The stream keeps the same text as state (``turns.heard``); the group is one utterance.
    """
    item = F.struct("seq", "t", F.trim("text").alias("text"), "cumulative", "is_end")
    g = chunks.groupBy("session_id", "turn").agg(F.array_sort(F.collect_set(item)).alias("c"))
    base = "coalesce(array_max(transform(c, (x, i) -> IF(x.cumulative, i, NULL))), 0)"
    text = f"trim(array_join(filter(transform(slice(c, {base} + 1, size(c)), x -> x.text), t -> t <> ''), ' '))"
    return g.select("session_id", "turn", F.expr(text).alias("text"), F.expr("exists(c, x -> x.is_end)").alias("complete"),
                    F.expr("element_at(c, -1).t").alias("t_last"), F.size("c").alias("chunks"))


class TurnProcessor:
    """``foreachBatch`` sink over ``turns.heard``: starts searches of open turns, answers the turns that ended.

    A batch reads what earlier batches wrote and overwrites its own output, so one that is repeated after a failure gives the same rows.
    A turn ends once in the stream, and is answered once.
    """

    def __init__(self, spark: SparkSession, index: Index, root: str, settings: Settings | None = None, idle_s: float = 3600, every: int = 50,
                 weights: Weights | None = None):
        self.index, self.root, self.s, self.idle = index, root.rstrip("/"), settings or Settings(), idle_s
        self.gate = choose(self.s, weights)
        self.states = SessionStore(spark, f"{self.root}/states", f"{STATE_DDL}, turn_id string, ordinal int, at_ms long", every=every)
        self.every = every
        self.early: SessionStore | None = None                   # its columns are those that a search returns
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/early/changes/batch=-1")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):            # a restart
            kinds = [f"{n} {t}" for n, t in spark.read.parquet(f"{self.root}/early/changes/batch=-1").dtypes if n not in ("batch", "bucket")]
            self.early = SessionStore(spark, f"{self.root}/early", ", ".join(kinds), key=X.TURN, every=every)

    def _early_store(self, spoken: Spoken) -> SessionStore:
        if self.early is None:
            ddl = lambda df: "array<struct<" + ",".join(f"{n}: {t}" for n, t in df.dtypes) + ">>"
            self.early = SessionStore(spoken.fired.sparkSession, f"{self.root}/early", f"{X.TURN} string, ordinal int, at_ms long, fired {ddl(spoken.fired)}, "
                                      f"hits {ddl(spoken.hits)}, sentences {ddl(spoken.sentences)}", key=X.TURN, every=self.every)
        return self.early

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, work = batch.sparkSession, f"{self.root}/work/{batch_id}"

        def keep(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{work}/{name}")
            return spark.read.parquet(f"{work}/{name}")

        turn_key = F.concat_ws("/", KEY, "turn").alias(X.TURN)
        rows = keep(batch.filter("text <> ''").select("*", turn_key), "heard")
        clock = rows.agg(F.max("at_ms").alias("now"), F.count("*").alias("n")).first()
        if not clock["n"]:
            return
        ended = rows.filter("complete")
        numbered = Window.partitionBy(KEY).orderBy("turn")       # the turns of one session that ended in this batch
        turns = keep(ended.withColumn("k", F.row_number().over(numbered)), "turns")
        rounds = turns.agg(F.max("k").alias("k")).first()["k"] or 0
        state = keep(self.states.latest(rows.select(KEY), batch_id).select(*STATE_COLUMNS, "ordinal"), "states-before")
        open_ = rows.join(ended.select(X.TURN), X.TURN, "left_anti")
        for k in range(1, rounds + 1):
            these = turns.filter(F.col("k") == k)
            spoken = self._listen(rows.join(these.select(X.TURN), X.TURN, "left_semi"), state, batch_id, f"{work}/{k}")
            now = these.select(KEY, F.col("turn").cast("string").alias("turn_id"), "text")
            records, fresh = advance(now, state.select(STATE_COLUMNS), self.index, self.s, f"{work}/{k}", spoken, self.gate)
            records.write.mode("overwrite").parquet(f"{self.root}/records/batch={batch_id}/round={k}")
            place = these.select(KEY, F.col("turn").cast("string").alias("turn_id"), "at_ms").join(state.select(KEY, F.col("ordinal").alias("_o")), KEY, "left")
            fresh = fresh.join(place.select(KEY, "turn_id", "at_ms", (F.coalesce("_o", F.lit(0)) + 1).alias("ordinal")), KEY)
            fresh = spark.read.parquet(self._kept(fresh, f"{work}/{k}/changed"))
            rest = state.join(fresh.select(KEY), KEY, "left_anti")
            state = spark.read.parquet(self._kept(fresh.select(*STATE_COLUMNS, "ordinal").unionByName(rest), f"{work}/{k}/states"))
        if rounds:
            changed = spark.read.parquet(f"{work}/1/changed")
            for k in range(2, rounds + 1):
                changed = changed.unionByName(spark.read.parquet(f"{work}/{k}/changed"))
            self.states.put(changed, batch_id)
        if open_.limit(1).count():                               # turns that go on: searches are kept for the batches to come
            spoken = self._listen(open_, state, batch_id, f"{work}/open")
            self._remember(spoken, open_, batch_id)
        horizon = clock["now"] - int(1000 * self.idle)
        self.states.snapshot(batch_id, horizon)
        if self.early is not None:
            self.early.snapshot(batch_id, horizon)

    @staticmethod
    def _kept(df: DataFrame, path: str) -> str:
        df.write.mode("overwrite").parquet(path)
        return path

    def _listen(self, rows: DataFrame, state: DataFrame, batch_id: int, scratch: str) -> Spoken:
        """All searches of these turns so far: those of earlier batches and those that the new chunks start."""
        spark = rows.sparkSession

        def keep(df: DataFrame, name: str) -> DataFrame:
            return spark.read.parquet(self._kept(df, f"{scratch}/{name}"))

        before = self._recall(rows, batch_id, keep)
        done = spark.createDataFrame([], X.FIRED_DDL) if before is None else before.fired.withColumnRenamed("m", "n").select(
            *spark.createDataFrame([], X.FIRED_DDL).columns)
        live = rows.filter("ended_by IS NULL OR ended_by <> 'silence'")
        new = speak(live.select(KEY, X.TURN, "seq", "t", "text"), state.select(STATE_COLUMNS), done, self.index, self.s, keep, self.gate)
        if before is None:
            return new
        both = lambda a, b: a.select(b.columns).unionByName(b)
        return Spoken(both(before.fired, new.fired), both(before.hits, new.hits), both(before.sentences, new.sentences))

    def _recall(self, rows: DataFrame, batch_id: int, keep) -> Spoken | None:
        if self.early is None:
            return None
        kept = keep(self.early.latest(rows.select(X.TURN), batch_id), "recalled")
        part = lambda c: kept.select(F.explode(c).alias("x")).select("x.*")
        return Spoken(part("fired"), part("hits"), part("sentences"))

    def _remember(self, spoken: Spoken, rows: DataFrame, batch_id: int) -> None:
        """One row for each open turn with all its searches, which are a handful."""
        store = self._early_store(spoken)
        lists = rows.groupBy(X.TURN).agg(F.max("at_ms").alias("at_ms"))
        for name, df in (("fired", spoken.fired), ("hits", spoken.hits), ("sentences", spoken.sentences)):
            g = df.groupBy(X.TURN).agg(F.collect_list(F.struct(*df.columns)).alias(name))
            lists = lists.join(g, X.TURN, "left")
        store.put(lists.filter("fired IS NOT NULL").select(X.TURN, F.lit(1).alias("ordinal"), "at_ms", "fired", "hits", "sentences"), batch_id)

    def history(self) -> DataFrame:
        """Every version of every session's answer with the turns for which it held."""
        return self.states.history()


def answer_stream(chunks: DataFrame, index: Index, root: str, settings: Settings | None = None, silence_s: float = 30, idle_s: float = 3600,
                  delay: str = "10 seconds", weights: Weights | None = None, **trigger):
    """Starts the query; ``trigger`` as for ``DataStreamWriter.trigger`` (default: all that is available), ``weights`` for a fitted gate."""
    return (heard(chunks, silence_s, idle_s, delay).writeStream.outputMode("append")
            .foreachBatch(TurnProcessor(chunks.sparkSession, index, root, settings, idle_s, weights=weights))
            .option("checkpointLocation", f"{root.rstrip('/')}/checkpoint")
            .trigger(**(trigger or {"availableNow": True})).start())


def append_trace(events: DataFrame, path: str, checkpoint: str, **trigger):
    """Append-only event trace as partitioned JSON lines."""
    return (events.writeStream.outputMode("append").format("json").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
