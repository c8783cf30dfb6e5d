"""Session files: JSON lines with turns of timed chunks or plain utterances."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import END_SILENCE_S
from ..operators.timeline import timed_parts

SESSION_DDL = ("session_id string, title string, turns array<struct<turn_id: string, utterance: string, "
               "chunks: array<struct<t: double, text: string>>, end_t: double>>")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, turn, turn_id, text, parts, end_t): explicit chunks as given, utterances as simulated speech."""
    t = spark.read.schema(SESSION_DDL).json(path).select("session_id", F.posexplode("turns").alias("turn", "x"))
    t = t.select("session_id", "turn", "x.turn_id", F.coalesce("x.utterance", F.lit("")).alias("utterance"), "x.chunks", "x.end_t")
    t = t.withColumn("_seed", F.concat_ws("/", "session_id", "turn_id"))
    t = t.withColumn("parts", F.when(F.size("chunks") > 0, F.col("chunks")).otherwise(timed_parts("utterance", "_seed")))
    end = F.expr(f"round(coalesce(element_at(parts, -1).t, 0D) + {END_SILENCE_S}, 3)")
    return t.select("session_id", "turn", "turn_id", F.expr("array_join(transform(parts, p -> p.text), ' ')").alias("text"),
                    "parts", F.coalesce("end_t", end).alias("end_t"))


def chunk_rows(sessions: DataFrame) -> DataFrame:
    """The same sessions as rows of a transcript stream; the last chunk of a turn ends it."""
    p = sessions.select("session_id", "turn", F.size("parts").alias("n"), F.posexplode("parts").alias("seq", "p"))
    return p.select("session_id", "turn", "seq", "p.t", "p.text", F.lit(False).alias("cumulative"),
                    (F.col("seq") == F.col("n") - 1).alias("is_end"))
