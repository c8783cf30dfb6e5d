"""Training rows of the turn gate, made from a corpus' own terms, and fitted weights as a fingerprinted artifact.

A topic is two pairs of a chunk's rarest terms.  Each topic fills one sentence of every kind below, so rows grow with the
corpus; the sentence and the numbers in it come from a digest of topic and kind, and the same corpus gives the same rows.
"""
from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dialogue as D
from ..operators import gate as G
from ..plans.layout import top_per_key
from ..session import stage

FITTED = 2                                # which way of fitting: weights of another are not read
COMMON = 1 << 16                          # terms whose df is sent to all tasks; the others meet theirs in a join


@dataclass(frozen=True)
class Kind:
    """One kind of utterance: its label, and what was answered before (None: nothing; else topic or other)."""
    name: str
    label: str
    before: str | None
    sentences: tuple[str, ...]


# {t} topic, {u} other topic, {n} {m} numbers, {k} a small count
KINDS = (
    Kind("opening", "retrieval", None, (
        "what do the documents say about {t}?", "could you look up {t} for me", "which rules apply to {t}?", "I want to understand {t}",
        "please find everything on {t}", "hello, I have a question on {t}", "is {t} covered anywhere?", "how is {t} handled",
        "where can I read about {t}", "explain {t} to me")),
    Kind("change of subject", "retrieval", "other", (
        "now what about {t}?", "different subject, how does {t} work", "next I need {t}", "and where do I find {t}?",
        "okay, what is the procedure for {t}", "let us move on to {t}, who decides on it?", "can you also check {t}?", "tell me about {t} as well")),
    Kind("two at once", "retrieval", None, (
        "I need {t} and also {u}", "what is {t}, and how about {u}?", "look up {t}, then {u}", "compare {t} with {u} please",
        "tell me about {t} and whether {u} matters")),
    Kind("further question", "retrieval", "topic", (
        "and how much time does {u} take?", "who signs off on {u}?", "also when is {u} due", "is there a form for {u}?",
        "what documents does {u} require", "which team is responsible for {u}?")),
    Kind("detail", "refinement", "topic", (
        "oh, I should add that there are {n} of us", "actually it is {n}, not {m}", "sorry, it has to happen within {n} days",
        "wait, it starts {n} days later than I said", "we are now {n} people by the way", "it turned out to be {n} nights",
        "hmm, and if it took {n} hours longer?", "I forgot to say that it is abroad", "make it {n} instead of {m}",
        "well, in fact it falls on a weekend", "oh and my manager has agreed already", "the date moved by {n} weeks")),
    Kind("other form", "presentation", "topic", (
        "say that in {k} bullet points", "shorter please", "could you repeat the answer", "give me the gist of that",
        "just the key points", "summarize that in {k} bullets", "read that back to me", "one more time, but briefer", "turn that into a short list",
        "can you say the last part again?")),
    Kind("thanks", "chitchat", "topic", (
        "thank you, that helps", "great, thanks a lot", "okay, understood", "perfect, that is all", "thanks, bye for now", "cool, good to know",
        "all right, cheers", "wonderful, I appreciate it")),
    Kind("greeting", "chitchat", None, (
        "hello there", "good morning", "hi", "hey, how are you", "okay", "good afternoon to you", "thanks in advance", "hmm okay")),
)
COUNTS = ("two", "three", "2", "3")


def topics(postings: DataFrame, terms: DataFrame, common: int = COMMON) -> DataFrame:
    """(topic, other): of every chunk the four terms that the fewest chunks hold, in pairs; chunks with fewer than four words have none."""
    words = terms.filter("term RLIKE '^[a-z]{4,}$' AND df IS NOT NULL").select("term", "df")
    often = F.broadcast(words.orderBy(F.desc("df"), "term").limit(common))     # most postings get their df from these few, where they lie
    held = postings.filter("term RLIKE '^[a-z]{4,}$'").select("term", "chunk_id").join(often, "term", "left")
    order = [F.asc("df"), F.asc("term")]
    known = top_per_key(held.filter("df IS NOT NULL"), "chunk_id", order, 4).drop("rank")
    other = held.filter("df IS NULL").select("term", "chunk_id").hint("merge").join(words, "term")    # all terms are no small side
    rare = top_per_key(known.unionByName(other), "chunk_id", order, 4).groupBy("chunk_id").agg(
        F.array_sort(F.collect_list(F.struct("df", "term"))).alias("r")).filter("size(r) = 4")
    return rare.select(F.expr("concat(r[0].term, ' ', r[1].term)").alias("topic"), F.expr("concat(r[2].term, ' ', r[3].term)").alias("other")).distinct()


def training_rows(topic_rows: DataFrame) -> DataFrame:
    """``topics`` -> (topic, kind, text, has_prev, prev_topic, label): one row of each kind per topic."""
    def s(x: str | None) -> str:
        return "CAST(NULL AS STRING)" if x is None else "'" + x.replace("'", "\\'") + "'"
    kinds = ", ".join(f"named_struct('name', {s(k.name)}, 'label', {s(k.label)}, 'before', {s(k.before)}, 'sentences', "
                      f"array({', '.join(map(s, k.sentences))}))" for k in KINDS)
    t = topic_rows.select("topic", "other", F.explode(F.expr(f"array({kinds})")).alias("k"))
    t = t.withColumn("h", F.expr("CAST(conv(substr(md5(concat_ws('/', topic, other, k.name)), 1, 7), 16, 10) AS INT)"))
    text = "element_at(k.sentences, h % size(k.sentences) + 1)"
    counts = f"element_at(array({', '.join(map(s, COUNTS))}), h % {len(COUNTS)} + 1)"
    for slot, value in (("t", "topic"), ("u", "other"), ("n", "CAST(h % 97 + 13 AS STRING)"), ("m", "CAST(h % 9 + 3 AS STRING)"), ("k", counts)):
        text = f"replace({text}, '{{{slot}}}', {value})"
    return t.select("topic", "other", F.col("k.name").alias("kind"), F.expr(text).alias("text"), F.col("k.before").isNotNull().alias("has_prev"),
                    F.expr("CASE k.before WHEN 'topic' THEN topic WHEN 'other' THEN other ELSE '' END").alias("prev_topic"),
                    F.col("k.label").alias("label"))


def held_out(topic: str = "topic"):
    """A fifth of the topics, by digest: a topic is either fitted or measured, never both."""
    return F.expr(f"CAST(conv(substr(md5({topic}), 1, 7), 16, 10) AS INT) % 5 = 0")


def understood(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``training_rows`` with what the gates read: terms, cues and the rule gate's own decision (``label``); the given label is ``gold``."""
    t = rows.withColumn("turn_key", F.md5(F.concat_ws("/", "topic", "other", "kind"))).withColumnRenamed("label", "gold").withColumn(
        "prev_topic", T.content_tokens("prev_topic"))
    t = t.repartition(int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")), "turn_key")    # few bytes, much work: not by size
    n = D.with_vocabulary(stage(D.normalise(t), "gate_normalised"), terms, "turn_key")                # read for its words and for its rows
    return G.rule_gate(n, D.clauses(n, "turn_key"), "turn_key")


def fit(rows: DataFrame, terms: DataFrame, dim: int) -> G.Weights:
    """Weights from all rows of the topics that are not held out."""
    x = G.cue_features(understood(rows.filter(~held_out()), terms)).withColumn("_tokens", T.content_tokens("norm"))
    return G.train_gate(stage(x.select("_tokens", "cues", "gold"), "gate_fit"), "_tokens", dim, "gold")       # read three times


def fingerprint(corpus: str, dim: int, fitted: int = FITTED) -> str:
    """Changes with the corpus, the sentences, the vector size and the way of fitting."""
    kinds = json.dumps([[k.name, k.label, k.before, *k.sentences] for k in KINDS])
    return hashlib.sha256(f"{corpus}/{kinds}/{dim}/{fitted}".encode()).hexdigest()[:16]


def save(spark: SparkSession, weights: G.Weights, print_: str, root: str) -> None:
    """Four rows in a folder of their own; the manifest that names it is written last."""
    path = f"{root}/gate-{print_}-{uuid.uuid4().hex[:8]}"
    rows = [(k, b, w, weights.dim) for k, (w, b) in enumerate(zip(weights.rows, weights.intercepts))]
    spark.createDataFrame(rows, "label int, intercept double, weights array<double>, dim int").coalesce(1).write.parquet(path)
    spark.createDataFrame([(path,)], "path string").write.mode("overwrite").parquet(f"{root}/gate-manifest-{print_}")


def load(spark: SparkSession, print_: str, root: str) -> G.Weights | None:
    try:
        path = spark.read.parquet(f"{root}/gate-manifest-{print_}").first()["path"]
    except AnalysisException:
        return None
    rows = spark.read.parquet(path).orderBy("label").collect()                       # one per label
    return G.Weights([list(r["weights"]) for r in rows], [r["intercept"] for r in rows], rows[0]["dim"])


def load_or_train(spark: SparkSession, index, corpus: str, root: str, dim: int) -> G.Weights:
    """The weights stored for this corpus, else fitted to its topics and stored."""
    print_ = fingerprint(corpus, dim)
    found = load(spark, print_, root)
    if found is None:
        found = fit(training_rows(topics(index.postings, index.terms)), index.terms, dim)
        save(spark, found, print_, root)
    return found
