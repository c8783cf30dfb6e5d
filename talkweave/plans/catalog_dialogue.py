"""Registered queries over conversations: cues, clauses, sub-queries, gates, session state."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import cues as Q
from ..functions import text as T
from ..operators import dialogue as D
from ..operators import gate as G
from ..operators import speculation as X
from ..operators import timeline as L
from ..operators.containment import containment_join
from ..operators.dense import embed_tokens
from ..session import stage
from ..sources import gate_store as GS
from . import inputs as I
from .catalog import S, query
from .layout import blocked_position
from .replay import cap_queries


def _turns(spark, sf):
    return I.conversations(spark, sf).select("conv_id", "turn", "role", "text",
                                             F.concat_ws("/", "conv_id", "turn").alias("turn_key"))


def _with_previous(turns):
    """Each turn with its predecessor's text: an equi-join on the position, not a window over the session."""
    prev = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prev_text"))
    return turns.join(prev, ["conv_id", "turn"], "left")


@query
def cue_flags(spark, sf):
    t = G.cue_flags(I.conversations(spark, sf), "text")
    return t.select("conv_id", "turn", *[f"is_{c}" for c in G.CUES])


@query
def question_patterns(spark, sf):
    """Request, context and anaphora patterns of the segmenter, plus the answer type asked for."""
    t = I.conversations(spark, sf)
    flags = {"starts_question": V.QUESTION_START, "has_request": V.REQUEST_CUE, "starts_context": V.CONTEXT_START,
             "starts_preposition": V.PREPOSITION_START, "has_wh": V.WH_ANYWHERE, "distinct_question": V.DISTINCT_QUESTION}
    return t.select("conv_id", "turn", *[Q.flag("text", p).alias(n) for n, p in flags.items()],
                    F.expr(Q.anaphoric("text")).alias("anaphoric"))


@query
def answer_types(spark, sf):
    said = "concat('How many days ', role, ' or what is the rate? ', text)"
    t = I.conversations(spark, sf).withColumn("q", F.expr(f"CASE role WHEN 'user' THEN {said} "
                                                          "WHEN 'assistant' THEN concat('what is the fee ', text) ELSE text END"))
    return t.select("conv_id", "turn", Q.answer_type("q").alias("kind"),
                    Q.satisfies("'duration'", "q").alias("has_duration"), Q.satisfies("'number'", "q").alias("has_number"))


@query
def cross_references(spark, sf):
    u = I.documents(spark, sf).select("doc_id", F.explode(T.sentence_units("text")).alias("unit"))
    said = u.select("doc_id", F.concat("unit", F.lit(" (see Doc_"), "doc_id", F.lit(")")).alias("u"), "unit")
    return said.groupBy("doc_id").agg(
        F.count_if(F.expr(Q.has("u", V.CROSS_REFERENCE))).alias("with_reference"),
        F.count_if(F.expr(Q.has("unit", V.CROSS_REFERENCE))).alias("plain"))


@query
def spoken_normalise(spark, sf):
    """Spoken forms of every turn: number words, a self-repair and fillers are put in front of the text."""
    said = F.concat(F.lit("um so we are twenty five, sorry, forty two people and "), "role", F.lit(", you know, "), "text")
    n = D.normalise(_turns(spark, sf).withColumn("text", said))
    return n.select("conv_id", "turn", F.length("norm").alias("n_chars"), F.md5("norm").alias("norm_md5"))


def _segmented(spark, sf):
    terms = I.index(spark, sf).terms
    n = stage(D.normalise(_turns(spark, sf)), "normalised")
    return D.with_vocabulary(n, terms, "turn_key")


def _clauses(spark, sf):
    return stage(D.clauses(_segmented(spark, sf)), "clauses")


@query
def clause_segments(spark, sf):
    c = D.clauses(_segmented(spark, sf))
    return c.select("turn_key", "idx", "kind", "complete", "joiner", "text", F.array_join("content", " ").alias("content"),
                    F.array_join("proper", " ").alias("proper"))


@query
def subqueries(spark, sf):
    q = D.subqueries(_clauses(spark, sf))
    return q.select("turn_key", "n", "text", F.array_join("keywords", " ").alias("keywords"), "origin", "is_anchor", "alt")


@query
def merged_subqueries(spark, sf):
    q = D.subqueries(_clauses(spark, sf))
    q = stage(q.withColumn("vec", embed_tokens("keywords", S.embed_dim)), "subqueries")
    m = D.merge_near_duplicates(q, "turn_key", S.dedup_cosine)
    return m.groupBy("turn_key").agg(F.count("*").alias("queries"), F.count_if(F.col("n") == F.col("owner")).alias("kept"))


def _gated(spark, sf):
    t = _with_previous(_turns(spark, sf)).select(
        "turn_key", "role", "text", (F.col("turn") > 0).alias("has_prev"),
        T.content_tokens("coalesce(prev_text, '')").alias("prev_topic"))
    n = stage(D.normalise(t), "normalised")                      # read for its words and for its rows
    n = stage(D.with_vocabulary(n, I.index(spark, sf).terms, "turn_key"), "vocabulary")
    return G.rule_gate(n, stage(D.clauses(n), "clauses"))


@query
def rule_gate(spark, sf):
    return _gated(spark, sf).select("turn_key", "label", "confidence", "reason", F.size("new_terms").alias("new_terms"))


@query
def cue_features(spark, sf):
    return G.cue_features(_gated(spark, sf)).select("turn_key", F.array_join(
        F.transform("cues", lambda c: F.format_number(c, 4)), " ").alias("cues"))


@query
def trained_gate(spark, sf):
    """What the three gates make of every turn; the model is fitted to utterances about the corpus' topics, not to the rules' labels."""
    weights = I.gate_weights(spark, sf)
    rows = stage(_gated(spark, sf), "gate_rows")
    by = lambda kind: G.decide(rows, G.Gate(kind, weights)).select("turn_key", F.col("label").alias(f"{kind}_label"))
    three = rows.select("turn_key", F.col("label").alias("rule_label")).join(by("model"), "turn_key").join(by("hybrid"), "turn_key")
    return three.groupBy("rule_label", "model_label", "hybrid_label").agg(F.count("*").alias("turns"))


def _gate_rows(spark, sf):
    ix = I.index(spark, sf)
    return GS.training_rows(GS.topics(ix.postings, ix.terms)), ix


@query
def gate_training_rows(spark, sf):
    """Utterances of known kind about every topic of the corpus."""
    return _gate_rows(spark, sf)[0].select("topic", "kind", "text", "has_prev", "prev_topic", "label", GS.held_out().alias("held_out"))


@query
def gate_holdout(spark, sf):
    """Right decisions of the three gates on the topics that were not fitted, per true label."""
    rows, ix = _gate_rows(spark, sf)
    weights = I.gate_weights(spark, sf)
    seen = stage(GS.understood(rows.filter(GS.held_out()), ix.terms), "gate_holdout")
    every = None
    for kind in ("rule", "model", "hybrid"):
        d = G.decide(seen, G.Gate(kind, weights)).groupBy("gold").agg(F.count("*").alias("utterances"), F.count_if(F.expr("label = gold")).alias("right"))
        d = d.select(F.lit(kind).alias("gate"), F.col("gold").alias("label"), "utterances", "right")
        every = d if every is None else every.unionByName(d)
    return every


@query
def spoken_counts(spark, sf):
    said = F.concat(F.lit("put that in "), F.element_at(F.array(*[F.lit(w) for w in ("two", "3", "a couple of", "five")]),
                                                       (F.col("turn") % 4 + 1).cast("int")), F.lit(" short bullets "), "text")
    t = I.conversations(spark, sf).withColumn("said", said)
    return t.select("conv_id", "turn", Q.spoken_count("said").alias("n"))


@query
def timed_transcript(spark, sf):
    """Every turn as timed partial transcripts."""
    t = _turns(spark, sf).withColumn("parts", L.timed_parts("text", "turn_key"))
    return t.select("turn_key", F.size("parts").alias("n_parts"), L.end_of("parts").alias("t_end"),
                    F.md5(F.expr("array_join(transform(parts, p -> p.text), ' ')")).alias("text_md5"))


@query
def turn_accumulate(spark, sf):
    """Lines of a turn as deltas: the text heard so far after each."""
    parts = "transform(split(text, '\\n'), (l, i) -> named_struct('t', CAST(i AS DOUBLE), 'text', trim(l)))"
    t = _turns(spark, sf).withColumn("parts", F.expr(parts)).select("turn_key", F.explode(L.partials("parts")).alias("p"))
    return t.select("turn_key", "p.t", F.md5("p.partial").alias("partial_md5"))


@query
def session_merge_ctx(spark, sf):
    """Five most recent distinct terms per conversation; a turn contributes all its terms."""
    terms = f"array_distinct({T.content_tokens_sql('text')})"
    m = I.conversations(spark, sf).select("conv_id", "turn", F.posexplode(F.expr(terms)).alias("pos", "term"))
    return L.recent_terms(m, "conv_id", "turn", "pos", "term", 5)


@query
def version_lineage(spark, sf):
    """Answer versions: each user turn makes one, every other turn shows the latest."""
    c = I.conversations(spark, sf).select("conv_id", "turn", "role")
    v = blocked_position(c, "conv_id", "turn", "version", F.col("role") == "user")
    return v.select("conv_id", "turn", "version")


def _lines(spark, sf):
    t = _turns(spark, sf).select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return t.withColumn("query_key", L.query_key("line")).filter(F.col("query_key") != "")


@query
def dispatch_dedup(spark, sf):
    """Lines of a turn that neither repeat within it nor were searched in the turn before."""
    lines = _lines(spark, sf).withColumn("k", F.concat_ws("/", "conv_id", "turn"))
    before = lines.select(F.concat_ws("/", "conv_id", F.col("turn") + 1).alias("k"), "query_key")
    return L.new_dispatches(lines, before, "k", "n").select("conv_id", "turn", "n", F.md5("query_key").alias("key_md5"))


@query
def speculative_reuse(spark, sf):
    """Every complete clause was searched while the turn was spoken; the turn's final queries, near-copies merged and the
    surplus joined to its nearest, reuse those searches or miss them."""
    spoken = stage(D.subqueries(_clauses(spark, sf)), "spoken")
    shape = lambda q: q.select("turn_key", "n", L.query_key("text").alias("query_key"),
                               "hard", embed_tokens("keywords", S.embed_dim).alias("vec"))
    terms = I.index(spark, sf).terms
    hard = lambda q: X.hard_terms(q.withColumn("_k", F.concat_ws("/", "turn_key", "n")), terms, "_k")  # noqa: E731  (entities and numbers)
    q = stage(shape(hard(cap_queries(spoken, "turn_key", S.max_subqueries, S.embed_dim).filter("n IS NOT NULL"))), "finals")
    first = stage(shape(hard(spoken)), "dispatched").withColumnRenamed("n", "m")
    r = L.reuse(q, first, "turn_key", S.reuse_cosine)
    return r.groupBy("turn_key").agg(F.count("*").alias("finals"), F.count("reused").alias("reused"),
                                     F.count_if(F.col("reused") < F.col("n")).alias("from_earlier"))


@query
def speculative_dispatches(spark, sf):
    """User turns as timed speech: when the first search could start, against the end of speech."""
    t = _turns(spark, sf).filter("role = 'user'").withColumn("parts", L.timed_parts("text", "turn_key"))
    t = stage(t.select("turn_key", "parts", L.end_of("parts").alias("t_end")), "speech")
    return X.early_turns(t, X.dispatches(t, I.index(spark, sf).terms))


@query
def hard_term_containment(spark, sf):
    """Lines with entities or numbers, and how many turns of their conversation name all of them."""
    hard = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[A-Z][a-z]+|[0-9]+"), 0))
    t = _turns(spark, sf)
    lines = t.select("conv_id", F.posexplode(F.split("text", "\n")).alias("n", "line"), "turn").select(
        "conv_id", F.struct("turn", "n").alias("at"), hard(F.col("line")).alias("items")).filter(F.size("items") > 0)
    lines = stage(lines, "hard_lines")
    met = containment_join(lines, t.select("conv_id", F.col("turn").alias("other"), hard(F.col("text")).alias("items")), ["conv_id"], "at", "other")
    counts = met.groupBy("conv_id", "at").agg(F.count("*").alias("n_turns"))
    return lines.join(counts, ["conv_id", "at"], "left").select(
        "conv_id", "at.turn", "at.n", F.size("items").alias("n_terms"), F.coalesce("n_turns", F.lit(0).cast("long")).alias("n_turns"))
