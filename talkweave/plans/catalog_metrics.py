"""Registered queries for telemetry and evaluation."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics as M
from ..operators import telemetry as E
from ..operators import timeline as L
from . import inputs as I
from . import retrieval as R
from .catalog import S, query
from ..session import stage
from .layout import blocked_position, broadcast_if_small, byte_size, read_table, spread

# the event log stands in for a trace: a user's day is a turn
KINDS = {"signup": "turn_started", "view": "chunk_received", "click": "controller_decision",
         "purchase": "turn_completed", "error": "retrieval_started"}


def _events(spark, sf):
    e = spread(read_table(spark, sf, "events"), "event_id")
    return e.select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("event"), F.col("user_id").alias("session_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("turn_id"), F.col("value"), "props",
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t_wall")).withColumn("t_stream", F.col("t_wall"))


@query
def trace_coverage(spark, sf):
    e = _events(spark, sf).withColumn("has_cost", F.col("value") > 5)
    c = E.trace_coverage(e, KINDS)
    return c.select("session_id", "turn_id", "events", F.array_join("missing", "|").alias("missing"))


@query
def trace_coverage_rate(spark, sf):
    """Coverage of the same log when a session is the unit."""
    e = _events(spark, sf).withColumn("has_cost", F.col("value") > 5)
    return E.coverage_rate(E.trace_coverage(e, KINDS, by=("session_id",)))


@query
def event_schema_check(spark, sf):
    """The log read as telemetry: event names mapped, payload taken as it is."""
    names = F.expr("map(" + ", ".join(f"'{a}', '{b}'" for a, b in {**KINDS, "error": "oops"}.items()) + ")[event]")
    payload = F.expr("regexp_replace(props, '\"k\"', CASE WHEN event = 'purchase' THEN '\"kind\"' ELSE '\"text\"' END)")
    bad = E.schema_violations(_events(spark, sf).withColumn("payload", payload).withColumn("event", names))
    return bad.groupBy("event").agg(F.count("*").alias("rows"), F.sum(F.size("problems")).alias("problems"),
                                    F.count_if(F.array_contains("problems", "event=oops")).alias("unknown_event"))


@query
def latency_percentiles(spark, sf):
    return E.nearest_rank(_events(spark, sf), ["event"], "value", {"p50": 0.5, "p95": 0.95})


@query
def cost_model(spark, sf):
    """Cost per session and day: each measured millisecond charged once."""
    t = _events(spark, sf).groupBy("session_id", "turn_id").agg(F.round(F.sum("value"), 2).alias("cpu_ms"),
                                                               F.count("*").alias("tokens"))
    return t.select("session_id", "turn_id", E.cost_usd("cpu_ms", S.threads, S.cpu_usd_per_vcpu_hour, "tokens", None,
                                                        0.5, 0.0).alias("usd"))


@query
def latest_per_turn(spark, sf):
    return E.latest_per_turn(_events(spark, sf)).select("session_id", "turn_id", "event", "seq", "value")


@query
def job_spans(spark, sf):
    return E.job_spans(_events(spark, sf), "click", "view").select("session_id", "turn_id", "t_start", "t_end", "lead_s")


@query
def virtual_worker(spark, sf):
    """Events as jobs of a single worker per user: the value, in minutes, is the cost."""
    jobs = _events(spark, sf).select("session_id", "seq", "t_stream", (F.col("value") * 60).alias("cost"))
    w = L.virtual_worker(jobs, "session_id", "t_stream", "cost", "seq", 86400.0)
    return w.select("session_id", "seq", F.round("t_start", 3).alias("t_start"), F.round("t_end", 3).alias("t_end"))


# ------------------------------------------------------------------ evaluation
def _turn_records(spark, sf):
    """Turns with an expected kind (from role and position) and a predicted one (from length)."""
    c = I.conversations(spark, sf)
    n = F.size(T.words("text"))
    expected = F.expr("CASE WHEN role = 'system' THEN 'chitchat' WHEN role = 'assistant' THEN 'presentation' "
                      "WHEN turn <= 1 THEN 'single' ELSE 'refinement' END")
    kind = F.when(n < 12, "chitchat").when(n > 60, "presentation").when(F.col("turn") <= 1, "retrieval").otherwise("refinement")
    t = c.select("conv_id", "turn", expected.alias("type"), kind.alias("kind"), n.alias("n_words"), "text")
    t = blocked_position(t, "conv_id", "turn", "version", F.col("kind").isin("retrieval", "refinement"))
    return t.withColumn("expected", M.expected_kind("type"))


@query
def confusion_matrix(spark, sf):
    return M.confusion(_turn_records(spark, sf))


@query
def turn_kind_accuracy(spark, sf):
    return _turn_records(spark, sf).groupBy("type").agg(F.count("*").alias("turns"),
                                                        M.pct(F.col("expected") == F.col("kind")).alias("accuracy_pct"))


@query
def early_retrieval(spark, sf):
    t = _turn_records(spark, sf)
    spoken = F.col("n_words") / 2.7
    t = t.select("type", (F.col("expected").isin("retrieval", "refinement")).alias("retrieval_required"),
                 (F.col("kind").isin("retrieval", "refinement")).alias("retrieved"),
                 F.when(F.col("n_words") > 12, spoken - 2.5).otherwise(F.lit(None)).alias("first_retrieval_s"),
                 spoken.alias("last_chunk_t"), (F.col("n_words") > 12).alias("early"))
    return M.early_retrieval(t, ["type"])


@query
def previous_answer(spark, sf):
    t = M.previous_answer(_turn_records(spark, sf), "conv_id")
    return t.select("conv_id", "turn", "kind", "version", "prev_version")


@query
def refinement_gate(spark, sf):
    t = M.previous_answer(_turn_records(spark, sf), "conv_id")
    t = t.select("type", "kind", "version", "prev_version", F.col("prev_version").alias("parent_version"),
                 F.when(F.col("n_words") % 5 == 0, "new_answer").otherwise("refine").alias("mode"),
                 (F.col("n_words") % 7).alias("n_kept"), (F.col("n_words") % 6).alias("n_queries"),
                 F.lit(0).alias("n_repeated"))
    return M.refinement(t)


@query
def uncertainty_metrics(spark, sf):
    t = _turn_records(spark, sf)
    return M.uncertainty(t.select(
        (F.col("expected") != "chitchat").alias("retrieval_required"), (F.col("n_words") % 4 == 0).alias("unanswerable"),
        (F.col("n_words") % 3).alias("n_intent_flags"), (F.col("n_words") % 2).alias("n_coverage_notes")))


def _gold(spark, sf):
    """Gold chunks of a benchmark passage: those that contain one of its sentence units word for word."""
    q = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("turn_key"),
                                                  F.posexplode(T.sentence_units("text")).alias("intent", "unit"))
    return q.withColumn("unit_key", F.md5("unit"))


def _gold_labels(spark, sf, ix):
    units = ix.chunks.select("chunk_id", F.explode_outer("sentences").alias("sentence")).filter("sentence IS NOT NULL")      # no table of all sentences and vectors is needed
    s = units.select("chunk_id", F.md5("sentence").alias("unit_key"))
    size = byte_size(read_table(spark, sf, "benchmark"), "text")
    g = s.join(broadcast_if_small(_gold(spark, sf), size), "unit_key")
    return g.select("turn_key", "intent", F.col("chunk_id").alias("label")).distinct()


def _evidence(spark, sf, ix, **overrides):
    b = R.query_block(I.benchmark_queries(spark, sf), S)
    h = R.retrieve(b, ix, S.with_overrides(**overrides))
    return R.per_owner(h, b).select(F.col("qid").alias("turn_key"), F.col("chunk_id").alias("label"), "rank")


@query
def hit_and_recall(spark, sf):
    ix = I.index(spark, sf)
    return M.rank_quality(_evidence(spark, sf, ix), _gold_labels(spark, sf, ix))


@query
def citation_precision(spark, sf):
    ix = I.index(spark, sf)
    return M.citation_precision(_evidence(spark, sf, ix).filter("rank <= 4"), _gold_labels(spark, sf, ix))


@query
def gold_misses(spark, sf):
    ix = I.index(spark, sf)
    return M.gold_misses(_evidence(spark, sf, ix), _gold_labels(spark, sf, ix))


@query
def key_fact_recall(spark, sf):
    """Sentence units of the passages looked up in the texts of all their hits."""
    ix = I.index(spark, sf)
    hits = stage(_evidence(spark, sf, ix), "evidence")
    answers = ix.chunks.select(F.col("chunk_id").alias("label"), "text").join(broadcast_if_small(hits, byte_size(hits, "turn_key", "label")), "label").select(
        "turn_key", "text")
    facts = _gold(spark, sf).select("turn_key", F.col("unit").alias("fact"))
    return M.key_fact_recall(answers, facts).groupBy("turn_key").agg(
        F.count("*").alias("facts"), F.count_if("found").alias("found"))


@query
def summary_pivot(spark, sf):
    """Hit@3 of four configurations in one table."""
    ix = I.index(spark, sf)
    configs = {"default": {}, "dense_only": {"retrieval_mode": "dense"}, "bm25_only": {"retrieval_mode": "bm25"},
               "no_rerank": {"rerank": False}}
    every = None
    for name, o in configs.items():
        e = _evidence(spark, sf, ix, **o).withColumn("config", F.lit(name))
        every = e if every is None else every.unionByName(e)
    m = M.rank_quality(every, _gold_labels(spark, sf, ix), list(configs))
    long = m.unpivot(["config"], ["hit_at_3_pct", "recall_at_5_pct"], "metric", "value")
    return M.summary_pivot(long, list(configs))


@query
def multi_intent(spark, sf):
    """Passages as compound turns: an edge joins a retrieved chunk (rank <= 3) with a gold unit it contains."""
    ix = I.index(spark, sf)
    gold = _gold_labels(spark, sf, ix)
    top = _evidence(spark, sf, ix).filter("rank <= 3")
    per_hit = top.join(gold, ["turn_key", "label"]).groupBy("turn_key", "rank").agg(
        F.array_sort(F.collect_set(F.col("intent").cast("int"))).alias("golds"))
    edges = per_hit.groupBy("turn_key").agg(F.collect_list("golds").alias("edges"))
    n = gold.groupBy("turn_key").agg(F.count_distinct("intent").alias("answerable"))
    t = n.join(edges, "turn_key", "left").withColumn("edges", F.coalesce("edges", F.expr("CAST(array() AS ARRAY<ARRAY<INT>>)")))
    return M.multi_intent(t).drop("detected_2plus")


def _sweep(spark, sf):
    s = _events(spark, sf).select(((F.col("value") - 10) / 4).alias("score"),
                                  F.col("event").isin("purchase", "click").alias("positive"))
    return M.threshold_sweep(s)


@query
def threshold_sweep(spark, sf):
    return _sweep(spark, sf)


@query
def best_threshold(spark, sf):
    return M.best_threshold(_sweep(spark, sf))


@query
def gate_verdicts(spark, sf):
    """Shares of the event log, per event type as configuration, against the gate targets."""
    e = _events(spark, sf)
    m = e.groupBy(F.col("event").alias("config")).agg(
        M.pct(F.col("value") > 2).alias("G2"), M.pct(F.col("value") > 5).alias("G3"), M.pct(F.col("value") > 1).alias("G4"),
        M.pct(F.col("value") > 4).alias("G5"), M.pct(F.col("value") >= 0).alias("G6"), F.count_if(F.col("value") > 200).alias("fabricated"))
    long = m.unpivot(["config", "fabricated"], ["G2", "G3", "G4", "G5", "G6"], "gate", "value")
    return M.gate_verdicts(long)
