"""Evaluation: gate metrics, retrieval quality, ablation tables."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as T


def pct(condition) -> Column:
    """Share of true among non-null, in per cent with one decimal; null for none."""
    c = T._c(condition).cast("int")
    return F.round(100 * F.avg(c), 1)


def norm_fact(x: str) -> str:
    return f"regexp_replace(regexp_replace(replace(lower({x}), '’', ''''), r'(?<=\\d),(?=\\d)', ''), r'\\s+', ' ')"


def expected_kind(turn_type: str) -> Column:
    return F.expr("map(" + ", ".join(f"'{a}', '{b}'" for a, b in V.EXPECTED_KIND.items()) + f")[{turn_type}]")


def confusion(turns: DataFrame) -> DataFrame:
    """``turns(expected, kind)`` -> one row per expected kind, one column per predicted kind."""
    return turns.groupBy("expected").pivot("kind", list(V.GATE_LABELS)).count().na.fill(0)


def early_retrieval(turns: DataFrame, by: list[str] | None = None) -> DataFrame:
    """G2: ``turns(retrieval_required, retrieved, early, first_retrieval_s, last_chunk_t)``."""
    need, got = F.col("retrieval_required"), F.col("retrieved")
    strict = F.coalesce(F.col("first_retrieval_s") < F.col("last_chunk_t"), F.lit(False))
    g = turns.groupBy(*by) if by else turns.groupBy()
    return g.agg(F.count("*").alias("turns"), pct(got == need).alias("decision_accuracy_pct"),
                 pct(F.when(need, F.col("early"))).alias("g2_early_pct"),
                 pct(F.when(need, strict)).alias("g2_strict_pct"),
                 pct(F.when(~need, got)).alias("false_trigger_pct"))


def rank_quality(evidence: DataFrame, gold: DataFrame, configs: list[str] | None = None) -> DataFrame:
    """hit@3 and recall@5 per gold intent: ``evidence(turn_key, label, rank)``, ``gold(turn_key, intent, label)``.

    Gold rows keep their intent; a turn's evidence joins on (turn, label), so nothing is gathered.
    """
    by = ["config"] if configs else []
    best = evidence.groupBy(*by, "turn_key", "label").agg(F.min("rank").alias("rank"))
    if by:
        gold = gold.withColumn("config", F.explode(F.array(*[F.lit(c) for c in configs])))
    j = gold.join(best, [*by, "turn_key", "label"], "left")
    per_intent = j.groupBy(*by, "turn_key", "intent").agg(
        F.coalesce(F.max(F.col("rank") <= 3), F.lit(False)).alias("hit3"),
        (F.count_if(F.col("rank") <= 5) / F.count("*")).alias("recall5"))
    g = per_intent.groupBy(*by) if by else per_intent.groupBy()
    return g.agg(F.count("*").alias("gold_intents"), pct("hit3").alias("hit_at_3_pct"),
                 F.round(100 * F.avg("recall5"), 1).alias("recall_at_5_pct"))


def key_fact_recall(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """``answers(turn_key, text)``, ``facts(turn_key, fact)`` -> one row per fact with ``found``.

    A turn may have several answer texts (its cited passages, a handful): a fact is found in any of them.
    """
    texts = answers.groupBy("turn_key").agg(F.collect_list("text").alias("texts"))
    return facts.join(texts, "turn_key", "left").select("turn_key", "fact", F.expr(
        f"coalesce(exists(texts, t -> coalesce(contains({norm_fact('t')}, {norm_fact('fact')}), false)), false)").alias("found"))


def citation_precision(cites: DataFrame, gold: DataFrame) -> DataFrame:
    """Mean share of a turn's distinct citations that are gold."""
    c = cites.select("turn_key", "label").distinct()
    g = gold.select("turn_key", "label").distinct().withColumn("ok", F.lit(1))
    per = c.join(g, ["turn_key", "label"], "left").groupBy("turn_key").agg(
        (F.count("ok") / F.count("*")).alias("p"))
    return per.agg(F.count("*").alias("turns"), F.round(100 * F.avg("p"), 1).alias("citation_precision_pct"))


def matching_size(edges: str) -> Column:
    """Maximum bipartite matching of array<array<int>>: our intents -> the gold intents they hit."""
    @F.pandas_udf("int")
    def match(col: pd.Series) -> pd.Series:
        def size(adj) -> int:
            owner: dict[int, int] = {}
            for start in range(len(adj)):
                # breadth-first search for a free gold intent, then flip the path to it
                came, queue, free = {}, [start], None
                for u in queue:
                    for v in adj[u]:
                        v = int(v)
                        if v in came:
                            continue
                        came[v] = u
                        if v not in owner:
                            free = v
                            break
                        queue.append(owner[v])
                    if free is not None:
                        break
                back = {u: v for v, u in owner.items()}
                while free is not None:
                    u = came[free]
                    owner[free], free = u, (back.get(u) if u != start else None)
            return len(owner)
        return col.map(size)
    return match(F.col(edges))


def multi_intent(turns: DataFrame) -> DataFrame:
    """G3: ``turns(turn_key, edges array<array<int>>, answerable)``, as coded and by the documented rule of two."""
    m = turns.withColumn("m", matching_size("edges"))
    need = F.least(F.lit(2), F.col("answerable"))
    return m.select("turn_key", "answerable", "m",
                    ((F.col("m") >= need) & (need >= 1)).alias("g3_as_coded"),
                    F.when(F.col("answerable") >= 2, F.col("m") >= 2).alias("g3_strict"),
                    (F.size("edges") >= 2).alias("detected_2plus"),
                    F.round(F.col("m") / F.col("answerable"), 6).alias("isolated"))


def previous_answer(turns: DataFrame, session: str = "session_id", order: str = "turn") -> DataFrame:
    """Adds the version of the latest earlier answering turn (``prev_version``, 0 for none).

    Versions only grow within a session, so the latest earlier one is the running maximum; it is
    taken per block of turns first, so long sessions spread over tasks.
    """
    b = turns.withColumn("_b", F.floor(F.col(order) / 4096).cast("long"))
    v = F.when(F.col("kind").isin("retrieval", "refinement"), F.col("version"))
    b = b.withColumn("_v", v)
    earlier = Window.partitionBy(session, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy(session).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    top = b.groupBy(session, "_b").agg(F.max("_v").alias("_m")).withColumn("_before", F.max("_m").over(blocks)).drop("_m")
    return (b.withColumn("_in", F.max("_v").over(earlier)).join(top, [session, "_b"])
            .withColumn("prev_version", F.coalesce("_in", "_before", F.lit(0))).drop("_b", "_v", "_in", "_before"))


def refinement(turns: DataFrame) -> DataFrame:
    """G5: ``turns(type, kind, version, prev_version, parent_version, mode, n_kept, n_queries, n_repeated)``."""
    versioned = ((F.col("kind") == "refinement") & (F.col("version") == F.col("prev_version") + 1)
                 & (F.col("parent_version") == F.col("prev_version")))
    continuity = versioned & (F.col("mode") == "refine") & (F.col("n_kept") > 0)
    delta = (F.col("kind") == "refinement") & (F.col("n_queries") <= 4) & (F.col("n_repeated") == 0)
    return turns.filter(F.col("type") == "refinement").agg(
        F.count("*").alias("g5_turns"), pct(versioned).alias("versioned_pct"), pct(continuity).alias("continuity_pct"),
        pct(delta).alias("delta_only_pct"), pct(continuity & delta).alias("g5_pass_pct"))


def uncertainty(turns: DataFrame) -> DataFrame:
    """``turns(retrieval_required, unanswerable, n_intent_flags, n_coverage_notes)``."""
    any_flag = F.col("n_intent_flags") + F.col("n_coverage_notes") > 0
    need, un = F.col("retrieval_required"), F.col("unanswerable")
    return turns.agg(pct(F.when(need & un, any_flag)).alias("unanswerable_flagged_pct"),
                     pct(F.when(need & ~un, F.col("n_intent_flags") > 0)).alias("false_uncertainty_pct"),
                     pct(F.when(need & ~un, F.col("n_coverage_notes") > 0)).alias("coverage_notes_pct"))


def threshold_sweep(scores: DataFrame, low: int = -12, high: int = 12) -> DataFrame:
    """For thresholds low/2 .. (high-1)/2: how many scores fall on their right side.

    ``scores(score, positive)`` is first counted into half-unit steps, so the sweep runs over a few
    dozen counts whatever the number of scores.
    """
    step = F.least(F.greatest(F.floor(F.col("score") * 2), F.lit(low - 1)), F.lit(high)).cast("int")
    bins = scores.groupBy(step.alias("bin")).agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    packed = bins.agg(F.collect_list(F.struct("bin", "p", "n")).alias("b"))        # at most high - low + 2 entries
    total = "aggregate(filter(b, x -> {}), 0L, (s, x) -> s + x.{})"
    return packed.select("b", F.explode(F.sequence(F.lit(low), F.lit(high - 1))).alias("k")).select(
        (F.col("k") / 2).alias("threshold"),
        F.expr(f"{total.format('x.bin >= k', 'p')} + {total.format('x.bin < k', 'n')}").alias("correct"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    return sweep.agg(F.min_by("threshold", F.struct(-F.col("correct"), F.col("threshold"))).alias("threshold"),
                     F.max("correct").alias("correct"))


def summary_pivot(metrics: DataFrame, configs: list[str]) -> DataFrame:
    """``metrics(metric, config, value)`` -> one row per metric, one column per configuration."""
    return metrics.groupBy("metric").pivot("config", configs).agg(F.first("value"))


def gate_verdicts(metrics: DataFrame) -> DataFrame:
    """``metrics(config, gate, value, fabricated)`` against the fixed targets; G1 is not measured here."""
    target = F.expr("map(" + ", ".join(f"'{g}', {v}D" for g, v in V.GATE_TARGETS.items()) + ")[gate]")
    ok = F.when(F.col("gate") == "G4", (F.col("value") >= target) & (F.coalesce("fabricated", F.lit(0)) == 0)).otherwise(
        F.col("value") >= target)
    return metrics.select("config", "gate", target.alias("target"), "value",
                          F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail").alias("verdict"))


def gold_misses(evidence: DataFrame, gold: DataFrame, k: int = 3) -> DataFrame:
    """Error analysis: gold intents none of whose labels is in the first k."""
    top = evidence.filter(F.col("rank") <= k).select("turn_key", "label").distinct()
    hit = gold.join(top, ["turn_key", "label"], "left_semi").select("turn_key", "intent").distinct()
    return gold.select("turn_key", "intent").distinct().join(hit, ["turn_key", "intent"], "left_anti")
