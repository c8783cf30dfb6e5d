"""The three gates: what they decide, how the fitted one is stored, and that replays and streams use the one that is set."""
import tempfile

import pytest
from pyspark.sql import functions as F

from talkweave import fixed_values as V
from talkweave.operators import dialogue as D
from talkweave.operators import gate as G
from talkweave.plans.replay import replay_all
from talkweave.settings import Settings
from talkweave.sources import gate_store as GS

DIM = Settings().embed_dim


@pytest.fixture(scope="module")
def weights(spark, fixture_index):
    return GS.fit(GS.training_rows(GS.topics(fixture_index.postings, fixture_index.terms)), fixture_index.terms, DIM)


def _gated(spark, index, rows, final=True):
    t = spark.createDataFrame(rows, "turn_key string, text string, has_prev boolean, prev_topic array<string>")
    n = D.with_vocabulary(D.normalise(t), index.terms, "turn_key")
    return G.rule_gate(n, D.clauses(n, "turn_key", final), "turn_key", final)


def test_training_rows_follow_the_topics(spark):
    rows = GS.training_rows(spark.createDataFrame([("hotel cap", "visa fee"), ("gym pass", "late bill")], "topic string, other string"))
    got = rows.collect()
    assert len(got) == 2 * len(GS.KINDS) and {r["label"] for r in got} == set(V.GATE_LABELS)
    assert not any("{" in r["text"] for r in got)
    for r in got:
        kind = next(k for k in GS.KINDS if k.name == r["kind"])
        assert r["has_prev"] == (kind.before is not None)
        assert r["prev_topic"] == {"topic": r["topic"], "other": r["other"], None: ""}[kind.before]
    assert got == rows.collect()                                  # the same rows each time
    assert GS.training_rows(spark.createDataFrame([], "topic string, other string")).count() == 0


def test_topics_are_the_rarest_words(spark):
    p = spark.createDataFrame([(t, "c") for t in ("alpha", "beta", "gamma", "delta", "omega", "x1", "of")] + [("alpha", "d"), (None, "d")], "term string, chunk_id string")
    terms = p.groupBy("term").agg(F.count("*").alias("df"))
    assert [tuple(r) for r in GS.topics(p, terms).collect()] == [("beta delta", "gamma omega")]


def test_held_out_topics_are_recognised(spark, fixture_index, weights):
    """Topics that were not fitted: those of the fixture that are held out, and words that it does not hold."""
    words = "parcel customs orchard pruning violin lessons harbour mooring vaccine schedule thesis binding".split()
    foreign = spark.createDataFrame([(f"{a} {b}", f"{b} {a}") for a, b in zip(words, words[1:])], "topic string, other string")
    own = GS.training_rows(GS.topics(fixture_index.postings, fixture_index.terms)).filter(GS.held_out())
    seen = GS.understood(own.unionByName(GS.training_rows(foreign)), fixture_index.terms)
    d = G.decide(seen, G.Gate("model", weights))
    right, n = d.agg(F.count_if(F.expr("label = gold")), F.count("*")).first()
    assert n >= 80 and right / n >= 0.9


def test_other_sentences_are_recognised(spark, fixture_index, weights):
    """Sentences that no training row holds."""
    said = [("who has to approve overtime", False, "retrieval"), ("when does the library close?", False, "retrieval"),
            ("could you tell me the rules on parking permits", False, "retrieval"), ("hey, what's the policy on pets", True, "retrieval"),
            ("oh wait, there will be sixty guests", True, "refinement"), ("actually I am travelling with two children", True, "refinement"),
            ("by the way it was a customer event", True, "refinement"), ("repeat that in four bullets please", True, "presentation"),
            ("can you make that shorter?", True, "presentation"), ("just the main points", True, "presentation"),
            ("brilliant, thank you so much", True, "chitchat"), ("hi there", False, "chitchat")]
    rows = [(str(k), t, p, ["travel", "rule"] if p else []) for k, (t, p, _) in enumerate(said)]
    got = {int(r["turn_key"]): r["label"] for r in G.decide(_gated(spark, fixture_index, rows), G.Gate("model", weights)).collect()}
    wrong = [(said[k][0], got[k]) for k in got if got[k] != said[k][2]]
    assert len(wrong) <= 3, wrong


def test_model_scores_equal_plain_arithmetic(spark, fixture_index, weights):
    import numpy as np
    rows = [("a", "what is the hotel cap in Pune?", False, []), ("b", "actually it is 50 people", True, ["hotel"]), ("c", "", True, []), ("d", "thanks", True, [])]
    x = G.cue_features(_gated(spark, fixture_index, rows)).withColumn("tok", F.split("norm", " "))
    feats = {r["turn_key"]: np.array(r["_x"]) for r in G._features(x, "tok", DIM).collect()}
    for r in G.model_gate(weights, x, "tok").collect():
        z = np.array(weights.rows) @ feats[r["turn_key"]] + np.array(weights.intercepts)
        e = np.exp(z - z.max())
        if not r["has_prev"]:
            e[[1, 2]] = 0
        assert np.allclose(r["probs"], e / e.sum(), atol=1e-9) and sum(r["probs"]) == pytest.approx(1)
        assert r["model_label"] == V.GATE_LABELS[int((e / e.sum()).argmax())]


def _leaning(to: str) -> G.Weights:
    """A gate that always says ``to``."""
    return G.Weights([[0.0] * (DIM + 14)] * 4, [9.0 if k == to else 0.0 for k in V.GATE_LABELS], DIM)


def test_three_gates_decide_differently(spark, fixture_index):
    rows = [("sure", "okay perfect, thanks, that's really helpful", True, ["travel"]),        # rule 0.9: the hybrid keeps it
            ("open", "what about the travel reimbursement rule?", True, ["travel", "reimbursement", "rule"]),   # rule 0.8: the model decides
            ("first", "travel reimbursement rule", False, [])]                                # nothing before: the rule decides, a follow-up is impossible
    g = _gated(spark, fixture_index, rows)
    got = {k: {r["turn_key"]: r["label"] for r in G.decide(g, G.Gate(k, _leaning("refinement"))).collect()} for k in ("rule", "model", "hybrid")}
    assert got["rule"] == {"sure": "chitchat", "open": "retrieval", "first": "retrieval"}
    assert got["model"]["sure"] == got["model"]["open"] == "refinement" and got["model"]["first"] != "refinement"
    assert got["hybrid"] == {"sure": "chitchat", "open": "refinement", "first": "retrieval"}
    assert G.decide(g, G.Gate("hybrid", _leaning("refinement"))).columns == g.columns


def test_hybrid_keeps_the_rule_when_the_model_is_unsure(spark, fixture_index):
    g = _gated(spark, fixture_index, [("open", "what about the travel reimbursement rule?", True, ["travel", "reimbursement", "rule"])])
    unsure = G.Weights([[0.0] * (DIM + 14)] * 4, [0.0, 0.5, 0.0, 0.0], DIM)
    assert G.decide(g, G.Gate("model", unsure)).first()["label"] == "refinement"
    assert G.decide(g, G.Gate("hybrid", unsure)).first()["label"] == "retrieval"


def test_model_waits_for_content(spark, fixture_index):
    g = _gated(spark, fixture_index, [("um", "so what is", True, [])], final=False)
    r = G.decide(g, G.Gate("model", _leaning("retrieval")), final=False).first()
    assert (r["label"], r["confidence"]) == ("undecided", 0.5)


def test_weights_are_stored_once(spark, fixture_index, monkeypatch):
    root = tempfile.mkdtemp(prefix="run-")
    assert GS.load(spark, GS.fingerprint("c", DIM), root) is None
    first = GS.load_or_train(spark, fixture_index, "c", root, DIM)
    monkeypatch.setattr(GS, "fit", lambda *a: pytest.fail("fitted again"))
    assert GS.load_or_train(spark, fixture_index, "c", root, DIM) == first
    assert len({GS.fingerprint(*a) for a in (("c", DIM), ("d", DIM), ("c", DIM + 1), ("c", DIM, 5))}) == 4


def test_settings_choose_the_gate():
    with pytest.raises(ValueError, match="none of"):
        G.choose(Settings(controller="dice"))
    with pytest.raises(ValueError, match="weights"):
        G.choose(Settings(controller="model"))
    assert G.choose(Settings()) is G.RULE and G.choose(Settings(controller="hybrid"), _leaning("chitchat")).kind == "hybrid"


def test_absent_labels_are_never_chosen(spark, fixture_index):
    rows = GS.training_rows(spark.createDataFrame([("hotel cap", "visa fee"), ("gym pass", "late bill")], "topic string, other string"))
    x = G.cue_features(GS.understood(rows, fixture_index.terms)).withColumn("tok", F.split("norm", " "))
    w = G.train_gate(x.filter("gold <> 'chitchat'"), "tok", DIM, "gold")
    assert len(w.rows) == 4 and x.count() == 16
    assert "chitchat" not in {r["model_label"] for r in G.model_gate(w, x, "tok").collect()}


def test_replay_uses_the_gate_of_the_settings(spark, fixture_index, weights):
    turns = spark.createDataFrame([("s", 0, "What is the travel reimbursement rule for an employee trip?")], "session_id string, turn int, text string")
    kind = lambda c, w=None: replay_all(turns, fixture_index, Settings(controller=c), w).records.first()["kind"]
    assert kind("rule") == kind("hybrid", _leaning("chitchat")) == kind("model", weights) == "retrieval"
    assert kind("model", _leaning("chitchat")) == "chitchat"
