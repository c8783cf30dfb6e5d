import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from talkweave.functions import text as T
from talkweave.operators import answer as A
from talkweave.operators import dialogue as D
from talkweave.operators import fusion, gate, lexical, metrics, telemetry, timeline
from talkweave.operators.dense import dense_topk
from talkweave.plans.layout import blocked_position


def test_dense_topk_matches_brute_force_in_both_layouts(spark):
    rng = np.random.default_rng(5)
    c = rng.normal(size=(300, 8)).astype(np.float32)
    c[50:150] = c[7]                                   # a third of the rows are copies
    q = rng.normal(size=(9, 8)).astype(np.float32)
    cdf = spark.createDataFrame([(f"c{i:03d}", v.tolist()) for i, v in enumerate(c)], "chunk_id string, vec array<float>").repartition(5)
    qdf = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)], "qkey string, vec array<float>")
    unit = lambda m: m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    s = np.round(unit(q) @ unit(c).T, 6)
    want = {(f"q{i}", f"c{j:03d}", r + 1) for i in range(9)
            for r, j in enumerate(sorted(range(300), key=lambda j: (-s[i, j], j))[:20])}
    for limit in (64 << 20, 200):
        got = {(r["qkey"], r["chunk_id"], r["rank"]) for r in dense_topk(qdf, cdf, 20, broadcast_bytes=limit).collect()}
        assert got == want


def test_bm25_scan_equals_join(spark):
    rng = random.Random(3)
    docs = [(f"c{i}", [rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))]) for i in range(60)]
    chunks = spark.createDataFrame(docs, "chunk_id string, tokens array<string>")
    post = lexical.postings(chunks)
    size = lexical.corpus_size(chunks).first()
    terms = lexical.term_table(post, size["n"])
    q = spark.createDataFrame([("q1", "a"), ("q1", "b"), ("q2", "h"), ("q2", "zz")], "qkey string, term string").join(terms, "term")
    a = lexical.bm25_topk(q, post, size["avgdl"], 7).select("qkey", "chunk_id", "score", "rank")
    b = lexical.bm25_topk_scan(q, chunks, size["avgdl"], 7).select("qkey", "chunk_id", "score", "rank")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert all(r["score"] > 0 for r in b.collect())


def test_rrf_ignores_input_order(spark):
    rows = [("q", 0, "a", 1), ("q", 0, "b", 2), ("q", 0, "c", 3)]
    ddl = "qkey string, variant int, chunk_id string, rank int"
    one = fusion.rrf(spark.createDataFrame(rows, ddl), spark.createDataFrame(rows[::-1], ddl))
    two = fusion.rrf(spark.createDataFrame(rows[::-1], ddl), spark.createDataFrame(rows, ddl))
    key = lambda df: sorted((r["chunk_id"], r["rrf"]) for r in df.collect())
    assert key(one) == key(two)
    assert dict(key(one))["a"] == 2 / 61


def test_virtual_worker_recurrence(spark):
    rng = random.Random(1)
    jobs = [(f"s{s}", i, rng.uniform(0, 500), rng.uniform(0, 30)) for s in range(3) for i in range(60)]
    df = spark.createDataFrame(jobs, "session_id string, seq int, t double, cost double")
    got = {(r["session_id"], r["seq"]): r["t_end"] for r in timeline.virtual_worker(df, "session_id", "t", "cost", "seq", 50.0).collect()}
    for s in range(3):
        free = 0.0
        for _, i, t, c in sorted((j for j in jobs if j[0] == f"s{s}"), key=lambda j: (j[2], j[1])):
            free = max(t, free) + c
            assert abs(got[(f"s{s}", i)] - free) < 1e-6


def test_blocked_position(spark):
    df = spark.createDataFrame([("hot", i) for i in range(100)] + [("cold", 5)], "k string, o int")
    got = sorted((r["k"], r["o"], r["p"]) for r in blocked_position(df, "k", "o", "p", block=16).collect())
    assert got == [("cold", 5, 1)] + [("hot", i, i + 1) for i in range(100)]


def test_matching_size(spark):
    def brute(adj):
        golds = sorted({v for a in adj for v in a})
        best = 0
        for k in range(len(adj), 0, -1):
            for us in itertools.combinations(range(len(adj)), k):
                for vs in itertools.permutations(golds, k):
                    if all(v in adj[u] for u, v in zip(us, vs)):
                        return k
        return best
    rng = random.Random(9)
    cases = [[rng.sample(range(4), rng.randint(0, 3)) for _ in range(rng.randint(1, 4))] for _ in range(40)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, edges array<array<int>>")
    got = {r["i"]: r["m"] for r in df.select("i", metrics.matching_size("edges").alias("m")).collect()}
    assert got == {i: brute(c) for i, c in enumerate(cases)}


def test_nearest_rank_rounds_half_even(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)], "g string, v double")
    r = telemetry.nearest_rank(df, ["g"], "v", {"p50": 0.5}).first()
    assert r["p50"] == 3.0 and r["n"] == 4            # rank 1.5 goes to the even 2


def test_trace_coverage_flags(spark):
    ev = [("s", "t", e, 1.0, 1.0, e == "turn_completed") for e in
          ("turn_started", "chunk_received", "controller_decision", "answer_version", "grounding_check", "turn_completed")]
    ev += [("s", "u", "turn_started", 1.0, 1.0, False), ("s", "u", "retrieval_started", 1.0, None, False)]
    df = spark.createDataFrame(ev, "session_id string, turn_id string, event string, t_stream double, t_wall double, has_cost boolean")
    got = {r["turn_id"]: r["missing"] for r in telemetry.trace_coverage(df).collect()}
    assert got["t"] == [] and "retrieval_completed" in got["u"] and "timestamps" in got["u"]


def _understood(spark, rows, terms=()):
    df = spark.createDataFrame(rows, "turn_key string, text string, has_prev boolean, prev_topic array<string>")
    vocab = spark.createDataFrame([(t, 0.6, False) for t in terms] or [("x", 0.1, False)], "term string, salience double, is_proper boolean")
    n = D.with_vocabulary(D.normalise(df), vocab, "turn_key")
    return n, D.clauses(n)


def test_compound_utterance_is_decomposed(spark):
    said = ("So um I need to plan a customer workshop in Pune for about thirty people, and I also need the cancellation policy "
            "and, you know, whatever catering options there are.")
    _, c = _understood(spark, [("t", said, False, [])], ["workshop", "cancellation", "policy", "cater"])
    q = {r["n"]: r for r in D.subqueries(c).collect()}
    assert len(q) == 3
    assert q[1]["text"] == "room or venue capacity for 30 people: customer workshop in Pune" and q[1]["is_anchor"]
    assert q[2]["text"] == "cancellation policy Pune" and q[2]["alt"] == "cancellation policy"
    assert "pune" in q[3]["keywords"] and "cater" in q[3]["keywords"]


def test_rule_gate(spark):
    rows = [("new", "What is the travel reimbursement rule?", False, []),
            ("bullets", "Can you repeat that in two bullets?", True, ["travel"]),
            ("thanks", "okay perfect, thanks, that's really helpful", True, ["travel"]),
            ("late", "Oh wait, actually it's going to be around fifty people, not thirty.", True, ["travel"])]
    n, c = _understood(spark, rows, ["travel", "rule"])
    got = {r["turn_key"]: r["label"] for r in gate.rule_gate(n, c).collect()}
    assert got == {"new": "retrieval", "bullets": "presentation", "thanks": "chitchat", "late": "refinement"}


def test_near_duplicate_queries_merge_greedily(spark):
    rows = [("t", 1, "hotel cap Pune", [1.0, 0.0]), ("t", 2, "hotel cap in Pune", [1.0, 0.01]), ("t", 3, "visa", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "k string, n int, origin string, vec array<float>")
    got = {r["n"]: r["owner"] for r in D.merge_near_duplicates(df, "k").collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_attribute_gap(spark, fixture_index):
    rows = [("a", "Is there catering at Hill View?", "catering at Hill View"), ("b", "Is there parking at Lake House?", "parking Lake House")]
    intents = spark.createDataFrame(rows, "ikey string, origin string, text string")
    ev = spark.createDataFrame([("a", "Doc_02§1", 1), ("b", "Doc_01§1", 1)], "ikey string, chunk_id string, use_rank int")
    got = {r["ikey"]: r["reason"] for r in A.attribute_gaps(intents, ev, fixture_index).collect()}
    assert got == {"a": "Hill View, Pune does not mention cater"}


def test_coverage_gap(spark):
    d = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    ent = d([("s", "A"), ("s", "B"), ("s", "C")], "akey string, doc_id string")
    asp = d([("s", "food")], "akey string, ikey string")
    ev = d([("food", "A")], "ikey string, doc_id string")
    words = d([(x, w) for x in "AB" for w in ("overview", "capacity")] + [("C", "history")], "doc_id string, word string")
    best = d([("food", "B", -3.0), ("food", "C", -3.0)], "ikey string, doc_id string, score double")
    got = [(r["ikey"], r["doc_id"]) for r in A.coverage_gaps(ent, asp, ev, words, best).collect()]
    assert got == [("food", "B")]                      # C is no sibling, A is covered


def test_threshold_sweep(spark):
    s = [(-2.0, False), (0.4, False), (0.5, True), (3.0, True), (40.0, True), (-40.0, False)]
    df = spark.createDataFrame(s, "score double, positive boolean")
    got = {r["threshold"]: r["correct"] for r in metrics.threshold_sweep(df).collect()}
    assert got == {t / 2: sum(p == (x >= t / 2) for x, p in s) for t in range(-12, 12)}
    assert T is not None and F is not None


def test_session_events_are_not_a_turn(spark):
    rows = [("s", None, "session_started", 0.0, 0.0, False)] + [
        ("s", "t1", e, 1.0, 1.0, e == "turn_completed") for e in (*telemetry.V.REQUIRED_EVENTS, *telemetry.V.RETRIEVAL_EVENTS)]
    df = spark.createDataFrame(rows, "session_id string, turn_id string, event string, t_stream double, t_wall double, has_cost boolean")
    r = telemetry.coverage_rate(telemetry.trace_coverage(df)).first()
    assert (r["turns"], r["complete"], r["coverage"]) == (1, 1, 1.0)


def test_percentiles_in_two_passes_are_exact(spark):
    rng = random.Random(4)
    values = {"a": [rng.gauss(0, 1) for _ in range(501)], "b": [3.0] * 40 + [1e9], "c": [2.5]}
    df = spark.createDataFrame([(g, x) for g, v in values.items() for x in v] + [("a", None)], "g string, v double")
    want = {g: (len(v), *(sorted(v)[round(q * (len(v) - 1))] for q in (0.0, 0.5, 0.95, 1.0))) for g, v in values.items()}
    for bins in (1024, 3):
        got = telemetry.nearest_rank(df, ["g"], "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}, bins).collect()
        assert {r["g"]: tuple(r)[1:] for r in got} == want


def test_topk_in_two_levels_is_the_same(spark, monkeypatch):
    from talkweave.operators import topk
    rng = np.random.default_rng(9)
    c = spark.createDataFrame([(f"c{i:03d}", v.tolist()) for i, v in enumerate(rng.normal(size=(120, 6)))], "chunk_id string, vec array<float>").repartition(9)
    q = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(rng.normal(size=(4, 6)))], "qkey string, vec array<float>")
    one = sorted(map(tuple, dense_topk(q, c, 7).collect()))
    monkeypatch.setattr(topk, "MIDDLE_LEVEL", 2)
    assert sorted(map(tuple, dense_topk(q, c, 7).collect())) == one


def test_zero_vectors_are_like_nothing(spark):
    """Two queries without a vector are merged by no cosine, and nothing divides by zero."""
    from talkweave.operators import dialogue as D
    from talkweave.plans.replay import cap_queries
    rows = [("t", n, "refund policy terms", [0.0, 0.0]) for n in (1, 2)] + [("t", 3, "refund policy terms", [1.0, 0.0]), ("t", 4, "refund policy terms", [1.0, 0.0])]
    q = spark.createDataFrame(rows, "k string, n int, origin string, vec array<float>")
    assert {r["n"]: r["owner"] for r in D.merge_near_duplicates(q, "k").collect()} == {1: 1, 2: 2, 3: 3, 4: 3}
    blank = spark.createDataFrame([("t", n, "of the", "of the", ["x"], n == 1, None, "") for n in range(1, 7)],
                                  "k string, n int, text string, origin string, keywords array<string>, is_anchor boolean, people int, alt string")
    assert cap_queries(blank, "k", 4, 16).count() == 4
