import json
import tempfile

import pytest
from pyspark.sql import functions as F

from talkweave.operators import telemetry
from talkweave.plans.replay import replay_all
from talkweave.plans.trace import trace
from talkweave.plans.turn_output import turn_output
from talkweave import fixed_values as V
from talkweave.sources import corpus as C
from talkweave.sources.session_store import as_of, history
from talkweave.sources.transcripts import chunk_rows, read_sessions
from talkweave.sources.turn_files import read_turns, violations, write_turns
from talkweave.streaming.sessions import answer_stream, partial_transcripts, read_chunks

SESSIONS = [{"session_id": "workshop", "turns": [
    {"turn_id": "t1", "utterance": "So um I need to plan a workshop in Pune for about thirty people, and I also need the "
                                   "cancellation policy and, you know, whatever catering options there are."},
    {"turn_id": "t2", "utterance": "Oh wait, actually it's going to be around fifty people, not thirty."},
    {"turn_id": "t3", "utterance": "Can you repeat that in two bullets?"}]},
    {"session_id": "travel", "turns": [
        {"turn_id": "t1", "utterance": "Can you summarize the travel reimbursement rule for an employee trip?"},
        {"turn_id": "t2", "chunks": [{"t": 0.0, "text": "okay perfect,"}, {"t": 0.7, "text": "thanks, that's helpful"}]}]}]


@pytest.fixture(scope="module")
def sessions(spark):
    d = tempfile.mkdtemp(prefix="run-")
    with open(f"{d}/s.jsonl", "w") as f:
        f.writelines(json.dumps(s) + "\n" for s in SESSIONS)
    return read_sessions(spark, d).cache()


@pytest.fixture(scope="module")
def replayed(sessions, fixture_index):
    return replay_all(sessions.select("session_id", "turn", "text", "parts"), fixture_index)


@pytest.fixture(scope="module")
def records(replayed):
    return {(r["session_id"], r["turn_id"]): r for r in replayed.records.collect()}


def test_transcript_times_grow(sessions):
    for r in sessions.collect():
        times = [p["t"] for p in r["parts"]]
        assert times == sorted(set(times)) and r["end_t"] == pytest.approx(times[-1] + 0.35, abs=1e-6)


def test_compound_turn(records):
    r = records[("workshop", "0")]
    assert r["kind"] == "retrieval" and r["version"] == 1 and len(r["queries"]) == 3
    assert any(c.startswith("Doc_01") for c in r["citations"])
    assert "room or venue capacity for 30 people" in r["queries"][0]


def test_late_detail_refines(records):
    a, b = records[("workshop", "0")], records[("workshop", "1")]
    assert b["kind"] == "refinement" and b["version"] == a["version"] + 1 and b["parent_version"] == a["version"]
    assert b["retained"] and b["retired"] and len(b["queries"]) == 1
    assert set(b["retained"]) | set(b["retired"]) == set(a["added"]) and not set(b["added"]) & set(a["added"])
    assert "Still applies" in b["text"] and "Update" in b["text"]


def test_presentation_keeps_citations(records):
    b, p = records[("workshop", "1")], records[("workshop", "2")]
    assert p["kind"] == "presentation" and not p["retrieved"] and p["version"] == b["version"]
    assert sum(line.startswith("- ") for line in p["text"].split("\n")) == 2
    assert set(p["citations"]) <= set(b["citations"])


def test_small_talk_is_silent(records):
    r = records[("travel", "1")]
    assert r["kind"] == "chitchat" and r["text"] == "" and not r["retrieved"] and r["version"] == 1


def test_claims_are_grounded(records, fixture_index):
    labels = {r["label"] for r in fixture_index.chunks.select("label").collect()}
    for r in records.values():
        assert r["fabricated"] == 0 and r["support_rate"] >= 0.85 and set(r["citations"]) <= labels
    # the superseded rules are not cited while current ones answer
    assert not any(c.startswith("Doc_04") for r in records.values() for c in r["citations"])


def test_early_searches_are_reused(records):
    first = records[("workshop", "0")]
    assert first["dispatched"] >= 3 and first["reused"] >= 2 and first["first_retrieval_s"] < 8
    assert records[("travel", "1")]["dispatched"] == 0                           # small talk searches nothing
    assert records[("workshop", "2")]["dispatched"] == 0                         # nor does "repeat that in two bullets"


def test_versions_as_of_a_turn(replayed, records):
    versions = history(replayed.states)
    rows = {(r["session_id"], r["version"]): r for r in versions.collect()}
    assert (rows[("workshop", 1)]["valid_from"], rows[("workshop", 1)]["valid_to"]) == (1, 2) and rows[("workshop", 2)]["valid_to"] is None
    seen = lambda k: {r["session_id"]: r["answer_text"] for r in as_of(versions, k).collect()}
    assert seen(1)["workshop"] == records[("workshop", "0")]["text"] and seen(3)["workshop"] == records[("workshop", "1")]["text"]
    # notes end with the intent they belong to
    last = rows[("workshop", 2)]
    assert {n["iid"] for n in last["notes"]} <= {i["iid"] for i in last["intents"] if i["status"] == "active"}


def test_trace_of_the_replay_is_complete(replayed):
    t = trace(replayed).cache()
    assert telemetry.schema_violations(t).count() == 0
    r = telemetry.coverage_rate(telemetry.trace_coverage(t)).first()
    assert r["turns"] == 5 and r["coverage"] == 1.0
    for s in ("workshop", "travel"):
        rows = t.filter(F.col("session_id") == s).orderBy("seq").collect()
        assert [x["seq"] for x in rows] == list(range(1, len(rows) + 1))
        assert rows[0]["event"] == "session_started" and rows[-1]["event"] == "session_ended"
    kinds = {x["event"] for x in t.select("event").distinct().collect()}
    assert set(V.EVENT_TYPES) - kinds <= {"uncertainty_flag"}
    early = t.filter("event = 'turn_completed' AND turn_id = '0' AND session_id = 'workshop'").selectExpr("parse_json(payload) v").selectExpr(
        "variant_get(v, '$.early_retrieval', 'boolean') e", "variant_get(v, '$.speculative.reused', 'int') n").first()
    assert early["e"] and early["n"] >= 2


def test_turn_records_round_trip(spark, replayed, records, sessions):
    out = turn_output(replayed).cache()
    path = tempfile.mkdtemp(prefix="run-") + "/turns"
    write_turns(out, path)
    order = ["session_id", "turn_id"]
    assert read_turns(spark, path).orderBy(order).collect() == out.orderBy(order).collect()
    got = {(r["session_id"], r["turn_id"]): r for r in out.collect()}
    assert set(got) == set(records)
    for k, r in got.items():
        want = records[k]
        assert (r["kind"], r["text"], r["version"], r["citations"]) == (want["kind"], want["text"], want["version"], want["citations"])
        assert [q["text"] for q in r["sub_queries"]] == want["queries"]
        assert [u["message"] for u in r["uncertainty"]] == [u["message"] for u in want["uncertainty"]]
        assert (r["diff"] is not None) == (r["kind"] == "refinement") and r["gate"]["label"] in V.GATE_LABELS
    first, late, small_talk = got[("workshop", "0")], got[("workshop", "1")], got[("travel", "1")]
    assert first["early"] and first["latency"]["retrieval_lead_ms"] > 0 and {q["trigger"] for q in first["sub_queries"]} & {"multi_intent", "provisional"}
    assert late["diff"]["parent_version"] == first["version"] and set(late["diff"]["retired"]) == set(records[("workshop", "1")]["retired"])
    assert not small_talk["retrieved"] and small_talk["cost"]["cpu_ms"] == 0 and small_talk["intents"] == [] and small_talk["cost"]["answer_words"] == 0
    # chunks are what was heard, with its times
    for r in sessions.collect():
        o = got[(r["session_id"], str(r["turn"]))]
        assert [(c["t"], c["text"]) for c in o["chunks"]] == [(p["t"], p["text"].strip()) for p in r["parts"]]
        assert o["t_end"] == pytest.approx(r["end_t"], abs=1e-3)
    line = json.loads(spark.read.text(path).filter("value LIKE '%workshop%'").first()[0])
    assert all(isinstance(c, list) and isinstance(c[0], (int, float)) and isinstance(c[1], str) for c in line["chunks"])


def test_broken_records_are_not_written(spark, replayed):
    out = turn_output(replayed).limit(2).cache()
    path = tempfile.mkdtemp(prefix="run-") + "/turns"
    assert violations(out).count() == 0
    cases = {"unknown kind": out.withColumn("kind", F.lit("song")), "text is missing": out.withColumn("text", F.lit(None).cast("string")),
             "turn occurs twice": out.union(out), "negative version": out.withColumn("version", F.lit(-1)),
             "uncertainty without message": out.withColumn("uncertainty", F.expr("array(named_struct('message', CAST(NULL AS STRING), 'intent_id', '1', 'doc_id', 'd'))")),
             "unknown trigger": out.withColumn("sub_queries", F.expr("array(named_struct('qid', 'q', 'text', 't', 'keywords', '', 'trigger', 'whim', 'origin', '', 'alt', ''))"))}
    for rule, df in cases.items():
        with pytest.raises(ValueError, match=rule):
            write_turns(df, path)
    write_turns(out.limit(0), path)                               # nothing is a valid output
    assert read_turns(spark, path).count() == 0


def test_stream_equals_batch(spark, sessions, fixture_index, records):
    """Two batches that cut the first turn in the middle: what was searched in the first serves the answer in the second."""
    root = tempfile.mkdtemp(prefix="run-")
    rows = chunk_rows(sessions.filter("turn < 2")).withColumn("at", F.timestamp_seconds(F.lit(1e9) + F.col("t")))
    head = (F.col("turn") == 0) & (F.col("seq") < 8) & ~F.col("is_end")
    rows.filter(head).coalesce(1).write.json(f"{root}/in/a")
    q = answer_stream(read_chunks(spark, f"{root}/in/*"), fixture_index, f"{root}/out")
    q.awaitTermination()
    assert not q.exception() and spark.read.parquet(f"{root}/out/early/changes/batch=0").count() >= 1
    rows.filter(~head).coalesce(1).write.json(f"{root}/in/b")
    q = answer_stream(read_chunks(spark, f"{root}/in/*"), fixture_index, f"{root}/out")       # a restart from the checkpoint
    q.awaitTermination()
    got = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/out/records").collect()
    assert len(got) == 4
    for r in got:
        want = records[(r["session_id"], r["turn_id"])]
        assert (r["kind"], r["version"], r["text"], r["citations"]) == (want["kind"], want["version"], want["text"], want["citations"])
        assert (r["dispatched"], r["reused"]) == (want["dispatched"], want["reused"])


def test_cumulative_chunks(spark):
    rows = [("s", 1, 0, 0.0, "hello", False, False), ("s", 1, 1, 0.5, "hello there", True, False), ("s", 1, 2, 0.9, "friend", False, True)]
    df = spark.createDataFrame(rows, "session_id string, turn int, seq int, t double, text string, cumulative boolean, is_end boolean")
    r = partial_transcripts(df).first()
    assert r["text"] == "hello there friend" and r["complete"]


def test_corpus_directory(spark, fixture_index):
    rows = {r["chunk_id"]: r for r in fixture_index.chunks.collect()}
    assert len(rows) == 15 and rows["Faq§2"]["section"] == "2"
    assert rows["Doc_01§2"]["sentences"][1].startswith("Lotus Hall") and rows["Doc_04§1"]["demote"] == 1.0
    twice = fixture_index.chunks.select("chunk_id", "source").union(fixture_index.chunks.select("chunk_id", "source"))
    with pytest.raises(ValueError):
        C.reject_duplicate_ids(twice)
    errors = [tuple(r) for r in C.validation_errors(fixture_index.chunks.filter(F.col("doc_id") == "Doc_01")).collect()]
    assert errors == []


def test_searches_start_before_the_turn_ends(sessions, fixture_index):
    from talkweave.operators import speculation as X
    t = sessions.select(F.concat_ws("/", "session_id", "turn_id").alias("turn_key"), "parts", F.col("end_t").alias("t_end"))
    d = X.dispatches(t, fixture_index.terms).cache()
    got = {r["turn_key"]: r for r in X.early_turns(t, d).collect()}
    assert got["workshop/t1"]["early"] and got["workshop/t1"]["lead_ms"] > 1000
    keys = {r["query_key"] for r in d.filter("turn_key = 'workshop/t1'").collect()}
    assert any("cancellation" in k.split() and "policy" in k.split() for k in keys)
    assert got["travel/t2"]["searches"] == 0


def test_a_repeated_batch_gives_the_same_rows(spark, fixture_index):
    """A batch that runs again after a failure overwrites its own output, and reads the state of the batches before only."""
    from talkweave.streaming.sessions import TurnProcessor
    from talkweave.streaming.turns import HEARD_DDL
    root = tempfile.mkdtemp(prefix="run-")
    ask = "Can you summarize the travel reimbursement rule for an employee trip?"
    go = TurnProcessor(spark, fixture_index, root)
    rows = [("s", 1, 0, 0.0, 1000, ask, True, "chunk"), ("t", 1, 0, 0.0, 1000, "thanks, that's", False, None)]
    for _ in range(2):
        go(spark.createDataFrame(rows, HEARD_DDL), 0)
    got = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/records").collect()
    assert [(r["session_id"], r["turn_id"], r["version"]) for r in got] == [("s", "1", 1)]
    assert [(r["session_id"], r["version"], r["valid_from"], r["valid_to"]) for r in go.history().collect()] == [("s", 1, 1, None)]


def test_suffixes_in_any_case_and_bad_lines(spark):
    d = tempfile.mkdtemp(prefix="run-")
    with open(f"{d}/Doc_09_upper.MD", "w") as f:
        f.write("---\ndoc_id: Doc_09\ntitle: \"Upper\"\nstatus: current\n---\n\n# Upper\n\n## §1 One\nThe hall seats 40 people.\n")
    with open(f"{d}/more.JSONL", "w") as f:
        f.write(json.dumps({"doc_id": "", "id": "J1", "section": "", "text": "First record here."}) + "\n" + json.dumps({"id": "J1", "text": "Second record here."}) + "\n")
    got = {r["chunk_id"] for r in C.read_directory(spark, d).collect()}
    assert {"J1§1", "J1§2"} <= got and any(c.startswith("Doc_09") for c in got)
    lines = spark.createDataFrame([("x/a.jsonl", 0, "{not json"), ("x/a.jsonl", 10, '{"id": "a", "text": "t"}')], "path string, offset long, raw string")
    with pytest.raises(Exception, match="no JSON record"):
        C.jsonl_chunks(lines).collect()
