"""Turn assembly with timers, the session store, and containment joins."""
import json
import os
import tempfile

import numpy as np

from talkweave.operators.containment import containment_join
from talkweave.sources.session_store import SessionStore, as_of, history
from talkweave.streaming.turns import heard

CHUNKS = "session_id string, turn int, seq int, t double, at timestamp, text string, cumulative boolean, is_end boolean"


class Feed:
    """Files of chunks, read one run after the other by a query that goes on from its checkpoint."""

    def __init__(self, spark, **how):
        self.spark, self.root, self.n, self.how = spark, tempfile.mkdtemp(prefix="run-"), 0, how
        os.mkdir(f"{self.root}/in")

    def __call__(self, *rows):
        with open(f"{self.root}/in/{self.n}.json", "w") as f:
            for session, turn, seq, at, text, *end in rows:
                f.write(json.dumps({"session_id": session, "turn": turn, "seq": seq, "t": float(at), "at": f"2026-01-01T{at // 3600:02d}:{at // 60 % 60:02d}:{at % 60:02d}Z",
                                    "text": text, "cumulative": "cum" in end, "is_end": "end" in end}) + "\n")
        self.n += 1
        out = []
        chunks = self.spark.readStream.schema(CHUNKS).json(f"{self.root}/in")
        q = heard(chunks, **self.how).writeStream.option("checkpointLocation", f"{self.root}/checkpoint").foreachBatch(
            lambda df, _: out.extend(df.collect())).trigger(availableNow=True).start()
        q.awaitTermination()
        return [(r["session_id"], r["turn"], r["seq"], r["text"], r["complete"]) for r in sorted(out, key=lambda r: (r["session_id"], r["turn"], r["seq"]))]


def test_turns_in_any_order_end_once(spark):
    feed = Feed(spark, silence_s=30, idle_s=600)
    assert feed(("a", 1, 0, 0, "one"), ("a", 1, 1, 1, "two"), ("b", 1, 1, 1, "second")) == [("a", 1, 0, "one", False), ("a", 1, 1, "one two", False)]
    # repeated chunks change nothing, the gap of b is closed, a ends
    assert feed(("a", 1, 1, 1, "two"), ("a", 1, 2, 2, "three", "end"), ("b", 1, 0, 2, "first")) == [
        ("a", 1, 2, "one two three", True), ("b", 1, 0, "first", False), ("b", 1, 1, "first second", False)]
    # after the end: late and repeated chunks are nothing, the next turn is one
    assert feed(("a", 1, 3, 3, "late"), ("a", 1, 2, 3, "three", "end"), ("a", 2, 0, 3, "next", "end")) == [("a", 2, 0, "next", True)]
    assert feed(("b", 1, 4, 4, "all of it", "cum"), ("b", 1, 5, 5, "end", "end")) == [("b", 1, 4, "all of it", False), ("b", 1, 5, "all of it end", True)]


def test_silence_ends_turns_and_sessions(spark):
    feed = Feed(spark, silence_s=30, idle_s=600)
    feed(("a", 1, 0, 0, "one"), ("a", 1, 2, 1, "three"), ("b", 1, 0, 5, "spoken", "end"))
    # time passes in another session: what a has said stands, without its gap
    assert feed(("c", 1, 0, 60, "x")) + feed(("c", 1, 1, 61, "y")) == [
        ("a", 1, 2, "one three", False), ("a", 1, 2, "one three", True), ("c", 1, 0, "x", False), ("c", 1, 1, "x y", False)]
    assert feed(("a", 1, 1, 62, "two")) == []                     # its turn is over
    feed(("c", 2, 0, 900, "later"))
    feed(("c", 2, 1, 901, "later"))
    # the state of a and b is gone, so the same turn number starts anew
    got = feed(("b", 1, 0, 902, "again", "end"), ("a", 1, 0, 902, "again"))
    assert ("b", 1, 0, "again", True) in got and ("a", 1, 0, "again", False) in got


STATE = "session_id string, ordinal int, version int, answer_text string, at_ms long"


def test_store_reads_latest_rows_and_versions(spark):
    rows = lambda *r: spark.createDataFrame(list(r), STATE)
    store = SessionStore(spark, tempfile.mkdtemp(prefix="run-"), STATE, every=3, buckets=4)
    keys = spark.createDataFrame([("a",), ("b",), ("nobody",)], "session_id string")
    got = lambda before: {r["session_id"]: (r["version"], r["answer_text"]) for r in store.latest(keys, before).collect()}
    assert got(0) == {}
    store.put(rows(("a", 1, 1, "a1", 10), ("b", 1, 1, "b1", 10), ("c", 1, 1, "c1", 10)), 0)
    store.put(rows(("a", 2, 2, "a2", 20), ("a", 3, 2, "a2", 21)), 1)                     # two turns of a session in one batch
    assert got(1) == {"a": (1, "a1"), "b": (1, "b1")} and got(2) == {"a": (2, "a2"), "b": (1, "b1")}
    store.put(rows(("a", 4, 3, "a3", 30)), 2)
    store.put(rows(("a", 4, 3, "a3 again", 30)), 2)                                       # a batch that is repeated
    store.put(rows(("c", 2, 2, "c2", 40)), 3)
    assert not store.snapshot(2) and store.snapshot(3, horizon_ms=15)                     # b has been silent too long
    assert got(4) == {"a": (3, "a3 again")} and got(3) == {"a": (3, "a3 again"), "b": (1, "b1")}
    store.put(rows(("b", 2, 1, "new b", 50)), 4)
    assert got(5) == {"a": (3, "a3 again"), "b": (1, "new b")}
    versions = store.history()
    seen = lambda k: {r["session_id"]: r["answer_text"] for r in as_of(versions, k).collect()}
    assert seen(1) == {"a": "a1", "b": "b1", "c": "c1"} and seen(3) == {"a": "a2", "b": "b1", "c": "c2"} and seen(9)["a"] == "a3 again"
    ends = {(r["session_id"], r["version"]): (r["valid_from"], r["valid_to"]) for r in versions.collect()}
    assert ends == {("a", 1): (1, 2), ("a", 2): (2, 4), ("a", 3): (4, None), ("b", 1): (1, None), ("c", 1): (1, 2), ("c", 2): (2, None)}


def test_store_writes_touched_sessions_only(spark):
    store = SessionStore(spark, tempfile.mkdtemp(prefix="run-"), STATE, buckets=8)
    store.put(spark.range(1000).selectExpr("concat('s', id) session_id", "1 ordinal", "1 version", "'x' answer_text", "id at_ms"), 0)
    store.put(spark.createDataFrame([("s5", 2, 2, "y", 7)], STATE), 1)
    assert spark.read.parquet(f"{store.root}/changes/batch=1").count() == 1
    one = spark.createDataFrame([("s5",)], "session_id string")
    plan = store.latest(one, 2)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1][:200]
    assert store.latest(one, 2).first()["answer_text"] == "y"


def test_containment_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(12)]
    some = lambda n, most: [(int(rng.integers(0, 6)), i, [str(x) for x in rng.choice(words, rng.integers(0, most))]) for i in range(n)]
    small, large = some(120, 4), some(150, 9)
    small.append((1, 900, ["nowhere"]))
    small.append((1, 901, None))
    got = containment_join(spark.createDataFrame(small, "k int, i int, items array<string>"), spark.createDataFrame(large, "k int, j int, items array<string>"), ["k"], "i", "j")
    want = {(k, i, j) for k, i, a in small for m, j, b in large if k == m and set(a or []) <= set(b)}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert history(spark.createDataFrame([], STATE)).count() == 0
