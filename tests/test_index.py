"""The stored index: which tables are written when, and postings of repeated and null chunk ids."""
import os
from collections import Counter

import numpy as np
import pytest

from talkweave.operators import grounding, lexical
from talkweave.operators.dense import embed_tokens, signed_bucket
from talkweave.sources import corpus as C
from talkweave.sources import gate_store, index_store


def written(path):
    return sorted(n.split("-")[0] for n in os.listdir(path) if not n.startswith("manifest"))


def test_tables_are_written_when_they_are_read(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"The Harbour office opens early. It closes at {i} today, says the clerk.", "s") for i in range(6)], "doc_id long, text string, source string")
    index = index_store.load_or_build(spark, C.table_chunks(docs), "few", str(tmp_path))
    assert written(index.path) == ["chunks"] and index.n_chunks == 6
    assert index.terms.filter("term = 'harbour'").first()["df"] == 6 and written(index.path) == ["chunks", "terms"]
    assert index.postings.count() == sum(len(set(r["tokens"])) for r in index.chunks.collect()) and index.sentences.count() == 12
    assert written(index.path) == ["chunks", "postings", "sentences", "terms"]
    again = index_store.load_or_build(spark, C.table_chunks(docs), "few", str(tmp_path))
    assert again.path == index.path and again.sentences.count() == 12 and len(written(index.path)) == 4


@pytest.mark.parametrize("ids", [["a", "b", "c", "d"], ["a", "a", None, None]])
def test_postings_add_up_rows_of_one_id(spark, ids):
    tokens = [["x", "y", "x"], ["x", "z"], [], ["x", "x"]]
    chunks = spark.createDataFrame(list(zip(ids, tokens)), "chunk_id string, tokens array<string>").repartition(2)
    want = Counter((t, i) for i, ts in zip(ids, tokens) for t in ts)
    rows = lexical.postings(chunks).collect()
    assert {(r["term"], r["chunk_id"]): r["tf"] for r in rows} == want and len(rows) == len(want)
    assert sorted(map(tuple, lexical.terms_of(chunks).collect()), key=repr) == sorted(((i, t) for t, i in want), key=repr)
    plan = lexical.postings(chunks)._jdf.queryExecution().toString()
    assert ids[0] == ids[1] or "Aggregate" not in plan          # nothing is shuffled unless ids repeat


def test_vectors_are_signed_counts(spark):
    rows = [["river", "river", "tower"], [], ["market", "river"], None]
    got = [r["v"] for r in spark.createDataFrame([(r,) for r in rows], "t array<string>").coalesce(1).select(embed_tokens("t", 8).alias("v")).collect()]
    for tokens, vec in zip(rows, got):
        want = np.zeros(8)
        for t in tokens or []:
            b = signed_bucket(t, 8)
            want[abs(b) - 1] += np.sign(b)
        assert vec == want.tolist()


@pytest.mark.parametrize("common", [0, 3, 100])
def test_topics_are_the_four_rarest_terms(spark, common):
    held = {f"c{i}": [f"term{chr(97 + k)}" for k in range(8) if i % (k + 1) == 0] + ["abc", "x1234"] for i in range(24)}
    df = Counter(t for ts in held.values() for t in ts)
    postings = spark.createDataFrame([(t, c) for c, ts in held.items() for t in ts], "term string, chunk_id string").repartition(3)
    terms = spark.createDataFrame(list(df.items()), "term string, df long")
    want = set()
    for ts in held.values():
        r = sorted((df[t], t) for t in ts if t.startswith("term"))[:4]
        if len(r) == 4:
            want.add((f"{r[0][1]} {r[1][1]}", f"{r[2][1]} {r[3][1]}"))
    got = gate_store.topics(postings, terms, common)
    assert want and set(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan                            # a chunk's common terms are cut to four before the shuffle


def test_tokens_of_chunks_are_not_shuffled_after_they_met_a_claim(spark):
    chunks = spark.createDataFrame([("A §1", "A", "1", "opens at 8 daily", ["open", "8", "daili"]), ("A §2", "A", "2", "closes at 20", ["clos", "20"])],
                                   "label string, doc_title string, section_title string, text string, tokens array<string>")
    rows = [("k1", "a", "open open close 8 and 20 [A §1, A §2]", None), ("k2", "a", "open close [A §1]", None), ("k3", "a", "open [A §1, B §9]", None),
            ("k4", "a", "open 21 [A §1]", None), ("k5", "a", "[A §2]", None), ("k6", "a", "nothing cited", None)]
    claims = spark.createDataFrame(rows, "claim_id string, answer_id string, text string, citations array<string>")
    seen = spark.createDataFrame([("a", "A §1")], "answer_id string, label string")
    checked = grounding.verify(claims, chunks, seen)
    got = {r["claim_id"]: (r["score"], r["supported"], r["supported_strict"], r["fabricated_ids"], r["unretrieved_ids"]) for r in checked.collect()}
    assert got == {"k1": (1.0, True, False, [], ["A §2"]), "k2": (0.5, False, False, [], []), "k3": (1.0, False, False, ["B §9"], []),
                   "k4": (0.0, False, False, [], []), "k5": (1.0, True, False, [], ["A §2"]), "k6": (0.0, False, False, [], [])}
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    top = plan[:plan.index("Join")]                              # what is grouped: no tokens of chunks
    assert "s_tokens" not in top and "c_tokens" not in top
