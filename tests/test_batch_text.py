"""Batch helpers give what the expressions give, whole scores and sentences need no table of the corpus."""
import os

import pytest
from pyspark.sql import functions as F

from talkweave.functions import text as T
from talkweave.operators import lexical
from talkweave.operators.dense import embed_tokens, tokens_and_vector
from talkweave.plans import retrieval as R
from talkweave.settings import Settings
from talkweave.sources import corpus as C
from talkweave.sources import index_store

ODD = ["", None, " \n", "The hotel's café isn’t 2,00,000 or 1,234.50; it's §4 a1,000 x.5", "İstanbul KELVIN Kelvin’s ΟΔΟΣ ΣΑΣ don't can't they'd've we're'x",
       "running hopped buzzing falling passes classes boxes wishes matches ladies ties dies bus gas is axes uses sings rings ring red bed seed agreed",
       "stopped stopping planned missed missing tree trees these those rate rated rates create es ed ing 1990s 12,3 1.2.3 4,5.6 99s 007 naïve's na'ïve's o'll_ o'll",
       "𝒶𝓫c x́'s ǅ's a'sß a's1 b'd٣ \U0001d7d8's ﬁ's", " ".join(f"word{i}ing w{i}es {i},{i:03d}" for i in range(40))]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(list(enumerate(ODD)), "i long, text string").repartition(3)


def test_token_lists_of_the_helper_equal_the_expression(odd):
    got = odd.select("i", tokens_and_vector("text", 16).alias("t"), T.content_tokens("text").alias("b"), embed_tokens(F.expr(f"coalesce({T.content_tokens_sql('text')}, {T.EMPTY})"), 16).alias("v")).collect()
    assert len(got) == len(ODD) and all(r["t"]["tokens"] == (r["b"] or []) and r["t"]["vec"] == r["v"] for r in got)


def test_stems_of_single_words_equal_the_expression(spark):
    ends = ["", "s", "es", "ies", "sses", "ing", "ed", "e", "ss", "us", "is", "ches", "shes", "xes", "zes", "lles", "tted", "lling", "zzed", "nning", "ee", "ses"]
    words = sorted({a + b for a in ("", "a", "ab", "abc", "abcd", "abll", "1", "12", "a1", "ennn") for b in ends} - {""})
    for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", T.stem("w").alias("s")).collect():
        assert T.stem_word(r["w"]) == r["s"], r


@pytest.mark.parametrize("ids", [["a", "b", "c", "d"], ["a", "a", None, None]])
def test_totals_without_exploded_postings(spark, ids):
    tokens = [["x", "y", "x"], ["x", "z"], [], ["x", "x", "q"]]
    chunks = spark.createDataFrame(list(zip(ids, tokens)), "chunk_id string, tokens array<string>").repartition(2)
    terms = spark.createDataFrame([(7, "x", 0.5), (7, "y", 2.0), (7, "y", 2.0), (8, "z", 1.0), (8, "none", 3.0), (9, "none", 3.0), (None, "q", 1.5)], "qkey long, term string, idf double")
    s = lexical.bm25_scores(terms, lexical.postings(chunks), 2.0)
    want = {r["qkey"]: (r["n"], r["m"], round(r["s"], 6)) for r in s.groupBy("qkey").agg(F.count("*").alias("n"), F.max("score").alias("m"), F.sum("score").alias("s")).collect()}
    totals = lexical.bm25_totals(terms, chunks, 2.0)
    assert {r["qkey"]: (r["chunks"], r["best"], round(r["total"], 6)) for r in totals.collect()} == want and len(want) == 3
    assert "term" not in [a for line in totals._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line and ids[0] != ids[1] for a in line.replace("#", " ").split()]


def test_a_small_block_cuts_only_the_sentences_of_its_hits(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"The Harbour office {'opens' if i % 2 else 'closes'} early. It serves pier {i} today, says the clerk.", "s") for i in range(12)],
                                 "doc_id long, text string, source string")
    index = index_store.load_or_build(spark, C.table_chunks(docs), "hits", str(tmp_path))
    few = spark.createDataFrame([("3§1",), ("3§1",), ("5§1",), ("none",), (None,)], "chunk_id string")
    got = index.sentences_of(few)
    assert "regexp_replace" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join LeftSemi")[1]       # no text is cut below the join
    s = Settings()
    q = spark.createDataFrame([(1, "Which pier does the Harbour office serve?", None, "")], "qid long, text string, keywords array<string>, alt string")
    b = R.query_block(q, s)
    hits = R.retrieve(b, index, s)
    scored = R.sentence_scores(hits, b, index, s).collect()
    assert b.small and len(scored) == 2 * s.sentence_chunks
    assert not any(n.startswith("sentences") for n in os.listdir(index.path))                          # the whole table was not written
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got) == rows(index.sentences.filter(F.col("chunk_id").isin("3§1", "5§1"))) and got.count() == 4
