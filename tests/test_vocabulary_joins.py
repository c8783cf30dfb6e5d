"""The vocabulary is dealt by term, a text is searched for repairs only while it has one, and words are counted in batches."""
from pyspark.sql import functions as F

from talkweave.functions import text as T
from talkweave.operators import dialogue as D
from talkweave.operators import lexical
from talkweave.sources import gate_store as GS


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def vocabulary_is_dealt(p):
    return p.count("SortMergeJoin") >= 1


def test_the_vocabulary_is_not_broadcast(spark):
    terms = spark.createDataFrame([("visa", 3, 0.5, False), ("pune", 1, 0.9, True)], "term string, df long, salience double, is_proper boolean")
    t = spark.createDataFrame([("a", "Visa for Pune"), ("b", None), ("c", "")], "k string, norm string")
    got = D.with_vocabulary(t, terms, "k")
    assert vocabulary_is_dealt(plan(got))
    assert {r["k"]: set(r["vocab"]) for r in got.collect()} == {"a": {"visa", "pune"}, "b": set(), "c": set()}
    held = spark.createDataFrame([("visa", "c"), ("pune", "c")], "term string, chunk_id string")
    assert vocabulary_is_dealt(plan(GS.topics(held, terms, 1)))


def test_repairs_are_still_found_three_times(spark):
    said = ["twenty, sorry, thirty, sorry, forty, sorry, fifty people", "it is red, sorry, blue", "plain text", "", None]
    df = spark.createDataFrame(list(enumerate(said)), "k int, text string")
    got = {r["k"]: r["norm"] for r in D.normalise(df).collect()}
    assert D.normalise(df).columns == ["k", "text", "norm"]
    assert "red" not in got[1] and got[2] == "plain text" and got[3] == "" and got[4] is None
    assert "50" in got[0] and not {"20", "30"} & set(got[0].split())


def test_words_counted_in_batches_are_the_exploded_ones(spark):
    odd = ["It's 2,00,000 and 1.5 or n't § 7 Don't", "", None, "Été naïve STRASSE straße", "a a A b", "x’s İstanbul"]
    df = spark.createDataFrame([(t,) for t in odd], "text string")
    want = df.select(F.explode(T.raw_tokens("text")).alias("word")).groupBy("word").count().collect()
    assert {tuple(r) for r in T.word_counts(df, "text").collect()} == {tuple(r) for r in want} and want
    assert lexical.proper_terms(spark.createDataFrame([("we saw Pune, and pune in Delhi",)], "text string")).collect() == [("delhi",)]
