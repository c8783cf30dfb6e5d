import pytest
from pyspark.sql import functions as F

from talkweave.functions import cues as Q
from talkweave.functions import text as T
from talkweave.operators import dialogue as D
from talkweave.operators import grounding as G


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column).first()[0]


def test_stem_forms_agree(spark):
    words = ("image images charged charge charges taxes dies stopped policies classes bus glass running falling buzzed use "
             "expense booking bookings boxes rates his ties agreed seen").split()
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.stem("w").alias("s")).collect()
    got = {r["w"]: r["s"] for r in df}
    assert got["images"] == got["image"] and got["charged"] == got["charge"] == got["charges"]
    assert got["taxes"] == "tax" and got["stopped"] == "stop" and got["policies"] == "policy" and got["falling"] == "fall"
    assert got == {w: T.stem_word(w) for w in words}


@pytest.mark.parametrize("said, want", [
    ("around a hundred and ten people", "around 110 people"),
    ("error eight oh nine", "error 809"),
    ("lands at eleven thirty at night", "lands at 11 30 at night"),
    ("a fifteen hour flight", "a 15 hour flight"),
    ("two lakh thirty thousand", "230000"),
    ("what hotel, sorry, what flight class", "what flight class"),
    ("hotel cap in Mumbai, no sorry, Hyderabad", "hotel cap in Hyderabad"),
    ("the limit in Bengaluru, no sorry, I meant Chennai", "the limit in Chennai"),
])
def test_normalise(spark, said, want):
    df = spark.createDataFrame([(said,)], "text string")
    assert D.normalise(df).first()["norm"] == want


def test_aliases_and_fillers(spark):
    df = spark.createDataFrame([("so um it was in pounds and I'm flying to the US, you know",)], "text string")
    t = D.normalise(df).first()["norm"]
    assert "GBP" in t and "USA" in t and " um " not in f" {t} " and "you know" not in t


def test_numbers_and_tokens(spark):
    assert set(one(spark, "INR 2,00,000 and 45 people", T.numbers_in("x"))) == {"200000", "45"}
    assert "200000" in one(spark, "INR 2,00,000", T.content_tokens("x"))
    assert one(spark, "Don't use §3 of Riverside's plan", T.raw_tokens("x")) == [
        "do", "not", "use", "section", "3", "of", "riverside", "plan"]


def test_sentence_units(spark):
    text = "Intro sentence here now.\n\n- first bullet item text\n- second bullet item text"
    assert one(spark, text, T.sentence_units("x")) == ["Intro sentence here now.", "first bullet item text", "second bullet item text"]
    table = "Lead line one here\n| Name | Fee |\n|---|---|\n| Big hall | 20 units |\nand it goes on."
    assert one(spark, table, T.sentence_units("x")) == ["Big hall - 20 units", "Lead line one here and it goes on."]


def test_spoken_count_and_citations(spark):
    assert one(spark, "repeat that in two bullets", Q.spoken_count("x")) == 2
    assert one(spark, "put that in 3 quick bullet points", Q.spoken_count("x")) == 3
    assert one(spark, "just repeat", Q.spoken_count("x")) is None
    assert one(spark, "A claim. [Doc_03 §2] Another [Doc_05 §3, Doc_05 §4]", G.extract_citations("x")) == [
        "Doc_03 §2", "Doc_05 §3", "Doc_05 §4"]


def test_labels(spark):
    assert one(spark, "How much paternity leave do I get", Q.label("x")) == "Paternity leave"
    assert one(spark, "for that same trip what's the cap", Q.label("x")) == "Cap"


def test_expand_terms(spark):
    df = spark.createDataFrame([(["food", "meal"],)], "t array<string>")
    assert df.select(T.expand_terms("t")).first()[0] == ["food", "meal", "cater"]
    assert df.select(T.mentions("'cancel'", "array('cancellation')")).first()[0]


def test_support(spark):
    chunks = spark.createDataFrame([("D §1", "Suite B", "", "32 classroom people")],
                                   "label string, doc_title string, section_title string, text string")
    chunks = chunks.withColumn("tokens", T.content_tokens("text"))
    rows = [("a", "x", "Suite B holds 32 people.", ["D §1"]), ("b", "x", "Suite B holds 99 people.", ["D §1"]),
            ("c", "x", "32 people", ["E §9"]), ("d", "x", "32 classroom people [D §1]", None)]
    claims = spark.createDataFrame(rows, "claim_id string, answer_id string, text string, citations array<string>")
    got = {r["claim_id"]: r for r in G.verify(claims, chunks).collect()}
    assert got["b"]["score"] == 0.0 and got["c"]["score"] == 0.0 and got["c"]["fabricated_ids"] == ["E §9"]
    assert got["d"]["score"] == 1.0 and got["d"]["supported"]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_rewrite_check(spark):
    chunks = spark.createDataFrame([("D §1", "T", "S", "The hall seats 40 people in total.")],
                                   "label string, doc_title string, section_title string, text string")
    chunks = chunks.withColumn("tokens", T.content_tokens("text"))
    text = "The hall seats 40 people. [D §1] It seats 90 people. [D §1] Parking is free. [E §7] Fees could not be verified."
    rw = spark.createDataFrame([("a", text, "plain"), ("b", "", "plain")], "answer_id string, text string, fallback string")
    seen = spark.createDataFrame([("a", "D §1")], "answer_id string, label string")
    got = {r["answer_id"]: r for r in G.keep_supported_sentences(rw, chunks, seen).collect()}
    assert "40 people" in got["a"]["text"] and "90" not in got["a"]["text"] and "Parking" not in got["a"]["text"]
    assert "could not be verified" in got["a"]["text"] and not got["a"]["fell_back"]
    assert F is not None
