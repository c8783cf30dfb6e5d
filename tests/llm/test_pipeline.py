"""The stages of the pipeline on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""
import numpy as np
import pytest

import corpus_pipeline as P

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, fp long, score double, contaminated boolean"
WORDS = ["the", "river", "house", "green", "stands", "and", "of", "near", "old", "tower", "bridge", "market"]


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n)) + "."


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark, and the rows of documents."""
    at = str(tmp_path_factory.mktemp("tables"))
    run = "\n".join(prose(900 + i, 20) for i in range(4))
    passage = " ".join(f"b{i}" for i in range(30))
    texts = {i: prose(i, 60) for i in range(40)}
    texts.update({i: " | ".join(["#"] * 60) for i in range(40, 60)})                       # what the labels call bad
    texts.update({60: "first line\n" + run, 61: run + "\nlast line of another text", 62: passage + " " + prose(62, 40), 63: None, 64: "", 65: prose(65, 30_000),
                  66: texts[1], 67: texts[2] + " one more"})
    rows = [(i, t, "en", "s", len(t or ""), "r", "k", 1, 0.5, False) for i, t in texts.items()]
    rows += [rows[5], (None, prose(70, 50), "en", "s", 3, None, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i < 40), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rejected_documents_go(spark, tables):
    at, rows = tables
    kept = as_rows(P.quality_classifier(spark, spark.createDataFrame(rows, DOCS), at))
    assert not {r[0] for r in kept} & set(range(40, 60)) and {r[0] for r in kept} >= {*range(40), 60, 61, 65, 66, 67}
    assert set(kept) <= set(rows) and sum(r[0] == 5 for r in kept) == 2


def test_later_line_runs_go(spark, tables):
    at, rows = tables
    got = P.line_dedup(spark, spark.createDataFrame(rows, DOCS), at)
    assert got.schema.simpleString() == spark.createDataFrame([], DOCS).schema.simpleString()
    new = as_rows(got)
    by = {r[0]: r for r in new if r[0] is not None}
    assert by[61][1] == "last line of another text" and by[61][4] == len(by[61][1]) and by[60][1] == rows[60][1] and len(new) == len(rows)
    assert by[65][1] == rows[65][1] and by[63][1] in (None, "") and by[66][1] == ""        # a single line of 50 words and more is a run as well


def test_one_of_each_group_stays(spark, tables):
    at, rows = tables
    kept = as_rows(P.simhash_dedup(spark, spark.createDataFrame(rows, DOCS), at))
    ids = [r[0] for r in kept]
    assert set(kept) <= set(rows) and ids.count(5) == 1 and 66 not in ids and 67 not in ids and {1, 2, 60, 62, 65} <= set(ids) and len([i for i in ids if i in range(40, 60)]) == 1


def test_contaminated_documents_go(spark, tables):
    at, rows = tables
    kept = as_rows(P.benchmark_decontamination(spark, spark.createDataFrame(rows, DOCS), at))
    assert kept == sorted((r for r in rows if r[0] != 62), key=repr)


def test_ids_decode_to_the_texts(spark, tables):
    at, rows = tables
    got = P.sentencepiece_encoding(spark, spark.createDataFrame(rows, DOCS), at).collect()
    assert sorted((str(r["doc_id"]), r["text"].strip()) for r in got) == sorted((str(r[0]), (r[1] or "").strip()) for r in rows)


def test_stages_take_empty_tables(spark, tables):
    at, _ = tables
    for name, step in P.STAGES:
        assert step(spark, spark.createDataFrame([], DOCS), at).count() == 0, name


def test_the_whole_pipeline(spark, tables):
    at, rows = tables
    got = {r["doc_id"]: r for r in P.run(spark, at).collect()}
    assert not set(got) & {*range(40, 60), 62, 66, 67} and set(got) >= {0, 1, 2, 5, 60, 61, 65} and got[61]["text"].strip() == "last line of another text"
