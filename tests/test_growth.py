"""Steps that must not grow faster than their input, or do their work twice."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from talkweave.functions import text as T
from talkweave.operators import dialogue as D
from talkweave.operators import topk
from talkweave.plans import inputs as I
from talkweave.plans import layout
from talkweave.sources.index_store import with_demotion

ODD = ["a  b\tc\nd e f\u001cg\u0085h", "", None, " 　\n", "one", "x​y 'z'", " ".join(f"w{i}" for i in range(23))]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_windows_of_the_helper_equal_the_expression(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = df.select("doc_id", T.windows("text", 5).alias("w"), F.expr(T.windows_sql("text", 5)).alias("x")).collect()
    assert all((r["w"] or []) == (r["x"] or []) for r in got) and len(got[-1]["w"]) == 5
    assert "pyspark" in plan(df.select(T.windows("text", 5))).lower() or "cut(" in plan(df.select(T.windows("text", 5)))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(ODD)], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, 0), (3, 0), (5, 0), (6, 1)], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    return at


def test_documents_with_chunks_are_known_without_cutting(spark, tables):
    chunks, ids = I.chunks(spark, tables), I.chunked_ids(spark, tables)
    assert sorted(r[0] for r in ids.collect()) == sorted({r["doc_id"] for r in chunks.select("doc_id").collect()}) == ["0", "4", "5", "6"]
    flags = lambda df: sorted(map(tuple, df.select("chunk_id", "demote").collect()))
    assert flags(with_demotion(chunks, ids)) == flags(with_demotion(chunks))
    assert plan(with_demotion(chunks.select("chunk_id", "doc_id", "status", "superseded_by"), ids)).count("cut(text") == 2     # current and superseded rows, each once


def test_a_large_file_is_spread_by_size(spark, tables, monkeypatch):
    df = layout.read_table(spark, tables, "documents")
    assert layout.spread(df, "doc_id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(layout, "PART_BYTES", 64)
    assert layout.spread(df, "doc_id").rdd.getNumPartitions() > spark.sparkContext.defaultParallelism


def test_spoken_forms_are_looked_up_not_built_per_clause(spark):
    said = "We host a Gala in Pune for 40 people, what does catering cost? and is it open, how much is the stage? and where is parking?"
    t = spark.createDataFrame([("a", said), ("b", "")], "turn_key string, text string")
    terms = spark.createDataFrame([(w, 0.9, w in ("pune", "gala")) for w in ("gala", "pune", "cater", "cost", "stag", "park", "host")], "term string, salience double, is_proper boolean")
    q = D.subqueries(D.clauses(D.with_vocabulary(D.normalise(t), terms, "turn_key")))
    assert "map_from_entries(flatten" not in plan(q)
    rows = [r for r in q.collect() if r["turn_key"] == "a"]
    assert rows and any("Gala" in r["text"] and "Pune" in r["text"] for r in rows[1:])


@pytest.mark.parametrize("floor", [None, 0.0])
def test_rows_below_a_known_bound_leave_early(floor):
    rng = np.random.default_rng(5)
    ids = np.array([f"c{x}" for x in rng.permutation(5000)], dtype=object)
    s = np.round(rng.random((40, 5000)) ** 3, 2) * (rng.random((40, 5000)) < (0.002 if floor == 0.0 else 1))
    qi, ci = np.nonzero(s > -1 if floor is None else s > 0)
    want = topk.prune([(qi, ids[ci], s[qi, ci])], 30)
    first = topk.prune(topk.score_rows(ids[:2000], lambda part: s[part, :2000], 40, 30, floor), 30)
    least = topk.kth_best(first[0], first[2], 40, 30)
    rest = topk.score_rows(ids[2000:], lambda part: s[part, 2000:], 40, 30, floor, least)
    for got in (topk.prune(topk.score_rows(ids, lambda part: s[part], 40, 30, floor), 30), topk.prune([first, *rest], 30)):
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(got, want))
    if floor is None:
        assert sum(len(p[0]) for p in rest) < 40 * 200
