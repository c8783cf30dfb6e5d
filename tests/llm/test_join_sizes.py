"""Rows that an explode or a decompression makes are dealt by key: Spark takes them for a small table and would send them to the driver."""
import pytest
from pyspark.sql import functions as F

from talkweave.llm import graph, linededup, simhash


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def staged(monkeypatch):
    """The plans of what the modules stage, by name."""
    seen = {}

    def watch(module):
        real = module.stage

        def stage(df, name, *by):
            seen[name] = plan(df)
            return real(df, name, *by)
        monkeypatch.setattr(module, "stage", stage)
    for m in (graph, linededup, simhash):
        watch(m)
    return seen


def test_probes_and_codes_are_not_broadcast(spark):
    p = plan(simhash.links(spark.range(100).select(F.xxhash64("id").alias("fp"))))
    assert "SortMergeJoin" in p and "BroadcastExchange" not in p


def test_bands_edges_and_levels_are_not_broadcast(spark, staged):
    texts = [" ".join(f"a{i}w{k}" for k in range(60)) for i in range(6)]
    lines = "\n".join(f"some words of a line that comes again {k}" for k in range(20))
    d = spark.createDataFrame(list(enumerate(texts + [t + " end" for t in texts] + [lines, "x\n" + lines])), "doc_id long, text string")
    assert simhash.keep_one(d).count() == 7
    assert simhash.near_duplicates(d).count() == 14
    assert linededup.dedup_lines(d).agg(F.sum("n_deleted")).first()[0] == 20
    for name in ("bands", "edges", "pairs", "repeated", "level", "windows"):
        assert "BroadcastExchange" not in staged[name], name
