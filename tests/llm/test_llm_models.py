"""The classifier against plain numpy, and how a token file is laid out."""
import glob

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from talkweave.llm import quality, tokenfile


@pytest.mark.parametrize("seed", range(4))
def test_isotonic_matches_brute_force(seed):
    """The level of a row is the largest over its left ends of the smallest mean over its right ends."""
    rng = np.random.default_rng(seed)
    s = rng.permutation(80) / 7.0
    y = (rng.uniform(size=80) < s / 12).astype(float)
    at = y[np.argsort(s)]
    want = np.array([max(min(at[a:b + 1].mean() for b in range(i, 80)) for a in range(i + 1)) for i in range(80)])
    knots, levels = quality.isotonic(s, y)
    assert np.allclose(levels, np.unique(want.round(12))) and np.isclose(want.mean(), y.mean())
    sizes = [np.isclose(want, v).sum() for v in levels]
    assert np.isclose(np.dot(levels, sizes), y.sum()) and np.isclose(np.dot(knots, sizes), s.sum())


def test_fit_matches_plain_ridge(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["the", "house", "of", "|", "#", "Green", "river."], rng.integers(1, 50))) for _ in range(200)] + [None, ""]
    y = rng.integers(0, 2, len(texts)).astype(float)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = quality.fit(d, spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int"))
    folds = np.array([quality.fold_of(i) for i in range(len(texts))])
    x = np.array([quality.features(t) for t in texts])
    learnt = x[folds != 0]
    spread = learnt.std(0)
    plain = quality.Model(learnt.mean(0), np.where(spread > 1e-9, spread, 1.0))
    inner = (folds != 0) & (folds != quality.FOLDS - 1)
    z = plain.cosines(x[inner])
    penalty = quality.RIDGE * inner.sum() * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9
    # the same minimum as least squares over the rows and the square root of the penalty
    plain.weights = np.linalg.lstsq(np.vstack([z, np.sqrt(penalty)]), np.r_[y[inner], np.zeros(len(penalty))], rcond=None)[0]
    assert np.allclose(model.raw(x), plain.raw(x), atol=1e-6)
    held = folds == quality.FOLDS - 1
    knots, levels = quality.isotonic(plain.raw(x[held]), y[held])
    assert np.allclose(model.knots, knots, atol=1e-6) and np.allclose(model.levels, levels)


def test_token_files_are_laid_out_for_selective_reads(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(["river", "house", "of", "the", "tower"], 400))) for i in range(3000)]
    path = tokenfile.write(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"))
    files = [pq.ParquetFile(f) for f in glob.glob(f"{path}/*.parquet")]
    assert sum(f.metadata.num_rows for f in files) == 3000
    for f in files:
        group = f.metadata.row_group(0)
        column = {group.column(i).path_in_schema.split(".")[0]: group.column(i) for i in range(group.num_columns)}
        assert "RLE_DICTIONARY" in column["ids"].encodings and "DELTA_BINARY_PACKED" in column["pos"].encodings
        assert all(c.has_offset_index and c.has_column_index for n, c in column.items() if n != "ids")
        assert all(f.metadata.row_group(i).total_byte_size <= 2 * (32 << 20) for i in range(f.num_row_groups))
    bounds = sorted((c.min, c.max) for f in files for g in range(f.num_row_groups) for c in [f.metadata.row_group(g).column(2)] if c.path_in_schema == "doc_id" and c.statistics for c in [c.statistics])
    assert bounds and all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))         # a document's rows are in one row group
    one = tokenfile.read(spark, path).filter("doc_id = 1500").select("doc_id", "n_tokens", "start")
    assert one.count() == 1 and one.first()["start"] == sum(r["n_tokens"] for r in tokenfile.read(spark, path).filter("doc_id < 1500").collect())
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,1500)" in plan and "ids:array" not in plan
