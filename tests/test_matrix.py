"""Products of samples by tiles, samples of sites, and normal equations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoframe.operators import matrix, models, qc, sequence


@pytest.fixture(scope="module")
def many(spark):
    """Sites of 70 samples, some covered by all."""
    rng = np.random.default_rng(1)
    rows = []
    for pos in range(60):
        base = rng.random()
        for i in range(70):
            if pos % 4 or i % 9:
                c = int(rng.integers(10, 60))
                rows.append((f"s{i:02}", "chr1", pos * 10, int(rng.binomial(c, base)), c))
    return spark.createDataFrame(rows, "sample string, chrom string, pos int, n_meth int, coverage int").cache()


NAMES = [f"s{i:02}" for i in range(70)]


def wide(many):
    x = many.toPandas()
    return x.assign(b=x.n_meth / x.coverage).pivot_table(index=["chrom", "pos"], columns="sample", values="b")[NAMES].dropna()


def test_products_by_tiles(spark, many, monkeypatch):
    monkeypatch.setattr(matrix, "TILE", 16)
    monkeypatch.setattr(matrix, "FAN", 2)
    x = wide(many).to_numpy() - 0.5
    rows = matrix.complete_sites(many, NAMES, F.col("n_meth") / F.col("coverage"))
    n, sums, g = matrix.gram(rows.repartition(9), 70)
    assert n == len(x) == 45 and np.allclose(sums, x.sum(axis=0)) and np.allclose(g, x.T @ x)
    for method in ("pearson", "spearman"):
        got = {(r["sample_a"], r["sample_b"]): r["r"] for r in qc.sample_correlation(many, NAMES, method).collect()}
        want = wide(many).corr(method)
        assert len(got) == 70 * 69 // 2 and all(abs(want.loc[a, b] - v) < 1e-9 for (a, b), v in got.items())


def test_a_level_that_never_varies_has_no_correlation(spark):
    rows = [(s, "c", p, m, 10) for p in range(5) for s, m in (("a", 3), ("b", p), ("c", 2 * p))]
    df = spark.createDataFrame(rows, "sample string, chrom string, pos int, n_meth int, coverage int")
    assert {(r["sample_a"], r["sample_b"]): r["r"] for r in qc.sample_correlation(df, ["a", "b", "c"]).collect()} == {("a", "b"): None, ("a", "c"): None, ("b", "c"): pytest.approx(1)}
    assert all(r["r"] is None for r in qc.sample_correlation(df.where("pos > 9"), ["a", "b"]).collect())


def test_samples_of_sites_whatever_the_partitioning(spark, many):
    one = [(r["pos"], r["row"]) for r in matrix.sample_site_matrix(many.repartition(1), NAMES, 12, 5).collect()]
    seven = [(r["pos"], r["row"]) for r in matrix.sample_site_matrix(many.repartition(7), NAMES, 12, 5).collect()]
    assert sorted(one) == sorted(seven) and len(one) == 12
    assert sorted(one) != sorted((r["pos"], r["row"]) for r in matrix.sample_site_matrix(many, NAMES, 12, 6).collect())
    assert matrix.sample_site_matrix(many, NAMES, 1000).count() == 45 and matrix.coverage_sample(many, 100).count() == 100
    w = wide(many).loc["chr1"]
    assert all(np.allclose(w.loc[p], row) for p, row in one)
    few = w.loc[[p for p, _ in one]].to_numpy()
    got = sequence.pca(many, NAMES, n_sites=12, seed=5).collect()
    u, s, _ = np.linalg.svd((few - few.mean(axis=1)[:, None]).T, full_matrices=False)
    assert np.allclose(np.abs([r["pc1"] for r in got]), np.abs(u[:, 0] * s[0]), atol=1e-6)
    assert np.allclose([r["mean_beta"] for r in got], few.mean(axis=0))


def test_least_squares_from_sums(spark):
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.random((30, 6)), rng.random(30) - 0.3
        x = models.nnls_of_sums(a.T @ a, a.T @ b)
        grad = a.T @ (b - a @ x)
        assert (x >= 0).all() and (grad < 1e-8).all() and np.abs(grad[x > 1e-10]).max(initial=0) < 1e-8
    assert models.nnls_of_sums(np.zeros((2, 2)), np.zeros(2)).tolist() == [0, 0]


def test_deconvolution_keeps_samples_without_the_panel(spark):
    ref = spark.createDataFrame([(f"p{i}", i % 2 * 1.0, i % 3 / 2) for i in range(12)], "cpg_id string, t double, u double")
    man = spark.createDataFrame([(f"p{i}", "c", i) for i in range(12)], "cpg_id string, chrom string, pos int")
    rows = [("a", "c", i, round(100 * (0.25 * (i % 2) + 0.75 * (i % 3) / 2)), 100) for i in range(12)] + [("z", "c", 99, 1, 2)]
    s = spark.createDataFrame(rows, "sample string, chrom string, pos int, n_meth int, coverage int")
    got = {(r["sample"], r["cell_type"]): r["proportion"] for r in models.deconvolve(s.repartition(5), ref, man, ["t", "u"]).collect()}
    assert got["z", "t"] is None and abs(got["a", "t"] - 0.25) < 0.02 and abs(got["a", "u"] - 0.75) < 0.02
