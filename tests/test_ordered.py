"""Running sums over borders, blocks with their surroundings, and chromosome models that don't depend on blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoframe.functions import ordered
from cytoframe.operators import sequence


@pytest.fixture(scope="module")
def split(spark):
    """As on a cluster: partitions stay as they are dealt."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_running_over_borders(spark, split):
    df = spark.range(4000).selectExpr("IF(id % 7 < 5, 'hot', IF(id % 7 = 5, 'b', null)) AS g", "id % 3 div 2 AS h", "id AS o", "id * 7919 % 1000003 AS x", "xxhash64(id) AS y").repartition(11)
    got = {(r["g"], r["h"], r["o"]): (r["place"], r["x"], r["y"]) for r in ordered.running(df, ["g", "h"], ["o"], sums=("x",), xors=("y",)).collect()}
    state = {}
    for r in sorted(df.collect(), key=lambda r: r["o"]):
        p, x, y = state.get((r["g"], r["h"]), (0, 0, 0))
        state[r["g"], r["h"]] = p + 1, x + r["x"], y ^ r["y"]
        assert got[r["g"], r["h"], r["o"]] == state[r["g"], r["h"]]
    assert len(got) == 4000 and ordered.running(df.limit(0), ["g"], ["o"]).count() == 0


def test_halos(spark, split):
    rng = np.random.default_rng(3)
    pos = np.cumsum(rng.integers(1, 90, 300))
    df = spark.createDataFrame([("a", int(p)) for p in pos] + [("b", 5)], "chrom string, pos int").repartition(5)
    for size, reach, sites, beyond in ((40, 200, 0, 0), (7, 500, 0, 1), (11, 0, 25, 0), (300, 100, 5, 2), (1, 60, 2, 1)):
        got = {}
        for r in ordered.with_halo(df, ["chrom"], size=size, reach=reach, sites=sites, beyond=beyond).collect():
            got.setdefault((r["chrom"], r["block"]), []).append((r["place"] - 1, r["own"], r["low"], r["high"], r["n"]))
        assert len(got) == -(-300 // size) + 1 and got["b", 0] == [(0, True, 5.0, 5.0, 1)]
        for (chrom, block), rows in got.items():
            if chrom == "b":
                continue
            i, j = block * size, min(block * size + size, 300) - 1
            near = [k for k in range(300) if (pos[i] - reach <= pos[k] <= pos[j] + reach) or (i - sites <= k <= j + sites)]
            want = range(max(near[0] - beyond, 0), min(near[-1] + beyond, 299) + 1)
            assert sorted(r[0] for r in rows) == list(want)
            assert all(own == (i <= k <= j) for k, own, *_ in rows) and {r[2:] for r in rows} == {(float(pos[0]), float(pos[-1]), 300)}


@pytest.fixture(scope="module")
def sites(spark):
    rng = np.random.default_rng(8)
    rows = []
    for sample in ("s0", "s1"):
        for chrom, n in (("chr1", 900), ("chr2", 60), ("chr3", 3)):
            pos = np.cumsum(rng.integers(2, 300, n)) + (5000 * (np.arange(n) > n // 2))
            low = (np.arange(n) // 40) % 2
            for p, m, c in zip(pos, rng.binomial(20, np.where(low, 0.15, 0.8)), rng.integers(1, 40, n)):
                rows.append((sample, chrom, int(p), int(min(m, c)), int(c)))
    return spark.createDataFrame(rows, "sample string, chrom string, pos int, n_meth int, coverage int").withColumn("n_unmeth", F.col("coverage") - F.col("n_meth")).cache()


def rows(df):
    return sorted(map(tuple, df.collect()))


def close(a, b):
    assert len(a) == len(b) and a
    for x, y in zip(a, b):
        assert [v for v in x if not isinstance(v, float)] == [v for v in y if not isinstance(v, float)]
        assert np.allclose([v for v in x if isinstance(v, float)], [v for v in y if isinstance(v, float)], rtol=1e-9, atol=1e-12)


def test_markov_chain_for_every_block_size(spark, split, sites):
    x = sequence._betas(sites)
    for means, loop, kind in (([0.2, 0.8], 0.9, "bernoulli"), ([0.1, 0.5, 0.9], 0.97, "gaussian")):
        whole = rows(sequence.hmm_states(x, ["sample", "chrom"], "beta", means, loop, kind))
        by = {}
        for s, c, p, b, *_ in rows(x):
            by.setdefault((s, c), []).append((p, b))
        for (s, c), v in by.items():
            path, post = sequence.hmm_segment(np.array([b for _, b in v]), means, loop, kind)
            own = [r for r in whole if r[:2] == (s, c)]
            assert [r[5] for r in own] == (path.tolist() if len(v) >= 5 else [])
            assert np.allclose([r[6] for r in own], post[:, -1] if len(v) >= 5 else [], atol=1e-9)
        for block in (1, 13, 64, 450):
            close(rows(sequence.hmm_states(x, ["sample", "chrom"], "beta", means, loop, kind, block=block)), whole)


def test_ties_of_paths_don_t_depend_on_blocks(spark, split):
    """Levels of one half say nothing, so all ways to change state are alike but for the number of changes."""
    y = [0.9] * 6 + [0.5] * 30 + [0.1] * 6 + [0.5] * 9
    x = spark.createDataFrame([("a", i, v) for i, v in enumerate(y)], "chrom string, pos int, beta double")
    want = sequence.hmm_segment(np.array(y), [0.1, 0.9], 0.9)[0].tolist()
    for block in (1, 4, 20, 100):
        assert [r[3] for r in rows(sequence.hmm_states(x, ["chrom"], "beta", [0.1, 0.9], 0.9, block=block))] == want


def test_smoothers_and_imputation_for_every_block_size(spark, split, sites):
    for kernel, more in (("gaussian", {}), ("gaussian", {"bandwidth": 200}), ("weighted", {"bandwidth": 500}), ("bsmooth", {"ns": 20, "h": 400})):
        whole = rows(sequence.smooth(sites, kernel, **more))
        for block in (1, 29, 300) if kernel != "bsmooth" else (29, 300):
            close(rows(sequence.smooth(sites, kernel, block=block, **more)), whole)
    thin = sites.where("pos % 3 <> 0 OR sample = 's1'")
    whole = rows(sequence.knn_impute(thin, ["s0", "s1"], max_distance=700).fillna(-1.0))
    for block in (5, 100):
        close(rows(sequence.knn_impute(thin, ["s0", "s1"], max_distance=700, block=block).fillna(-1.0)), whole)


def test_a_long_group_is_blocks_that_a_task_can_hold(spark):
    rows = spark.range(60_000).selectExpr("'a' AS k", "cast(id AS int) AS pos")
    sizes = sorted(r["count"] for r in ordered.blocked(rows, ["k"]).groupBy("block").count().collect())
    assert sum(sizes) == 60_000 and sizes[-1] <= 25_000
