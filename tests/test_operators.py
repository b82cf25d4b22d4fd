"""Planted truth and edge cases of the methylation operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoframe import schemas
from cytoframe.operators import fdr, models, ranges, reads, regions, sequence, sites as S, tests
from cytoframe.plans.frame import MethylFrame
from cytoframe.sources import readers, sinks

CASE, CONTROL = ["a1", "a2", "a3", "a4"], ["b1", "b2", "b3", "b4"]


@pytest.fixture(scope="module")
def planted(spark):
    """600 sites; 150 to 299 differ by 0.4."""
    rng = np.random.default_rng(42)
    rows = []
    for s in CASE + CONTROL:
        for i in range(600):
            p = 0.3 + (0.4 if s in CASE and 150 <= i < 300 else 0.0)
            n = int(rng.poisson(20)) + 1
            m = int(rng.binomial(n, np.clip(p + rng.normal(0, 0.03), 0.01, 0.99)))
            rows.append(("chr1", 1000 + 60 * i, "+", "CpG", m, n - m, n, s))
    return spark.createDataFrame(rows, schemas.SITE_DDL).cache()


def hits(df, p="qvalue"):
    found = {(r["pos"] - 1000) // 60 for r in df.where(F.col(p) < 0.05).collect()}
    true = set(range(150, 300))
    return len(found & true) / 150, len(found - true) / max(len(found), 1)


@pytest.mark.parametrize("test", ["lr", "score", "fisher", "welch_t", "logit_t"])
def test_power_and_false_discoveries(planted, test):
    power, fdp = hits(MethylFrame(planted, CASE, CONTROL).unite("intersect").dmc(test))
    assert power >= (0.2 if test == "logit_t" else 0.5) and fdp <= 0.25, (power, fdp)


def test_region_callers_find_the_block(planted):
    f = MethylFrame(planted, CASE, CONTROL)
    dmc = f.dmc("lr")
    for out in (regions.dmr_chain(dmc), regions.dmr_sliding(dmc), sequence.dmr_hmm(dmc)):
        got = out.collect()
        covered = sum(max(0, min(r["end"], 1000 + 60 * 300) - max(r["start"], 1000 + 60 * 150)) for r in got)
        assert covered > 0.5 * 9_000 and all(r["dmr_type"] == "hyper" for r in got if r["start"] >= 1000 + 60 * 150 and r["end"] <= 1000 + 60 * 300)
    assert f.dmr("tile", size=600, test="lr", min_cpgs=3).count() >= 1


def test_glm_agrees_with_two_group_likelihood(planted):
    obs = [{"sample": s, "treatment": int(s in CASE)} for s in CASE + CONTROL]
    names, x = models.design(obs, "~ treatment")
    assert names == ["Intercept", "treatment"]
    got = models.glm(planted, CASE + CONTROL, x, x[:, :1])
    raw = tests.raw_statistics(tests.with_dispersion(tests.accumulate(planted, F.col("sample").isin(CASE)))).select("pos", "lr_raw")
    worst = got.join(raw, "pos").agg(F.max(F.abs(F.col("stat") * F.col("phi") - F.col("lr_raw")))).first()[0]
    assert worst < 1e-3


def test_design_and_contrast():
    obs = [{"g": "KO", "age": 3}, {"g": "WT", "age": 5}, {"g": "KO", "age": 8}]
    names, x = models.design(obs, "~ g + age + g:age")
    assert names == ["Intercept", "g[T.WT]", "age", "g[T.WT]:age"] and x[:, 3].tolist() == [0, 5, 0]
    assert models.contrast("2*age - g[T.WT]", names).tolist() == [[0, -1, 2, 0]] and models.contrast("age, g[T.WT] = age", names).tolist() == [[0, 0, 1, 0], [0, 1, -1, 0]] == models.contrast([[0, 0, 1, 0], [0, 1, -1, 0]], names).tolist()
    with pytest.raises(ValueError):
        models.contrast("nothing", names)


def test_fdr_ties_nulls_and_empty(spark):
    df = spark.createDataFrame([(0.01,), (0.01,), (0.5,), (None,), (1.0,)], "pvalue double")
    q = sorted((r["pvalue"], round(r["qvalue"], 9)) for r in fdr.adjust(df).collect() if r["pvalue"] is not None)
    assert q == [(0.01, 0.025), (0.01, 0.025), (0.5, round(0.5 * 5 / 3, 9)), (1.0, 1.0)]
    drop = sorted((r["pvalue"], round(r["qvalue"], 9)) for r in fdr.adjust(df, missing="drop").collect() if r["pvalue"] is not None)
    assert drop == [(0.01, 0.02), (0.01, 0.02), (0.5, round(2 / 3, 9)), (1.0, 1.0)]
    assert fdr.adjust(df.limit(0)).count() == 0


def test_interval_joins(spark):
    p = spark.createDataFrame([("c", 5), ("c", 10), ("c", 20_000), ("d", 5)], "chrom string, pos int")
    r = spark.createDataFrame([("c", 0, 10), ("c", 5, 30_000)], "chrom string, start int, end int")
    assert sorted((x["pos"], x["start"]) for x in ranges.points_in(p, r).collect()) == [(5, 0), (5, 5), (10, 5), (20_000, 5)]
    assert ranges.points_in(p, r, "left_anti").count() == 1
    b = spark.createDataFrame([("c", 10, 15_000)], "chrom string, r_start int, r_end int")
    assert ranges.overlaps(r, b).count() == 1 and ranges.overlaps(r, b, closed=True).count() == 2
    assert sorted((x["start"], x["end"]) for x in ranges.merge_spans(r, ["chrom"]).collect()) == [(0, 30_000)]


def test_tile_merge(spark):
    rows = [("chr1", 0, 1000, 9, 0.4, 1e-4, "hyper"), ("chr1", 1000, 2000, 9, 0.2, 1e-4, "hyper"), ("chr1", 2000, 3000, 9, -0.3, 1e-4, "hypo"), ("chr1", 9000, 9999, 5, 0.3, 0.01, "hyper")]
    out = sorted(regions.merge_tiles(spark.createDataFrame(rows, "chrom string, start int, end int, n_cpgs long, meth_diff double, pvalue double, dmr_type string")).collect(), key=lambda r: r["start"])
    assert [(r["start"], r["end"], r["n_cpgs"]) for r in out] == [(0, 2000, 18), (2000, 3000, 9), (9000, 9999, 5)]
    assert abs(out[0]["meth_diff"] - 0.3) < 1e-12 and out[0]["pvalue"] < 1e-4


def test_hmm_recovers_states():
    rng = np.random.default_rng(7)
    z = np.zeros(2000, int)
    for t in range(1, 2000):
        z[t] = z[t - 1] if rng.random() < 0.99 else 1 - z[t - 1]
    y = np.clip(rng.normal(np.where(z, 0.85, 0.1), 0.1), 0, 1)
    path, post = sequence.hmm_segment(y, [0.1, 0.85], 0.99)
    assert (path == z).mean() > 0.97 and np.allclose(post.sum(axis=1), 1)
    assert sequence.hmm_segment(np.array([np.nan, 0.9]), [0.1, 0.9], 0.9)[0].tolist() == [1, 1]


def test_entropy_extremes(spark):
    rows = []
    for i in range(16):
        for j in range(4):
            rows.append(("t", f"o{i}", "c", 4 * j, int(j < 2)))
            rows.append(("u", f"m{i}", "c", 4 * j, i >> j & 1))
    got = {r["sample"]: r for r in reads.entropy(spark.createDataFrame(rows, "sample string, read_id string, chrom string, pos int, status int")).collect()}
    assert got["t"]["entropy"] == 0 and abs(got["u"]["normalized_entropy"] - 1) < 1e-12


def test_nnls():
    rng = np.random.default_rng(3)
    a = rng.random((50, 3))
    assert np.allclose(models.nnls(a, a @ np.array([0.2, 0.0, 0.8])), [0.2, 0, 0.8], atol=1e-9)


def test_readers(spark):
    m = ["CpG context (R1)", "=====", "position\tcount", "1\t12\t4\t75.0\t16", "CHH context (R2)", "====", "2\t1\t9\t10.0\t10"]
    got = readers.parse_mbias(spark.createDataFrame([("s", i, v) for i, v in enumerate(m)], "sample string, line_no int, value string")).collect()
    assert [(r["context"], r["read"], r["position"], r["coverage"]) for r in sorted(got, key=lambda r: r["context"])] == [("CHH", "R2", 2, 10), ("CpG", "R1", 1, 16)]
    t = spark.createDataFrame([("s", "x\nC methylated in CpG context:\t71.5%\nmean coverageData = 12.25X")], "sample string, value string")
    r = readers.report_metrics(t).first()
    assert (r["pct_meth_cpg"], r["mean_coverage"], r["pct_meth_chg"]) == (71.5, 12.25, None)
    f = spark.createDataFrame([("585\tNM_1\tchr1\t+\t10\t90\t0\t0\t2\t10,50,\t20,90,\t0\tG1",)], "value string")
    g, e = readers.parse_refgene(f)
    assert g.first()["gene_type"] == "protein_coding" and sorted((v["start"], v["end"]) for v in e.collect()) == [(10, 20), (50, 90)]


def test_save_and_load(spark, planted, tmp_path):
    f = MethylFrame(planted, CASE, CONTROL).filter_coverage(5, 99.9)
    f.dmc("lr")
    f.save(str(tmp_path / "m"))
    back = MethylFrame.load(spark, str(tmp_path / "m"))
    assert back.sites.count() == f.sites.count() and back.results["dmc_lr"].count() == f.results["dmc_lr"].count() and back.signature() == f.signature()


def test_text_export_in_order(spark, planted, tmp_path):
    rows = sinks.bedgraph_rows(planted, "a1")
    sinks.write_text(rows, str(tmp_path / "b"), [sinks.chromosome_order(), "start"])
    got = [r[0].split("\t")[1] for r in spark.read.text(str(tmp_path / "b")).collect()]
    assert sorted(map(int, got)) == [1000 + 60 * i for i in range(600)]


def test_normalised_counts_add_up(planted):
    assert S.normalize_coverage(planted).where("coverage <> n_meth + n_unmeth").count() == 0


def test_shuffle_partitions_do_not_matter(spark, planted):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return sorted((r["pos"], round(r["qvalue"], 9)) for r in MethylFrame(planted, CASE, CONTROL).dmc("score").collect() if r["qvalue"] is not None)

    try:
        assert run("1") == run("8")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_null_of_permutations_is_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    p = spark.createDataFrame([(i, [0.1, 0.5, 0.5, 0.9, None][i % 5]) for i in range(50)], "i int, pvalue double")
    null = spark.createDataFrame([(x,) for x in [0.05, 0.5, 0.5, 0.7] * 10], "pvalue double").mapInPandas(counted, "pvalue double")
    got = {r["pvalue"]: r["p_empirical"] for r in tests.permuted_pvalues(p, null).collect()}
    assert got == {0.1: 11 / 41, 0.5: 31 / 41, 0.9: 1.0, None: None}
    assert seen.value == 40
