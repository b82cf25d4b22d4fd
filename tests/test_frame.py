"""MethylFrame, stores, stages and readers, and the package without its optional parts."""

import os
import shutil
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoframe import schemas
from cytoframe.functions import tables
from cytoframe.operators import regions, tests
from cytoframe.plans.frame import MethylFrame
from cytoframe.sources import readers, report, sinks, store, versions

CASE, CONTROL = ["a1", "a2", "a3", "a4"], ["b1", "b2", "b3", "b4"]
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def sites(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in CASE + CONTROL:
        for i in range(240):
            p = 0.25 + (0.5 if s in CASE and 60 <= i < 120 else 0.0)
            n = int(rng.poisson(20)) + 1
            rows.append((f"chr{1 + i // 120}", 1000 + 60 * (i % 120), "+", "CpG", int(rng.binomial(n, p)), 0, n, s))
    rows = [(c, p, st, x, m, n - m, n, s) for c, p, st, x, m, _, n, s in rows]
    return spark.createDataFrame(rows, schemas.SITE_DDL).cache()


@pytest.fixture
def frame(spark, sites):
    obs = spark.createDataFrame([(s, int(s in CASE), 30.0 + 5 * (i % 4) + i // 4, "xyz"[i % 3]) for i, s in enumerate(CASE + CONTROL)], "sample string, treatment int, age double, batch string")
    return MethylFrame(sites, CASE, CONTROL, obs=obs).unite("intersect")


def found(df):
    hits = {(r["chrom"], (r["pos"] - 1000) // 60) for r in df.where("qvalue < 0.05").collect()}
    true = {("chr1", i) for i in range(60, 120)}
    return len(hits & true) / len(true), len(hits - true) / max(1, len(hits))


@pytest.mark.parametrize("test", ["auto", "cmh", "bb_lr", "glm", "welch_t"])
def test_every_test_finds_the_planted_sites(frame, test):
    power, fdp = found(frame.dmc(test))
    assert power > (0.1 if test == "welch_t" else 0.5) and fdp < (0.5 if test == "cmh" else 0.25)  # its strata share samples
    assert frame.get_dmc().count() == 240 and frame.significant_dmcs().count() <= 240


def test_formula_contrast_and_joint_contrast(frame):
    power, fdp = found(frame.dmc(formula="~ treatment + age"))
    assert power > 0.4 and fdp < 0.25 and "dmc_glm" in frame.results
    one = frame.dmc(formula="~ treatment + batch", contrast="treatment").collect()
    joint = frame.dmc(formula="~ treatment + batch", contrast="batch[T.y], batch[T.z]")
    assert len(one) == 240 and found(joint)[0] < 0.2
    with pytest.raises(ValueError):
        frame.dmc(formula="~ age")


def test_minima_guards_and_choice(frame, spark, sites):
    assert tests.auto_test(4, 4) == "lr" and tests.auto_test(1, 3, True) == "fisher"
    for bad in (lambda: tests.auto_test(1, 3), lambda: tests.auto_test(0, 3), lambda: frame.dmc("lr", min_case=5)):
        with pytest.raises(ValueError):
            bad()
    thin = sites.where("NOT (sample IN ('a1', 'a2', 'a3') AND pos < 2000)")
    x = MethylFrame(thin, CASE, CONTROL).dmc("score", min_case=2).where("pos < 2000")
    assert x.count() > 0 and x.where("pvalue IS NOT NULL OR meth_diff IS NOT NULL").count() == 0
    single = MethylFrame(sites, ["a1"], ["b1"])
    with pytest.raises(ValueError):
        single.dmc()
    assert single.unite("intersect").dmc(allow_single=True).where("pvalue < 0.05").count() > 10


def test_separated_sites_and_permutations(frame):
    plain = {(r["chrom"], r["pos"]): r["pvalue"] for r in frame.dmc("lr").collect()}
    exact = {(r["chrom"], r["pos"]): r["pvalue"] for r in frame.dmc("lr", separated=0.1).collect()}
    assert all(exact[k] <= plain[k] + 1e-9 for k in plain) and any(exact[k] < plain[k] - 1e-6 for k in plain)
    p = frame.dmc("score", permutations=9)
    r = p.agg(F.min("p_empirical"), F.max("p_empirical"), F.count("q_empirical")).first()
    assert 0 < r[0] <= r[1] <= 1 and r[2] == p.where("p_empirical IS NOT NULL").count()
    t = frame.dmr("tile", size=600, test="lr", min_cpgs=3, permutations=5, merge=False)
    assert {"p_empirical", "q_empirical"} <= set(t.columns) and t.count() >= 1


def test_boost_for_small_groups(sites):
    small = MethylFrame(sites, CASE[:2], CONTROL[:2]).unite("intersect")
    plain, more = found(small.dmc("lr"))[0], found(small.dmc("lr", boost="auto"))[0]
    assert more >= plain and more > 0.5


def test_overview_tables(frame):
    d = frame.dashboard()
    assert set(d) == {"coverage", "levels", "uniformity", "correlation", "contamination", "worst"} and d["worst"].count() == 3 and d["correlation"].count() == 28


def test_permutations_against_brute_force(spark, sites):
    sets = tests.label_sets(CASE, CONTROL, 3)
    assert len(sets) == 3 and all(len(s) == 4 for s in sets) and sets == tests.label_sets(CASE, CONTROL, 3)
    got = tests.permuted_tests(sites, sets, "lr", "eb")
    for i, s in enumerate(sets):
        want = {(r["chrom"], r["pos"]): r["pvalue"] for r in tests.quasi_binomial(sites, F.col("sample").isin(s), "lr", "eb").collect()}
        for r in got.where(F.col("perm") == i).collect():
            assert r["pvalue"] == pytest.approx(want[r["chrom"], r["pos"]], abs=1e-9)


def test_smoothing_into_tests(frame):
    f = frame.smooth("gaussian", bandwidth=500)
    assert found(f.dmc("lr", smoothed=True))[0] > 0.7 and found(frame.dmc("lr", smooth_bp=300))[0] > 0.7
    with pytest.raises(ValueError):
        frame.dmc("lr", smoothed=True)
    assert f.results["smoothed"].count() == 240 * 8


@pytest.mark.parametrize("method", ["chain_merge", "sliding_window", "hmm"])
def test_every_region_caller(frame, method):
    frame.dmc("lr")
    got = frame.dmr(method).collect()
    assert any(r["chrom"] == "chr1" and r["dmr_type"] == "hyper" and r["start"] < 1000 + 60 * 115 and r["end"] > 1000 + 60 * 65 for r in got)


def test_samples_and_wrappers(spark, frame):
    o = {r["sample"]: r for r in frame.qc(contamination=True, correlation="pearson", sex_chrom="chr2").collect()}
    assert len(o) == 8 and all(0 < r["methylation"] < 1 and r["n_sites"] == 240 and r["sex"] in ("XX", "XY") for r in o.values())
    m = frame.sites.select("chrom", "pos").distinct().withColumn("cpg_id", F.concat("chrom", F.col("pos").cast("string")))
    o = frame.age_clock(m.select("cpg_id", F.lit(0.01).alias("coefficient")), m, intercept=5.0).collect()
    assert all(5 < r["age"] < 10 for r in o) and "methylation" in o[0].asDict()
    ref = m.select("cpg_id", (F.col("pos") % 7 / 7).alias("t"), (F.col("pos") % 11 / 11).alias("u"))
    o = frame.deconvolve(ref, m, ["t", "u"]).collect()
    assert all(abs(r["t"] + r["u"] - 1) < 1e-9 for r in o)
    frame.dvc()
    assert frame.dvr(min_cpgs=3).count() > 0
    assert frame.pmd(min_length=1000).count() >= 0 and frame.hmr().count() >= 0
    calls = spark.createDataFrame([("s", f"q{i}", "chr1", 4 * j, (i >> j) & 1) for i in range(16) for j in range(4)], "sample string, read_id string, chrom string, pos int, status int")
    assert frame.entropy(calls).count() == 1
    alleles = spark.createDataFrame([("s", f"q{i}", 50, "A", "G", "AG"[i % 2]) for i in range(16)], "sample string, read_id string, snv_pos int, ref string, alt string, base string")
    assert frame.asm(calls, alleles, min_reads=4).count() == 4


def test_annotation_and_report(spark, frame, tmp_path):
    genes = spark.createDataFrame([("chr1", 4000, 9000, "+", "g1", "protein_coding"), ("chr2", 2000, 4000, "-", "g2", "lncRNA")], "chrom string, start int, end int, strand string, gene_id string, gene_type string")
    exons = spark.createDataFrame([("chr1", 4000, 4500, "+", "g1"), ("chr1", 8000, 9000, "+", "g1")], "chrom string, start int, end int, strand string, gene_id string")
    frame.dmc("lr")
    frame.dmr("chain_merge")
    got = frame.annotate(genes, exons, gene_types=["protein_coding"])
    x = got["dmc_lr_annotated"]
    assert set(got) == {"dmc_lr_annotated", "dmr_annotated"} and x.count() > 10
    assert {r[0] for r in x.select("nearest_gene").distinct().collect()} <= {"g1", None}
    tables_ = frame.report(5)
    assert set(tables_) == {"samples", "hits", "top_dmcs", "top_dmrs"} and tables_["top_dmcs"].count() == 5
    page = report.html(tables_, "A <title>")
    assert page.count("<table") == 4 and "A &lt;title&gt;" in page
    report.write_html(spark, tables_, str(tmp_path / "r" / "report.html"), "t")
    assert os.path.getsize(tmp_path / "r" / "report.html") > 500


def test_save_load_and_signature(spark, frame, sites, tmp_path):
    frame.dmc("lr")
    frame.save(str(tmp_path / "m"))
    back = MethylFrame.load(spark, str(tmp_path / "m"))
    assert back.get_dmc("lr").count() == 240 and back.obs.count() == 8 and back.meta == frame.meta
    other = MethylFrame(sites.where("pos > 2000"), CASE, CONTROL, meta=frame.meta)
    same = MethylFrame(sites.repartition(7), CASE, CONTROL, meta=frame.meta)
    assert frame.signature() == same.signature() != other.signature()


def test_stages_resume_only_under_the_same_signature(spark, sites, tmp_path):
    log, made = store.Stages(spark, str(tmp_path)), []

    def make():
        made.append(1)
        return sites.groupBy("chrom").count()

    assert log.completed() == [] and log.find("count") is None
    for _ in range(2):
        assert log.run("count", {"k": 1}, sites, make).count() == 2
    assert len(made) == 1 and log.completed() == ["count"] and log.resume("count").count() == 2
    log.run("count", {"k": 2}, sites, make)
    log.run("count", {"k": 1}, sites.where("pos > 1500"), make)
    assert len(made) == 3 and len(log.all()) == 3
    with pytest.raises(KeyError):
        log.resume("other")


def test_result_store(spark, sites, tmp_path):
    rows = sites.groupBy("chrom", "pos").agg(F.sum("n_meth").alias("n")).withColumn("chrom", F.regexp_replace("chrom", "chr2", "chr10"))
    s = store.ResultStore.create(rows, str(tmp_path / "s"), test="lr")
    with pytest.raises(FileNotFoundError):
        store.ResultStore.open(spark, str(tmp_path / "none"))
    s = store.ResultStore.open(spark, str(tmp_path / "s"))
    assert s.chroms() == ["chr1", "chr10"] and [c for c, _ in s.iter_chroms()] == s.chroms() and s.manifest()["test"] == "lr"
    assert "PartitionFilters: [isnotnull(chrom" in s.scan_chrom("chr1")._jdf.queryExecution().toString()
    s.update_chrom("chr10", rows.where("chrom = 'chr10'").limit(3))
    assert s.read_chrom("chr10", ["pos"]).columns == ["pos"] and s.to_dataframe().count() == 123
    with pytest.raises(ValueError):
        s.update_chrom("chr10", rows.where("chrom = 'chr1'"))
    s.mark_adjusted(method="by")
    assert s.manifest()["adjusted"] == {"column": "qvalue", "method": "by"} and s.manifest()["test"] == "lr"
    s.delete()
    assert not os.path.exists(tmp_path / "s")


def test_matrix_export(spark, sites, frame, tmp_path):
    store.write_matrix(sites, frame.obs, str(tmp_path / "m"), CASE + CONTROL, ("beta", "coverage"), modalities={"other": frame.obs})
    var = spark.read.parquet(str(tmp_path / "m/var"))
    assert [r["site"] for r in var.orderBy("chrom", "pos").collect()] == list(range(240))
    x = spark.read.parquet(str(tmp_path / "m/layers/coverage")).join(var, "site")
    want = {(CASE + CONTROL).index(r["sample"]) * 10**6 + hash((r["chrom"], r["pos"])) % 10**6: r["coverage"] for r in sites.collect()}
    assert x.count() == 1920 and all(want[r["sample"] * 10**6 + hash((r["chrom"], r["pos"])) % 10**6] == r["value"] for r in x.limit(200).collect())
    assert spark.read.parquet(str(tmp_path / "m/modalities/other")).count() == 8


def coverage_file(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.writelines("\t".join(map(str, r)) + "\n" for r in rows)


def test_files_of_one_name_and_run_folder(spark, tmp_path):
    a, b = str(tmp_path / "a b" / "x.cov"), str(tmp_path / "b+c" / "x.cov")
    coverage_file(a, [("chr1", 5, 6, 50, 1, 1)])
    coverage_file(b, [("chr1", 5, 6, 50, 2, 3), ("chr1", 9, 10, 0, 0, 3)])
    got = sorted((r["sample"], r["pos"], r["n_meth"], r["coverage"]) for r in readers.read_coverage(spark, {"s": a, "t": b}).collect())
    assert got == [("s", 5, 1, 2), ("t", 5, 2, 5), ("t", 9, 0, 3)]
    run = str(tmp_path / "run")
    for name in ("s1.bismark.cov", "deep/s1_rep2.deduplicated.bismark.cov", "deep/s10_1.deduplicated.bismark.cov", "other.cov"):
        coverage_file(f"{run}/{name}", [("chr1", 5, 6, 50, len(name), 1)])
    with open(f"{run}/samplesheet.csv", "w") as f:
        f.write("sample_id,group\ns1,ko\ns10,wt\ns1_rep2,wt\n")
    sites, obs = readers.read_run_folder(spark, run, "ko", "wt")
    assert {(r["sample"], r["n_meth"]) for r in sites.collect()} == {("s1", 14), ("s10", 35), ("s1_rep2", 37)}
    assert {(r["sample_id"], r["treatment"]) for r in obs.collect()} == {("s1", 1), ("s10", 0), ("s1_rep2", 0)}
    with open(f"{run}/samplesheet.csv", "a") as f:
        f.write("s77,wt\n")
    with pytest.raises(ValueError):
        readers.read_run_folder(spark, run, "ko", "wt")


def test_convert_only_if_stale(spark, tmp_path):
    p, out = str(tmp_path / "s.cov"), str(tmp_path / "store")
    coverage_file(p, [("chr1", 5, 6, 50, 1, 1)])
    assert readers.convert_if_stale(spark, {"s": p}, out) and not readers.convert_if_stale(spark, {"s": p}, out)
    coverage_file(p, [("chr1", 5, 6, 50, 1, 1), ("chr1", 8, 9, 50, 1, 1)])
    assert readers.convert_if_stale(spark, {"s": p}, out) and sinks.read_sites(spark, out).count() == 2


SAM = [
    "@SQ\tSN:chr1\tLN:1000",
    "r1\t0\tchr1\t11\t40\t2S3M1I2M2D2M\t*\t0\t0\tACGCTACGTA\tIIIIIIIIII\tXM:Z:.zZ.zzZ..z",
    "r2\t16\tchr1\t21\t40\t6M\t*\t0\t0\tACGGTC\tIII!II\tXM:Z:z.Z...",
    "r3\t4\t*\t0\t0\t*\t*\t0\t0\tACG\tIII\tXM:Z:zzz",
    "r4\t0\tchr1\t31\t5\t3M\t*\t0\t0\tACG\tIII\tXM:Z:zzz",
    "m1\t0\tchr1\t41\t40\t6M\t*\t0\t0\tCACCTC\tIIIIII\tMM:Z:C+h,0;C+m,0,1;\tML:B:C,9,200,100",
    "m2\t16\tchr1\t51\t40\t6M\t*\t0\t0\tGAGGTG\tIIIIII\tMM:Z:C+m?,0,1;\tML:B:C,200,128",
]


def test_calls_from_alignments(spark):
    x = readers.parse_alignments(spark.createDataFrame([(v,) for v in SAM], "value string"))
    got = sorted((r["read_id"], r["pos"], r["status"], r["strand"]) for r in readers.calls_of(x, sample="s").collect())
    # r1: bases 0-1 clipped, 2-4 at 10-12, 5 inserted, 6-7 at 13-14, 8-9 at 17-18 behind the deletion
    assert got == [("r1", 10, 1, "+"), ("r1", 12, 0, "+"), ("r1", 13, 1, "+"), ("r1", 18, 0, "+"), ("r2", 20, 0, "-"), ("r2", 22, 1, "-")]
    mods = sorted((r["read_id"], r["pos"], r["status"]) for r in readers.calls_of(x, "methyldackel").collect())
    # m1: C at 0, 2, 3, 5; skips 0 and 1 name the first and the third. m2: the other strand, from its end
    assert mods == [("m1", 40, 1), ("m1", 43, 0), ("m2", 52, 1), ("m2", 55, 1)]


def test_variants_and_alleles(spark):
    vcf = ["##x", "#CHROM", "chr1\t12\t.\tG\tT\t.\t.\t.\tGT:DP\t0/1:9", "chr1\t13\t.\tG\tT\t.\t.\t.\tDP:GT\t9:1|1", "chr1\t14\t.\tG\tT\t.\t.\t.\tGT\t./1", "chr1\t15\t.\tGA\tT\t.\t.\t.\tGT\t0/1", "chr1\t16\t.\tG\tT\t.\t.\t.\tDP\t9"]
    v = readers.parse_variants(spark.createDataFrame([(x,) for x in vcf], "value string"))
    assert [(r["pos"], r["ref"], r["alt"]) for r in v.collect()] == [(11, "G", "T")]
    x = readers.parse_alignments(spark.createDataFrame([(s,) for s in SAM], "value string"))
    assert [(r["read_id"], r["snv_pos"], r["base"]) for r in readers.alleles_of(x, v).collect()] == [("r1", 11, "C")]


def test_annotation_sources_and_reports(spark, tmp_path):
    assert readers.annotation_kind("x/hg38.refGene.txt.gz") == "refgene" and readers.annotation_kind("a.gtf.gz") == "gtf"
    with pytest.raises(ValueError):
        readers.annotation_kind("genes.bed")
    p = tmp_path / "refGene.txt"
    p.write_text("585\tNM_1\tchr1\t+\t10\t90\t0\t0\t2\t10,50,\t20,90,\t0\tG1\n")
    genes, exons, utrs = readers.read_annotation(spark, str(p))
    assert exons.select("gene_name").distinct().first()[0] == "G1" and utrs.count() == 0 and genes.count() == 1
    g = tmp_path / "a.gtf"
    g.write_text("\n".join(f'chr1\tx\t{f}\t{a}\t{b}\t.\t+\t.\tgene_id "g1"; gene_type "protein_coding";' for f, a, b in (("gene", 1, 900), ("exon", 1, 100), ("five_prime_utr", 1, 50), ("three_prime_utr", 800, 900))) + "\n")
    genes, exons, utrs = readers.read_annotation(spark, str(g))
    assert {(r["side"], r["start"], r["end"]) for r in utrs.collect()} == {("5UTR", 0, 50), ("3UTR", 799, 900)}
    from cytoframe.operators import annotate

    at = annotate.best_feature(spark.createDataFrame([("chr1", 10), ("chr1", 850), ("chr1", 60)], "chrom string, pos int"), annotate.feature_index(genes, exons, ("5UTR", "3UTR", "exon"), utrs))
    assert {(r["pos"], r["feature_type"]) for r in at.collect()} == {(10, "5UTR"), (850, "3UTR"), (60, "exon")}
    os.makedirs(tmp_path / "out" / "deep")
    (tmp_path / "out" / "s1_report.txt").write_text("C methylated in CpG context:\t71.5%\n")
    (tmp_path / "out" / "deep" / "s1_genome.txt").write_text("mean coverageData = 12.25X\n")
    (tmp_path / "out" / "s12_report.txt").write_text("C methylated in CpG context:\t60.0%\n")
    got = {r["sample"]: r for r in readers.read_reports(spark, str(tmp_path / "out"), ["s1", "s12"]).collect()}
    assert (got["s1"]["pct_meth_cpg"], got["s1"]["mean_coverage"], got["s12"]["pct_meth_cpg"]) == (71.5, 12.25, 60.0)


def test_sample_sheet(spark, tmp_path):
    p = tmp_path / "sheet.csv"
    p.write_text("sample_id,group,path,age\ns1,ko,a.cov,3\ns2,wt,b.cov,4\ns3,het,c.cov,5\n")
    assert {(r["sample_id"], r["treatment"]) for r in readers.read_samplesheet(spark, str(p), "ko", "wt").collect()} == {("s1", 1), ("s2", 0)}
    assert readers.read_samplesheet(spark, str(p), groups=["het"]).count() == 1
    p.write_text("sample_id,path\ns1,a.cov\n")
    with pytest.raises(ValueError):
        readers.read_samplesheet(spark, str(p))


def test_report_sections(spark, sites, tmp_path):
    from cytoframe.operators import qc

    out = sinks.qc_documents({"summary": qc.conversion_rate(sites)})
    assert set(out) == {"summary"} and '"a1"' in out["summary"]


def test_written_tables_go(spark, sites):
    t = tables.Written(sites.limit(5))
    assert t.df.count() == 5
    path = t.path.removeprefix("file:")
    assert os.path.exists(path)
    tables.release(spark)
    assert not os.path.exists(path)


def test_without_the_optional_parts(tmp_path):
    """With the text operators and the pipeline gone the rest imports and answers."""
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse"))
    say = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); print(len(q), len(s), sum(n.startswith('op') for n in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", say], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode == 0, out.stderr
    n, m, ops, pipeline = out.stdout.split()[-4:]
    assert int(n) > 100 and int(m) > 100 and pipeline == "False"


@pytest.mark.parametrize("test", ["lr", "score", "fisher", "cmh", "welch_t", "logit_t", "bb_lr", "glm"])
def test_tiles_by_every_test(frame, test):
    got = frame.dmr("tile", test=test, size=600, min_cpgs=3).collect()
    assert any(r["chrom"] == "chr1" and r["dmr_type"] == "hyper" and r["start"] < 1000 + 60 * 115 and r["end"] > 1000 + 60 * 65 for r in got)
    assert all(r["n_case"] == 4 and r["n_control"] == 4 and abs(r["mean_beta_case"] - r["mean_beta_control"] - r["meth_diff"]) < 1e-5 and r["qvalue"] < 0.05 for r in got)


def test_tile_defaults_and_filters(frame, sites):
    auto, lr = (sorted(map(tuple, frame.dmr("tile", size=600, min_cpgs=3, **more).collect())) for more in ({}, {"test": "lr"}))
    assert auto == lr
    every, some = (frame.dmr("tile", size=600, min_cpgs=3, alpha=0.9, delta=0.0, min_mean_q=q).count() for q in (None, 0.05))
    assert every > some
    few = MethylFrame(sites.where(~F.col("sample").isin(CASE[:3]) | (F.col("chrom") == "chr2")), CASE, CONTROL)
    assert few.dmr("tile", size=600, min_cpgs=3, test="score", alpha=0.9, delta=0.0, min_mean_q=None, min_case=3, min_control=1).where("chrom = 'chr1'").count() == 0
    united = few.unite("intersect").dmr("tile", size=600, min_cpgs=3, test="score", alpha=0.9, delta=0.0, min_mean_q=None)
    assert {r["chrom"] for r in united.collect()} <= {"chr2"}
    with pytest.raises(ValueError):
        frame.dmr("tile", test="nothing")
    with pytest.raises(ValueError):
        frame.dmr("tile", test="fisher", permutations=3)
    glm = frame.dmr("tile", size=600, min_cpgs=3, formula="~ treatment").collect()
    assert glm and all(r["n_case"] == 4 for r in glm)


def test_sliding_spans_reach_to_the_window_s_end(spark):
    rows = [("c", p, 0.3, 0.001, 0.001) for p in (0, 10, 20, 30, 40, 500, 510, 520, 530, 540)]
    dmc = spark.createDataFrame(rows, "chrom string, pos int, meth_diff double, pvalue double, qvalue double")
    spans = [(r["start"], r["end"]) for r in regions.sliding_spans(dmc, F.lit(True), 500).collect()]
    assert spans == [(0, 1000)]  # windows from 0 and from 500 touch
    assert [(r["start"], r["end"]) for r in regions.sliding_spans(dmc.where("pos < 100"), F.lit(True), 500).collect()] == [(0, 500)]


def test_exact_test_s_odds_ratio_is_that_of_counts(spark):
    rows = [("s0", "c", 0, 9, 10), ("s4", "c", 0, 2, 10), ("s0", "c", 1, 10, 10), ("s4", "c", 1, 3, 10), ("s0", "c", 2, 0, 10), ("s4", "c", 2, 3, 10), ("s0", "c", 3, 10, 10), ("s4", "c", 3, 10, 10)]
    x = tests.fisher(spark.createDataFrame(rows, "sample string, chrom string, pos int, n_meth int, coverage int"), F.col("sample") == "s0")
    got = {r["pos"]: r["log2_odds_ratio"] for r in x.collect()}
    assert got == {0: pytest.approx(np.log2(9 * 8 / (1 * 2))), 1: float("inf"), 2: None, 3: None}


def test_fewer_samples_saved_are_fewer_loaded(spark, sites, frame, tmp_path):
    path = str(tmp_path / "saved")
    MethylFrame(sites, CASE, CONTROL).save(path)
    two = MethylFrame(sites.where(F.col("sample").isin("a1", "b1")), CASE[:1], CONTROL[:1])
    two.save(path)
    got = MethylFrame.load(spark, path)
    assert {r[0] for r in got.sites.select("sample").distinct().collect()} == {"a1", "b1"} and got.sites.count() == two.sites.count()
    got.filter_coverage(1, 100).save(path)  # over what it was read from
    assert MethylFrame.load(spark, path).sites.count() > 0
    out = str(tmp_path / "sites")
    sinks.write_sites(sites, out)
    sinks.write_sites(sites.where("sample = 'a1'").withColumn("sample", F.lit("new")), out, keep=True)
    assert sinks.read_sites(spark, out).select("sample").distinct().count() == 9
    sinks.write_sites(sites.where("sample = 'a1'"), out)
    assert sinks.read_sites(spark, out).select("sample").distinct().count() == 1 and sinks.read_sites(spark, out).columns == sites.columns


def test_a_save_that_ends_midway_leaves_the_one_before(spark, sites, tmp_path, monkeypatch):
    path = str(tmp_path / "saved")
    whole = MethylFrame(sites, CASE, CONTROL)
    whole.save(path)
    n = whole.sites.count()
    small = MethylFrame(sites.where("sample IN ('a1', 'b1')"), CASE[:1], CONTROL[:1])
    for step in ("commit", "signature"):
        with monkeypatch.context() as m:
            m.setattr(versions.Versions if step == "commit" else MethylFrame, step, lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
            with pytest.raises(KeyboardInterrupt):
                small.save(path)
        assert MethylFrame.load(spark, path).sites.count() == n
    v = versions.Versions(spark, path)
    number, _ = v.current()
    stream = v.fs.create(v._path(f"_states/{number + 1:012d}.json"), False)
    stream.write(bytearray(b'{"state": {"half'))  # a state that breaks off
    stream.close()
    assert MethylFrame.load(spark, path).sites.count() == n
    small.save(path)
    assert MethylFrame.load(spark, path).sites.count() == small.sites.count()


def test_two_commits_on_one_state(spark, tmp_path):
    v = versions.Versions(spark, str(tmp_path / "v"))
    v.change(lambda s: {"n": 1})
    number, _ = v.current()
    v.commit({"n": 2}, number)
    with pytest.raises(versions.Conflict):
        v.commit({"n": 3}, number)
    assert v.current()[1] == {"n": 2}
    log, other = store.Stages(spark, str(tmp_path / "log")), store.Stages(spark, str(tmp_path / "log"))
    began = log.versions.current

    def late():  # another's entry comes between reading and writing
        found = began()
        log.versions.current = began
        other.append("b", {}, "k2", "p2")
        return found

    log.versions.current = late
    log.append("a", {}, "k1", "p1")
    assert log.completed() == ["b", "a"]
    for i in range(5):
        v.change(lambda s: {"n": s["n"] + 1})
    assert v.current()[1] == {"n": 7} and len(v.numbers()) == v.KEEP


def test_result_store_takes_a_chromosome_out_and_reads_itself(spark, sites, tmp_path):
    rows = sites.where("sample = 'a1'").select("chrom", "pos", "coverage")
    s = store.ResultStore.create(rows, str(tmp_path / "r"))
    before = s.to_dataframe()
    s.update_chrom("chr1", s.read_chrom("chr1").withColumn("coverage", F.col("coverage") + 1000))
    assert s.read_chrom("chr1").where("coverage < 1000").count() == 0 and before.where("coverage >= 1000").count() == 0
    s.update_chrom("chr1", rows.limit(0))
    assert s.chroms() == ["chr2"]
