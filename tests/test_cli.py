import pytest

from cytoframe import cli
from cytoframe.sources import views


def test_commands(spark, tmp_path):
    sites = views.sites(spark, "/root/testdata/sf0.001")
    store = str(tmp_path / "store")
    cli.sinks.write_sites(sites, store)
    bed = tmp_path / "r.bed"
    bed.write_text("#c\ntrack x\nchr1\t0\t2000\tone\nchr2\t100\t900\n")
    go = lambda *a: cli.run(spark, cli.parser().parse_args(list(map(str, a))))
    go("filter", store, tmp_path / "f", "--low", 50, "--blacklist", bed)
    assert spark.read.parquet(str(tmp_path / "f")).where("coverage < 50 OR (chrom = 'chr1' AND pos < 2000)").count() == 0
    go("dmc", store, tmp_path / "d", "--case", "s0", "s1", "--control", "s4", "s5", "--test", "score")
    dmc = spark.read.parquet(str(tmp_path / "d"))
    assert dmc.count() > 0 and {"qvalue", "reject"} <= set(dmc.columns)
    go("aggregate-regions", store, tmp_path / "a", "--bed", bed)
    assert {r["region_id"] for r in spark.read.parquet(str(tmp_path / "a")).collect()} == {"one", "chr2:100-900"}
    go("export", store, tmp_path / "b", "--kind", "bedgraph", "--sample", "s1")
    assert spark.read.text(str(tmp_path / "b")).where("value LIKE 'chr%'").count() == sites.where("sample = 's1' AND coverage > 0").count()
    go("sample-summary", store, tmp_path / "s")
    go("dmc", store, tmp_path / "g", "--case", "s0", "s1", "s2", "--control", "s4", "s5", "s6", "--formula", "~ treatment", "--unite", "union")
    assert {"coef", "qvalue"} <= set(spark.read.parquet(str(tmp_path / "g")).columns)
    go("report", store, tmp_path / "report.html", "--case", "s0", "s1", "--control", "s4", "s5")
    assert (tmp_path / "report.html").read_text().count("<table") == 4
    go("export", store, tmp_path / "m", "--kind", "matrix")
    assert spark.read.parquet(str(tmp_path / "m" / "layers" / "beta")).count() == sites.where("coverage > 0").count()
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["nothing"])


def test_convert(spark, tmp_path):
    for s in ("x", "y"):
        (tmp_path / f"{s}.bismark.cov").write_text("chr1\t10\t11\t50\t3\t3\nchr1\t20\t21\t100\t4\t0\n")
    sheet = tmp_path / "sheet.csv"
    sheet.write_text("sample_id,group,path,age\n" + "".join(f"{s},g,{tmp_path}/{s}.bismark.cov,4\n" for s in ("x", "y")))
    cli.run(spark, cli.parser().parse_args(["convert", str(tmp_path / "out"), "--sheet", str(sheet)]))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["sample"], r["pos"], r["coverage"]) for r in got.collect()) == [("x", 10, 6), ("x", 20, 4), ("y", 10, 6), ("y", 20, 4)]
