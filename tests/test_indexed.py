"""Sorted lines in block gzip, found by their indexes."""

import gzip

import pytest
from pyspark.sql import functions as F

from cytoframe.sources import bgzf, indexed, sinks


def test_index_lookups_return_a_region_s_rows(spark, tmp_path):
    rows = [(s, c, p, f"{s}\t{c}\t{p}\t" + "x" * 200) for s in ("a", "b") for c, n in (("chr1", 3000), ("chr2", 40)) for p in range(5, n * 37, 37)]
    df = spark.createDataFrame(rows, "sample string, chrom string, pos int, line string").repartition(6)
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files
    try:
        state = indexed.write_table(df, path, "s\tchrom\tpos\tx", (2, 3), {"a": {"treatment": 1}, "none": {"treatment": 0}})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert state["samples"]["a"]["treatment"] == 1 and state["samples"]["a"]["n_rows"] == len(rows) // 2 and "files" not in state["samples"]["none"]
    assert len(state["samples"]["a"]["files"]) > 1
    text = "".join(gzip.open(f"{path}/{f['file']}", "rt").read().split("\n", 1)[1] for f in state["samples"]["b"]["files"])
    assert text == "".join(r[3] + "\n" for r in sorted(rows) if r[0] == "b")
    for region in (("chr1", 0, 40), ("chr1", 42, 43), ("chr1", 43, 79), ("chr1", 16_384, 16_500), ("chr1", 60_000, 200_000), ("chr2", 0, 10**6), ("chr2", 500, 500), ("chr9", 0, 10**6)):
        want = sorted(r[3] for r in rows if r[0] == "a" and r[1] == region[0] and region[1] <= r[2] < region[2])
        assert sorted(r["value"] for r in indexed.read_region(spark, path, "a", region).collect()) == want
    assert indexed.read_region(spark, path, "none", ("chr1", 0, 9)).count() == 0
    f = f"{path}/{state['samples']['a']['files'][0]['file']}"
    chrom, index = "chr1", bgzf.Index.read(f + ".tbi")
    part = sum((high >> 16) - (low >> 16) for low, high in index.chunks(index.names.index(chrom), 60, 70))
    assert part < bgzf.opened(f)[1] / 2
    with pytest.raises(FileNotFoundError):
        indexed.read_region(spark, str(tmp_path / "no"), "a", ("chr1", 0, 9))


def test_methylkit_files(spark, tmp_path):
    sites = spark.createDataFrame([("s", "chr1", 7, "+", 3, 4), ("s", "chr1", 9, "*", 0, 0), ("t", "chr2", 1, "-", 1, 1)], "sample string, chrom string, pos int, strand string, n_meth int, coverage int").withColumn("n_unmeth", F.col("coverage") - F.col("n_meth"))
    obs = spark.createDataFrame([("s", 1), ("t", 0)], "sample string, treatment int")
    state = sinks.write_methylkit(sites, str(tmp_path / "m"), obs)
    assert {s: (a["n_rows"], a["treatment"]) for s, a in state["samples"].items()} == {"s": (1, 1), "t": (1, 0)}
    got = indexed.read_region(spark, str(tmp_path / "m"), "s", ("chr1", 7, 8)).first()["value"].split("\t")
    assert got[:5] == ["chr1.7", "chr1", "7", "+", "4"] and [float(x) for x in got[5:]] == [75.0, 25.0]
