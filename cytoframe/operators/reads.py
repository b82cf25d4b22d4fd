"""Read-level operators over the table of calls (read_id, sample, chrom, pos, status)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import fdr


def usable_calls(calls: DataFrame, min_mapq: int = 10, min_baseq: int = 20) -> DataFrame:
    return calls.where((F.col("mapq") >= min_mapq) & (F.col("base_qual") >= min_baseq))


def entropy(calls: DataFrame, window: int = 4, min_reads: int = 10) -> DataFrame:
    """Shannon entropy of read patterns in windows of consecutive sites, in bits and over the window's length.

    A read's calls are one sorted array; a window is a slice of it whose site
    numbers are consecutive, so no table is joined with itself.
    """
    at = calls.select("sample", "chrom", "pos").distinct().withColumn("site", F.row_number().over(Window.partitionBy("sample", "chrom").orderBy("pos")))
    x = calls.join(at, ["sample", "chrom", "pos"])
    per = x.groupBy("sample", "chrom", "read_id").agg(F.sort_array(F.collect_set(F.struct("site", "pos", "status"))).alias("c")).where(F.size("c") >= window)
    starts = per.select("sample", "chrom", "c", F.explode(F.sequence(F.lit(1), F.size("c") - window + 1)).alias("i"))
    w = starts.select("sample", "chrom", F.slice("c", F.col("i"), F.lit(window)).alias("w"))
    whole = (F.col("w")[window - 1]["site"] - F.col("w")[0]["site"] == window - 1) & ~F.exists("w", lambda c: c["status"] < 0)
    p = w.where(whole).groupBy("sample", "chrom", F.col("w")[0]["pos"].alias("start"), (F.col("w")[window - 1]["pos"] + 1).alias("end"), F.array_join(F.transform("w", lambda c: c["status"].cast("string")), "").alias("pattern")).agg(F.count("*").alias("n"))
    g = p.groupBy("sample", "chrom", "start", "end").agg(F.sum("n").alias("n_reads"), F.count("*").alias("n_patterns"), F.sum(F.col("n") * F.log2("n")).alias("_s")).where(F.col("n_reads") >= min_reads)
    h = F.log2("n_reads") - F.col("_s") / F.col("n_reads")
    return g.withColumns({"entropy": F.greatest(h, F.lit(0.0)), "normalized_entropy": F.greatest(h, F.lit(0.0)) / window}).drop("_s")


def phase_reads(alleles: DataFrame, min_snvs: int = 1) -> DataFrame:
    """(sample, read_id, hap) of reads whose bases at heterozygous sites agree; alleles: sample, read_id, snv_pos, ref, alt, base."""
    h = F.when(F.col("base") == F.col("ref"), 0).when(F.col("base") == F.col("alt"), 1)
    x = alleles.withColumn("_h", h).where("_h IS NOT NULL").groupBy("sample", "read_id").agg(F.min("_h").alias("hap"), F.max("_h").alias("_top"), F.count("*").alias("_n"))
    return x.where((F.col("hap") == F.col("_top")) & (F.col("_n") >= min_snvs)).select("sample", "read_id", "hap")


def asm_counts(calls: DataFrame, haplotypes: DataFrame, min_reads: int = 10) -> DataFrame:
    x = calls.where("status >= 0").join(haplotypes, ["sample", "read_id"])
    c = [F.count_if((F.col("hap") == h) & (F.col("status") == s)).alias(f"{'meth' if s else 'unmeth'}_{h}") for h in (0, 1) for s in (1, 0)]
    g = x.groupBy("sample", "chrom", "pos").agg(*c)
    return g.where((F.col("meth_0") + F.col("unmeth_0") >= min_reads) & (F.col("meth_1") + F.col("unmeth_1") >= min_reads))


def allele_specific(calls: DataFrame, alleles: DataFrame, min_reads: int = 10, min_snvs: int = 1, alpha: float = 0.05) -> DataFrame:
    g = asm_counts(calls, phase_reads(alleles, min_snvs), min_reads)
    b = [F.col(f"meth_{h}") / (F.col(f"meth_{h}") + F.col(f"unmeth_{h}")) for h in (0, 1)]
    x = g.withColumns({"beta_0": b[0], "beta_1": b[1], "meth_diff": b[0] - b[1]}).withColumn("pvalue", C.fisher_tail("meth_0", "unmeth_0", "meth_1", "unmeth_1"))
    return fdr.adjust(x, "pvalue", "bh", alpha, "drop").withColumnRenamed("reject", "is_asm")
