"""Quality-control aggregates over the site table."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written
from . import matrix


def sample_summary(sites: DataFrame) -> DataFrame:
    return sites.groupBy("sample", "chrom").agg(
        F.count("*").alias("n_sites"), F.avg("coverage").alias("mean_coverage"), F.percentile("coverage", F.lit(0.5)).alias("median_coverage"),
        F.try_divide(F.sum("n_meth").cast("double"), F.sum("coverage")).alias("methylation"),
    )


def global_methylation(sites: DataFrame, cut: float = 3.0) -> DataFrame:
    """Per sample and context; an outlier is over `cut` scaled median deviations away, among three samples at least."""
    g = sites.groupBy("sample", "context").agg(F.count("*").alias("n_sites"), F.try_divide(F.sum("n_meth").cast("double"), F.sum("coverage")).alias("methylation"))
    mid = g.groupBy("context").agg(F.percentile("methylation", F.lit(0.5)).alias("mid"), F.count("methylation").alias("n"))
    x = g.join(mid, "context").withColumn("dev", F.abs(F.col("methylation") - F.col("mid")))
    mad = x.groupBy("context").agg(F.percentile("dev", F.lit(0.5)).alias("mad"))
    out = x.join(mad, "context")
    hit = (F.col("n") >= 3) & (F.col("mad") > 0) & (F.col("dev") > cut * 1.4826 * F.col("mad"))
    return out.select("sample", "context", "n_sites", "methylation", F.coalesce(hit, F.lit(False)).alias("is_outlier"))


def coverage_uniformity(sites: DataFrame, thresholds: tuple[int, ...] = (1, 5, 10, 20, 30)) -> DataFrame:
    """Per chromosome, and a `genome` row whose mean is that of the chromosomes' means and whose fractions weigh sites alike."""
    counts = [F.count_if(F.col("coverage") >= t).alias(f"ge_{t}") for t in thresholds]
    by = sites.groupBy("sample", "chrom").agg(F.count("*").alias("n_sites"), F.avg("coverage").alias("mean_coverage"), *counts)
    genome = by.groupBy("sample").agg(F.sum("n_sites").alias("n_sites"), F.avg("mean_coverage").alias("mean_coverage"), *(F.sum(f"ge_{t}").alias(f"ge_{t}") for t in thresholds)).withColumn("chrom", F.lit("genome"))
    both = by.unionByName(genome)
    return both.select("sample", "chrom", "n_sites", "mean_coverage", *((F.col(f"ge_{t}") / F.col("n_sites")).alias(f"frac_ge_{t}x") for t in thresholds))


def conversion_rate(sites: DataFrame) -> DataFrame:
    """1 - methylation of a store of non-CpG sites, per sample."""
    return sites.groupBy("sample").agg((1 - F.try_divide(F.sum("n_meth").cast("double"), F.sum("coverage"))).alias("conversion_rate"))


def contamination(sites: DataFrame, min_coverage: int = 10) -> DataFrame:
    b = F.col("n_meth") / F.col("coverage")
    s = sites.where((F.col("coverage") >= min_coverage) & (F.col("coverage") > 0))
    return s.groupBy("sample").agg(F.count("*").alias("n_sites"), F.avg(((b > 0.2) & (b < 0.8)).cast("int")).alias("intermediate"))


def sex_check(sites: DataFrame, chrom: str = "chrX", min_coverage: int = 5) -> DataFrame:
    """Samples above the largest gap of the chromosome's methylation are XX; one sample is split at 0.25."""
    x = sites.where((F.col("chrom") == chrom) & (F.col("coverage") >= min_coverage)).groupBy("sample").agg(F.try_divide(F.sum("n_meth").cast("double"), F.sum("coverage")).alias("x_beta"))
    w = Window.orderBy("x_beta", "sample")  # one row per sample
    gaps = x.withColumn("before", F.lag("x_beta").over(w)).withColumn("gap", F.col("x_beta") - F.col("before"))
    cut = gaps.agg(F.max_by((F.col("x_beta") + F.col("before")) / 2, F.struct(F.col("gap"), -F.col("x_beta"))).alias("cut"), F.count("*").alias("n"))
    return x.crossJoin(cut).select("sample", "x_beta", F.when(F.col("x_beta") > F.when(F.col("n") >= 2, F.col("cut")).otherwise(0.25), "XX").otherwise("XY").alias("sex"))


def sample_correlation(sites: DataFrame, samples: list[str], method: str = "pearson", min_coverage: int = 10) -> DataFrame:
    """(sample_a, sample_b, r) over the sites that all samples cover.

    Sums of products are gathered as tiles of samples over blocks of sites, not
    from a join of the table with itself, nor from an expression for each pair.
    """
    ok = sites.where(F.col("coverage") >= min_coverage).withColumn("beta", F.col("n_meth") / F.col("coverage"))
    if method == "spearman":
        # average ranks from the counts of each sample's distinct values, over the sites that all have
        common = written(ok.groupBy("chrom", "pos").agg(F.count_distinct("sample").alias("_k")).where(F.col("_k") == len(samples)).select("chrom", "pos"))
        ok = ok.join(common, ["chrom", "pos"], "left_semi")
        h = ok.groupBy("sample", "beta").agg(F.count("*").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy("sample").orderBy("beta").rowsBetween(Window.unboundedPreceding, 0))
        ok = ok.join(h.select("sample", "beta", (upto - (F.col("_n") - 1) / 2).alias("_r")), ["sample", "beta"]).withColumn("beta", F.col("_r"))
    middle = (common.count() + 1) / 2 if method == "spearman" else 0.5
    return matrix.correlations(matrix.complete_sites(ok, samples, F.col("beta")), samples, middle)


def coverage_histogram(sites: DataFrame, bins: int, top: int) -> DataFrame:
    """Counts per sample in equal bins of 0..top; the last takes what lies above."""
    b = F.least(F.floor(F.col("coverage") * bins / top), F.lit(bins - 1)).cast("int")
    return sites.groupBy("sample", b.alias("bin")).agg(F.count("*").alias("n"))


def power(diff: float, coverage: float, n_per_group: int | None = None, power: float | None = None, alpha: float = 0.05, baseline: float = 0.5, sd: float = 0.05, two_sided: bool = True) -> float:
    """Power of a two-group comparison, or the least group size (2 to 10000) that reaches the power."""
    nd = NormalDist()
    other = min(max(baseline + diff, 0.0), 1.0)
    var = sum(b * (1 - b) / coverage + sd * sd for b in (baseline, other))
    z = nd.inv_cdf(1 - alpha / (2 if two_sided else 1))

    def at(n: int) -> float:
        return nd.cdf(abs(diff) / math.sqrt(var / n) - z)

    if n_per_group is not None:
        return at(n_per_group)
    return float(next((n for n in range(2, 10_001) if at(n) >= (power or 0.8)), 10_000))

