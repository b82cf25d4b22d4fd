"""Operators over the site table: filters, normalisation, set operations, random access, regions, tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges

SITE = ["chrom", "pos"]


def with_coverage(df: DataFrame) -> DataFrame:
    return df.withColumn("coverage", F.col("n_meth") + F.col("n_unmeth"))


def sum_duplicates(sites: DataFrame) -> DataFrame:
    """One row per (sample, chrom, pos): counts summed, strand the first real one."""
    return with_coverage(
        sites.groupBy("sample", *SITE).agg(
            F.min(F.when(F.col("strand") != "*", F.col("strand"))).alias("strand"), F.min("context").alias("context"),
            F.sum("n_meth").cast("int").alias("n_meth"), F.sum("n_unmeth").cast("int").alias("n_unmeth"),
        ).withColumn("strand", F.coalesce("strand", F.lit("*")))
    )


def merge_strands(sites: DataFrame) -> DataFrame:
    """A minus-strand C joins the plus-strand one a base before it."""
    shifted = sites.withColumn("pos", F.when(F.col("strand") == "-", F.col("pos") - 1).otherwise(F.col("pos")).cast("int"))
    out = shifted.groupBy("sample", *SITE).agg(F.sum("n_meth").cast("int").alias("n_meth"), F.sum("n_unmeth").cast("int").alias("n_unmeth"), F.count("*").alias("n_strands"))
    return with_coverage(out).withColumn("strand", F.lit("+"))


def coverage_quantile(sites: DataFrame, q: float) -> DataFrame:
    """(sample, cap): the coverage in row round(q (n - 1)) of the sample's sorted rows.

    Works on the histogram of coverage, so no sample's rows meet in one task.
    """
    hist = sites.groupBy("sample", "coverage").agg(F.count("*").alias("n"))
    w = Window.partitionBy("sample").orderBy("coverage")
    at = F.floor(F.lit(q) * (F.sum("n").over(Window.partitionBy("sample")) - 1) + 0.5)
    hit = hist.withColumn("at", at).withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("upto > at")
    return hit.groupBy("sample").agg(F.min("coverage").alias("cap"))


def filter_coverage(sites: DataFrame, low: int = 10, high_quantile: float = 0.999, blacklist: DataFrame | None = None) -> DataFrame:
    """Coverage at least `low` and at most the sample's quantile; a quantile over 1 is in percent."""
    q = high_quantile / 100 if high_quantile > 1 else high_quantile
    kept = sites.join(coverage_quantile(sites, q), "sample").where((F.col("coverage") >= low) & (F.col("coverage") <= F.col("cap"))).drop("cap")
    return kept if blacklist is None else ranges.points_in(kept, blacklist, "left_anti")


def normalize_coverage(sites: DataFrame, method: str = "median") -> DataFrame:
    """Counts scaled by target / centre of the sample; the target is the same statistic of the centres."""
    stat = (lambda c: F.percentile(c, F.lit(0.5))) if method == "median" else F.avg
    centre = sites.groupBy("sample").agg(stat("coverage").alias("centre"))
    target = centre.agg(stat("centre").alias("target"))
    factor = centre.crossJoin(target).select("sample", F.try_divide("target", "centre").alias("factor"))  # one row times one per sample
    scaled = sites.join(factor, "sample")
    for c in ("n_meth", "n_unmeth"):
        scaled = scaled.withColumn(c, F.round(F.col(c) * F.col("factor")).cast("int"))
    return with_coverage(scaled).drop("factor")


def unite(sites: DataFrame, how: str, n_samples: int) -> DataFrame:
    """(chrom, pos, strand) of the sites of all samples (intersect) or any (union)."""
    s = sites.groupBy(*SITE).agg(F.count_distinct("sample").alias("n"), F.min(F.when(F.col("strand") != "*", F.col("strand"))).alias("strand"))
    s = s.where(F.col("n") == n_samples) if how == "intersect" else s
    return s.select(*SITE, F.coalesce("strand", F.lit("*")).alias("strand"))


def covered_in(sites: DataFrame, case: Column, min_case: int, min_control: int) -> DataFrame:
    """Sites covered in at least so many samples of either group."""
    covered = F.col("coverage") > 0
    return sites.groupBy(*SITE).agg(F.count_if(covered & case).alias("n_case"), F.count_if(covered & ~case).alias("n_control")).where((F.col("n_case") >= min_case) & (F.col("n_control") >= min_control))


def query_region(sites: DataFrame, chrom: str, start: int, end: int, samples: list[str] | None = None) -> DataFrame:
    out = sites.where((F.col("chrom") == chrom) & (F.col("pos") >= start) & (F.col("pos") < end))
    out = out.where(F.col("sample").isin(samples)) if samples is not None else out
    return out.withColumn("beta", F.try_divide(F.col("n_meth").cast("double"), "coverage"))


def query_regions(sites: DataFrame, regions: DataFrame) -> DataFrame:
    """One row for each site and region that holds it."""
    return ranges.points_in(sites, regions).withColumn("beta", F.try_divide(F.col("n_meth").cast("double"), "coverage"))


def query_sites(sites: DataFrame, wanted: DataFrame) -> DataFrame:
    return sites.join(wanted.select(*SITE).distinct(), SITE, "left_semi").withColumn("beta", F.try_divide(F.col("n_meth").cast("double"), "coverage"))


def region_beta(sites: DataFrame, samples: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Per sample over the closed interval; a sample without a site has a null beta and n 0."""
    inside = sites.where((F.col("chrom") == chrom) & F.col("pos").between(start, end))
    got = inside.groupBy("sample").agg((F.sum("n_meth") / F.greatest(F.sum("coverage"), F.lit(1))).alias("beta"), F.count("*").alias("n_sites"), F.avg("coverage").alias("mean_coverage"))
    return samples.select("sample").join(got, "sample", "left").withColumn("n_sites", F.coalesce("n_sites", F.lit(0)))


def aggregate_regions(sites: DataFrame, regions: DataFrame, min_sites: int = 1) -> DataFrame:
    """Counts per sample and region; a site belongs to the region of the greatest start at or before it, if that still holds it."""
    at = ranges.last_start_before(sites, regions.select("chrom", "start", "end", "region_id")).where("pos < end")
    out = at.groupBy("sample", "chrom", "region_id", "start", "end").agg(F.sum("n_meth").alias("n_meth"), F.sum("n_unmeth").alias("n_unmeth"), F.count("*").alias("n_cpgs"))
    return with_coverage(out.where(F.col("n_cpgs") >= min_sites)).withColumn("pos", F.expr("cast((start + end) div 2 as int)"))


def tiles(sites: DataFrame, size: int = 1000) -> DataFrame:
    out = sites.groupBy("sample", "chrom", F.expr(f"cast(pos div {size} * {size} as int)").alias("pos")).agg(
        F.sum("n_meth").alias("n_meth"), F.sum("n_unmeth").alias("n_unmeth"), F.count("*").alias("n_cpgs"), F.min(F.when(F.col("strand") != "*", F.col("strand"))).alias("strand")
    )
    return with_coverage(out)


def site_matrix(sites: DataFrame, samples: list[str], value: str = "beta") -> DataFrame:
    """One row per site, one column per sample."""
    v = F.try_divide(F.col("n_meth").cast("double"), "coverage") if value == "beta" else F.col(value)
    return sites.groupBy(*SITE).pivot("sample", samples).agg(F.first(v))
