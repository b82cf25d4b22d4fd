"""What plots and reports show, as tables: profiles along genes and chromosomes, masks, best rows, region matrices, clustered orders."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranges
from .regions import significant


def karyogram(results: DataFrame, value: str = "meth_diff", bin_size: int = 1_000_000) -> DataFrame:
    """(chrom, bin, value, n): the mean of a value in equal bins of a chromosome."""
    return results.groupBy("chrom", F.expr(f"cast(pos div {bin_size} as int)").alias("bin")).agg(F.avg(F.col(value).cast("double")).alias("value"), F.count("*").alias("n"))


def tss_windows(genes: DataFrame, window: int = 2000) -> DataFrame:
    """(chrom, start, end, from, strand) around the first base of each gene; that of a minus-strand gene is the one before its end. `from` may lie before 0."""
    first = F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end") - 1)
    w = genes.select("chrom", (first - window).alias("from"), (first + window).alias("end"), F.col("strand").alias("gene_strand"))
    return w.withColumn("start", F.greatest("from", F.lit(0)))


def tss_profile(sites: DataFrame, genes: DataFrame, window: int = 2000, bin_size: int = 200) -> DataFrame:
    """(sample, bin, beta, n): mean level by distance from the start of genes, in the direction of the gene."""
    x = ranges.points_in(sites.where("coverage > 0"), tss_windows(genes, window))
    b = F.when(F.col("gene_strand") == "+", F.expr(f"(pos - from) div {bin_size}")).otherwise(F.expr(f"(end - 1 - pos) div {bin_size}")).cast("int")
    return x.groupBy("sample", b.alias("bin")).agg(F.avg(F.col("n_meth") / F.col("coverage")).alias("beta"), F.count("*").alias("n"))


def near_genes(sites: DataFrame, genes: DataFrame, window: int = 2000) -> DataFrame:
    """Sites within any gene's window, each once: overlapping windows are merged first."""
    spans = ranges.merge_spans(tss_windows(genes, window).select("chrom", "start", "end"), ["chrom"])
    return ranges.points_in(sites, spans, "left_semi")


def gene_body_profile(sites: DataFrame, genes: DataFrame, flank: int = 1000, flank_bins: int = 10, body_bins: int = 20, min_length: int = 500) -> DataFrame:
    """(sample, zone, bin, beta, n): upstream, along the gene's length, downstream, in the direction of the gene."""
    g = genes.where(F.col("end") - F.col("start") >= min_length).select("chrom", F.greatest(F.col("start") - flank, F.lit(0)).alias("start"), (F.col("end") + flank).alias("end"), F.col("start").alias("_gs"), F.col("end").alias("_ge"), F.col("strand").alias("_g"))
    x = ranges.points_in(sites.where("coverage > 0"), g).withColumn("_len", F.col("_ge") - F.col("_gs"))
    x = x.withColumn("_r", F.when(F.col("_g") == "+", F.col("pos") - F.col("_gs")).otherwise(F.col("_ge") - 1 - F.col("pos")))
    zone = F.when(F.col("_r") < 0, "upstream").when(F.col("_r") >= F.col("_len"), "downstream").otherwise("body")
    b = F.expr(f"cast(CASE WHEN _r < 0 THEN (_r + {flank}) * {flank_bins} div {flank} WHEN _r >= _len THEN (_r - _len) * {flank_bins} div {flank} ELSE _r * {body_bins} div _len END as int)")
    return x.groupBy("sample", zone.alias("zone"), b.alias("bin")).agg(F.avg(F.col("n_meth") / F.col("coverage")).alias("beta"), F.count("*").alias("n"))


def chromosome_offsets(results: DataFrame, gap: int = 10_000_000) -> DataFrame:
    """(chrom, size, offset): where each chromosome begins on one axis; one row a chromosome."""
    x = results.groupBy("chrom").agg(F.max("pos").alias("size"))
    before = F.sum(F.col("size") + gap).over(Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1))
    return x.withColumn("offset", F.coalesce(before, F.lit(0)).cast("bigint"))


def manhattan(results: DataFrame, alpha: float = 0.05, gap: int = 10_000_000) -> DataFrame:
    """(chrom, pos, x, neg_log10_p, is_hit) of rows with a p-value."""
    x = results.where("pvalue IS NOT NULL").join(chromosome_offsets(results, gap).select("chrom", "offset"), "chrom")
    return x.select("chrom", "pos", (F.col("pos") + F.col("offset")).alias("x"), (-F.log10(F.greatest("pvalue", F.lit(1e-300)))).alias("neg_log10_p"), F.coalesce(F.col("qvalue") < alpha, F.lit(False)).alias("is_hit"))


def _hits(alpha: float, delta: float) -> tuple:
    hit = significant("qvalue", alpha, delta)
    return (hit & (F.col("meth_diff") > 0)).alias("is_hyper"), (hit & (F.col("meth_diff") < 0)).alias("is_hypo")


def volcano(results: DataFrame, alpha: float = 0.05, delta: float = 0.1) -> DataFrame:
    return results.select("chrom", "pos", (-F.log10("pvalue")).alias("neg_log10_p"), *_hits(alpha, delta))


def mean_difference(results: DataFrame, alpha: float = 0.05, delta: float = 0.1) -> DataFrame:
    """(chrom, pos, mean_beta, meth_diff, is_hyper, is_hypo): difference against the mean of both groups' levels."""
    mean = (F.col("mean_beta_case").cast("double") + F.col("mean_beta_control").cast("double")) / 2
    return results.select("chrom", "pos", mean.alias("mean_beta"), "meth_diff", *_hits(alpha, delta))


def hit_counts(results: DataFrame, alpha: float = 0.05, delta: float = 0.1) -> DataFrame:
    """One row: sites, tested sites, significant ones and their directions."""
    up, down = _hits(alpha, delta)
    return results.agg(F.count("*").alias("n_sites"), F.count("pvalue").alias("n_tested"), F.count_if(F.col("qvalue") < alpha).alias("n_significant"), F.count_if(up).alias("n_hyper"), F.count_if(down).alias("n_hypo"))


def top_sites(results: DataFrame, n: int = 50) -> DataFrame:
    """The n rows of least p-value."""
    return results.where("pvalue IS NOT NULL AND NOT isnan(pvalue)").orderBy("pvalue", "chrom", "pos").limit(n)


def top_regions(regions: DataFrame, n: int = 50, by: str = "qvalue") -> DataFrame:
    return regions.where(F.col(by).isNotNull()).orderBy(by, "chrom", "start").limit(n)


def widest_sites(results: DataFrame, n: int = 1000) -> DataFrame:
    """The n rows of the largest difference either way."""
    return results.where("meth_diff IS NOT NULL").orderBy(F.abs(F.col("meth_diff")).desc(), "chrom", "pos").limit(n)


def site_heatmap(sites: DataFrame, results: DataFrame, samples: list[str], n: int = 1000) -> DataFrame:
    """(chrom, pos, one column per sample) of the widest sites."""
    at = widest_sites(results, n).select("chrom", "pos")
    level = F.try_divide(F.col("n_meth").cast("double"), "coverage")
    return sites.join(F.broadcast(at), ["chrom", "pos"]).groupBy("chrom", "pos").pivot("sample", samples).agg(F.first(level))  # n rows at most


def region_levels(sites: DataFrame, regions: DataFrame) -> DataFrame:
    """(chrom, start, end, sample, beta, n_sites): pooled level of each sample in each region."""
    x = ranges.points_in(sites.where("coverage > 0"), regions.select("chrom", "start", "end").distinct())
    return x.groupBy("chrom", "start", "end", "sample").agg((F.sum("n_meth").cast("double") / F.sum("coverage")).alias("beta"), F.count("*").alias("n_sites"))


def region_matrix(sites: DataFrame, regions: DataFrame, samples: list[str]) -> DataFrame:
    """(chrom, start, end, one column per sample): mean of the sites' levels."""
    x = ranges.points_in(sites.where("coverage > 0"), regions.select("chrom", "start", "end").distinct())
    return x.groupBy("chrom", "start", "end").pivot("sample", samples).agg(F.avg(F.col("n_meth") / F.col("coverage")))


def region_spread(regions: DataFrame, value: str = "meth_diff", split: str = "dmr_type") -> DataFrame:
    """(split, n, low, q1, median, q3, high): what a box or violin of a value by class shows."""
    v = F.col(value).cast("double")
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    x = regions.groupBy(split).agg(F.count(v).alias("n"), F.min(v).alias("low"), q.alias("_q"), F.max(v).alias("high"))
    return x.select(split, "n", "low", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"), "high")


def two_sets(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("chrom", "start", "end")) -> DataFrame:
    """One row: keys in a alone, in b alone and in both."""
    both = a.select(*keys).distinct().withColumn("_a", F.lit(1)).join(b.select(*keys).distinct().withColumn("_b", F.lit(1)), list(keys), "full")
    return both.agg(F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"))


def histogram(values: DataFrame, low: float, high: float, bins: int = 30, by: str = "annotation", value: str = "value") -> DataFrame:
    """(by, bin, n, density) of a value in equal bins of low..high; what lies outside is left out, high itself is in the last."""
    width = (high - low) / bins
    b = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    x = values.where(F.col(value).between(low, high)).groupBy(by, b.alias("bin")).agg(F.count("*").alias("n"))
    return x.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy(by)) * F.lit(width)))


def row_shares(pairs: DataFrame) -> DataFrame:
    """(a, b, n) counts with the share of a's own count, which is n where a = b."""
    own = pairs.where("a = b").select("a", F.col("n").alias("_own"))
    return pairs.join(own, "a").withColumn("share", F.col("n") / F.col("_own")).drop("_own")


def average_linkage(distance: np.ndarray) -> list[int]:
    """Leaf order of average-linkage clustering of a small square matrix, the nearer ends side by side in the order of merging."""
    d = np.array(distance, float)
    np.fill_diagonal(d, np.inf)
    leaves, size = [[i] for i in range(len(d))], np.ones(len(d))
    live = list(range(len(d)))
    while len(live) > 1:
        sub = d[np.ix_(live, live)]
        i, j = (live[k] for k in sorted(np.unravel_index(sub.argmin(), sub.shape)))
        leaves[i] = leaves[i] + leaves[j]
        merged = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        size[i] += size[j]
        live.remove(j)
    return leaves[live[0]] if live else []


def clustered_samples(correlations: DataFrame, samples: list[str]) -> list[str]:
    """Samples in the order of average linkage over 1 - r; correlations has one row for each pair."""
    at = {s: i for i, s in enumerate(samples)}
    d = np.zeros((len(samples), len(samples)))
    for r in correlations.collect():  # one row for each pair of samples
        d[at[r["sample_a"]], at[r["sample_b"]]] = d[at[r["sample_b"]], at[r["sample_a"]]] = 1 - (r["r"] if r["r"] is not None else 0.0)
    return [samples[i] for i in average_linkage(d)]


def clustered_regions(matrix: DataFrame, samples: list[str], n: int = 200, by: str | None = None) -> list[tuple]:
    """(chrom, start, end) of the first n rows of a region matrix in the order of average linkage over Euclidean distance; missing levels count as the row's mean."""
    rows = matrix.orderBy(*([by] if by else []), "chrom", "start").limit(n).toPandas()
    x = rows[samples].to_numpy(float)
    x = np.where(np.isnan(x), np.nan_to_num(np.nanmean(x, axis=1, keepdims=True)) if len(x) else 0.0, x)
    order = average_linkage(np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(axis=2), 0)))
    return [tuple(rows.loc[i, ["chrom", "start", "end"]]) for i in order]


def mbias_profile(mbias: DataFrame, context: str = "CpG") -> DataFrame:
    """(sample, read, position, percent): the level by position in the read, from counts where there are any."""
    percent = F.coalesce(100 * F.try_divide(F.col("n_meth").cast("double"), F.col("n_meth") + F.col("n_unmeth")), F.col("percent"))
    return mbias.where(F.col("context") == context).select("sample", "read", "position", percent.alias("percent"))


def worst_samples(contamination: DataFrame, n: int = 3) -> DataFrame:
    return contamination.orderBy(F.col("intermediate").desc(), "sample").limit(n)


def canonical_order(rows: DataFrame) -> DataFrame:
    """Rows by sample and position, for display."""
    return rows.orderBy("sample", "chrom", "pos")
