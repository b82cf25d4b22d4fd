"""Region callers over per-site results, and what they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import dispatch, fdr, ranges, sites as S, tests


def smooth_counts(sites: DataFrame, span: int = 500) -> DataFrame:
    """Mean counts within span // 2 to either side, inclusive, per sample."""
    half = span // 2
    w = Window.partitionBy("sample", "chrom").orderBy(F.col("pos").cast("long")).rangeBetween(-half, half)
    return sites.withColumns({"meth_sm": F.avg("n_meth").over(w), "cov_sm": F.avg("coverage").over(w)})


def signed_z(p: Column, diff: Column, zero_sign: int) -> Column:
    sign = F.when(diff > 0, 1).when(diff < 0, -1).otherwise(zero_sign)
    return sign * C.normal_isf(C.clip(p, 1e-300, 1 - 1e-12) / 2)


def combine_neighbours(dmc: DataFrame, bp: int = 200, min_agree: float = 0.6, focal: float = 0.5) -> DataFrame:
    """pvalue_combined: signed Stouffer over sites within bp, where enough agree and the site itself shows something; never larger than its own."""
    x = dmc.withColumn("_z", F.coalesce(signed_z(F.col("pvalue"), F.col("meth_diff"), 1), F.lit(0.0)))
    w = Window.partitionBy("chrom").orderBy(F.col("pos").cast("long")).rangeBetween(-bp, bp)
    up = F.col("meth_diff") >= 0
    n, z = F.count("*").over(w), F.sum("_z").over(w)
    agree = F.when(up, F.count_if(up).over(w)).otherwise(F.count_if(~up).over(w)) / n
    p = 2 * C.normal_sf(F.abs(z / F.sqrt(n)))
    x = x.withColumns({"_p": p, "_agree": agree})
    use = (F.col("_agree") >= min_agree) & (F.col("pvalue") < focal) & (F.col("_p") < F.col("pvalue"))
    return x.withColumn("pvalue_combined", F.when(use, F.col("_p")).otherwise(F.col("pvalue"))).drop("_z", "_p", "_agree")


def neighbour_counts(dmc: DataFrame, bp: int = 200) -> DataFrame:
    """Sites within bp, and those that share the site's sign."""
    w = Window.partitionBy("chrom").orderBy(F.col("pos").cast("long")).rangeBetween(-bp, bp)
    up = F.col("meth_diff") >= 0
    return dmc.withColumns({"n_near": F.count("*").over(w), "n_agree": F.when(up, F.count_if(up).over(w)).otherwise(F.count_if(~up).over(w))})


def significant(p: str, alpha: float, delta: float) -> Column:
    return F.coalesce((F.col(p) < alpha) & (F.abs(F.col("meth_diff").cast("float")) >= F.lit(delta).cast("float")), F.lit(False))


def sliding_spans(dmc: DataFrame, sig: Column, window: int = 500, min_cpgs: int = 5, min_sig: int = 3) -> DataFrame:
    """Union of the windows [pos, pos + window) that hold enough sites and significant sites; windows that touch are one span."""
    x = dmc.withColumn("_sig", sig.cast("int"))
    w = Window.partitionBy("chrom").orderBy(F.col("pos").cast("long")).rangeBetween(0, window - 1)
    c = x.withColumns({"_n": F.count("*").over(w), "_ns": F.sum("_sig").over(w), "end": (F.col("pos") + window).cast("int")})
    return ranges.merge_spans(c.where((F.col("_n") >= min_cpgs) & (F.col("_ns") >= min_sig)).select("chrom", F.col("pos").alias("start"), "end"), ["chrom"])


def chain_spans(dmc: DataFrame, sig: Column, gap: int = 500, min_length: int = 50) -> DataFrame:
    """Runs of significant sites with steps up to the gap, as [first, last + 1)."""
    x = ranges.gap_islands(dmc.where(sig), ["chrom"], "pos", gap)
    out = x.groupBy("chrom", "island").agg(F.min("pos").alias("start"), (F.max("pos") + 1).cast("int").alias("end"))
    return out.where(F.col("end") - F.col("start") >= min_length).drop("island")


def score_spans(dmc: DataFrame, spans: DataFrame, sig: Column, p: str = "pvalue") -> DataFrame:
    """spans with site counts, mean difference, Stouffer's p over all their sites, and direction."""
    x = ranges.points_in(dmc.withColumn("_sig", sig), spans.withColumnsRenamed({"start": "start", "end": "end"}))
    ok = (F.col(p) > 0) & (F.col(p) <= 1)
    sign = F.signum(F.col("meth_diff").cast("double"))
    x = x.withColumn("_z", F.when(ok, sign * C.normal_isf(C.clip(F.col(p), 1e-300, 1 - 1e-15) / 2)))
    g = x.groupBy("chrom", "start", "end").agg(
        F.count("*").alias("n_cpgs"), F.count_if("_sig").alias("n_significant"), F.avg("meth_diff").alias("mean_meth_diff"),
        (F.sum("_z") / F.sqrt(F.count("_z"))).alias("_zz"), F.count_if(F.col("meth_diff") > 0).alias("_up"), F.count_if(F.col("meth_diff") < 0).alias("_down"),
    )
    part = F.greatest("_up", "_down") / F.greatest(F.col("_up") + F.col("_down"), F.lit(1))
    kind = F.when(part < 0.6, "mixed").when(F.col("mean_meth_diff") > 0, "hyper").otherwise("hypo")
    return g.withColumn("combined_pvalue", F.when(F.col("_zz").isNotNull(), 2 * C.normal_sf(F.abs("_zz")))).withColumn("dmr_type", kind).drop("_zz", "_up", "_down")


def _finish(scored: DataFrame, alpha: float) -> DataFrame:
    return fdr.adjust(scored, "combined_pvalue", "bh", alpha, "one", "combined_qvalue").drop("reject")


def dmr_sliding(dmc: DataFrame, window: int = 500, min_cpgs: int = 5, min_sig: int = 3, alpha: float = 0.05, delta: float = 0.1, p: str = "qvalue", longest: int = 10_000) -> DataFrame:
    sig = significant(p, alpha, delta)
    spans = sliding_spans(dmc, sig, window, min_cpgs, min_sig).where(F.col("end") - F.col("start") <= longest)
    x = score_spans(dmc, spans, sig, p).where((F.col("n_cpgs") >= min_cpgs) & (F.col("n_significant") >= min_sig) & (F.abs("mean_meth_diff") >= delta))
    return _finish(x, alpha)


#: Named sets of chain-merge settings. Fixed values.
PRESETS = {
    "strict": {"alpha": 1e-6, "delta": 0.20, "gap": 250, "min_cpgs": 5, "share": 0.5, "min_length": 100},
    "default": {"alpha": 1e-4, "delta": 0.10, "gap": 500, "min_cpgs": 3, "share": 0.5, "min_length": 50},
    "permissive": {"alpha": 1e-4, "delta": 0.05, "gap": 1000, "min_cpgs": 3, "share": 0.5, "min_length": 50},
}
_PLAIN = {"alpha": 0.05, "delta": 0.1, "gap": 500, "min_cpgs": 3, "share": 0.5, "min_length": 50}


def dmr_chain(dmc: DataFrame, preset: str | None = None, p: str = "pvalue", **settings) -> DataFrame:
    """Chained significant sites; settings given win over the preset's."""
    use = (PRESETS[preset] if preset else _PLAIN) | {k: v for k, v in settings.items() if v is not None}
    sig = significant(p, use["alpha"], use["delta"])
    x = score_spans(dmc, chain_spans(dmc, sig, use["gap"], use["min_length"]), sig)
    return _finish(x.where((F.col("n_cpgs") >= use["min_cpgs"]) & (F.col("n_significant") / F.col("n_cpgs") >= use["share"])), use["alpha"])


def merge_tiles(dmr: DataFrame) -> DataFrame:
    """Neighbouring tiles of one direction become one: means of differences, levels and odds ratios, the larger numbers of samples, and one-sided p-values combined two at a time in order; then BH.

    The fold runs over each island's own short list of tiles. A mean is missing where one of its tiles' is.
    """
    w = Window.partitionBy("chrom").orderBy("start")
    new = (F.lag("end").over(w).isNull()) | (F.col("start") > F.lag("end").over(w)) | (F.col("dmr_type") != F.lag("dmr_type").over(w))
    x = ranges.islands(dmr.withColumn("_new", new), ["chrom"], "start", F.col("_new")).withColumn("_z", C.normal_isf(C.clip(F.col("pvalue"), 1e-300, 1 - 1e-15)))
    means = [F.when(F.count(c) == F.count("*"), F.avg(F.col(c).cast("double"))).alias(c) for c in ("meth_diff", "log2_odds_ratio", "mean_beta_case", "mean_beta_control") if c in dmr.columns]
    g = x.groupBy("chrom", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_cpgs").alias("n_cpgs"), F.first("dmr_type").alias("dmr_type"), *means,
        *(F.max(c).alias(c) for c in ("n_case", "n_control") if c in dmr.columns), F.sort_array(F.collect_list(F.struct("start", F.col("_z").alias("z")))).alias("_t"),
    )
    z = F.aggregate(F.slice("_t", F.lit(2), F.size("_t")), F.col("_t")[0]["z"], lambda a, t: (a + t["z"]) / F.sqrt(F.lit(2.0)))
    out = g.withColumn("pvalue", C.normal_sf(z)).drop("_t", "island")
    return fdr.adjust(out, "pvalue", "bh").drop("reject")


def tested_tiles(sites: DataFrame, size: int, min_cpgs: int, samples: int | None = None) -> DataFrame:
    """Counts of the tiles that hold enough sites of a sample; with a number of samples only tiles that as many have."""
    t = S.tiles(sites, size).where(F.col("n_cpgs") >= min_cpgs)
    if samples is None:
        return t
    return t.join(t.groupBy("chrom", "pos").agg(F.count("*").alias("_k")).where(F.col("_k") == samples).select("chrom", "pos"), ["chrom", "pos"], "left_semi")


def dmr_tiles(
    sites: DataFrame, groups: dispatch.Groups, size: int = 1000, test: str = "logit_t", min_cpgs: int = 5, alpha: float = 0.05, delta: float = 0.1, merge: bool = True,
    dispersion: str = "site", reference: str = "adaptive", united: bool = False, min_case: int = 0, min_control: int = 0,
) -> DataFrame:
    """Tiles that differ by any of the site tests on their counts, neighbours of one direction merged."""
    t = tested_tiles(sites, size, min_cpgs, len(groups.samples) if united else None)
    r = tests.masked(dispatch.site_test(t, groups, test, dispersion, reference), t, groups.is_case, min_case, min_control)
    about = dispatch.covered(t, groups.is_case)
    about = about.join(t.groupBy("chrom", "pos").agg(F.max("n_cpgs").alias("n_cpgs")), ["chrom", "pos"])
    levels = [c for c in ("mean_beta_case", "mean_beta_control") if c not in r.columns]
    x = r.drop("n_cpgs", "n_case", "n_control").join(about.select("chrom", "pos", "n_cpgs", "n_case", "n_control", *levels), ["chrom", "pos"])
    q = fdr.adjust(x, "pvalue", "bh", alpha)
    hit = q.where(significant("qvalue", alpha, delta) & F.col("pvalue").isNotNull())
    out = hit.select(
        "chrom", F.col("pos").alias("start"), (F.col("pos") + size).cast("int").alias("end"), "n_cpgs", "n_case", "n_control", "mean_beta_case", "mean_beta_control", "meth_diff", "log2_odds_ratio",
        "pvalue", "qvalue", F.when(F.col("meth_diff") > 0, "hyper").otherwise("hypo").alias("dmr_type"),
    )
    return merge_tiles(out) if merge else out


def dvr_density(dvc: DataFrame, tile: int = 1000, min_cpgs: int = 5, alpha: float = 0.05) -> DataFrame:
    """Tiles with more differentially variable sites than the overall rate explains."""
    rate = dvc.agg(F.avg(F.col("is_dvc").cast("int")).alias("_rate"))
    g = dvc.groupBy("chrom", F.expr(f"pos div {tile}").alias("_t")).agg(
        F.min("pos").alias("start"), (F.max("pos") + 1).cast("int").alias("end"), F.count("*").alias("n_cpgs"), F.count_if("is_dvc").alias("n_dvc"),
        F.avg("var_log_ratio").alias("mean_log_ratio"), F.sum(F.when(F.col("is_dvc"), F.signum("var_log_ratio"))).alias("sign_sum"),
    )
    x = g.where(F.col("n_cpgs") >= min_cpgs).drop("_t").crossJoin(rate)
    x = x.withColumn("pvalue", C.binomial_tail("n_dvc", "n_cpgs", "_rate")).drop("_rate")
    return fdr.adjust(x, "pvalue", "bh", alpha, "drop").withColumnRenamed("reject", "is_dvr")


def diagnose(dmc: DataFrame, reference: DataFrame, called: DataFrame, alpha: float = 1e-5) -> DataFrame:
    """Reference regions: called (closed overlap), else whether any site is in them and passes."""
    c = called.select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    hit = ranges.overlaps(reference, c, True, "left_semi").select("chrom", "start", "end").distinct().withColumn("_hit", F.lit(True))
    best = ranges.points_in(dmc, reference.withColumn("end", F.col("end") + 1).select("chrom", "start", "end")).groupBy("chrom", "start", (F.col("end") - 1).cast("int").alias("end")).agg(F.min("qvalue").alias("min_q"), F.count("*").alias("n_sites"))
    x = reference.join(hit, ["chrom", "start", "end"], "left").join(best, ["chrom", "start", "end"], "left")
    why = F.when(F.col("_hit"), "called").when(F.col("n_sites").isNull(), "no_sites").when(F.col("min_q") < alpha, "filtered").otherwise("not_significant")
    return x.withColumn("status", why).drop("_hit")
