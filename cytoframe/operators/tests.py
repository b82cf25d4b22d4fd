"""Per-site tests of two groups, as one aggregate by site and column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.tables import small, written
from . import fdr

SITE = ["chrom", "pos"]


def accumulate(sites: DataFrame, case: Column) -> DataFrame:
    """Per site and group: s0 coverage, s1 methylated, s2 sum of m^2/n, v covered samples; mean and variance of beta."""
    out = []
    n, m = F.col("coverage"), F.col("n_meth")
    for g, on in (("a", case), ("b", ~case)):
        some = on & (n > 0)
        b = F.when(some, m / n)
        out += [
            F.coalesce(F.sum(F.when(on, n)), F.lit(0)).alias(f"s0_{g}"), F.coalesce(F.sum(F.when(on, m)), F.lit(0)).alias(f"s1_{g}"),
            F.coalesce(F.sum(F.when(some, m.cast("double") * m / n)), F.lit(0.0)).alias(f"s2_{g}"), F.count_if(some).alias(f"v_{g}"),
            F.avg(b).alias(f"mean_{g}"), F.var_samp(b).alias(f"var_{g}"),
        ]
    return sites.groupBy(*SITE).agg(*out)


def with_dispersion(acc: DataFrame, mode: str = "site", min_sites: int = 100, pseudo: float = 4.0, by: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """acc with pi_a, pi_b, chi_a, chi_b, disp and phi; modes site, chrom, shrink and eb.

    Chromosome-wide figures are aggregates joined back, one row for each value
    of `by` (a chromosome, or a permutation and chromosome).
    """
    x = acc
    for g in "ab":
        x = x.withColumn(f"pi_{g}", F.try_divide(F.col(f"s1_{g}").cast("double"), f"s0_{g}"))
        num = F.col(f"s2_{g}") - F.try_divide(F.col(f"s1_{g}").cast("double") * F.col(f"s1_{g}"), F.col(f"s0_{g}"))
        den = F.try_divide(F.col(f"s1_{g}").cast("double") * (F.col(f"s0_{g}") - F.col(f"s1_{g}")), F.col(f"s0_{g}").cast("double") * F.col(f"s0_{g}"))
        x = x.withColumn(f"den_{g}", F.coalesce(den, F.lit(0.0))).withColumn(f"chi_{g}", F.when(F.col(f"den_{g}") > 0, num / F.col(f"den_{g}")).otherwise(0.0))
    both = (F.col("s0_a") > 0) & (F.col("s0_b") > 0) & (F.col("v_a") > 0) & (F.col("v_b") > 0)
    x = x.withColumn("both", both).withColumn("disp", both & (F.col("den_a") > 0) & (F.col("den_b") > 0))
    df = F.col("v_a") + F.col("v_b") - 2
    chi = F.col("chi_a") + F.col("chi_b")
    site = F.greatest(F.when(F.col("disp") & (df > 0), chi / df).otherwise(1.0), F.lit(1.0))
    x = x.withColumn("df", df).withColumn("phi_site", site)
    if mode == "site":
        return x.withColumn("phi", F.col("phi_site"))
    d = F.col("disp")
    whole_of = x.groupBy(*by).agg(
        F.count_if(d).alias("nd"), F.sum(F.when(d, chi)).alias("sum_chi"), F.sum(F.when(d, F.col("v_a") + F.col("v_b"))).alias("sum_v"),
        F.avg(F.when(d, F.col("phi_site"))).alias("m_phi"), F.var_pop(F.when(d, F.col("phi_site"))).alias("v_phi"),
    )
    whole = F.greatest(F.lit(1.0), F.when(F.col("nd") >= min_sites, F.col("sum_chi") / F.greatest(F.col("sum_v") - 2 * F.col("nd"), F.lit(1))).otherwise(1.0))
    whole_of = whole_of.withColumn("phi_chrom", whole).withColumn(
        "w", F.when((F.col("nd") >= min_sites) & (F.col("v_phi") > 1e-9), F.greatest(F.lit(1.0), 2 * (F.col("m_phi") ** 2 / F.when(F.col("v_phi") > 1e-9, F.col("v_phi")) + 2))).otherwise(pseudo)
    )
    x = x.join(whole_of.select(*by, "phi_chrom", "w"), list(by))
    if mode == "chrom":
        return x.withColumn("phi", F.col("phi_chrom"))
    w = F.col("w") if mode == "eb" else F.lit(pseudo)
    mixed = F.greatest(F.lit(1.0), (F.col("df") * F.col("phi_site") + w * F.col("phi_chrom")) / F.when(F.col("df") + w != 0, F.col("df") + w))
    return x.withColumn("phi", F.when(d, mixed).otherwise(F.col("phi_chrom")))


def raw_statistics(x: DataFrame) -> DataFrame:
    """x with score_raw and lr_raw; null where the pooled variance is 0 or a group is empty."""
    s0a, s0b, s1a, s1b = (F.col(c).cast("double") for c in ("s0_a", "s0_b", "s1_a", "s1_b"))
    pooled = F.try_divide(s1a + s1b, s0a + s0b)
    p = C.clip(pooled, C.EPS, 1 - C.EPS)
    var = F.try_divide(s0a * s0b, s0a + s0b) * p * (1 - p)
    ok = F.col("both") & (var > 0)

    def part(s0, s1, pi):
        q = C.clip(pi, C.EPS, 1 - C.EPS)
        return s1 * F.ln(q / p) + (s0 - s1) * F.ln((1 - q) / (1 - p))

    lr = 2 * (part(s0a, s1a, F.col("pi_a")) + part(s0b, s1b, F.col("pi_b")))
    return x.withColumn("score_raw", F.when(ok, (s1a - s0a * pooled) ** 2 / F.when(var > 0, var))).withColumn("lr_raw", F.when(ok, lr))


def _effects(x: DataFrame, pooled: bool) -> DataFrame:
    a, b = (F.col("pi_a"), F.col("pi_b")) if pooled else (F.col("mean_a"), F.col("mean_b"))
    lo, hi = C.welch_ci(a, F.coalesce(F.try_divide("var_a", "v_a"), F.lit(0.0)), b, F.coalesce(F.try_divide("var_b", "v_b"), F.lit(0.0)))
    return x.withColumns({
        "mean_beta_case": a.cast("float"), "mean_beta_control": b.cast("float"), "meth_diff": (a - b).cast("float"),
        "log2_odds_ratio": C.log2_odds_ratio(a, b), "meth_diff_ci_lo": lo.cast("float"), "meth_diff_ci_hi": hi.cast("float"),
    })


def _quasi_p(x: DataFrame, statistic: str, reference: str) -> DataFrame:
    x = x.withColumn("stat", F.col(f"{statistic}_raw") / F.col("phi"))
    chi, f = C.chi2_tail(F.col("stat")), C.f1_tail(F.col("stat"), F.greatest(F.col("df"), F.lit(1)).cast("double"))
    return x.withColumn("pvalue", {"chi2": chi, "F": f, "adaptive": F.when(F.col("phi") > 1, f).otherwise(chi)}[reference])


def quasi_binomial(sites: DataFrame, case: Column, statistic: str = "lr", dispersion: str = "site", reference: str = "adaptive", separated: float | None = None) -> DataFrame:
    """Quasi-likelihood ratio or score test with F(1, df) where phi > 1 (adaptive), always (F) or never (chi2).

    separated: where pooled levels differ by that much and p is over 0.05, an exact test of the pooled counts counts if its p is smaller.
    """
    x = _quasi_p(raw_statistics(with_dispersion(accumulate(sites, case), dispersion)), statistic, reference)
    if separated is not None:
        far = F.col("both") & (F.abs(F.col("pi_a") - F.col("pi_b")) >= separated) & (F.col("pvalue") > 0.05)
        exact = C.fisher_exact(*(F.when(far, c).otherwise(0) for c in (F.col("s1_a"), F.col("s0_a") - F.col("s1_a"), F.col("s1_b"), F.col("s0_b") - F.col("s1_b"))))
        x = x.withColumn("pvalue", F.when(far, F.least("pvalue", exact)).otherwise(F.col("pvalue")))
    return _effects(x, True)


def fisher(sites: DataFrame, case: Column) -> DataFrame:
    """Exact test of the groups' summed counts; the odds ratio is that of the counts, infinite where only its numerator is over 0."""
    x = with_dispersion(accumulate(sites, case))
    ma, ua, mb, ub = (c.cast("double") for c in (F.col("s1_a"), F.col("s0_a") - F.col("s1_a"), F.col("s1_b"), F.col("s0_b") - F.col("s1_b")))
    x = _effects(x.withColumn("pvalue", C.fisher_tail("s1_a", F.col("s0_a") - F.col("s1_a"), "s1_b", F.col("s0_b") - F.col("s1_b"))), False)
    top, low = ma * ub, ua * mb
    ratio = F.when((top > 0) & (low > 0), F.log2(F.when(top > 0, top) / F.when(low > 0, low))).when(top > 0, F.lit(float("inf")))
    return x.withColumn("log2_odds_ratio", F.when((F.col("s0_a") > 0) & (F.col("s0_b") > 0), ratio))


def cmh(sites: DataFrame, case: Column) -> DataFrame:
    """Cochran-Mantel-Haenszel over strata of each case sample with each control sample of a site.

    The strata of a site come from its two arrays of counts and are folded as
    they come; their number is the product of the group sizes.
    """
    pair = F.struct(F.col("n_meth").cast("double").alias("m"), F.col("coverage").cast("double").alias("n"))
    level = F.when(F.col("coverage") > 0, F.col("n_meth") / F.col("coverage"))
    spread = [f(F.when(on, level)).alias(f"{n}_{g}") for g, on in (("a", case), ("b", ~case)) for n, f in (("mean", F.avg), ("var", F.var_samp), ("v", F.count))]
    g = sites.groupBy(*SITE).agg(F.collect_list(F.when(case, pair)).alias("xs"), F.collect_list(F.when(~case, pair)).alias("ys"), *spread)
    none = "named_struct('ome', 0.0D, 'var', 0.0D, 'or_num', 0.0D, 'or_den', 0.0D, 'k', 0)"
    n = "(x.n + y.n)"
    step = (
        f"IF({n} > 1, named_struct('ome', t.ome + x.m - x.n * (x.m + y.m) / {n}, 'var', t.var + x.n * y.n * (x.m + y.m) * ({n} - x.m - y.m) / ({n} * {n} * ({n} - 1)), "
        f"'or_num', t.or_num + x.m * (y.n - y.m) / {n}, 'or_den', t.or_den + (x.n - x.m) * y.m / {n}, 'k', t.k + 1), t)"
    )
    fold = F.expr(f"aggregate(xs, {none}, (s, x) -> aggregate(ys, s, (t, y) -> {step}))")
    kept = [f"{n}_{g}" for g in "ab" for n in ("mean", "var", "v")]
    out = _effects(g.select(*SITE, fold.alias("f"), *kept).where("f.k > 0"), False).select("*", "f.ome", "f.var", "f.or_num", "f.or_den").drop("f")
    stat = F.when(F.col("var") > 0, F.col("ome") ** 2 / F.when(F.col("var") > 0, F.col("var")))
    ratio = F.when((F.col("or_num") > 0) & (F.col("or_den") > 0), F.log2(F.col("or_num") / F.when(F.col("or_den") > 0, F.col("or_den"))))
    return out.withColumn("stat", stat).withColumn("log2_odds_ratio", ratio).withColumn("pvalue", C.chi2_tail(F.col("stat")))


def welch(sites: DataFrame, case: Column, transform: str = "none") -> DataFrame:
    """Welch's t on beta, or on its logit with the delta method's variance."""
    x = with_dispersion(accumulate(sites, case))
    for g in "ab":
        s2 = F.coalesce(F.col(f"var_{g}"), F.lit(0.0))
        if transform == "logit":
            x = x.withColumn(f"loc_{g}", C.logit(F.col(f"mean_{g}"))).withColumn(f"se2_{g}", s2 * C.logit_jacobian(F.col(f"mean_{g}")) ** 2 / F.greatest(F.col(f"v_{g}"), F.lit(1)))
        else:
            x = x.withColumn(f"loc_{g}", F.col(f"mean_{g}")).withColumn(f"se2_{g}", s2 / F.greatest(F.col(f"v_{g}"), F.lit(1)))
    total = F.col("se2_a") + F.col("se2_b")
    ok = F.col("both") & (total > 0)
    t = F.when(ok, (F.col("loc_a") - F.col("loc_b")) / F.sqrt(F.when(total > 0, total)))
    bottom = F.col("se2_a") ** 2 / F.greatest(F.col("v_a") - 1, F.lit(1)) + F.col("se2_b") ** 2 / F.greatest(F.col("v_b") - 1, F.lit(1))
    df = F.when(ok, F.greatest(F.lit(1.0), total**2 / F.when(bottom > 0, bottom)))
    return _effects(x.withColumn("stat", t).withColumn("t_df", df).withColumn("pvalue", C.t_tails(F.col("stat"), F.col("t_df"))), False)


def bartlett(sites: DataFrame, case: Column) -> DataFrame:
    """Differential variability: Bartlett's chi-square of the two variances, with Welch's test of the means beside it."""
    x = welch(sites, case)
    na, nb, va, vb = F.col("v_a"), F.col("v_b"), F.col("var_a"), F.col("var_b")
    ok = (na > 1) & (nb > 1) & (va > 0) & (vb > 0)
    dof = na + nb - 2
    pooled = ((na - 1) * va + (nb - 1) * vb) / F.when(dof > 0, dof)
    corr = 1 + (F.try_divide(F.lit(1.0), na - 1) + F.try_divide(F.lit(1.0), nb - 1) - F.try_divide(F.lit(1.0), dof)) / 3
    stat = F.when(ok, (dof * F.ln(F.when(pooled > 0, pooled)) - (na - 1) * F.ln(F.when(va > 0, va)) - (nb - 1) * F.ln(F.when(vb > 0, vb))) / corr)
    ratio = F.when(ok, F.log2(F.when(va > 0, va) / F.when(vb > 0, vb)))
    x = x.withColumnRenamed("pvalue", "p_mean").withColumn("bartlett", stat).withColumn("var_log_ratio", ratio)
    return x.withColumn("p_var", C.chi2_tail(F.col("bartlett")))


def label_sets(case: list[str], control: list[str], n_perm: int = 100, seed: int = 42) -> list[list[str]]:
    """Case samples of each permutation: the labels of all samples, shuffled by a generator seeded with seed + number."""
    out = []
    for i in range(n_perm):
        names = [*case, *control]
        np.random.default_rng(seed + i + 1).shuffle(names)
        out.append(sorted(names[: len(case)]))
    return out


def permuted_tests(sites: DataFrame, sets: list[list[str]], statistic: str = "lr", dispersion: str = "site", reference: str = "adaptive") -> DataFrame:
    """(perm, chrom, pos, pvalue) of the test under each set of case samples.

    A site's counts are one array, gathered once; each permutation folds it
    anew in place, so permutations multiply work but not what is shuffled.
    """
    row = F.struct("sample", F.col("n_meth").cast("double").alias("m"), F.col("coverage").cast("double").alias("n"))
    g = sites.groupBy(*SITE).agg(F.collect_list(row).alias("c"))
    perms = F.array(*(F.struct(F.lit(i).alias("perm"), F.array(*map(F.lit, s)).alias("case")) for i, s in enumerate(sets)))
    x = g.select(*SITE, "c", F.explode(perms).alias("p")).select("p.perm", *SITE, "c", "p.case")
    for side, yes in (("a", ""), ("b", "NOT ")):
        own = f"filter(c, x -> {yes}array_contains(case, x.sample))"
        x = x.withColumn(f"_{side}", F.expr(f"aggregate({own}, named_struct('s0', 0.0D, 's1', 0.0D, 's2', 0.0D, 'v', 0), (t, x) -> named_struct('s0', t.s0 + x.n, 's1', t.s1 + x.m, 's2', IF(x.n > 0, t.s2 + x.m * x.m / x.n, t.s2), 'v', t.v + IF(x.n > 0, 1, 0)))"))
    acc = x.select("perm", *SITE, *(F.col(f"_{g}.{k}").alias(f"{k}_{g}") for g in "ab" for k in ("s0", "s1", "s2", "v")))
    return _quasi_p(raw_statistics(with_dispersion(acc, dispersion, by=("perm", "chrom"))), statistic, reference).select("perm", *SITE, "pvalue")


def masked(results: DataFrame, sites: DataFrame, case: Column, min_case: int = 0, min_control: int = 0) -> DataFrame:
    """results with p-value, effects and bounds null at sites that too few samples of a group cover."""
    if not (min_case or min_control):
        return results
    covered = F.col("coverage") > 0
    n = sites.groupBy(*SITE).agg(F.count_if(covered & case).alias("_nc"), F.count_if(covered & ~case).alias("_nn"))
    x = results.join(n, SITE, "left")
    ok = (F.col("_nc") >= min_case) & (F.col("_nn") >= min_control)
    hide = [c for c in ("pvalue", "stat", "log2_odds_ratio", "meth_diff", "mean_beta_case", "mean_beta_control", "meth_diff_ci_lo", "meth_diff_ci_hi", "coef", "coef_se") if c in results.columns]
    return x.withColumns({c: F.when(ok, F.col(c)) for c in hide}).drop("_nc", "_nn")


def auto_test(n_case: int, n_control: int, allow_single: bool = False) -> str:
    """The test for groups of these sizes: a likelihood ratio, or with one sample in a group an exact test of counts, if that is allowed."""
    if min(n_case, n_control) < 1:
        raise ValueError("both groups need a sample")
    if min(n_case, n_control) < 2:
        if not allow_single:
            raise ValueError("a group of one sample has no spread to test against; allow_single=True takes an exact test of its counts")
        return "fisher"
    return "lr"


def check_groups(n_case: int, n_control: int, united: str, allow_single: bool, min_case: int | None, min_control: int) -> None:
    """Refuses sample minima that no site can meet, and single samples over the union of sites, where most sites would have one group only."""
    if (min_case or 0) > n_case or min_control > n_control:
        raise ValueError("a minimum of covered samples is over the group's size")
    if min(n_case, n_control) < 2 and united != "intersect" and not (min_case and min_control):
        if not allow_single:
            raise ValueError("single samples over the union of sites; unite by intersection or set minima for both groups")


def permuted_pvalues(observed: DataFrame, null: DataFrame, p: str = "pvalue") -> DataFrame:
    """observed with (1 + null values at most p) / (1 + all null values).

    Counts come from the union of both tables' distinct values in order, once
    summed by value; no row meets every other.
    """
    observed = written(observed)  # joined by value below
    own = observed.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_v")).agg(F.lit(0).cast("bigint").alias("_n"))
    v = own.union(null.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_v")).agg(F.count("*").alias("_n")))
    v = written(v.groupBy("_v").agg(F.sum("_n").alias("_n")))  # the null is worked out once
    total = v.agg(F.sum("_n")).first()[0] or 0
    upto = small(written(fdr.running_total(v, "_v", "_n").select(F.col("_v").alias(p), "_upto")))
    return observed.join(upto, p, "left").withColumn("p_empirical", F.when(F.col(p).isNotNull(), (F.col("_upto") + 1) / F.lit(total + 1))).drop("_upto")


def shrink_differences(dmc: DataFrame) -> DataFrame:
    """meth_diff_shrunk: times tau^2 / (tau^2 + se^2), tau^2 = max(0, variance of differences - mean se^2)."""
    se2 = ((F.col("meth_diff_ci_hi").cast("double") - F.col("meth_diff_ci_lo").cast("double")) / (2 * 1.959963984540054)) ** 2
    x = dmc.withColumn("_se2", se2)
    d = F.when(F.col("_se2").isNotNull(), F.col("meth_diff").cast("double"))
    tau = x.agg(F.greatest(F.lit(0.0), F.var_samp(d) - F.avg(F.when(F.col("meth_diff").isNotNull(), F.col("_se2")))).alias("_tau2"))
    return x.crossJoin(tau).withColumn("meth_diff_shrunk", F.col("meth_diff").cast("double") * F.try_divide("_tau2", F.col("_tau2") + F.col("_se2"))).drop("_se2", "_tau2")
