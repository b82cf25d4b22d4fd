"""One door to the two-group tests, for sites and for tiles alike."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import models, tests


@dataclass(frozen=True)
class Groups:
    """The samples of both groups; a design (rows in the order case, control) with the column that is tested, or contrasts of it, makes the test a regression."""

    case: list[str]
    control: list[str]
    design: np.ndarray | None = None
    column: int | None = None
    contrasts: np.ndarray | None = None

    @property
    def samples(self) -> list[str]:
        return [*self.case, *self.control]

    @property
    def is_case(self) -> Column:
        return F.col("sample").isin(self.case)


TESTS = ("lr", "score", "fisher", "cmh", "welch_t", "logit_t", "bb_lr", "glm")


def site_test(x: DataFrame, groups: Groups, test: str, dispersion: str = "site", reference: str = "adaptive", separated: float | None = None) -> DataFrame:
    """Rows (chrom, pos, pvalue, …) of the named test over counts (sample, chrom, pos, n_meth, coverage)."""
    case = groups.is_case
    if test in ("lr", "score"):
        return tests.quasi_binomial(x, case, test, dispersion, reference, separated if test == "lr" else None)
    if test in ("welch_t", "logit_t"):
        return tests.welch(x, case, "logit" if test == "logit_t" else "none")
    if test in ("fisher", "cmh"):
        return (tests.fisher if test == "fisher" else tests.cmh)(x, case)
    if test not in ("bb_lr", "glm"):
        raise ValueError(f"no test {test!r}; there are {', '.join(TESTS)}")
    full = groups.design
    if test == "bb_lr" or full is None:
        out = models.two_group_glm(x, groups.case, groups.control, dispersion, reference)
    elif groups.contrasts is not None:
        out = models.glm(x, groups.samples, full, contrasts=groups.contrasts, reference=reference, dispersion=dispersion)
    else:
        out = models.glm(x, groups.samples, full, np.delete(full, groups.column, axis=1), groups.column, reference=reference, dispersion=dispersion)
    out = out.join(covered(x, case).select(*tests.SITE, "mean_beta_case", "mean_beta_control"), tests.SITE)
    out = out.withColumn("meth_diff", F.col("mean_beta_case") - F.col("mean_beta_control"))
    odds = F.col("coef") / math.log(2) if groups.contrasts is None else F.lit(None).cast("double")
    return out.withColumn("log2_odds_ratio", odds)


def covered(x: DataFrame, case: Column) -> DataFrame:
    """(chrom, pos, n_case, n_control, mean_beta_case, mean_beta_control): samples with coverage, and their levels' means."""
    on = F.col("coverage") > 0
    level = F.when(on, F.col("n_meth") / F.col("coverage"))
    return x.groupBy(*tests.SITE).agg(
        F.count_if(on & case).cast("int").alias("n_case"), F.count_if(on & ~case).cast("int").alias("n_control"),
        F.avg(F.when(case, level)).cast("float").alias("mean_beta_case"), F.avg(F.when(~case, level)).cast("float").alias("mean_beta_control"),
    )
