"""Multiple-testing control without a global sort in one task.

Ranks come from the distinct p-values: counted by value, cut into ranges at
approximate quantiles (a bounded list of cut points), summed within ranges and
over the short table of ranges. A value that a third of all rows share is one
row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import meet, written

CUTS = 256


_FRACTIONS = [i / CUTS for i in range(1, CUTS)]


def _part(values: DataFrame, v: str, cuts: list[float] | None) -> Column:
    """How many cuts lie below v, by halving."""
    if cuts is None:
        cuts = values.agg(F.percentile_approx(v, _FRACTIONS, 2000)).first()[0] or []
    cuts = sorted(set(cuts))
    if not cuts:
        return F.lit(0)
    array = "array(" + ", ".join(f"{c!r}D" for c in cuts) + ")"
    mid = "cast((s.lo + s.hi) div 2 as int)"
    return F.expr(
        f"aggregate(sequence(1, {len(cuts).bit_length() + 1}), named_struct('lo', 0, 'hi', {len(cuts)}), (s, i) -> IF(s.lo >= s.hi, s, "
        f"IF(element_at({array}, {mid} + 1) < {v}, named_struct('lo', {mid} + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', {mid})))).lo"
    )


def running_total(values: DataFrame, v: str, n: str, cuts: list[float] | None = None) -> DataFrame:
    """values (distinct v) with _upto, the sum of n over all values at most v, and _part, its range."""
    x = values.withColumn("_part", _part(values, v, cuts))
    base = x.groupBy("_part").agg(F.sum(n).alias("_sum"))
    base = base.withColumn("_base", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    own = F.sum(n).over(Window.partitionBy("_part").orderBy(v).rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("_own", own).join(base, "_part").withColumn("_upto", F.col("_own") + F.col("_base")).drop("_own", "_base")


def _suffix_min(ranked: DataFrame, v: str, raw: Column) -> DataFrame:
    x = ranked.withColumn("_raw", raw)
    low = x.groupBy("_part").agg(F.min("_raw").alias("_low"))
    low = low.withColumn("_later", F.min("_low").over(Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing))).drop("_low")
    own = F.min("_raw").over(Window.partitionBy("_part").orderBy(v).rowsBetween(0, Window.unboundedFollowing))
    return x.withColumn("_own", own).join(low, "_part").withColumn("_q", F.least(F.lit(1.0), F.col("_own"), F.coalesce("_later", F.lit(float("inf")))))


def adjust(df: DataFrame, p: str = "pvalue", method: str = "bh", alpha: float = 0.05, missing: str = "one", q: str = "qvalue") -> DataFrame:
    """df with q and reject; methods bh, by, storey, tsbh and tsbky.

    missing: null p-values count as 1 in the number of tests ("one") or not at
    all ("drop"); their q is null either way. The two-stage methods estimate the
    number of true nulls from a first pass at alpha (tsbky: alpha / (1 + alpha)).
    """
    df = written(df)  # sums of doubles may differ in the last digit from pass to pass, and p is joined by value below
    v = F.col(p).cast("double")
    some = F.coalesce(v, F.lit(1.0)) if missing == "one" else v
    counted = df.select(some.alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)").groupBy("_v").agg(F.count("*").alias("_n"))
    total = counted.agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_v") > 0.5, F.col("_n"))).alias("high"), F.percentile_approx("_v", _FRACTIONS, 2000).alias("cuts")).first()
    n = total["n"] or 0
    ranked = running_total(counted, "_v", "_n", total["cuts"] or [])
    factor, first = 1.0, 1.0
    if method == "by":  # sum of 1 / i by its expansion beyond what is summed directly
        import math

        m = min(n, 1_000_000)
        factor = math.fsum(1 / i for i in range(1, m + 1)) + (math.log(n) - math.log(m) + 0.5 / n - 0.5 / m if n > m else 0.0)
    if method == "storey":
        factor = min(1.0, max(0.0, (total["high"] or 0) / (n * 0.5))) if n else 1.0
    if method in ("tsbh", "tsbky") and n:
        first = 1 + alpha if method == "tsbky" else 1.0
        hit = ranked.where(F.col("_v") * n / F.col("_upto") <= alpha / first).agg(F.max("_upto")).first()[0] or 0
        factor = first if hit in (0, n) else (n - hit) / n * first
    adjusted = _suffix_min(ranked, "_v", F.col("_v") * (n * factor) / F.col("_upto"))
    # p = 1 and a few others can be shared by very many rows, so hot values are met by broadcast; rows without p need no join
    some_p = df.withColumn("_v", v).where("_v IS NOT NULL AND NOT isnan(_v)")
    out = meet(some_p, adjusted.select("_v", F.col("_q").alias(q), F.col("_n").alias("n")), "_v", n).drop("_v")
    out = out.unionByName(df.where(F.col(p).isNull() | F.isnan(v)).withColumn(q, F.lit(None).cast("double")))
    return out.withColumn("reject", F.coalesce(F.col(q) <= alpha, F.lit(False)))
