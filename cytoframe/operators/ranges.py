"""Interval joins on bins, backward and nearest joins, and islands.

A point or interval join is an equi-join on (chrom, bin) with the range test as
residual: the interval side is exploded over the bins that it touches. There is
no nested loop and no broadcast of a side of unknown size; Spark may still
broadcast a side that it has measured.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIN = 10_000


def points_in(points: DataFrame, regions: DataFrame, how: str = "inner", bin_size: int = BIN) -> DataFrame:
    """points (chrom, pos) x regions (chrom, start, end), start <= pos < end; how: inner, left_semi, left_anti or left."""
    r = regions.withColumn("_bin", F.explode(F.sequence(F.expr(f"start div {bin_size}"), F.expr(f"greatest(start, end - 1) div {bin_size}")))).withColumnRenamed("chrom", "_rc")
    p = points.withColumn("_pb", F.expr(f"pos div {bin_size}"))
    on = (F.col("chrom") == F.col("_rc")) & (F.col("_pb") == F.col("_bin")) & (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end"))
    return p.join(r, on, how).drop("_pb", "_bin", "_rc")


def overlaps(left: DataFrame, right: DataFrame, closed: bool = False, how: str = "inner", bin_size: int = BIN) -> DataFrame:
    """Intervals left (chrom, start, end, ...) x right (chrom, r_start, r_end, ...), each pair once; closed: touching counts."""
    slack = 1 if closed else 0
    lx = left.withColumn("_lb", F.explode(F.sequence(F.expr(f"start div {bin_size}"), F.expr(f"(end - 1 + {slack}) div {bin_size}"))))
    rx = right.withColumn("_rb", F.explode(F.sequence(F.expr(f"r_start div {bin_size}"), F.expr(f"(r_end - 1 + {slack}) div {bin_size}")))).withColumnRenamed("chrom", "_rc")
    test = (F.col("start") <= F.col("r_end")) & (F.col("r_start") <= F.col("end")) if closed else (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    on = (F.col("chrom") == F.col("_rc")) & (F.col("_lb") == F.col("_rb")) & test
    if how in ("inner", "left"):  # a pair counts in the bin of the later start
        on = on & (F.col("_lb") == F.greatest(F.expr(f"start div {bin_size}"), F.expr(f"r_start div {bin_size}")))
    out = lx.join(rx, on, how).drop("_lb", "_rb", "_rc")
    return out.distinct() if how in ("left_semi", "left_anti") else out


def _around(points: DataFrame, marks: DataFrame, at: str, bin_size: int) -> DataFrame:
    """points with _in, the marks (structs, in order) of their bin, and _before and _after, the nearest marks of other bins.

    Only the table of bins is ordered along a chromosome, a row for each bin
    that has points or marks; points meet it by (chrom, bin).
    """
    cols = [c for c in marks.columns if c != "chrom"]
    m = marks.select("chrom", F.expr(f"{at} div {bin_size}").alias("_bin"), F.struct(at, *(c for c in cols if c != at)).alias("_m"))
    m = m.groupBy("chrom", "_bin").agg(F.sort_array(F.collect_list("_m")).alias("_in"))
    p = points.withColumn("_bin", F.expr(f"pos div {bin_size}"))
    bins = p.select("chrom", "_bin").distinct().join(m, ["chrom", "_bin"], "full")
    w = Window.partitionBy("chrom").orderBy("_bin")
    bins = bins.withColumns({
        "_before": F.last(F.element_at("_in", -1), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "_after": F.first(F.element_at("_in", 1), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
    })
    return p.join(bins, ["chrom", "_bin"]).drop("_bin")


def last_start_before(points: DataFrame, regions: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Backward join: each point with the region of the greatest start <= pos on its chromosome (region columns null if none)."""
    cols = [c for c in regions.columns if c != "chrom"]
    x = _around(points, regions, "start", bin_size)
    own = F.try_element_at(F.filter("_in", lambda r: r["start"] <= F.col("pos")), F.lit(-1))
    x = x.withColumn("_hit", F.coalesce(own, F.col("_before")))
    return x.select(*points.columns, *(F.col("_hit")[c].alias(c) for c in cols))


def nearest(points: DataFrame, marks: DataFrame, bin_size: int = BIN * 10) -> DataFrame:
    """points with the nearest mark (chrom, at, name): columns near_at, near_name; of two as near the lower."""
    m = marks.groupBy("chrom", "at").agg(F.min("name").alias("name"))
    x = _around(points, m, "at", bin_size)
    lo = F.coalesce(F.try_element_at(F.filter("_in", lambda r: r["at"] <= F.col("pos")), F.lit(-1)), F.col("_before"))
    hi = F.coalesce(F.try_element_at(F.filter("_in", lambda r: r["at"] >= F.col("pos")), F.lit(1)), F.col("_after"))
    x = x.withColumns({"_lo": lo, "_hi": hi})
    low = F.col("_lo").isNotNull() & (F.col("_hi").isNull() | (F.col("pos") - F.col("_lo.at") <= F.col("_hi.at") - F.col("pos")))
    return x.select(*points.columns, F.when(low, F.col("_lo.at")).otherwise(F.col("_hi.at")).alias("near_at"), F.when(low, F.col("_lo.name")).otherwise(F.col("_hi.name")).alias("near_name"))


def islands(rows: DataFrame, keys: list[str], order: str, starts: object) -> DataFrame:
    """rows with `island`: the running count, within keys by order, of rows where `starts` (a Column over lag) is true."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("island", F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def gap_islands(rows: DataFrame, keys: list[str], order: str, gap: int) -> DataFrame:
    """A new island where the step from the row before exceeds the gap."""
    before = F.lag(order).over(Window.partitionBy(*keys).orderBy(order))
    return islands(rows.withColumn("_new", before.isNull() | (F.col(order) - before > gap)), keys, order, F.col("_new")).drop("_new")


def merge_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Union of spans (keys, start, end) that overlap or touch: start <= running end."""
    w = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("end").over(w)
    x = islands(spans.withColumn("_new", reach.isNull() | (F.col("start") > reach)), keys, "start", F.col("_new"))
    return x.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
