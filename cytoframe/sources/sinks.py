"""Exports as rows of text or JSON, written by Spark."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import indexed
from .versions import Versions


def chromosome_order(chrom: str = "chrom") -> Column:
    """Sort key: 1 to 22, X, Y, M, then the rest by name."""
    bare = F.regexp_replace(F.upper(F.regexp_replace(chrom, "(?i)^chr", "")), "^MT$", "M")
    named = F.when(bare.rlike(r"^\d+$"), F.try_to_number(bare, F.lit("999999999")).cast("int")).when(bare == "X", 1000).when(bare == "Y", 1001).when(bare == "M", 1002).otherwise(2000)
    return F.struct(named.alias("n"), F.col(chrom).alias("c"))


def value_of(kind: str) -> Column:
    return F.try_divide(F.col("n_meth").cast("double"), "coverage") if kind == "beta" else F.col(kind).cast("double")


def bedgraph_rows(sites: DataFrame, sample: str, value: str = "beta") -> DataFrame:
    """(chrom, start, end, value) of one sample, rows without a value left out."""
    return sites.where(F.col("sample") == sample).select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), value_of(value).alias("value")).where("value IS NOT NULL")


def chromosome_sizes(sites: DataFrame) -> DataFrame:
    return sites.groupBy("chrom").agg((F.max("pos") + 1).alias("size"))


def _numbered(df: DataFrame, prefix: str) -> Column:
    """Names by genomic order: counts of the chromosomes before, plus the row within its own."""
    return F.concat(F.lit(f"{prefix}_"), (F.col("_before") + F.row_number().over(Window.partitionBy("chrom").orderBy("start"))).cast("string"))


def _with_before(df: DataFrame) -> DataFrame:
    n = df.groupBy("chrom").agg(F.count("*").alias("_n"))
    n = n.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return df.join(n, "chrom")


def dmc_bed_rows(dmc: DataFrame, alpha: float = 0.05, delta: float = 0.0) -> DataFrame:
    x = dmc.where((F.col("qvalue") < alpha) & (F.abs("meth_diff") >= delta)).withColumn("start", F.col("pos"))
    score = F.greatest(F.lit(0), F.least(F.lit(1000), F.floor(1000 * (1 - F.col("qvalue"))))).cast("int")
    x = _with_before(x)
    return x.select("chrom", "start", (F.col("start") + 1).alias("end"), _numbered(x, "dmc").alias("name"), score.alias("score"), F.when(F.col("meth_diff") > 0, "+").otherwise("-").alias("strand"))


def dmr_bed_rows(dmr: DataFrame, q: str = "combined_qvalue") -> DataFrame:
    x = _with_before(dmr)
    score = F.when(F.col(q) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1000.0), -100 * F.log10(F.when(F.col(q) > 0, F.col(q)))))).otherwise(0.0)
    strand = F.when(F.col("dmr_type") == "hyper", "+").when(F.col("dmr_type") == "hypo", "-").otherwise(".")
    return x.select("chrom", "start", "end", _numbered(x, "dmr").alias("name"), F.floor(score).cast("int").alias("score"), strand.alias("strand"))


def methylkit_rows(sites: DataFrame) -> DataFrame:
    freq = 100 * F.col("n_meth").cast("double") / F.col("coverage")
    x = sites.where("coverage > 0")
    return x.select("sample", F.concat_ws(".", "chrom", F.col("pos").cast("string")).alias("chrBase"), F.col("chrom").alias("chr"), F.col("pos").alias("base"), F.coalesce("strand", F.lit("*")).alias("strand"), "coverage", F.format_string("%.6f", freq).alias("freqC"), F.format_string("%.6f", 100 - freq).alias("freqT"))


#: Heading of a table of methylKit rows. Fixed value.
METHYLKIT_HEADER = ("chrBase", "chr", "base", "strand", "coverage", "freqC", "freqT")


def write_methylkit(sites: DataFrame, path: str, obs: DataFrame | None = None) -> dict:
    """methylKit rows of every sample in block gzip with position indexes, sorted by chromosome and position; the commit says which files are whose, and a sample's treatment by obs (sample, treatment)."""
    x = methylkit_rows(sites)
    line = F.concat_ws("\t", *(F.col(c).cast("string") for c in METHYLKIT_HEADER))
    rows = x.select("sample", F.col("chr").alias("chrom"), F.col("base").alias("pos"), line.alias("line"))
    about = {r["sample"]: {"treatment": r["treatment"]} for r in obs.select("sample", "treatment").collect()} if obs is not None else None  # a row for each sample
    return indexed.write_table(rows, path, "\t".join(METHYLKIT_HEADER), (2, 3), about)


def write_text(rows: DataFrame, path: str, order: list, header: str | None = None, compression: str | None = None) -> None:
    """Tab-separated text in global order: ranges of rows sorted side by side, in files that read in order."""
    line = F.concat_ws("\t", *(F.col(c).cast("string") for c in rows.columns))
    out = rows.orderBy(*order).select(line.alias("value"))
    if header:
        out = rows.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).union(out)
    w = out.write.mode("overwrite")
    (w.option("compression", compression) if compression else w).text(path)


def write_sites(sites: DataFrame, path: str, keep: bool = False) -> None:
    """The site table as a store by sample and chromosome, in one commit: the samples of the table, and with keep also those that the store has besides."""
    v = Versions(sites.sparkSession, path)
    folder = v.fresh()
    sites.repartition("sample", "chrom").sortWithinPartitions("sample", "chrom", "pos").write.option("compression", "zstd").partitionBy("sample", "chrom").parquet(f"{v.root}/{folder}")
    parts = v.parts(folder)
    v.change(lambda state: {"parts": ((state or {}).get("parts", {}) if keep else {}) | parts, "schema": sites.schema.jsonValue()})


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """A site store as its last commit left it, or plain Parquet."""
    v = Versions(spark, path)
    state = v.current()[1]
    return spark.read.parquet(path) if state is None else v.read(list(state["parts"].values()), StructType.fromJson(state["schema"]))


def qc_documents(tables: dict[str, DataFrame]) -> dict[str, str]:
    """Report sections as JSON, of tables with one row per sample."""
    return {k: json.dumps({"id": k, "plot_type": "table", "data": {r["sample"]: {c: r[c] for c in r.asDict() if c != "sample"} for r in df.collect()}}, sort_keys=True) for k, df in tables.items()}
