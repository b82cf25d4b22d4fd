"""Methylation-shaped views over the driver's tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = [f"s{i}" for i in range(8)]
CASE, CONTROL = SAMPLES[:4], SAMPLES[4:]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select(
        F.expr("concat('s', l_suppkey % 8)").alias("sample"), F.expr("concat('chr', l_partkey % 5)").alias("chrom"), F.expr("cast((l_partkey div 5) * 100 as int)").alias("pos"), "l_quantity",
        F.expr("l_returnflag = 'R' OR (l_returnflag = 'N' AND l_suppkey % 8 < 4 AND ((l_partkey div 5) div 8) % 10 = 3)").alias("meth"),
    )
    g = x.groupBy("sample", "chrom", "pos").agg(F.sum("l_quantity").cast("int").alias("coverage"), F.sum(F.when(F.col("meth"), F.col("l_quantity")).otherwise(0)).cast("int").alias("n_meth"))
    return g.select("chrom", "pos", F.lit("+").alias("strand"), F.lit("CpG").alias("context"), "n_meth", (F.col("coverage") - F.col("n_meth")).alias("n_unmeth"), "coverage", "sample")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr("concat('chr', s_suppkey % 5) AS chrom", "cast(s_suppkey * 400 as int) AS start", "cast(s_suppkey * 400 + 250 + (s_suppkey % 7) * 100 as int) AS end", "concat('r', s_suppkey) AS region_id")


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('chr', s_suppkey % 5) AS chrom", "cast(s_suppkey * 390 + 1000 as int) AS start", "cast(s_suppkey * 390 + 2000 + (s_suppkey % 9) * 150 as int) AS end",
        "IF(s_suppkey % 2 = 0, '+', '-') AS strand", "concat('g', s_suppkey) AS gene_id", "IF(s_suppkey % 4 = 0, 'lncRNA', 'protein_coding') AS gene_type",
    )


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genes(spark, sf_dir).selectExpr("chrom", "explode(array(0, 1, 2)) AS k", "start AS gs", "strand", "gene_id").selectExpr("chrom", "cast(gs + 100 + k * 350 as int) AS start", "cast(gs + 250 + k * 350 as int) AS end", "strand", "gene_id")


def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").where("s_suppkey % 6 = 0").selectExpr("concat('chr', s_suppkey % 5) AS chrom", "cast(s_suppkey * 395 as int) AS start", "cast(s_suppkey * 395 + 500 as int) AS end")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "concat('t', user_id % 3) AS sample", "'chr1' AS chrom", "concat('q', event_id div 6) AS read_id", "cast((event_id % 6 + (event_id div 6) % 5) * 4 as int) AS pos", "cast(IF(value > 10, 1, 0) as tinyint) AS status", "user_id",
    ).selectExpr("'t0' AS sample", "chrom", "read_id", "pos", "status")


def alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "'t0' AS sample", "concat('q', event_id div 6) AS read_id", "50 AS snv_pos", "'A' AS ref", "'G' AS alt", "IF(event_type IN ('error', 'click'), 'A', IF(event_type = 'view', 'G', 'C')) AS base"
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-site differences with a made-up p-value, so that what builds on p-values can be compared exactly."""
    s = sites(spark, sf_dir)
    case = F.col("sample").isin(CASE)
    g = s.groupBy("chrom", "pos").agg(*(F.sum(F.when(on, F.col(c))).alias(f"{c}_{k}") for k, on in (("a", case), ("b", ~case)) for c in ("n_meth", "coverage")))
    g = g.where("coverage_a > 0 AND coverage_b > 0")
    diff = (F.col("n_meth_a").cast("double") / F.col("coverage_a") - F.col("n_meth_b").cast("double") / F.col("coverage_b")).cast("float")
    p = F.expr("((cast(pos as bigint) * 7919 + cast(substring(chrom, 4) as int) * 104729) % 10007 + 1) / 10008.0D")
    return g.select("chrom", "pos", diff.alias("meth_diff"), p.alias("pvalue"), p.alias("qvalue"))


SITES = """sites AS (SELECT chrom, pos, '+' AS strand, 'CpG' AS context, n_meth, coverage - n_meth AS n_unmeth, coverage, sample FROM (
  SELECT 's' || (l_suppkey % 8) AS sample, 'chr' || (l_partkey % 5) AS chrom, CAST((l_partkey // 5) * 100 AS INTEGER) AS pos,
    CAST(sum(l_quantity) AS INTEGER) AS coverage,
    CAST(sum(CASE WHEN l_returnflag = 'R' OR (l_returnflag = 'N' AND l_suppkey % 8 < 4 AND ((l_partkey // 5) // 8) % 10 = 3) THEN l_quantity ELSE 0 END) AS INTEGER) AS n_meth
  FROM lineitem GROUP BY ALL))"""
REGIONS = """regions AS (SELECT 'chr' || (s_suppkey % 5) AS chrom, CAST(s_suppkey * 400 AS INTEGER) AS "start", CAST(s_suppkey * 400 + 250 + (s_suppkey % 7) * 100 AS INTEGER) AS "end", 'r' || s_suppkey AS region_id FROM supplier)"""
GENES = """genes AS (SELECT 'chr' || (s_suppkey % 5) AS chrom, CAST(s_suppkey * 390 + 1000 AS INTEGER) AS "start", CAST(s_suppkey * 390 + 2000 + (s_suppkey % 9) * 150 AS INTEGER) AS "end",
  CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand, 'g' || s_suppkey AS gene_id, CASE WHEN s_suppkey % 4 = 0 THEN 'lncRNA' ELSE 'protein_coding' END AS gene_type FROM supplier)"""
EXONS = """exons AS (SELECT chrom, CAST("start" + 100 + k * 350 AS INTEGER) AS "start", CAST("start" + 250 + k * 350 AS INTEGER) AS "end", strand, gene_id FROM genes, (SELECT unnest([0, 1, 2]) AS k))"""
ISLANDS = """islands AS (SELECT 'chr' || (s_suppkey % 5) AS chrom, CAST(s_suppkey * 395 AS INTEGER) AS "start", CAST(s_suppkey * 395 + 500 AS INTEGER) AS "end" FROM supplier WHERE s_suppkey % 6 = 0)"""
CALLS = """calls AS (SELECT 't0' AS sample, 'chr1' AS chrom, 'q' || (event_id // 6) AS read_id, CAST((event_id % 6 + (event_id // 6) % 5) * 4 AS INTEGER) AS pos, CASE WHEN value > 10 THEN 1 ELSE 0 END AS status FROM events)"""
ALLELES = """alleles AS (SELECT 't0' AS sample, 'q' || (event_id // 6) AS read_id, CASE WHEN event_type IN ('error', 'click') THEN 0 WHEN event_type = 'view' THEN 1 END AS h FROM events)"""
RESULTS = """res0 AS (SELECT chrom, pos, sum(n_meth) FILTER (WHERE sample < 's4') AS ma, sum(coverage) FILTER (WHERE sample < 's4') AS ca, sum(n_meth) FILTER (WHERE sample >= 's4') AS mb, sum(coverage) FILTER (WHERE sample >= 's4') AS cb FROM sites GROUP BY chrom, pos),
results AS (SELECT chrom, pos, CAST(CAST(ma AS DOUBLE) / ca - CAST(mb AS DOUBLE) / cb AS FLOAT) AS meth_diff,
  ((CAST(pos AS BIGINT) * 7919 + CAST(substring(chrom, 4) AS INTEGER) * 104729) % 10007 + 1) / CAST(10008.0 AS DOUBLE) AS pvalue,
  ((CAST(pos AS BIGINT) * 7919 + CAST(substring(chrom, 4) AS INTEGER) * 104729) % 10007 + 1) / CAST(10008.0 AS DOUBLE) AS qvalue FROM res0 WHERE ca > 0 AND cb > 0)"""
