"""Gene models, features and islands, and sites annotated with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranges

#: Lower comes first when a site lies in several features. Fixed values.
PRIORITY = {"promoter": 0, "5UTR": 1, "3UTR": 2, "TTS": 3, "exon": 4, "intron": 5, "noncoding": 6}


def _window(genes: DataFrame, at: str, up: int, down: int) -> DataFrame:
    """Around the first (tss) or last (tes) base of a gene, by strand."""
    first = F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end")) if at == "tss" else F.when(F.col("strand") == "+", F.col("end")).otherwise(F.col("start"))
    lo = F.when(F.col("strand") == "+", first - up).otherwise(first - down)
    hi = F.when(F.col("strand") == "+", first + down).otherwise(first + up)
    return genes.select("chrom", F.greatest(lo, F.lit(0)).cast("int").alias("start"), hi.cast("int").alias("end"), "gene_id")


def promoters(genes: DataFrame, upstream: int = 2000, downstream: int = 200) -> DataFrame:
    return _window(genes, "tss", upstream, downstream)


def tts(genes: DataFrame, upstream: int = 100, downstream: int = 1000) -> DataFrame:
    return _window(genes, "tes", upstream, downstream)


def introns(exons: DataFrame, genes: DataFrame) -> DataFrame:
    """Gaps between a gene's exons, within the gene; one before its first exon counts."""
    w = Window.partitionBy("gene_id").orderBy("start", "end")
    g = genes.select("gene_id", F.col("start").alias("_gs"), F.col("end").alias("_ge"))
    x = exons.join(g, "gene_id").withColumn("_from", F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_gs")))
    x = x.select("chrom", F.greatest("_from", "_gs").alias("_a"), F.least("start", "_ge").alias("_b"), "gene_id")
    return x.where("_b > _a").select("chrom", F.col("_a").cast("int").alias("start"), F.col("_b").cast("int").alias("end"), "gene_id")


def noncoding(genes: DataFrame) -> DataFrame:
    return genes.where(F.col("gene_type") != "protein_coding").select("chrom", "start", "end", "gene_id")


def feature_index(genes: DataFrame, exons: DataFrame, features: tuple[str, ...] = ("promoter", "exon", "intron"), utrs: DataFrame | None = None, **promoter: int) -> DataFrame:
    """(chrom, start, end, gene_id, feature, priority), distinct."""
    make = {
        "promoter": lambda: promoters(genes, **promoter), "exon": lambda: exons.select("chrom", "start", "end", "gene_id"), "intron": lambda: introns(exons, genes),
        "TTS": lambda: tts(genes), "noncoding": lambda: noncoding(genes),
        **{s: lambda s=s: (utrs.where(F.col("side") == s) if utrs is not None else exons.limit(0)).select("chrom", "start", "end", "gene_id") for s in ("5UTR", "3UTR")},
    }
    out = None
    for f in features:
        x = make[f]().withColumn("feature", F.lit(f)).withColumn("priority", F.lit(PRIORITY[f]))
        out = x if out is None else out.unionByName(x)
    return out.distinct()


def best_feature(sites: DataFrame, index: DataFrame) -> DataFrame:
    """Each site with its feature of the least priority (then gene_id, start); intergenic without one."""
    hit = ranges.points_in(sites.select("chrom", "pos").distinct(), index)
    best = hit.groupBy("chrom", "pos").agg(F.min(F.struct("priority", "gene_id", "start", "feature")).alias("b"))
    out = sites.join(best, ["chrom", "pos"], "left")
    return out.withColumns({"feature_type": F.coalesce("b.feature", F.lit("intergenic")), "feature_gene": F.col("b.gene_id")}).drop("b")


def all_features(sites: DataFrame, index: DataFrame) -> DataFrame:
    """Each site with the sorted sets of its features and genes."""
    hit = ranges.points_in(sites.select("chrom", "pos").distinct(), index)
    g = hit.groupBy("chrom", "pos").agg(F.sort_array(F.collect_set("feature")).alias("all_overlapping_features"), F.sort_array(F.collect_set("gene_id")).alias("all_overlapping_genes"))
    empty = F.array().cast("array<string>")
    return sites.join(g, ["chrom", "pos"], "left").withColumns({c: F.coalesce(c, empty) for c in ("all_overlapping_features", "all_overlapping_genes")})


def feature_tss(annotated: DataFrame, genes: DataFrame) -> DataFrame:
    """annotated (with feature_gene) with that gene's strand, and the distance from its start in the direction of the gene: null without a gene."""
    start = F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end"))
    g = genes.groupBy("gene_id").agg(F.min(F.struct("strand", start.alias("at"))).alias("_g")).select(F.col("gene_id").alias("feature_gene"), F.col("_g.strand").alias("gene_strand"), F.col("_g.at").alias("_at"))
    x = annotated.join(g, "feature_gene", "left")
    away = F.col("pos") - F.col("_at")
    return x.withColumn("gene_distance", F.when(F.col("gene_strand") == "-", -away).otherwise(away)).drop("_at")


def nearest_tss(sites: DataFrame, genes: DataFrame) -> DataFrame:
    """nearest_gene and signed distance pos - TSS; the TSS of a minus-strand gene is its end."""
    marks = genes.select("chrom", F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end")).alias("at"), F.col("gene_id").alias("name"))
    x = ranges.nearest(sites, marks)
    return x.withColumn("tss_distance", F.col("pos") - F.col("near_at")).withColumnRenamed("near_name", "nearest_gene").drop("near_at")


def island_context(sites: DataFrame, islands: DataFrame, shore: int = 2000, shelf: int = 4000) -> DataFrame:
    """island, shore, shelf or open_sea."""
    wide = islands.withColumnsRenamed({"start": "_s", "end": "_e"})
    near = wide.select("chrom", F.greatest(F.col("_s") - shelf, F.lit(0)).alias("start"), (F.col("_e") + shelf).alias("end"), "_s", "_e")
    hit = ranges.points_in(sites.select("chrom", "pos").distinct(), near)
    far = F.when(F.col("pos") < F.col("_s"), F.col("_s") - F.col("pos")).when(F.col("pos") >= F.col("_e"), F.col("pos") - F.col("_e") + 1).otherwise(0)
    best = hit.groupBy("chrom", "pos").agg(F.min(far).alias("_far"))
    kind = F.when(F.col("_far") == 0, "island").when(F.col("_far") <= shore, "shore").when(F.col("_far") <= shelf, "shelf").otherwise("open_sea")
    return sites.join(best, ["chrom", "pos"], "left").withColumn("cpg_context", kind).drop("_far")


def annotation_counts(annotated: DataFrame, col: str = "all_overlapping_features") -> DataFrame:
    return annotated.select(F.explode(F.array_distinct(col)).alias("annotation")).groupBy("annotation").agg(F.count("*").alias("n"))


def coannotation(annotated: DataFrame, col: str = "all_overlapping_features") -> DataFrame:
    """Rows that have both of two annotations; the diagonal counts one."""
    x = annotated.select(F.array_distinct(col).alias("_a"))
    return x.select(F.explode("_a").alias("a"), "_a").select("a", F.explode("_a").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def categorical_shares(annotated: DataFrame, group: str, col: str = "feature_type") -> DataFrame:
    """Share of each class within each group, and within all."""
    x = annotated.select(F.col(group).alias("grp"), F.col(col).alias("annotation"))
    c = x.unionByName(x.withColumn("grp", F.lit("all"))).groupBy("grp", "annotation").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("grp")))


def numeric_by_annotation(annotated: DataFrame, value: str, col: str = "feature_type") -> DataFrame:
    x = annotated.select(F.col(col).alias("annotation"), F.col(value).alias("value"))
    return x.unionByName(x.withColumn("annotation", F.lit("All"))).where("value IS NOT NULL")


def overlap_sets(sets: dict[str, DataFrame], keys: tuple[str, ...] = ("chrom", "start", "end"), min_size: int = 1) -> DataFrame:
    """How many keys are in exactly this combination of the named sets."""
    every = None
    for name, df in sorted(sets.items()):
        x = df.select(*keys).distinct().withColumn("_set", F.lit(name))
        every = x if every is None else every.unionByName(x)
    combo = every.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set("_set")), "&").alias("combination"))
    return combo.groupBy("combination").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
