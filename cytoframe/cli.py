"""Command line: `python -m cytoframe.cli <command> ...` over stored site tables."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import annotate, qc, sequence, sites as S
from .plans.frame import MethylFrame
from .sources import bigwig, readers, report, sinks
from .sources.store import write_matrix


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cytoframe")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: tuple, store: bool = True) -> None:
        c = sub.add_parser(name)
        if store:
            c.add_argument("store")
        c.add_argument("output")
        for flags, kw in args:
            c.add_argument(*flags, **kw)

    def opt(*flags: str, **kw) -> tuple:
        return flags, kw

    groups = (opt("--case", nargs="+", required=True), opt("--control", nargs="+", required=True))
    add("convert", opt("--sheet", required=True), opt("--format", default="bismark", choices=["bismark", "methyldackel", "combined_strand_bed"]), opt("--context", default="CpG"), opt("--fasta"), opt("--keep-strands", action="store_true"), store=False)
    add("filter", opt("--low", type=int, default=10), opt("--high", type=float, default=99.9), opt("--blacklist"))
    add("sample-summary")
    add("qc-report")
    add(
        "dmc", *groups, opt("--test", default="auto"), opt("--dispersion", default="eb"), opt("--unite", default="intersect"), opt("--fdr", default="bh"), opt("--formula"), opt("--contrast"),
        opt("--obs", help="table of samples, CSV with a column sample"), opt("--min-case", type=int, default=0), opt("--min-control", type=int, default=0), opt("--permutations", type=int, default=0),
    )
    add("dmr", *groups, opt("--method", default="chain_merge", choices=["chain_merge", "sliding_window", "hmm", "tile"]), opt("--test", default="auto"), opt("--preset"))
    add("report", *groups, opt("--gtf"), opt("--alpha", type=float, default=0.05), opt("--top", type=int, default=50))
    add("annotate", opt("--gtf", required=True), opt("--islands"))
    add("smooth", opt("--bandwidth", type=int, default=1000))
    add("aggregate-regions", opt("--bed", required=True), opt("--min-sites", type=int, default=1))
    add("export", opt("--kind", required=True, choices=["bedgraph", "bigwig", "methylkit", "matrix", "dmcs-bed", "dmrs-bed"]), opt("--sample"))
    return p


def _save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.command == "convert":
        obs = readers.read_samplesheet(spark, a.sheet)
        paths = {r["sample_id"]: r["path"] for r in obs.select("sample_id", "path").toLocalIterator()}  # one row per file
        readers.convert_if_stale(spark, paths, a.output, a.format, a.context, a.fasta, not a.keep_strands)
        return None
    store = sinks.read_sites(spark, a.store)
    if a.command == "filter":
        black = readers.read_bed(spark, a.blacklist) if a.blacklist else None
        sinks.write_sites(S.filter_coverage(store, a.low, a.high, black), a.output)
    elif a.command == "sample-summary":
        _save(qc.sample_summary(store), a.output)
    elif a.command == "qc-report":
        for name, df in {"summary": qc.sample_summary(store), "global": qc.global_methylation(store), "uniformity": qc.coverage_uniformity(store), "contamination": qc.contamination(store)}.items():
            _save(df, f"{a.output}/{name}")
    elif a.command == "dmc":
        obs = spark.read.option("header", True).option("inferSchema", True).csv(a.obs) if a.obs else None
        f = MethylFrame(store, a.case, a.control, obs=obs).unite(a.unite)
        _save(f.dmc(a.test, a.dispersion, fdr_method=a.fdr, formula=a.formula, contrast=a.contrast, min_case=a.min_case, min_control=a.min_control, permutations=a.permutations), a.output)
    elif a.command == "report":
        f = MethylFrame(store, a.case, a.control).unite("intersect")
        f.qc(contamination=True)
        f.dmc()
        f.dmr()
        if a.gtf:
            genes, exons, _ = readers.read_annotation(spark, a.gtf)
            f.annotate(genes, exons, alpha=a.alpha)
        report.write_html(spark, f.report(a.top, a.alpha), a.output, "Methylation report")
    elif a.command == "dmr":
        settings = {"preset": a.preset} if a.method == "chain_merge" else {}
        _save(MethylFrame(store, a.case, a.control).dmr(a.method, a.test, **settings), a.output)
    elif a.command == "annotate":
        genes, exons, utrs = readers.read_annotation(spark, a.gtf)
        index = annotate.feature_index(genes, exons, utrs=utrs)
        out = annotate.nearest_tss(annotate.best_feature(annotate.all_features(store, index), index), genes)
        _save(annotate.island_context(out, readers.read_bed(spark, a.islands)) if a.islands else out, a.output)
    elif a.command == "smooth":
        _save(sequence.smooth(store, "gaussian", bandwidth=a.bandwidth), a.output)
    elif a.command == "aggregate-regions":
        _save(S.aggregate_regions(store, readers.read_bed(spark, a.bed), a.min_sites), a.output)
    elif a.kind == "bedgraph":
        sinks.write_text(sinks.bedgraph_rows(store, a.sample), a.output, [sinks.chromosome_order(), "start"], "track type=bedGraph")
    elif a.kind == "bigwig":
        sizes = [(r["chrom"], r["size"]) for r in sinks.chromosome_sizes(store).collect()]  # a row for each chromosome
        bigwig.write_bigwig(sinks.bedgraph_rows(store, a.sample), a.output, sizes)
    elif a.kind == "methylkit":
        sinks.write_methylkit(store, a.output)
    elif a.kind == "matrix":
        names = [r[0] for r in store.select("sample").distinct().orderBy("sample").collect()]  # a row for each sample
        write_matrix(store, spark.createDataFrame([(n,) for n in names], "sample string"), a.output, names, ("beta", "coverage"))
    elif a.kind == "dmcs-bed":
        sinks.write_text(sinks.dmc_bed_rows(store), a.output, [F.col("chrom"), F.col("start")], "track name=dmcs")
    else:
        sinks.write_text(sinks.dmr_bed_rows(store), a.output, [F.col("chrom"), F.col("start")], "track name=dmrs")


def main(argv: list[str] | None = None) -> None:
    run(SparkSession.builder.appName("cytoframe").getOrCreate(), parser().parse_args(argv))


if __name__ == "__main__":
    main()
