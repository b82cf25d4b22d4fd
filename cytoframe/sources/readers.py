"""Readers: count files, sample sheets, regions, gene models, read calls, report texts.

Every scan takes many paths in one job and has a fixed schema.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.tables import small, written
from . import fasta, sinks, store

#: File endings that a sample's name is followed by, longest first. Fixed values.
SUFFIXES = (
    ".deduplicated.bismark.cov.gz", ".bismark.cov.gz", ".deduplicated.cov.gz", ".cov.gz",
    ".deduplicated.bismark.cov", ".bismark.cov", ".deduplicated.cov", ".cov",
)
#: Report lines: metric and pattern. Fixed values.
REPORT_PATTERNS = {
    "aligned_reads": r"Number of alignments analysed in total:\s*(\d+)",
    "unique_alignments": r"Number of paired-end alignments with a unique best hit:\s*(\d+)",
    "mapping_efficiency": r"Mapping efficiency:\s*([0-9.]+)%",
    "pct_meth_cpg": r"C methylated in CpG context:\s*([0-9.]+)%",
    "pct_meth_chg": r"C methylated in CHG context:\s*([0-9.]+)%",
    "pct_meth_chh": r"C methylated in CHH context:\s*([0-9.]+)%",
    "mean_coverage": r"mean coverageData =\s*([0-9.]+)X",
    "std_coverage": r"std coverageData =\s*([0-9.]+)X",
}


def _fields(lines: DataFrame, n: int, sep: str = "\t") -> list[Column]:
    return [F.split("value", sep)[i] for i in range(n)]


def _canonical(rows: DataFrame, context: str) -> DataFrame:
    return rows.select("chrom", F.col("start").alias("pos"), F.lit("*").alias("strand"), F.lit(context).alias("context"), "n_meth", "n_unmeth", (F.col("n_meth") + F.col("n_unmeth")).alias("coverage"), "sample")


def parse_coverage(lines: DataFrame, context: str = "CpG", skip: str = "track") -> DataFrame:
    """lines (sample, value) of six tab-separated columns; lines that start with `skip` and blank ones are passed over."""
    keep = lines.where(~F.col("value").startswith(skip) & (F.trim("value") != ""))
    c = _fields(keep, 6)
    return _canonical(keep.select("sample", c[0].alias("chrom"), c[1].cast("int").alias("start"), c[4].cast("int").alias("n_meth"), c[5].cast("int").alias("n_unmeth")), context)


def parse_strand_pairs(lines: DataFrame, context: str = "CpG") -> DataFrame:
    """Twelve columns of both strands' counts and their sum: methylated M of T."""
    keep = lines.where(F.trim("value") != "")
    c = _fields(keep, 12)
    m, t = c[9].cast("int"), c[10].cast("int")
    return _canonical(keep.select("sample", c[0].alias("chrom"), c[1].cast("int").alias("start"), m.alias("n_meth"), (t - m).alias("n_unmeth")), context)


def _plain(path: Column) -> Column:
    """A path as Spark names files, without the slashes that a scheme may double."""
    return F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")


def _text(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(sample, value) of all samples' files in one scan; a line's sample is found by its file's whole path."""
    conf, hadoop = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    whole = {}
    for sample, path in paths.items():
        p = hadoop(path)
        whole[p.getFileSystem(conf).makeQualified(p).toUri().toString()] = sample
    if len(whole) < len(paths):
        raise ValueError("two samples name one file")
    names = F.create_map(*(x for k, v in whole.items() for x in (_plain(F.lit(k)), F.lit(v))))
    return spark.read.text(list(paths.values())).select(F.try_element_at(names, _plain(F.input_file_name())).alias("sample"), "value")


def read_coverage(spark: SparkSession, paths: dict[str, str], fmt: str = "bismark", context: str = "CpG") -> DataFrame:
    """Site table of the samples' files; fmt: bismark, methyldackel or combined_strand_bed."""
    lines = _text(spark, paths)
    return parse_strand_pairs(lines, context) if fmt == "combined_strand_bed" else parse_coverage(lines, context)


def read_samplesheet(spark: SparkSession, path: str, treatment: str | None = None, control: str | None = None, groups: list[str] | None = None) -> DataFrame:
    """sample_id, group, path and further text columns; treatment is 1, 0 or, for other groups, null."""
    obs = spark.read.option("header", True).csv(path)
    missing = {"sample_id", "group", "path"} - set(obs.columns)
    if missing:
        raise ValueError(f"sample sheet lacks {sorted(missing)}")
    return with_treatment(obs, treatment, control, groups)


def with_treatment(obs: DataFrame, treatment: str | None, control: str | None, groups: list[str] | None = None) -> DataFrame:
    keep = groups or [g for g in (treatment, control) if g]
    obs = obs.where(F.col("group").isin(keep)) if keep else obs
    return obs.withColumn("treatment", F.when(F.col("group") == treatment, 1).when(F.col("group") == control, 0))


def stem(path: Column) -> Column:
    """A file's name without folders and without the first of SUFFIXES that it ends with."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, "(" + "|".join(x.replace(".", r"\.") for x in SUFFIXES) + ")$", "")


def files_of_samples(files: DataFrame, obs: DataFrame) -> DataFrame:
    """obs (sample_id, ...) with the path of its file: the one whose stem is the sample's name, or begins with it before a dot, dash or underline.

    files: path. Of several, the one with the shortest stem, then the least path; of several samples that a file may
    stand for, the longest name takes it. A sample without a file is an error.
    """
    f = files.withColumn("_stem", stem(F.url_decode(F.regexp_replace("path", r"\+", "%2B"))))
    fits = (F.col("_stem") == F.col("sample_id")) | (F.col("_stem").startswith(F.col("sample_id")) & F.substr("_stem", F.length("sample_id") + 1, F.lit(1)).isin(".", "-", "_"))
    pairs = f.join(F.broadcast(obs.select("sample_id")), fits)  # a row for each sample on this side
    own = pairs.groupBy("path").agg(F.max_by("sample_id", F.length("sample_id")).alias("sample_id"), F.first("_stem").alias("_stem"))
    best = own.groupBy("sample_id").agg(F.min(F.struct(F.length("_stem"), "path")).getField("path").alias("path"))
    out = obs.drop("path").join(best, "sample_id", "left")
    lost = [r[0] for r in out.where("path IS NULL").select("sample_id").limit(20).collect()]
    if lost:
        raise ValueError(f"no file for samples {lost}")
    return out


def read_run_folder(spark: SparkSession, folder: str, treatment: str, control: str, sheet: str = "samplesheet.csv", context: str = "CpG") -> tuple[DataFrame, DataFrame]:
    """(sites, obs) of a pipeline's output folder: its sample sheet, and count files anywhere below, matched by name."""
    obs = spark.read.option("header", True).csv(f"{folder}/{sheet}")
    if missing := {"sample_id", "group"} - set(obs.columns):
        raise ValueError(f"sample sheet lacks {sorted(missing)}")
    # listing reads no content: only the path column is taken
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.cov*").load(folder).select("path")
    obs = with_treatment(files_of_samples(files, obs), treatment, control)
    paths = {r["sample_id"]: r["path"] for r in obs.select("sample_id", "path").collect()}  # a row for each sample
    return read_coverage(spark, paths, "bismark", context), obs


def converted(spark: SparkSession, paths: dict[str, str], fmt: str = "bismark", context: str = "CpG", reference: str | None = None, merge: bool = True) -> DataFrame:
    """Site table of count files; with a reference sequence strands are told by its bases, and the strands of a site joined unless merge is off."""
    sites = read_coverage(spark, paths, fmt, context)
    if reference is None:
        return sites
    pieces = fasta.read_fasta(spark, reference)
    return stranded(sites, pieces, merge)


def stranded(sites: DataFrame, pieces: DataFrame, merge: bool = True) -> DataFrame:
    """sites with strands by the bases of sequence pieces, merged.

    A sample without minus strands stays as it is. In the others sites of
    neither strand go, and a site is what both strands of it say.
    """
    own = infer_strand(sites, fasta.bases_at(sites, pieces))
    if not merge:
        return own.select(*sites.columns)
    own = written(own)
    both = small(written(own.groupBy("sample").agg(F.bool_or(F.col("strand") == "-").alias("_both"))))  # a row for each sample
    own = own.join(both, "sample")
    at = F.when(F.col("strand") == "-", F.col("pos") - 1).otherwise(F.col("pos")).cast("int")
    two = own.where("_both AND strand <> '*'").withColumn("pos", at).groupBy("sample", "chrom", "pos").agg(
        F.min("context").alias("context"), *(F.sum(c).cast("int").alias(c) for c in ("n_meth", "n_unmeth", "coverage"))
    )
    return own.where("NOT _both").select(*sites.columns).unionByName(two.withColumn("strand", F.lit("+")).select(*sites.columns))


def strand_pairs(sites: DataFrame) -> DataFrame:
    """(sample, paired, lone_plus, lone_minus): sites by the strands that they were seen on, before merging."""
    at = F.when(F.col("strand") == "-", F.col("pos") - 1).otherwise(F.col("pos"))
    g = sites.where("strand <> '*'").groupBy("sample", "chrom", at.alias("pos")).agg(F.bool_or(F.col("strand") == "+").alias("p"), F.bool_or(F.col("strand") == "-").alias("m"))
    return g.groupBy("sample").agg(F.count_if(F.col("p") & F.col("m")).alias("paired"), F.count_if(F.col("p") & ~F.col("m")).alias("lone_plus"), F.count_if(F.col("m") & ~F.col("p")).alias("lone_minus"))


def convert_if_stale(spark: SparkSession, paths: dict[str, str], output: str, fmt: str = "bismark", context: str = "CpG", reference: str | None = None, merge: bool = True) -> bool:
    """Converts count files to a stored site table unless that was made of the same files as they are, in the same way; True when work was done."""
    conf, hadoop = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    about = []
    for sample, path in [*sorted(paths.items()), *([("", reference)] if reference else [])]:
        status = hadoop(path).getFileSystem(conf).getFileStatus(hadoop(path))
        about.append([sample, path, status.getLen(), status.getModificationTime()])
    settings = {"format": fmt, "context": context, "reference": reference, "merge": merge}
    key, stages = store.signature("convert", about, settings), store.Stages(spark, f"{output}-log")
    if stages.find("convert", key):
        return False
    sinks.write_sites(converted(spark, paths, fmt, context, reference, merge), output)
    stages.append("convert", settings, key, output)
    return True


def infer_strand(sites: DataFrame, bases: DataFrame) -> DataFrame:
    """Strand from the reference base (chrom, pos, base): C is +, G is -, anything else *."""
    b = F.upper("base")
    x = sites.drop("strand").join(bases.select("chrom", "pos", "base"), ["chrom", "pos"], "left")
    return x.withColumn("strand", F.when(b == "C", "+").when(b == "G", "-").otherwise("*")).drop("base")


def read_bed(spark: SparkSession, path: str, id_column: int | None = None) -> DataFrame:
    return parse_bed(spark.read.text(path), id_column)


def parse_bed(lines: DataFrame, id_column: int | None = None) -> DataFrame:
    """(chrom, start, end, region_id); comment, track and browser lines go; the id is the chosen column, else the name, else chrom:start-end."""
    keep = lines.where(~F.col("value").rlike("^(#|track|browser)") & (F.trim("value") != "")).withColumn("_c", F.split("value", "\t"))
    at = F.lit((id_column if id_column is not None else 3) + 1)
    x = keep.select(F.col("_c")[0].alias("chrom"), F.col("_c")[1].cast("bigint").alias("start"), F.col("_c")[2].cast("bigint").alias("end"), F.try_element_at("_c", at).alias("name"))
    return x.select("chrom", "start", "end", F.coalesce("name", F.concat_ws("", "chrom", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))).alias("region_id"))


def parse_gtf(lines: DataFrame) -> DataFrame:
    """(chrom, feature, start, end, strand, gene_id, gene_name, gene_type); 1-based closed becomes 0-based half-open."""
    keep = lines.where(~F.col("value").startswith("#")).withColumn("_c", F.split("value", "\t")).where(F.size("_c") >= 9)
    a = F.col("_c")[8]

    def attr(name: str) -> Column:
        return F.nullif(F.regexp_extract(a, f'{name} "([^"]+)"', 1), F.lit(""))

    return keep.select(
        F.col("_c")[0].alias("chrom"), F.col("_c")[2].alias("feature"), (F.col("_c")[3].cast("int") - 1).alias("start"), F.col("_c")[4].cast("int").alias("end"), F.col("_c")[6].alias("strand"),
        attr("gene_id").alias("gene_id"), F.coalesce(attr("gene_name"), attr("gene_id")).alias("gene_name"), F.coalesce(attr("gene_type"), attr("gene_biotype")).alias("gene_type"),
    )


def read_gtf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(genes, exons, utrs), from one parse."""
    g = parse_gtf(spark.read.text(path))
    side = F.when(F.col("feature") == "five_prime_utr", "5UTR").when(F.col("feature") == "three_prime_utr", "3UTR")
    return g.where("feature = 'gene'").drop("feature"), g.where("feature = 'exon'").drop("feature"), g.withColumn("side", side).where("side IS NOT NULL").drop("feature")


def parse_refgene(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(genes, exons) of the table dump: one gene row per transcript; names with NM_ are protein coding."""
    t = lines.withColumn("_c", F.split("value", "\t")).where(F.size("_c") >= 13)
    c = F.col("_c")
    g = t.select(
        c[2].alias("chrom"), c[4].cast("int").alias("start"), c[5].cast("int").alias("end"), c[3].alias("strand"), c[1].alias("gene_id"), c[12].alias("gene_name"),
        F.when(c[1].startswith("NM_"), "protein_coding").otherwise("noncoding").alias("gene_type"), F.split(c[9], ",").alias("_s"), F.split(c[10], ",").alias("_e"),
    )
    e = g.select("chrom", "strand", "gene_id", F.explode(F.arrays_zip("_s", "_e")).alias("x")).where("x._s <> ''")
    return g.drop("_s", "_e"), e.select("chrom", F.col("x._s").cast("int").alias("start"), F.col("x._e").cast("int").alias("end"), "strand", "gene_id")


def annotation_kind(path: str) -> str:
    """refgene or gtf, by the file's name; anything else is an error."""
    name = os.path.basename(path).lower()
    if "refgene" in name:
        return "refgene"
    if re.search(r"\.gtf(\.gz)?$", name):
        return "gtf"
    raise ValueError(f"{name!r} is neither a .gtf file nor a refGene table")


def read_annotation(spark: SparkSession, path: str, kind: str = "auto") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(genes, exons, utrs); a refGene table has no rows of the last."""
    if (annotation_kind(path) if kind == "auto" else kind) == "gtf":
        return read_gtf(spark, path)
    genes, exons = parse_refgene(spark.read.text(path))
    return genes, with_gene_names(exons, genes), no_utrs(exons)


def with_gene_names(exons: DataFrame, genes: DataFrame) -> DataFrame:
    """exons with gene_name, of the gene of their id where they have none."""
    names = genes.groupBy("gene_id").agg(F.min("gene_name").alias("_name"))
    own = F.col("gene_name") if "gene_name" in exons.columns else F.lit(None).cast("string")
    return exons.join(names, "gene_id", "left").withColumn("gene_name", F.coalesce(own, F.col("_name"))).drop("_name")


def no_utrs(exons: DataFrame) -> DataFrame:
    """Untranslated regions of a source that has none: no row."""
    return exons.withColumn("side", F.lit("")).where(F.lit(False))


def read_reports(spark: SparkSession, folder: str, samples: list[str]) -> DataFrame:
    """Metrics of each sample's report files anywhere below a folder; a file is the sample's that its name begins with, the longest if several."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").withColumn("_name", F.element_at(F.split(F.input_file_name(), "/"), -1))
    own = F.lit(None).cast("string")
    for s in sorted(samples, key=len):  # a longer name later, so that it wins
        own = F.when(F.col("_name").startswith(s), s).otherwise(own)
    m = report_metrics(files.withColumn("sample", own).where("sample IS NOT NULL").select("sample", "value"))
    return m.groupBy("sample").agg(*(F.max(c).alias(c) for c in m.columns if c != "sample"))


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """The read-call table, as Parquet."""
    return spark.read.schema(schemas.CALL_DDL).parquet(path)


#: Columns of an alignment text line before its tags. Fixed values.
ALIGNMENT = ("read_id", "flag", "chrom", "start", "mapq", "cigar", "mate", "mate_start", "length", "sequence", "qualities")


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text, which Spark splits as any text; start is 0-based, tags a map by name."""
    return parse_alignments(spark.read.text(path))


def parse_alignments(lines: DataFrame) -> DataFrame:
    c = F.col("_c")
    x = lines.where(~F.col("value").startswith("@") & (F.trim("value") != "")).withColumn("_c", F.split("value", "\t"))
    x = x.select(*(c[i].alias(k) for i, k in enumerate(ALIGNMENT)), F.slice("_c", F.lit(len(ALIGNMENT) + 1), F.greatest(F.size("_c") - len(ALIGNMENT), F.lit(0))).alias("_t"))
    tags = F.map_from_entries(F.array_distinct(F.transform("_t", lambda t: F.struct(F.substr(t, F.lit(1), F.lit(2)), F.substr(t, F.lit(6))))))
    return x.select("read_id", F.col("flag").cast("int").alias("flag"), "chrom", (F.col("start").cast("int") - 1).alias("start"), F.col("mapq").cast("int").alias("mapq"), "cigar", "sequence", "qualities", tags.alias("tags"))


def _places(cigar: str) -> np.ndarray:
    """For each base of a read, how far from the read's start it lies on the reference; -1 where it has no place."""
    out, at = [], 0
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar or ""):
        if op in "M=X":
            out.append(np.arange(at, at + int(n)))
            at += int(n)
        elif op in "IS":
            out.append(np.full(int(n), -1))
        elif op in "DN":
            at += int(n)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


_FLIP = str.maketrans("ACGTN", "TGCAN")


def _modified(skipped: str | None, likelihoods: str | None, sequence: str, reverse: bool) -> list[tuple[int, int]]:
    """(base, status) by the tags of modified bases: skips over C in the direction of sequencing; methylated from half likelihood on."""
    likely = [int(v) for v in (likelihoods or "").split(",")[1:]]
    own = (sequence or "").translate(_FLIP)[::-1] if reverse else sequence or ""
    at = [i for i, b in enumerate(own) if b == "C"]
    out, k = [], 0
    for part in (skipped or "").split(";"):
        name, *skips = part.split(",")
        if not name:
            continue
        where = -1
        for j, skip in enumerate(skips):
            where += int(skip) + 1
            if name.rstrip("?.") == "C+m" and where < len(at) and k + j < len(likely):
                i = at[where]
                out.append((len(own) - 1 - i if reverse else i, int(likely[k + j] >= 128)))
        k += len(skips)
    return out


#: Call letters of a context. Fixed values.
LETTERS = {"CpG": "z", "CHG": "x", "CHH": "h", "any": "zxh"}


def _ragged(values: list[bytes], most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings end to end, and where each begins; of each at most so many bytes."""
    if most is not None:
        values = [v[:k] for v, k in zip(values, most.tolist())]
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum([0, *map(len, values)])


def calls_of(alignments: DataFrame, caller: str = "bismark", context: str = "CpG", sample: str = "", min_mapq: int = 10, min_baseq: int = 20) -> DataFrame:
    """(sample, read_id, chrom, pos, status, base_qual, mapq, strand, mate_pair_id, allele_base): a row for each called base with a place on the reference.

    caller: bismark (call letters in XM; context CpG, CHG, CHH or any) or methyldackel (modified bases in MM and ML).
    Unmapped, secondary and supplementary alignments are passed over, duplicates and those that failed their quality
    check too, and bases or alignments below the minima; a base without a quality has quality 0. The reads of an
    Arrow batch are worked on side by side. Chromosome and position are plain columns, so a region is a filter.
    """
    status = np.full(256, -1, np.int8)
    for c in LETTERS[context]:
        status[ord(c)], status[ord(c.upper())] = 0, 1
    spec = "sample string, read_id string, chrom string, pos int, status int, base_qual int, mapq int, strand string, mate_pair_id int, allele_base string"
    names = [f.split()[0] for f in spec.split(", ")]

    def run(batches):
        places: dict[str, np.ndarray] = {}
        for b in batches:
            col = {n: b.column(n) for n in b.schema.names}
            rel = [places[c] if c in places else places.setdefault(c, _places(c)) for c in col["cigar"].to_pylist()]
            flag = col["flag"].to_numpy()
            sequences = [(x or "").encode() if x != "*" else b"" for x in col["sequence"].to_pylist()]
            sizes = np.array([len(r) for r in rel], np.int64)
            if caller == "bismark":
                letters, at = _ragged([(x or "").encode() for x in col["xm"].to_pylist()], sizes)
                read = np.repeat(np.arange(len(rel)), np.diff(at))
                base, called = np.arange(len(letters)) - at[read], status[letters]
            else:
                each = [_modified(mm, ml, s.decode(), bool(f & 16)) for mm, ml, s, f in zip(col["mm"].to_pylist(), col["ml"].to_pylist(), sequences, flag.tolist())]
                read = np.repeat(np.arange(len(rel)), [len(x) for x in each])
                base, called = np.array([(i, v) for x in each for i, v in x], np.int64).reshape(-1, 2).T
            keep = (called >= 0) & (base < sizes[read])
            read, base, called = read[keep], base[keep], called[keep]
            flat, starts = np.concatenate([*rel, np.zeros(0, np.int64)]), np.cumsum([0, *sizes])
            place = flat[starts[read] + base]
            quality, bases = _at([(x or "*").encode() if x != "*" else b"" for x in col["qualities"].to_pylist()], read, base, 33), _at(sequences, read, base, 0)
            keep = (place >= 0) & (quality >= min_baseq)
            read, place, called, quality, bases = read[keep], place[keep], called[keep], quality[keep], bases[keep]
            f = flag[read]
            letters = pa.array([chr(c) if c else "" for c in range(256)])
            yield pa.RecordBatch.from_arrays([
                pa.array([sample]).take(pa.array(np.zeros(len(read), np.int64))), col["read_id"].take(pa.array(read)), col["chrom"].take(pa.array(read)),
                pa.array((col["start"].to_numpy()[read] + place).astype(np.int32)), pa.array(called.astype(np.int32)), pa.array(np.minimum(quality, 127).astype(np.int32)),
                pa.array(np.minimum(col["mapq"].to_numpy()[read], 127).astype(np.int32)), pa.array(["+", "-"]).take(pa.array((f >> 4 & 1).astype(np.int64))),
                pa.array(np.where(f & 1, np.where(f & 64, 1, 2), 0).astype(np.int32)), letters.take(pa.array(bases.astype(np.int64))),
            ], names)

    own = alignments.where((F.col("flag").bitwiseAND(4 | 256 | 512 | 1024 | 2048) == 0) & (F.col("mapq") >= min_mapq) & (F.col("cigar") != "*"))
    tags = [F.col("tags")[t].alias(t.lower()) for t in (("XM",) if caller == "bismark" else ("MM", "ML"))]
    return own.select("read_id", "flag", "chrom", "start", "mapq", "cigar", "sequence", "qualities", *tags).mapInArrow(run, spec)


def _at(values: list[bytes], read: np.ndarray, base: np.ndarray, less: int) -> np.ndarray:
    """Byte `base` of each read's string, less a constant; 0 where the string ends before."""
    flat, starts = _ragged(values)
    there = base < np.diff(starts)[read]
    out = np.zeros(len(read), np.int64)
    out[there] = flat[(starts[read] + base)[there]].astype(np.int64) - less
    return out


def parse_variants(lines: DataFrame) -> DataFrame:
    """(chrom, pos, ref, alt, genotype) of single-base variants of VCF text with two different alleles called in its first sample; pos is 0-based."""
    x = lines.where(~F.col("value").startswith("#")).withColumn("_c", F.split("value", "\t")).where(F.size("_c") >= 10)
    c = F.col("_c")
    gt = F.split(c[9], ":")[F.array_position(F.split(c[8], ":"), "GT").cast("int") - 1]
    x = x.where(F.array_contains(F.split(c[8], ":"), "GT")).select(c[0].alias("chrom"), (c[1].cast("int") - 1).alias("pos"), F.upper(c[3]).alias("ref"), F.upper(c[4]).alias("alt"), gt.alias("genotype"))
    a = F.split("genotype", "[/|]")
    return x.where(is_heterozygous(a) & (F.length("ref") == 1) & F.col("alt").rlike("^[ACGT]$"))


def is_heterozygous(alleles: Column) -> Column:
    """Two alleles, both called and different."""
    return F.coalesce((F.size(alleles) == 2) & (alleles[0] != ".") & (alleles[1] != ".") & (alleles[0] != alleles[1]), F.lit(False))


def alleles_of(alignments: DataFrame, variants: DataFrame, sample: str = "", min_baseq: int = 20, min_mapq: int = 10) -> DataFrame:
    """(sample, read_id, snv_pos, ref, alt, base) of reads over heterozygous variants: the input of phasing."""

    def run(batches):
        for g in batches:
            rows = []
            for r in g.itertuples(index=False):
                for i, at in enumerate(_places(r.cigar).tolist()):
                    q = ord(r.qualities[i]) - 33 if r.qualities not in (None, "*") and i < len(r.qualities) else 255
                    if at >= 0 and q >= min_baseq and i < len(r.sequence):
                        rows.append((r.read_id, r.chrom, r.start + at, r.sequence[i].upper()))
            yield pd.DataFrame(rows, columns=["read_id", "chrom", "pos", "base"])

    bases = alignments.where((F.col("flag").bitwiseAND(4 | 256 | 2048) == 0) & (F.col("mapq") >= min_mapq) & (F.col("cigar") != "*")).mapInPandas(run, "read_id string, chrom string, pos int, base string")
    return bases.join(variants, ["chrom", "pos"]).select(F.lit(sample).alias("sample"), "read_id", F.col("pos").alias("snv_pos"), "ref", "alt", "base")


def report_metrics(texts: DataFrame) -> DataFrame:
    """texts (sample, value: a whole report): a column for each metric found."""
    found = {k: F.try_to_number(F.nullif(F.regexp_extract("value", p, 1), F.lit("")), F.lit("999999999999.999999")).cast("double") for k, p in REPORT_PATTERNS.items()}
    return texts.select("sample", *(v.alias(k) for k, v in found.items()))


def parse_mbias(lines: DataFrame) -> DataFrame:
    """lines (sample, line_no, value) of a bias report: header lines name the context and read of the rows below."""
    # the heading of a block. Fixed value.
    head = r"(?i)^\s*(CpG|CHG|CHH)\s+context\s*(?:\(R(\d)\))?\s*$"
    w = Window.partitionBy("sample").orderBy("line_no")
    is_head = F.col("value").rlike(head)
    ctx = F.regexp_replace(F.upper(F.regexp_extract("value", head, 1)), "CPG", "CpG")
    read = F.concat(F.lit("R"), F.coalesce(F.nullif(F.regexp_extract("value", head, 2), F.lit("")), F.lit("1")))
    x = lines.withColumn("context", F.last(F.when(is_head, ctx), True).over(w)).withColumn("read", F.last(F.when(is_head, read), True).over(w))
    x = x.withColumn("_c", F.split(F.trim("value"), r"\s+")).where(F.col("value").rlike(r"^\s*\d+\s") & F.col("context").isNotNull())
    return x.select("sample", "context", "read", F.col("_c")[0].cast("bigint").alias("position"), F.col("_c")[1].cast("bigint").alias("n_meth"), F.col("_c")[2].cast("bigint").alias("n_unmeth"), F.col("_c")[3].cast("double").alias("percent"), F.col("_c")[4].cast("bigint").alias("coverage"))


