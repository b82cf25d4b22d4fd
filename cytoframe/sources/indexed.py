"""Tables of sorted lines in block gzip with an index beside each file, written and looked up by tasks.

Rows are dealt in ranges of sample, chromosome and position. A task writes its
range as files of its own, one for each sample in it, each with its index, so a
sample is one file or several that follow each other. One commit names the files
that count; what a task that was run again or lost has left is in no commit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import bgzf
from .versions import Versions

_BATCH = 8192


def write_table(rows: DataFrame, path: str, header: str, columns: tuple[int, int], about: dict[str, dict] | None = None) -> dict:
    """rows (sample, chrom, pos, line) under path; columns: which field of a line, from 1, names the chromosome and which the position.

    Returns the commit: for each sample its files in order, with their numbers
    of rows, and what `about` says of it. A sample without rows has no file.
    """
    v = Versions(rows.sparkSession, path)
    folder = v.fresh()
    at = f"{v.root}/{folder}"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now: dict = {}

        def end() -> None:
            if now:
                now["writer"].close()
                now["file"].close()
                with now["fs"].open_output_stream(now["where"] + ".tbi") as f:
                    f.write(now["index"].table_bytes((columns[0], columns[1], columns[1]), skip=1, zero_based=False))
                done.append((now["sample"], now["name"], now["first"], now["n"]))
                now.clear()

        def begin(sample: str, first: str) -> None:
            end()
            fs, base = bgzf.located(at)
            fs.create_dir(base, recursive=True)
            name = f"{uuid.uuid4().hex}.txt.gz"
            f = fs.open_output_stream(f"{base}/{name}", compression=None)
            now.update(sample=sample, name=name, first=first, n=0, fs=fs, where=f"{base}/{name}", file=f, writer=bgzf.Writer(f), index=bgzf.Index(), chrom=None)
            now["writer"].write(header.encode() + b"\n")

        for b in batches:
            for sample, chrom, pos, line in zip(*(b.column(c).to_pylist() for c in ("sample", "chrom", "pos", "line"))):
                if not now or sample != now["sample"]:
                    begin(sample, f"{chrom}\t{pos:012d}")
                if chrom != now["chrom"]:
                    now["chrom"] = chrom
                    now["index"].names.append(chrom)
                low = now["writer"].tell()
                now["writer"].write(line.encode() + b"\n")
                now["index"].add(len(now["index"].names) - 1, pos - 1, pos, low, now["writer"].tell())
                now["n"] += 1
        end()
        if done:
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], ["sample", "file", "first", "n"])

    sorted_ = rows.select("sample", "chrom", F.col("pos").cast("long").alias("pos"), "line").repartitionByRange("sample", "chrom", "pos").sortWithinPartitions("sample", "chrom", "pos")
    samples: dict[str, dict] = {s: dict(a) for s, a in (about or {}).items()}
    for r in sorted(sorted_.mapInArrow(put, "sample string, file string, first string, n long").collect(), key=lambda r: (r["sample"], r["first"])):  # a row for each file
        own = samples.setdefault(r["sample"], {})
        own.setdefault("files", []).append({"file": f"{folder}/{r['file']}", "index": f"{folder}/{r['file']}.tbi", "n_rows": r["n"]})
        own["n_rows"] = own.get("n_rows", 0) + r["n"]
    return v.change(lambda _: {"samples": samples, "header": header, "columns": list(columns)})


@dataclass
class Part(InputPartition):
    path: str
    chunks: list[tuple[int, int]] = field(default_factory=list)


def lines(f, low: int, high: int) -> Iterator[bytes]:
    """The lines between two virtual offsets, both of which are where a line begins or the data ends."""
    held = b""
    for offset, data in bgzf.members(f, low >> 16):
        start = low & 0xFFFF if offset == low >> 16 else 0
        if offset > high >> 16:
            break
        held += data[start : high & 0xFFFF] if offset == high >> 16 else data[start:]
        *whole, held = held.split(b"\n")
        yield from whole
    if held:
        yield held


class TableReader(DataSourceReader):
    """Lines of files (option files, separated by line ends) that lie in a region (option region), by their indexes."""

    def __init__(self, options: dict[str, str]):
        self.files = [f for f in options["files"].split("\n") if f]
        self.columns = [int(c) - 1 for c in options["columns"].split(",")]
        chrom, start, end = options["region"].split("\t")
        self.region = chrom, int(start), int(end)

    def partitions(self) -> list[InputPartition]:
        chrom, start, end = self.region
        parts: list[InputPartition] = []
        for path in self.files:
            index = bgzf.Index.read(path + ".tbi")
            if chrom in index.names and end > start:
                if chunks := index.chunks(index.names.index(chrom), max(start - 1, 0), max(end - 1, 1)):
                    parts.append(Part(path, chunks))
        return parts or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        chrom, start, end = self.region
        f, _ = bgzf.opened(partition.path)
        out: list[str] = []
        with f:
            for low, high in partition.chunks:
                for line in lines(f, low, high):
                    c = line.split(b"\t")
                    if c[self.columns[0]] == chrom.encode() and start <= int(c[self.columns[1]]) < end:
                        out.append(line.decode())
                    if len(out) >= _BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


class TableSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "indexed_lines"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return TableReader({k.lower(): v for k, v in self.options.items()})


def read_region(spark: SparkSession, path: str, sample: str, region: tuple[str, int, int]) -> DataFrame:
    """(value) the lines of a sample whose position is in (chrom, start, end): only blocks that the indexes name are read."""
    spark.dataSource.register(TableSource)
    v = Versions(spark, path)
    state = v.current()[1]
    if state is None:
        raise FileNotFoundError(f"no table at {path}")
    files = [f"{v.root}/{f['file']}" for f in state["samples"].get(sample, {}).get("files", [])]
    if not files:
        return spark.createDataFrame([], "value string")
    columns = ",".join(map(str, state["columns"]))
    return spark.read.format("indexed_lines").options(files="\n".join(files), columns=columns, region="\t".join(map(str, region))).load()
