"""Reference sequences as a table of pieces, split at any byte, and the base at a position.

Sequence text is wrapped, so where a base lies depends on the lengths of all
lines before it. A task reads a range of bytes as pieces without line ends and
notes where in the file each begins; running sums of the pieces' lengths then
place them on their chromosome. Neither a long chromosome nor a long line is
one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import ordered
from ..functions.tables import Written, small
from ..operators import ranges
from . import bgzf

PARTITION_BYTES = 16 << 20
#: Ranges shorter than PARTITION_BYTES may be asked for; beyond about a megabyte there are no more than twice as many of them as this.
MOST_SHORT = 256
#: Bases of a piece at most, and bytes of a heading.
PIECE, HEADING = 8192, 1 << 16
DDL = "file string, offset long, name string, bases string"
_BATCH = 512


@dataclass
class Part(InputPartition):
    path: str
    low: int
    high: int


class FastaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.step = options["path"], int(options.get("partition_bytes", PARTITION_BYTES))

    def partitions(self) -> list[InputPartition]:
        fs, path = bgzf.located(self.path)
        scheme = "" if isinstance(fs, pyarrow.fs.LocalFileSystem) else self.path[: self.path.index(path)]
        info = fs.get_file_info(path)
        found = [info] if info.is_file else [f for f in fs.get_file_info(pyarrow.fs.FileSelector(path)) if f.is_file and not f.base_name.startswith(("_", "."))]
        if not info.is_file and info.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        step = max(self.step, min(PARTITION_BYTES, sum(f.size for f in found) // MOST_SHORT // 4096 * 4096))
        return [Part(scheme + f.path, low, min(low + step, f.size)) for f in sorted(found, key=lambda f: f.path) for low in range(0, f.size, step)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in _pieces(partition):
            rows.append((partition.path, *row))
            if len(rows) >= _BATCH:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["file", "offset", "name", "bases"])


def _pieces(part: Part) -> Iterator[tuple[int, str | None, str | None]]:
    """(offset, name, None) of headings that begin in the part, and (offset, None, bases) of its sequence bytes."""
    f, size = bgzf.opened(part.path)
    with f:
        back, before = part.low, b""
        while back and part.low - back < HEADING and b"\n" not in before:  # lines are mostly short
            back = max(part.low - max(2 * (part.low - back), 512), part.low - HEADING, 0)
            f.seek(back)
            before = f.read(part.low - back)
        line = before.rfind(b"\n") + 1  # what the part begins in the middle of; without any line end it is sequence
        in_heading = before[line : line + 1] == b">" and (line > 0 or back == 0)
        at, held = part.low, b""
        while at < part.high:
            f.seek(at)
            held = f.read(min(PIECE, part.high - at))
            if in_heading:  # its beginning was another part's
                end = held.find(b"\n")
                in_heading, at = end < 0, at + (len(held) if end < 0 else end + 1)
                continue
            if held[:1] == b">" and _begins(f, at):
                f.seek(at)
                heading = f.read(HEADING)
                end = heading.find(b"\n")
                if end < 0 and len(heading) == HEADING:
                    raise ValueError(f"a heading of more than {HEADING} bytes at byte {at} of {part.path}")
                heading = heading if end < 0 else heading[:end]
                words = heading[1:].split()
                yield at, (words[0].decode() if words else ""), None
                at += len(heading) + 1
                continue
            start = held.find(b"\n>") + 1
            body = held[:start] if start else held
            bases = body.translate(None, b"\r\n\t ")
            if bases:
                yield at, None, bases.decode()
            at += len(body)


def _begins(f, at: int) -> bool:
    """Whether a line begins at this byte."""
    if not at:
        return True
    f.seek(at - 1)
    return f.read(1) == b"\n"


class FastaSource(DataSource):
    """Format fasta. Options: path (a file, or a folder of files), partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return DDL

    def reader(self, schema) -> DataSourceReader:
        return FastaReader({k.lower(): v for k, v in self.options.items()})


def read_fasta(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """(chrom, start, end, bases): pieces of every sequence, 0-based; a sequence is named by its heading's first word."""
    spark.dataSource.register(FastaSource)
    read = Written(spark.read.format("fasta").options(**options).load(path))  # dealing in ranges looks at the rows twice
    x = read.df.withColumn("head", F.col("name").isNotNull().cast("long")).withColumn("upto", F.coalesce(F.length("bases"), F.lit(0)).cast("long"))
    x = ordered.running(x, ["file"], ["offset"], sums=("head", "upto"))
    read.drop()
    heads = small(Written(x.where("name IS NOT NULL").select("file", "head", F.col("name").alias("chrom"), F.col("upto").alias("_from"))).df)
    end = (F.col("upto") - F.col("_from")).cast("int")
    return x.where("bases IS NOT NULL").select("file", "head", "upto", "bases").join(heads, ["file", "head"]).select("chrom", (end - F.length("bases")).alias("start"), end.alias("end"), "bases")


def bases_at(points: DataFrame, pieces: DataFrame) -> DataFrame:
    """(chrom, pos, base) of points (chrom, pos), each place once; places outside of the sequences are left out."""
    at = points.select("chrom", "pos").distinct()
    return ranges.points_in(at, pieces, bin_size=PIECE).select("chrom", "pos", F.substr("bases", F.col("pos") - F.col("start") + 1, F.lit(1)).alias("base"))
