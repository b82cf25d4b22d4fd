"""Binary alignments as a data source: split at any byte, or by an index at the blocks of some regions.

    spark.dataSource.register(BamSource)
    spark.read.format("bam").load("reads.bam")
    spark.read.format("bam").option("regions", "chr1:100-200,chr2:0-5000").load("reads.bam")

Rows are those of `readers.read_alignments`. A file is planned into byte ranges
of about `partition_bytes`; a record belongs to the range in which the block of
its first byte begins. A task finds the first block of its range by the chain of
block headers, and the first record in it by the chain of records, so nothing is
read twice and the driver reads the header only. With regions the planner reads
the index (`index`, else the path and .bai) and plans only the blocks that it
names; a read that overlaps several regions comes once.

Files are opened by Arrow's file systems, so local paths and the stores that
Arrow knows can be read. Several files are read by several loads and a union.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import bgzf

PARTITION_BYTES = 32 << 20
#: Rows of an Arrow batch.
BATCH = 4096
#: Records that must follow each other for the first of them to be believed, and bytes after which none is.
CHAIN, GIVE_UP = 8, 1 << 28
DDL = "read_id string, flag int, chrom string, start int, mapq int, cigar string, sequence string, qualities string, tags map<string,string>"
_ARROW = pa.schema([("read_id", pa.string()), ("flag", pa.int32()), ("chrom", pa.string()), ("start", pa.int32()), ("mapq", pa.int32()), ("cigar", pa.string()), ("sequence", pa.string()), ("qualities", pa.string()), ("tags", pa.map_(pa.string(), pa.string()))])
#: Codes of bases and of the operations of an alignment, and the kinds of numbers in tags. Fixed values.
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}

_FROM_HEX = str.maketrans("0123456789abcdef", BASES)
_PHRED = bytes(min(q + 33, 126) for q in range(256))
_FIXED = "<iiiBBHHHiiii"


@dataclass
class Header:
    names: list[str]
    lengths: list[int]
    #: Virtual offset of the first record.
    first: int


def read_header(f) -> Header:
    held, marks = b"", []
    source = bgzf.members(f, 0, 1 << 16)

    def need(n: int) -> None:
        nonlocal held
        while len(held) < n:
            offset, data = next(source)
            marks.append((len(held), offset))
            held += data

    need(8)
    if held[:4] != b"BAM\1":
        raise ValueError("no binary alignment file")
    at = 8 + struct.unpack_from("<i", held, 4)[0]
    need(at + 4)
    (n,) = struct.unpack_from("<i", held, at)
    at += 4
    names, lengths = [], []
    for _ in range(n):
        need(at + 4)
        (k,) = struct.unpack_from("<i", held, at)
        need(at + 8 + k)
        names.append(held[at + 4 : at + 3 + k].decode())
        lengths.append(struct.unpack_from("<i", held, at + 4 + k)[0])
        at += 8 + k
    if at == len(held):  # the first record begins in the next block
        offset = next(source, (None, b""))[0]
        return Header(names, lengths, (offset << 16) if offset is not None else 1 << 62)
    start, offset = [m for m in marks if m[0] <= at][-1]
    return Header(names, lengths, offset << 16 | at - start)


def _plausible(data: bytes, at: int, header: Header) -> int | None:
    """Where the record that may begin here ends, None if none can."""
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, mate, mate_pos, _ = struct.unpack_from(_FIXED, data, at)
    n = len(header.names)
    if not (-1 <= ref < n and -1 <= mate < n and pos >= -1 and mate_pos >= -1 and l_name and l_seq >= 0):
        return None
    if ref >= 0 and pos >= header.lengths[ref] or mate >= 0 and mate_pos >= header.lengths[mate]:
        return None
    body = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
    if not body <= size < GIVE_UP:
        return None
    name = data[at + 36 : at + 36 + l_name]
    if len(name) == l_name and (name[-1] or any(not 33 <= c <= 126 for c in name[:-1])):
        return None
    cigar = data[at + 36 + l_name : at + 36 + l_name + 4 * n_cigar]
    if any(op & 15 >= len(OPERATIONS) for op in cigar[::4]):
        return None
    return at + 4 + size


def first_record(f, offset: int, header: Header) -> tuple[int, int] | None:
    """(offset of a block, place in it) of the first record that begins in a block from offset on."""
    held, marks, whole = b"", [], False
    source = bgzf.members(f, offset, 1 << 18)
    at = 0
    while True:
        if not whole:
            got = next(source, None)
            if got is None:
                whole = True
            else:
                marks.append((len(held), got[0]))
                held += got[1]
        while at + 36 <= len(held):
            end, n = at, 0
            while end is not None and n < CHAIN and end + 36 <= len(held):
                end = _plausible(held, end, header)
                n += 1
            if end is None or end > len(held) and whole:
                at += 1
                continue
            if n == CHAIN or whole and end == len(held):
                start, block = [m for m in marks if m[0] <= at][-1]
                return block, at - start
            break  # more bytes will tell
        if whole:
            return None
        if len(held) > GIVE_UP:
            raise ValueError(f"no record after byte {offset}")


def records(f, block: int, within: int, stop: int) -> Iterator[bytes]:
    """The records, without their length, that begin at virtual offsets from (block, within) to stop."""
    held, at, marks = b"", within, []
    source = bgzf.members(f, block)
    while True:
        while len(held) < at + 4 or len(held) < at + 4 + struct.unpack_from("<i", held, at)[0]:
            got = next(source, None)
            if got is None:
                if held[at:]:
                    raise ValueError("the last record breaks off")
                return
            held, marks = held[at:] if marks else b"", [(s - at, o) for s, o in marks]
            at = 0 if marks else at
            marks.append((len(held), got[0]))
            held += got[1]
        while len(marks) > 1 and marks[1][0] <= at:
            marks.pop(0)
        if marks[0][1] << 16 | at - marks[0][0] >= stop:
            return
        (n,) = struct.unpack_from("<i", held, at)
        yield held[at + 4 : at + 4 + n]
        at += 4 + n


def _tags(data: bytes, at: int) -> list[tuple[str, str]]:
    """Tags as alignment text writes their values."""
    out = []
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            value, at = data[at:end].decode(), end + 1
        elif kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind == "B":
            inner, (n,) = chr(data[at]), struct.unpack_from("<i", data, at + 1)
            values = struct.unpack_from(f"<{n}{NUMBERS[inner]}", data, at + 5)
            value, at = ",".join([inner, *(f"{v:g}" if inner == "f" else str(v) for v in values)]), at + 5 + struct.calcsize(f"<{n}{NUMBERS[inner]}")
        else:
            (v,) = struct.unpack_from(f"<{NUMBERS[kind]}", data, at)
            value, at = f"{v:g}" if kind == "f" else str(v), at + struct.calcsize(NUMBERS[kind])
        out.append((name, value))
    return out


def _row(data: bytes, header: Header) -> tuple:
    ref, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", data, 0)
    at = 32 + l_name
    ops = struct.unpack_from(f"<{n_cigar}I", data, at)
    at += 4 * n_cigar
    half = (l_seq + 1) // 2
    sequence = data[at : at + half].hex().translate(_FROM_HEX)[:l_seq] or "*"
    at += half
    quality = data[at : at + l_seq]
    return (
        data[32 : 31 + l_name].decode(), flag, header.names[ref] if ref >= 0 else "*", pos, mapq, "".join(f"{op >> 4}{OPERATIONS[op & 15]}" for op in ops) or "*",
        sequence, "*" if not quality or quality[0] == 255 else quality.translate(_PHRED).decode(), _tags(data, at + l_seq),
    )


def _span(data: bytes) -> tuple[int, int, int]:
    """Reference, start and end of a record on it."""
    ref, pos, l_name = struct.unpack_from("<iiB", data, 0)
    ops = struct.unpack_from(f"<{struct.unpack_from('<H', data, 12)[0]}I", data, 32 + l_name)
    return ref, pos, pos + max(1, sum(op >> 4 for op in ops if OPERATIONS[op & 15] in "MDN=X"))


def parse_regions(text: str) -> list[tuple[str, int, int]]:
    """chrom:start-end, …, 0-based and half open."""
    out = []
    for part in filter(None, text.split(",")):
        chrom, _, span = part.rpartition(":")
        start, _, end = span.partition("-")
        out.append((chrom, int(start), int(end)))
    return out


@dataclass
class Part(InputPartition):
    """Bytes [low, high) of the file, or ranges of virtual offsets that an index names."""

    low: int = 0
    high: int = 0
    chunks: list[tuple[int, int]] = field(default_factory=list)


class BamReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.step = options["path"], int(options.get("partition_bytes", PARTITION_BYTES))
        self.index, self.regions = options.get("index", self.path + ".bai"), parse_regions(options.get("regions", ""))
        f, self.size = bgzf.opened(self.path)
        with f:
            self.header = read_header(f)
        #: Regions by reference number; chromosomes that the file doesn't have are passed over.
        self.wanted = {r: [(s, e) for c, s, e in self.regions if c == name] for r, name in enumerate(self.header.names) if any(c == name for c, _, _ in self.regions)}

    def partitions(self) -> list[InputPartition]:
        if not self.regions:
            return [Part(low, min(low + self.step, self.size)) for low in range(0, self.size, self.step)]
        index = bgzf.Index.read(self.index)
        chunks = bgzf.joined(c for r, spans in self.wanted.items() for s, e in spans for c in index.chunks(r, s, e))
        parts: list[InputPartition] = []
        for low, high in chunks:
            if parts and sum((b >> 16) - (a >> 16) for a, b in parts[-1].chunks) + (high >> 16) - (low >> 16) <= self.step:
                parts[-1].chunks.append((low, high))
            else:
                parts.append(Part(chunks=[(low, high)]))
        return parts or [Part()]

    def _records(self, part: Part) -> Iterator[bytes]:
        f, _ = bgzf.opened(self.path)
        with f:
            for low, high in part.chunks:
                for data in records(f, low >> 16, low & 0xFFFF, high):
                    ref, start, end = _span(data)
                    if any(start < e and end > s for s, e in self.wanted.get(ref, ())):
                        yield data
            if part.high:
                first = self.header.first
                if part.low <= first >> 16:
                    at = (first >> 16, first & 0xFFFF) if first >> 16 < part.high else None
                else:
                    block = bgzf.first_member(f, part.low, self.size)
                    at = first_record(f, block, self.header) if block < part.high else None
                if at and at[0] < part.high:
                    yield from records(f, *at, part.high << 16)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        rows = []
        for data in self._records(partition):
            rows.append(_row(data, self.header))
            if len(rows) >= BATCH:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


class BamSource(DataSource):
    """Format bam. Options: path, regions, index, partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return DDL

    def reader(self, schema) -> DataSourceReader:
        return BamReader({k.lower(): v for k, v in self.options.items()})


def read_bam(spark: SparkSession, path: str, regions: list[tuple[str, int, int]] | None = None, **options: str | int) -> DataFrame:
    """The alignments of a file, or those that overlap regions (chrom, start, end); the rows of `readers.read_alignments`."""
    spark.dataSource.register(BamSource)
    if regions is not None:
        if not regions:
            return spark.createDataFrame([], DDL)
        options["regions"] = ",".join(f"{c}:{s}-{e}" for c, s, e in regions)
    return spark.read.format("bam").options(**options).load(path)
