"""bigWig tracks: blocks and zoom levels made by tasks, trees over names and blocks, one stream of bytes at the end.

Rows are sorted in ranges; each task cuts its rows into sections, compresses
them and notes what they span. Zoom records are sums by bin, each level made of
the one before. How long every part of the file will be follows from counts and
sums of these tables, so the file is written front to back in one pass, by a
task that holds one block at a time and an entry for each block; a single file
has no other way. Nothing of it passes through the driver.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import Written, small
from . import bgzf

#: Items of a section, children of a node, and bases of a bin of each zoom level.
ITEMS, NODE, ZOOMS = 1024, 256, (100, 400, 1600, 6400, 25_600, 102_400, 409_600, 1_638_400)
#: What marks a file, its tree of names and its tree of blocks. Fixed values.
MAGIC, NAMES_MAGIC, BLOCKS_MAGIC = 0x888FFC26, 0x78CA8C91, 0x2468ACE0

_RECORD = ["c", "start", "end", "n", "low", "high", "total", "squares"]
_BLOCK = "level int, c long, start long, end long, raw int, data binary"


def _sections(rows: DataFrame, level: int) -> DataFrame:
    """Blocks of rows (c, start, end, value), or of zoom records: at most ITEMS of one chromosome, compressed."""
    sorted_ = rows.repartitionByRange("c", "start").sortWithinPartitions("c", "start")
    kinds = [("c", "<u4"), ("start", "<u4"), ("end", "<u4"), ("n", "<u4"), ("low", "<f4"), ("high", "<f4"), ("total", "<f4"), ("squares", "<f4")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {n: b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names}
            c = col["c"]
            edge = np.concatenate(([0], np.flatnonzero(c[1:] != c[:-1]) + 1, [len(c)]))
            out = []
            for low, high in zip(edge[:-1].tolist(), edge[1:].tolist()):
                for i in range(low, high, ITEMS):
                    at = slice(i, min(i + ITEMS, high))
                    n, first, last = at.stop - i, int(col["start"][i]), int(col["end"][at].max())
                    if level < 0:
                        item = np.zeros(n, [("start", "<u4"), ("end", "<u4"), ("value", "<f4")])
                        head = struct.pack("<IIIIIBBH", int(c[i]), first, last, 0, 0, 1, 0, n)
                    else:
                        item, head = np.zeros(n, kinds), b""
                    for name in item.dtype.names:
                        item[name] = col[name][at]
                    raw = head + item.tobytes()
                    out.append((level, int(c[i]), first, last, len(raw), zlib.compress(raw)))
            if out:
                types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], ["level", "c", "start", "end", "raw", "data"])

    return sorted_.mapInArrow(run, _BLOCK)


def zoom_records(rows: DataFrame, bases: int) -> DataFrame:
    """Sums by bin of so many bases: of rows (c, start, end, value), or of the records of a finer level whose bins divide these."""
    if "value" in rows.columns:
        x = rows.withColumn("_b", F.explode(F.sequence(F.expr(f"start div {bases}"), F.expr(f"(end - 1) div {bases}"))))
        n = F.least(F.col("end"), (F.col("_b") + 1) * bases) - F.greatest(F.col("start"), F.col("_b") * bases)
        v = F.col("value").cast("double")
        x = x.select("c", "_b", n.alias("n"), v.alias("low"), v.alias("high"), (v * n).alias("total"), (v * v * n).alias("squares"), F.greatest(F.col("start"), F.col("_b") * bases).alias("start"), F.least(F.col("end"), (F.col("_b") + 1) * bases).alias("end"))
    else:
        x = rows.withColumn("_b", F.expr(f"start div {bases}"))
    g = x.groupBy("c", "_b").agg(*(f(n).alias(n) for n, f in (("start", F.min), ("end", F.max), ("n", F.sum), ("low", F.min), ("high", F.max), ("total", F.sum), ("squares", F.sum))))
    return g.select(*_RECORD)


def _tree(items: list[bytes], keys: list, leaf_size: int, node_size: int, at: int, upper) -> bytes:
    """Nodes from the root down: leaves of items, and above them nodes of upper(keys of a child's items, the child's offset)."""
    levels = [[(items[i : i + NODE], keys[i : i + NODE]) for i in range(0, len(items), NODE)] or [([], [])]]
    while len(levels[0]) > 1:
        below = levels[0]
        levels.insert(0, [(None, below[i : i + NODE]) for i in range(0, len(below), NODE)])

    def spanned(node) -> list:
        return node[1] if node[0] is not None else [k for child in node[1] for k in (spanned(child)[0], spanned(child)[-1])]

    sizes = [sum(4 + (len(n[0]) * leaf_size if n[0] is not None else len(n[1]) * node_size) for n in level) for level in levels]
    out = []
    for depth, level in enumerate(levels):
        child = at + sum(sizes[: depth + 1])
        for node in level:
            if node[0] is not None:
                out.append(struct.pack("<BBH", 1, 0, len(node[0])) + b"".join(node[0]))
                continue
            out.append(struct.pack("<BBH", 0, 0, len(node[1])))
            for c in node[1]:
                out.append(upper(spanned(c), child))
                child += 4 + (len(c[0]) * leaf_size if c[0] is not None else len(c[1]) * node_size)
    return b"".join(out)


def _tree_bytes(n: int, leaf_size: int, node_size: int) -> int:
    total, count = 4 * max(1, -(-n // NODE)) + n * leaf_size, max(1, -(-n // NODE))
    while count > 1:
        total, count = total + 4 * -(-count // NODE) + count * node_size, -(-count // NODE)
    return total


def _names_tree(sizes: list[tuple[str, int]], at: int) -> bytes:
    width = max((len(n.encode()) for n, _ in sizes), default=1)
    key = lambda n: n.encode().ljust(width, b"\0")
    items = [key(n) + struct.pack("<II", i, size) for i, (n, size) in enumerate(sizes)]
    head = struct.pack("<IIIIQQ", NAMES_MAGIC, NODE, width, 8, len(items), 0)
    return head + _tree(items, [n for n, _ in sizes], width + 8, width + 8, at + len(head), lambda keys, child: key(keys[0]) + struct.pack("<Q", child))


def _blocks_tree(blocks: list[tuple[int, int, int, int, int]], at: int, end: int) -> bytes:
    """blocks: chromosome, start, end, offset and bytes, in order."""
    whole = (blocks[0][0], blocks[0][1], blocks[-1][0], max(b[2] for b in blocks if b[0] == blocks[-1][0])) if blocks else (0, 0, 0, 0)
    head = struct.pack("<IIQIIIIQII", BLOCKS_MAGIC, NODE, len(blocks), *whole, end, 1, 0)
    items = [struct.pack("<IIIIQQ", c, s, c, e, o, n) for c, s, e, o, n in blocks]

    def upper(keys: list, child: int) -> bytes:
        last = max(k[0] for k in keys)
        return struct.pack("<IIIIQ", keys[0][0], keys[0][1], last, max(k[2] for k in keys if k[0] == last), child)

    keys = blocks
    return head + _tree(items, keys, 32, 24, at + len(head), upper)


def write_bigwig(rows: DataFrame, path: str, sizes: list[tuple[str, int]], zooms: tuple[int, ...] = ZOOMS) -> None:
    """rows (chrom, start, end, value), not overlapping, as one bigWig file; sizes: (chromosome, length), a row for each.

    Rows of other chromosomes, beyond an end or without a value are left out. An
    older file is replaced once the new one is whole.
    """
    spark, sizes = rows.sparkSession, sorted(sizes, key=lambda x: x[0].encode())
    names = spark.createDataFrame([(n, i, s) for i, (n, s) in enumerate(sizes)], "chrom string, c long, _size long")
    x = rows.where("value IS NOT NULL AND NOT isnan(value) AND start < end").join(small(names), "chrom").where("end <= _size")
    x = Written(x.select("c", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("value").cast("float").alias("value"))).df
    levels = [z for z in zooms if z < max((s for _, s in sizes), default=0)]
    tables, below = [_sections(x, -1)], x
    for k, bases in enumerate(levels):
        below = Written(zoom_records(below, bases)).df
        tables.append(_sections(below, k))
    blocks = Written(_union(tables)).df
    about = {r["level"]: r for r in blocks.groupBy("level").agg(F.count("*").alias("n"), F.sum(F.length("data")).alias("bytes"), F.max("raw").alias("raw")).collect()}
    n = F.col("end") - F.col("start")
    v = F.col("value").cast("double")
    total = x.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.min(v), F.lit(0.0)), F.coalesce(F.max(v), F.lit(0.0)), F.coalesce(F.sum(v * n), F.lit(0.0)), F.coalesce(F.sum(v * v * n), F.lit(0.0))).first()

    # where everything will lie
    at_names = 64 + 24 * len(levels)
    at_total = at_names + len(_names_tree(sizes, at_names))
    at, places = at_total + 40, {}
    for level in range(-1, len(levels)):
        count, size = (about[level]["n"], about[level]["bytes"]) if level in about else (0, 0)
        places[level] = (at, at + 4 + size, count)
        at += 4 + size + 48 + _tree_bytes(count, 32, 24)
    raw = max((r["raw"] for r in about.values()), default=0)
    head = struct.pack("<IHHQQQHHQQIQ", MAGIC, 4, len(levels), at_names, places[-1][0], places[-1][1], 0, 0, 0, at_total, raw, 0)
    head += b"".join(struct.pack("<IIQQ", z, 0, *places[k][:2]) for k, z in enumerate(levels)) + _names_tree(sizes, at_names) + struct.pack("<Qdddd", *total)
    end = at

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = bgzf.located(path)
        beside = f"{where}.{uuid.uuid4().hex}"
        with fs.open_output_stream(beside) as f:
            f.write(head)
            level, found, at = -2, [], 0

            def begin(to: int) -> None:  # ends the levels before with their trees
                nonlocal level, found, at
                while level < to:
                    if level > -2:
                        f.write(_blocks_tree(found, places[level][1], places[level][1]))
                    level, found = level + 1, []
                    if level < len(levels):
                        f.write(struct.pack("<I", places[level][2]))
                        at = places[level][0] + 4

            for b in batches:
                for lv, c, s, e, data in zip(*(b.column(k).to_pylist() for k in ("level", "c", "start", "end", "data"))):
                    begin(lv)
                    if lv < len(levels):
                        found.append((c, s, e, at, len(data)))
                        f.write(data)
                        at += len(data)
            begin(len(levels))
            f.write(struct.pack("<I", MAGIC))
        fs.move(beside, where)
        yield pa.RecordBatch.from_arrays([pa.array([end + 4], pa.int64())], ["bytes"])

    last = spark.createDataFrame([(len(levels), 0, 0, 0, 0, b"")], _BLOCK)  # so that there is a row, and with it a file
    blocks.unionByName(last).repartition(1).sortWithinPartitions("level", "c", "start").mapInArrow(put, "bytes long").collect()


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
