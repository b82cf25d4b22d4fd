"""Binary alignments: split anywhere, found by index, equal to their text."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from cytoframe.sources import bam, bgzf, readers

REFS = [("chr1", 400_000), ("chr2", 200_000), ("chrEmpty", 50)]


def sam_lines(n=6000, seed=5):
    """Sorted reads with every kind of tag, operation and flag; some unplaced ones at the end."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ref = rng.randrange(2)
        length = rng.choice((30, 75, 76, 500 if i % 50 == 0 else 60))
        cigar = rng.choice((f"{length}M", f"5S{length - 10}M5I", f"{length - 20}M3D20M", f"10M1000N{length - 10}M", f"3H{length}M"))
        seq = "".join(rng.choice("ACGTN") for _ in range(length))
        xm = "".join(rng.choice("Zz..xXhH..") for _ in range(length))
        qual = "".join(chr(33 + rng.randrange(10, 42)) for _ in range(length)) if i % 17 else "*"
        rows.append((ref, rng.randrange(REFS[ref][1] - 2000), f"read{i}", rng.choice((0, 16, 99, 147, 1024, 512, 256, 2048)), rng.choice((0, 5, 30, 60)), cigar, seq, qual,
                     [f"XM:Z:{xm}", "NM:i:-3", "XA:A:c", "XF:f:0.5", "ML:B:C,200,10", f"XB:i:{70000 + i}"]))
    rows.sort(key=lambda r: r[:2])
    rows.append((-1, -1, "lost", 4, 0, "*", "ACG", "III", []))
    return rows


def as_text(rows):
    out = ["@HD\tVN:1.6"]
    for ref, pos, name, flag, mapq, cigar, seq, qual, tags in rows:
        out.append("\t".join([name, str(flag), REFS[ref][0] if ref >= 0 else "*", str(pos + 1), str(mapq), cigar, "*", "0", "0", seq, qual, *tags]))
    return out


def encoded(row):
    ref, pos, name, flag, mapq, cigar, seq, qual, tags = row
    ops = [(int(n), bam.OPERATIONS.index(o)) for n, o in readers.re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    span = max(1, sum(n for n, o in ops if o in (0, 2, 3, 7, 8)))
    body = name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops)
    codes = [bam.BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
    body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + (b"\xff" * len(seq) if qual == "*" else bytes(ord(c) - 33 for c in qual))
    for t in tags:
        key, kind, value = t[:2], t[3], t[5:]
        body += key.encode()
        if kind == "i":
            body += b"i" + struct.pack("<i", int(value)) if int(value) < 0 else b"I" + struct.pack("<I", int(value))
        elif kind == "f":
            body += b"f" + struct.pack("<f", float(value))
        elif kind == "B":
            v = value.split(",")[1:]
            body += b"BC" + struct.pack(f"<i{len(v)}B", len(v), *map(int, v))
        else:
            body += kind.encode() + value.encode() + (b"\0" if kind == "Z" else b"")
    fixed = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, bgzf.bin_of(max(pos, 0), max(pos, 0) + span), len(ops), flag, len(seq), -1, -1, 0)
    return struct.pack("<i", len(fixed) + len(body)) + fixed + body, span


def write_bam(path, rows):
    with open(path, "wb") as f:
        w, index = bgzf.Writer(f), bgzf.Index()
        text = b"@HD\tVN:1.6\n"
        w.write(b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(REFS)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in REFS))
        for r in rows:
            data, span = encoded(r)
            low = w.tell()
            w.write(data)
            if r[0] >= 0:
                index.add(r[0], r[1], r[1] + span, low, w.tell())
        w.close()
    with open(f"{path}.bai", "wb") as f:
        f.write(index.alignment_bytes(len(REFS)))


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    path, rows = str(tmp_path_factory.mktemp("bam") / "a.bam"), sam_lines()
    write_bam(path, rows)
    return path, rows


def flat(df):
    return sorted((r["read_id"], r["flag"], r["chrom"], r["start"], r["mapq"], r["cigar"], r["sequence"], r["qualities"], tuple(sorted(r["tags"].items()))) for r in df.collect())


def test_split_reads_every_record_once_and_as_its_text(spark, made):
    path, rows = made
    text = readers.parse_alignments(spark.createDataFrame([(x,) for x in as_text(rows)], "value string"))
    want = flat(text)
    size = bgzf.opened(path)[1]
    for parts in (1, 4, 40):
        df = bam.read_bam(spark, path, partition_bytes=-(-size // parts))
        assert df.rdd.getNumPartitions() == parts
        assert flat(df) == want


def test_every_split_of_a_small_file(tmp_path):
    """Cut between and inside blocks, also where a record goes on over several: no record is lost or comes twice."""
    path = str(tmp_path / "b.bam")
    rows = [(0, i, f"r{i}", 0, 60, "40000M", "ACGT" * 10000, "*", ["XM:Z:" + "z" * 40000]) for i in range(12)]
    write_bam(path, rows)
    size = bgzf.opened(path)[1]
    for step in (700, 1500, 4001, size):
        reader = bam.BamReader({"path": path, "partition_bytes": str(step)})
        assert [n for p in reader.partitions() for b in reader.read(p) for n in b.column("read_id").to_pylist()] == [r[2] for r in rows]


def test_regions_read_only_what_the_index_names(spark, made):
    path, rows = made
    regions = [("chr1", 1000, 9000), ("chr1", 8000, 9500), ("chr2", 150_000, 150_001), ("chr2", 0, 10), ("nowhere", 0, 9), ("chr1", 390_000, 500_000)]
    span = {r[2]: encoded(r)[1] for r in rows}
    want = sorted(r[2] for r in rows if r[0] >= 0 and any(REFS[r[0]][0] == c and r[1] < e and r[1] + span[r[2]] > s for c, s, e in regions))
    got = bam.read_bam(spark, path, regions)
    assert sorted(r["read_id"] for r in got.collect()) == want and len(want) > 50
    reader = bam.BamReader({"path": path, "regions": "chr1:1000-9000"})
    planned = sum((high >> 16) - (low >> 16) for p in reader.partitions() for low, high in p.chunks)
    assert 0 < planned < reader.size / 8  # of the compressed bytes
    assert bam.read_bam(spark, path, []).count() == 0 == bam.read_bam(spark, path, [("chrEmpty", 0, 50)]).count()
    with pytest.raises(Exception, match="(?i)bai|no such file"):
        bam.read_bam(spark, path, [("chr1", 0, 5)], index=path + ".none").count()


def test_calls_of_a_bam(spark, made):
    path, rows = made
    x = bam.read_bam(spark, path)
    for context, letters in (("CpG", "Zz"), ("any", "ZzXxHh")):
        want = []
        for ref, pos, name, flag, mapq, cigar, seq, qual, tags in rows:
            if flag & (4 | 256 | 512 | 1024 | 2048) or mapq < 10:
                continue
            at, i, xm = pos, 0, tags[0][5:]
            for n, o in readers.re.findall(r"(\d+)([MIDNSHP=X])", cigar):
                for _ in range(int(n)):
                    if o == "M":
                        q = 0 if qual == "*" else ord(qual[i]) - 33
                        if xm[i] in letters and q >= 20:
                            want.append((name, REFS[ref][0], at, int(xm[i].isupper()), q, mapq, "-" if flag & 16 else "+", (1 if flag & 64 else 2) if flag & 1 else 0, seq[i]))
                    i, at = i + (o in "MIS"), at + (o in "MDN")
        got = readers.calls_of(x, context=context, sample="s")
        assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(want)
        assert {r["sample"] for r in got.select("sample").distinct().collect()} == {"s"}
    assert readers.calls_of(x.where("flag = 1024")).count() == 0 == readers.calls_of(x.where("flag = 512")).count()


def test_what_is_no_bam_says_so(spark, tmp_path):
    p = tmp_path / "x.bam"
    p.write_bytes(bgzf.member(b"something else" * 10) + bgzf.END)
    with pytest.raises(Exception, match="no binary alignment file"):
        bam.read_bam(spark, str(p)).count()
    write_bam(str(p), [])
    assert bam.read_bam(spark, str(p)).count() == 0
    cut = tmp_path / "cut.bam"
    write_bam(str(cut), sam_lines(300))
    cut.write_bytes(cut.read_bytes()[:-40])
    with pytest.raises(Exception, match="breaks off"):
        bam.read_bam(spark, str(cut)).agg(F.count("*")).collect()
