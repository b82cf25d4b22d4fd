"""Tracks read back through their trees."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from cytoframe.sources import bigwig


def nodes(raw, at, leaf, size, inner):
    """The items of all leaves below a node, by the offsets that nodes give."""
    kind, _, n = struct.unpack_from("<BBH", raw, at)
    if kind:
        return [raw[at + 4 + i * size : at + 4 + (i + 1) * size] for i in range(n)]
    out = []
    for i in range(n):
        item = raw[at + 4 + i * inner : at + 4 + (i + 1) * inner]
        got = nodes(raw, struct.unpack("<Q", item[-8:])[0], leaf, size, inner)
        leaf(item, got)
        out += got
    return out


def read(path):
    raw = open(path, "rb").read()
    magic, version, n_zooms, names, data, index, _, _, _, total, buf, _ = struct.unpack_from("<IHHQQQHHQQIQ", raw, 0)
    assert magic == bigwig.MAGIC and version == 4 and struct.unpack("<I", raw[-4:])[0] == magic
    m, _, width, _, n, _ = struct.unpack_from("<IIIIQQ", raw, names)
    assert m == bigwig.NAMES_MAGIC
    chroms = {}
    for item in nodes(raw, names + 32, lambda i, got: i[:width] == got[0][:width] or pytest.fail("key"), width + 8, width + 8):
        cid, size = struct.unpack("<II", item[width:])
        chroms[cid] = (item[:width].rstrip(b"\0").decode(), size)
    assert len(chroms) == n

    def blocks(at):
        m, _, n, c0, s0, c1, e1, _, _, _ = struct.unpack_from("<IIQIIIIQII", raw, at)
        assert m == bigwig.BLOCKS_MAGIC

        def inside(item, got):
            a, s, b, e = struct.unpack("<IIII", item[:16])
            own = [struct.unpack("<IIII", g[:16]) for g in got]
            assert (a, s) == own[0][:2] and b == own[-1][2] and e >= max(o[3] for o in own if o[2] == b)

        found = nodes(raw, at + 48, inside, 32, 24)
        assert len(found) == n
        out = []
        for f in found:
            c, s, _, e, o, size = struct.unpack("<IIIIQQ", f)
            plain = zlib.decompress(raw[o : o + size])
            assert len(plain) <= buf
            out.append((c, s, e, plain))
        assert [b[:2] for b in out] == sorted(b[:2] for b in out)
        return out

    rows = []
    for c, s, e, plain in blocks(index):
        cid, start, end, _, _, kind, _, n = struct.unpack_from("<IIIIIBBH", plain, 0)
        assert (cid, start, end, kind) == (c, s, e, 1)
        rows += [(chroms[cid][0], *struct.unpack_from("<IIf", plain, 24 + 12 * i)) for i in range(n)]
    assert struct.unpack_from("<I", raw, data)[0] == len(blocks(index))
    zooms = {}
    for k in range(n_zooms):
        bases, _, _, at = struct.unpack_from("<IIQQ", raw, 64 + 24 * k)
        zooms[bases] = [(chroms[r[0]][0], *r[1:]) for b in blocks(at) for r in struct.iter_unpack("<IIIIffff", b[3])]
    return chroms, rows, zooms, struct.unpack_from("<Qdddd", raw, total)


def test_a_track_is_read_back_through_its_trees(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bigwig, "NODE", 3)  # several levels
    rng = random.Random(9)
    sizes = [("chr1", 60_000), ("chr10", 50_000), ("chr2", 40_000), ("chrM", 100), ("chrUn", 10)]
    rows = []
    for c, size in sizes[:4]:
        for p in sorted(rng.sample(range(size), min(size // 2, 3000))):
            rows.append((c, p, p + 1, rng.random()))
    bad = [("chrX", 1, 2, 0.5), ("chr1", 59_999, 60_001, 0.5), ("chr2", 1, 2, None)]
    df = spark.createDataFrame([r for r in rows if r[:2] != ("chr1", 59_999)] + bad, "chrom string, start int, end int, value double").repartition(7)
    rows = [r for r in rows if r[:2] != ("chr1", 59_999)]
    path = str(tmp_path / "a.bw")
    bigwig.write_bigwig(df, path, sizes, (50, 200, 1000, 10_000, 10**9))
    chroms, got, zooms, total = read(path)
    assert sorted(chroms.values()) == sizes and len(got) == len(rows)
    assert [g[:3] for g in got] == [r[:3] for r in sorted(rows)] and all(abs(g[3] - r[3]) < 1e-6 for g, r in zip(got, sorted(rows)))
    assert total[0] == len(rows) and abs(total[3] - sum(r[3] for r in rows)) < 1e-3 and total[1] <= total[2]
    assert set(zooms) == {50, 200, 1000, 10_000}
    for bases, found in zooms.items():
        want = {}
        for c, s, _, v in rows:
            want.setdefault((c, s // bases), []).append(v)
        assert len(found) == len(want)
        for c, s, e, n, low, high, sums, squares in found:
            v = want[c, s // bases]
            assert n == len(v) and (e - 1) // bases == s // bases
            assert (low, high, sums, squares) == pytest.approx((min(v), max(v), sum(v), sum(x * x for x in v)), rel=1e-5)


def test_wide_intervals_fall_into_their_bins_and_empty_tracks_are_files(spark, tmp_path):
    df = spark.createDataFrame([("c", 90, 310, 2.0)], "chrom string, start int, end int, value double")
    bigwig.write_bigwig(df, str(tmp_path / "w.bw"), [("c", 1000)], (100, 400))
    _, rows, zooms, total = read(str(tmp_path / "w.bw"))
    assert rows == [("c", 90, 310, 2.0)] and total == (220, 2.0, 2.0, 440.0, 880.0)
    assert [(r[1], r[2], r[3], r[6]) for r in zooms[100]] == [(90, 100, 10, 20.0), (100, 200, 100, 200.0), (200, 300, 100, 200.0), (300, 310, 10, 20.0)]
    assert [(r[1], r[2], r[3], r[6]) for r in zooms[400]] == [(90, 310, 220, 440.0)]
    bigwig.write_bigwig(df.where(F.lit(False)), str(tmp_path / "w.bw"), [("c", 1000)])
    assert read(str(tmp_path / "w.bw"))[1] == []
