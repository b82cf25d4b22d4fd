"""Sequence text split anywhere, strands by its bases, and strands joined."""

import random

import pytest

from cytoframe.sources import fasta, readers


def written(path, seqs, width, end="\n", last=True):
    lines = []
    for name, s in seqs:
        lines.append(f">{name} some words")
        lines += [s[i : i + width] for i in range(0, len(s), width)]
    path.write_bytes((end.join(lines) + (end if last else "")).encode())
    return str(path)


def test_every_split_gives_the_same_sequences(spark, tmp_path):
    rng = random.Random(4)
    seqs = [(f"chr{i}", "".join(rng.choice("acgtN") for _ in range(n))) for i, n in enumerate((700, 1, 0, 30_000, 61))]
    for width, end, last in ((60, "\n", True), (61, "\r\n", False), (10**6, "\n", True)):
        path = written(tmp_path / f"{width}.fa", seqs, width, end, last)
        for step in (37, 500, 10**7) if width != 61 else (499,):
            rows = sorted((r["chrom"], r["start"], r["end"], r["bases"]) for r in fasta.read_fasta(spark, path, partition_bytes=step).collect()) if step > 37 else None
            if rows is None:  # so many parts: read by the reader itself
                reader = fasta.FastaReader({"path": path, "partition_bytes": str(step)})
                got = sorted((o, n, b) for p in reader.partitions() for batch in reader.read(p) for o, n, b in zip(*(batch.column(c).to_pylist() for c in ("offset", "name", "bases"))))
                text = "".join(f">{n}" if n is not None else b for _, n, b in got)
                assert text == "".join(f">{n}{s}" for n, s in seqs)
                continue
            for name, s in seqs:
                own = [r for r in rows if r[0] == name]
                assert "".join(r[3] for r in own) == s and all(r[2] - r[1] == len(r[3]) for r in own)
                assert [r[1] for r in own] == [sum(len(q[3]) for q in own[:i]) for i in range(len(own))]


def test_folder_of_files_and_what_is_missing(spark, tmp_path):
    (tmp_path / "f").mkdir()
    written(tmp_path / "f" / "a.fa", [("x", "ACGT")], 60)
    written(tmp_path / "f" / "b.fa", [("y", "GG")], 1)
    assert sorted((r["chrom"], r["bases"]) for r in fasta.read_fasta(spark, str(tmp_path / "f")).collect()) == [("x", "ACGT"), ("y", "GG")]
    with pytest.raises(Exception, match="(?i)no such|not found|FileNotFound"):
        fasta.read_fasta(spark, str(tmp_path / "none.fa")).count()


def test_conversion_with_a_sequence(spark, tmp_path):
    ref = written(tmp_path / "ref.fa", [("chr1", "AACGTTCGNcg"), ("chr2", "TTTT")], 4)
    both, one = tmp_path / "both.cov", tmp_path / "one.cov"
    lines = [("chr1", 2, 3, 1), ("chr1", 3, 1, 1), ("chr1", 6, 5, 0), ("chr1", 10, 0, 4), ("chr1", 0, 9, 9), ("chr9", 5, 1, 1)]
    both.write_text("".join(f"{c}\t{p}\t{p + 1}\t0\t{m}\t{u}\n" for c, p, m, u in lines))
    one.write_text("".join(f"{c}\t{p}\t{p + 1}\t0\t{m}\t{u}\n" for c, p, m, u in lines if p in (2, 6, 0)))
    paths = {"b": str(both), "o": str(one)}
    plain = readers.converted(spark, paths)
    assert {r["strand"] for r in plain.collect()} == {"*"}
    kept = readers.converted(spark, paths, reference=ref, merge=False)
    assert {(r["sample"], r["chrom"], r["pos"]): r["strand"] for r in kept.where("sample = 'b'").collect()} == {("b", "chr1", 2): "+", ("b", "chr1", 3): "-", ("b", "chr1", 6): "+", ("b", "chr1", 10): "-", ("b", "chr1", 0): "*", ("b", "chr9", 5): "*"}
    assert sorted(map(tuple, readers.strand_pairs(kept).collect())) == [("b", 1, 1, 1), ("o", 0, 2, 0)]
    merged = sorted((r["sample"], r["pos"], r["strand"], r["n_meth"], r["n_unmeth"], r["coverage"]) for r in readers.converted(spark, paths, reference=ref).collect())
    assert merged == [("b", 2, "+", 4, 2, 6), ("b", 6, "+", 5, 0, 5), ("b", 9, "+", 0, 4, 4), ("o", 0, "*", 9, 9, 18), ("o", 2, "+", 3, 1, 4), ("o", 6, "+", 5, 0, 5)]
    out = str(tmp_path / "store")
    assert readers.convert_if_stale(spark, paths, out, reference=ref) and not readers.convert_if_stale(spark, paths, out, reference=ref)
    assert readers.convert_if_stale(spark, paths, out)


def test_short_ranges_are_bounded_in_number(tmp_path):
    """Ranges of few bytes are asked for; a file of any size still has a bounded number of them, none over the usual size."""
    p = tmp_path / "long.fa"
    p.write_bytes(b">a\n" + b"ACGT\n" * 400_000)
    parts = fasta.FastaReader({"path": str(p), "partition_bytes": "7"}).partitions()
    assert len(parts) <= 2 * fasta.MOST_SHORT and parts[0].low == 0 and parts[-1].high == p.stat().st_size
    assert all(a.high == b.low for a, b in zip(parts, parts[1:]))
