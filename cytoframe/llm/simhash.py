"""SimHash near-dedup over a byte-position inverted index with count filtering.

A fingerprint has 8 positional bytes. Two of them that differ in at most 4
bits differ in at most 4 bytes, so they share at least 4 positional bytes. Of
any 4 positions, one of the 20 fixed position triples below holds 3, so
posting lists keyed by a triple and its 3 byte values reach every such pair.
Within a list the shared positional bytes of a pair are tallied, pairs below
the guaranteed 4 go, and the rest are verified by their differing bits.

Equal fingerprints are one entry from the start. A long list is compared in
tiles of bounded size, and a list yields spanning links only, not pairs.

Defined cases: null and empty texts, and texts without a word, have
fingerprint zero and are linked like any other. Rows with a null doc_id take
part, but never name a component; one of nothing but such rows is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, Written, connected_components, give_back, meet, small
from ._tiles import segments, spanning, tiled

SHINGLE = 4
MAX_BITS = 4
MIN_SHARED = 4
SEED = 42
LIST_CAP = 2048
BUCKET_ROWS = 16384
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Bits summed at once for one document.
_CHUNK = 1 << 16


def _triples() -> list[tuple[int, int, int]]:
    """20 triples of 8 positions, one in any 4: within one of three parts, or two of a part with one of the next."""
    parts, out = [(0, 1, 2), (3, 4, 5), (6, 7)], []
    for k, own in enumerate(parts):
        nxt = parts[(k + 1) % 3]
        out += [own] if len(own) == 3 else []
        out += [(*two, c) for i, a in enumerate(own) for two in [(a, b) for b in own[i + 1 :]] for c in nxt]
    return [tuple(sorted(t)) for t in out]


TRIPLES = _triples()


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of lower-cased words; one of all words if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(b" ".join(words), SEED)], np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    pairs = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.fromiter((h(joined[a:b], SEED) for a, b in pairs), np.uint64, len(words) - width + 1)


def fingerprint(text: str | None) -> int:
    """64 bits, signed; a bit is 1 if it is set in over half of the hashes."""
    hashes = shingle_hashes(text)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[at : at + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0].astype(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text"), "text").mapInArrow(run, "doc_id bigint, text_hash bigint, fp bigint")


def _byte(position: int) -> Column:
    return F.shiftrightunsigned("fp", 56 - 8 * position).bitwiseAND(255)


def _links_of(fps: np.ndarray):
    as_bytes = fps.astype(">u8").view(np.uint8).reshape(-1, 8)

    def linked(i: int, js: np.ndarray) -> np.ndarray:
        tally = (as_bytes[js] == as_bytes[i]).sum(axis=1)
        hit = tally >= MIN_SHARED
        hit[hit] = np.bitwise_count(fps[js[hit]] ^ fps[i]) <= MAX_BITS
        return hit

    return linked


def fingerprint_links(fps: DataFrame, list_cap: int = LIST_CAP, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints fp that connect all that are within reach."""
    keys = [
        F.lit(k << 24).bitwiseOR(F.shiftleft(_byte(x), 16)).bitwiseOR(F.shiftleft(_byte(y), 8)).bitwiseOR(_byte(z))
        for k, (x, y, z) in enumerate(TRIPLES)
    ]
    postings = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    n = fps.count() * len(TRIPLES)
    buckets = max(1, -(-n // bucket_rows))
    met = tiled(postings, "key", F.xxhash64("fp"), list_cap)
    met = met.select(F.pmod(F.xxhash64("key", "t0", "t1"), F.lit(buckets)).alias("bucket"), "key", "t0", "t1", "fp")

    def run(key, g):
        cols = [g.column(c).to_numpy() for c in ("key", "t0", "t1", "fp")]
        order = np.lexsort(cols[::-1])
        k, t0, t1, fp = (c[order] for c in cols)
        fp = fp.astype(np.int64).view(np.uint64)
        new = np.zeros(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (t0[1:] != t0[:-1]) | (t1[1:] != t1[:-1])
        starts, ends = segments(np.cumsum(new))
        a, b = [], []
        two = ends - starts == 2  # most lists that chance makes
        i = starts[two]
        hit = np.bitwise_count(fp[i] ^ fp[i + 1]) <= MAX_BITS
        a.append(fp[i[hit]])
        b.append(fp[i[hit] + 1])
        for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist()):
            own = fp[s:e]
            got = np.array(spanning(len(own), _links_of(own)), np.int64).reshape(-1, 2)
            a.append(own[got[:, 0]])
            b.append(own[got[:, 1]])
        a, b = (np.concatenate(x).view(np.int64) for x in (a, b))
        return pa.table({"a": a, "b": b})

    return met.groupBy("bucket").applyInArrow(run, "a bigint, b bigint")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) of every row; text_hash is xxhash64(text)."""
    held = Written(fingerprints(docs)).df
    first = held.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    fps = Written(first).df
    comps = Written(connected_components(fingerprint_links(fps.select("fp")))).df
    named = fps.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of = named.join(least, "component").select("fp", "component_id", "n")
    return meet(held, Written(of).df, "fp", held.count()).select("doc_id", "text_hash", "fp", "component_id")


# --- near-duplicates by similarity of shingles ------------------------------

#: Words of a wide fingerprint, 64 bits each.
WIDE = 4
#: Pairs of positional bytes that index a wide fingerprint: each byte with those one and eleven places on, half of the latter.
PAIRS = [(i, (i + 1) % 32) for i in range(32)] + [(i, (i + 11) % 32) for i in range(0, 32, 2)]
#: Least positional bytes that a candidate shares, of 32.
WIDE_SHARED = 3
#: Deviations that a candidate's differing bits may lie over what is expected at the similarity asked for.
SLACK = 3.0
#: Lists up to this length are compared by shifting, and all their candidates go on at once.
SHORT = 16
#: Where more fingerprints than FEW hang together by candidates, an item of a list is first held against so many candidates of other groups only; in the last round it is all that are left.
FEW, FURTHER = 512, 32


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """256 bits of distinct shingles: the first 64 of their hashes, the rest of hashes made of these."""
    ones = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        words = np.stack([part if k == 0 else _mixed(part + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k in range(WIDE)], axis=1)
        ones += np.unpackbits(words.astype(">u8").view(np.uint8).reshape(len(part), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def most_bits(similarity: float) -> int:
    """Differing bits up to which a pair of that similarity is a candidate: the angle of two sets' sums, with slack."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(64 * WIDE * p + SLACK * np.sqrt(64 * WIDE * p * (1 - p)))


def _candidates(x: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """Which pairs of rows i, j of x (bytes) share enough positional bytes and differ in few enough bits."""
    a, b = x[i], x[j]
    ok = (a == b).sum(axis=1) >= WIDE_SHARED
    ok[ok] = np.bitwise_count(a[ok] ^ b[ok]).sum(axis=1, dtype=np.int64) <= most
    return ok


def wide_links(fps: DataFrame, most: int, each: int = 0, list_cap: int = LIST_CAP, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b), a < b: pairs of distinct wide fingerprints (fp, binary; group, bigint) of different groups that are candidates and share an indexed pair of bytes.

    Without each: pairs that connect all that candidates connect, of a long list
    only as many as it has items. With it: for each item the first `each`
    candidates of other groups in every list, so all of them once it is as large
    as a list.
    """
    pieces = [F.concat(F.substring("fp", i + 1, 1), F.substring("fp", j + 1, 1)) for i, j in PAIRS]
    keys = F.array(*(F.lit(k << 16).bitwiseOR(F.conv(F.hex(x), 16, 10).cast("int")) for k, x in enumerate(pieces)))
    buckets = max(1, -(-fps.count() * len(PAIRS) // bucket_rows))
    met = tiled(fps.select("fp", "group", F.explode(keys).alias("key")), "key", F.xxhash64("fp"), list_cap)
    met = met.select(F.pmod(F.xxhash64("key", "t0", "t1"), F.lit(buckets)).alias("bucket"), "key", "t0", "t1", "fp", "group")

    def run(key, g):
        fp = g.column("fp").to_pylist()
        x = np.frombuffer(b"".join(fp), np.uint8).reshape(-1, 8 * WIDE)
        cols = [g.column(c).to_numpy() for c in ("key", "t0", "t1")]
        order = np.lexsort((*x.T[::-1], *cols[::-1]))
        x, group, (k, t0, t1) = x[order], g.column("group").to_numpy()[order], (c[order] for c in cols)
        new = np.zeros(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (t0[1:] != t0[:-1]) | (t1[1:] != t1[:-1])
        of = np.cumsum(new)
        starts, ends = segments(of)
        short = np.repeat(ends - starts <= SHORT, ends - starts)
        found = []
        for step in range(1, SHORT):
            i = np.flatnonzero((of[step:] == of[:-step]) & short[step:])
            if not len(i):
                break
            i = i[group[i] != group[i + step]]
            ok = _candidates(x, i, i + step, most)
            found.append((i[ok], i[ok] + step))
        for a, b in zip(starts[ends - starts > SHORT].tolist(), ends[ends - starts > SHORT].tolist()):
            own = x[a:b]
            if each:
                for i in range(a, b - 1):
                    js = np.arange(i + 1, b)
                    js = js[group[js] != group[i]]
                    js = js[_candidates(x, np.full(len(js), i), js, most)][:each]
                    found.append((np.full(len(js), i), js))
                continue
            got = np.array(spanning(len(own), lambda i, js, own=own: _candidates(own, np.full(len(js), i), js, most)), np.int64).reshape(-1, 2) + a
            found.append((got[:, 0], got[:, 1]))
        i, j = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        i, j = np.minimum(i, j), np.maximum(i, j)
        pairs = sorted({(x[p].tobytes(), x[q].tobytes()) for p, q in zip(i.tolist(), j.tolist())})
        pairs = [(min(p), max(p)) for p in pairs]
        return pa.table({"a": pa.array([p for p, _ in pairs], pa.binary()), "b": pa.array([q for _, q in pairs], pa.binary())})

    return met.groupBy("bucket").applyInArrow(run, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, text_hash, component_id, group_id) of every row: groups that links of texts of that Jaccard similarity of their word shingles make.

    Fingerprints of 256 bits are indexed by pairs of positional bytes; of a
    list's pairs those that share enough positional bytes and differ in few
    enough bits are candidates, and a candidate is a link if the distinct
    shingles of the two fingerprints' first texts are that similar. Texts of
    one fingerprint are one group. component_id is a group's smallest doc_id,
    group_id a number of its own, for rows that share a doc_id. Candidates are found with high probability:
    a pair at the similarity asked for shares an indexed pair of bytes with a
    chance of about 0.97, a closer one more surely. A list first sends on only
    what connects its candidates; where some of these turn out not to be links,
    the groups that they left apart are held against each other: first a few
    candidates of each item, then all that still lie between two groups. So the
    groups are those of all candidates, whatever the lengths of lists.
    """
    most = most_bits(similarity)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [wide_fingerprint(np.unique(shingle_hashes(t.as_py(), width))) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.binary())], ["doc_id", "text_hash", "fp"])
        give_back()

    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), "text")
    held = Written(rows.mapInArrow(prints, "doc_id bigint, text_hash bigint, fp binary")).df
    total = held.count()
    classes = Written(held.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("r"), F.count("*").alias("n")).select("fp", "r.doc_id", "r.text_hash", "n")).df
    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), width)).view(np.int64) for t in b.column(1)]
            at = np.concatenate(([0], np.cumsum([len(x) for x in sets], dtype=np.int64)))
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int64())), b.column(2)], ["fp", "s", "n"])
        give_back()

    number = F.xxhash64  # fingerprints as numbers; a collision of two would need billions of them
    same = F.size(F.array_intersect("sa", "sb"))
    alike = (same >= similarity * (F.size("sa") + F.size("sb") - same)).alias("alike")

    # the first text of each fingerprint that has a candidate, and how many candidates want it
    links = Written(wide_links(classes.select("fp", number("fp").alias("group")), most)).df
    wanted = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n"))
    first = small(Written(classes.drop("n").join(wanted, "fp")).df)
    texts = rows.alias("d").join(first.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_hash").eqNullSafe(F.col("f.text_hash")))).select("f.fp", "d.text", "f.n").dropDuplicates(["fp"])
    sets = Written(texts.mapInArrow(shingles, "fp binary, s array<bigint>, n bigint")).df
    both = 2 * links.count()
    one = meet(links.withColumnRenamed("a", "fp"), sets, "fp", both, 100).withColumnsRenamed({"fp": "a", "s": "sa"})
    two = meet(Written(one).df.withColumnRenamed("b", "fp"), sets, "fp", both, 100).withColumnsRenamed({"fp": "b", "s": "sb"})
    known = Written(two.select("a", "b", alike)).df
    found = connected_components(known.where("alike").select(number("a").alias("a"), number("b").alias("b")))
    named = classes.select("fp", number("fp").alias("node")).join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("group"))
    named = Written(named).df

    def ends(links: DataFrame, groups: DataFrame) -> DataFrame:
        """(a, b): the groups of both ends of links."""
        for x in "ab":
            links = links.join(groups.select(F.col("fp").alias(x), F.col("group").alias(f"g{x}")), x)
        return links.where("ga <> gb").select(F.col("ga").alias("a"), F.col("gb").alias("b")).distinct()

    # candidates that turned out to be none lie between groups; what is untested lies within what these connect
    apart = Written(ends(known.where("NOT alike"), named)).df
    if apart.limit(1).count():
        around = connected_components(apart).select(F.col("node").alias("group"), F.col("component").alias("around"))
        left = Written(named.join(around, "group").select("fp", "group", "around")).df
        largest = left.groupBy("around").count().agg(F.max("count")).first()[0]
        for each in (2 * LIST_CAP,) if largest <= FEW else (FURTHER, 2 * LIST_CAP):
            fresh = wide_links(left.select("fp", "group"), most, each).join(known.select("a", "b"), ["a", "b"], "left_anti")
            for x in "ab":
                fresh = fresh.join(sets.select(F.col("fp").alias(x), F.col("s").alias(f"s{x}")), x)
            now = Written(fresh.select("a", "b", alike)).df
            known = known.unionByName(now)
            merged = connected_components(ends(now.where("alike"), left)).select(F.col("node").alias("group"), F.col("component").alias("to"))
            left = Written(left.join(merged, "group", "left").select("fp", F.coalesce("to", "group").alias("group"), "around")).df
        named = named.join(left.select("fp", F.col("group").alias("_g")), "fp", "left").select("fp", F.coalesce("_g", "group").alias("group"))
    named = named.withColumnRenamed("group", "component")
    named = classes.join(named, "fp")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = named.select("fp", "component", "n").join(least, "component").select("fp", "component_id", F.col("component").alias("group_id"), "n")
    return meet(held, Written(of).df, "fp", total).select("doc_id", "text_hash", "component_id", "group_id")


def digest(docs: DataFrame) -> DataFrame:
    return simhash_groups(docs.select("doc_id", "text")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
