"""Suffix-array dedup over run-length indexes of repetitive text.

A byte goes if it is covered by a `window`-byte string that also starts in a
document with a smaller id. Windows are dealt to buckets by their minimizer
(the least hash among their 16-byte grams), so equal windows meet in one bucket
whatever document they are in. A first pass sends 40 bits of each minimizer and
finds those that two documents have; all others are done with, but for the few
of a document that are like a shared one of its own in 24 bits. A second pass
sends the text around the shared ones: neighbouring windows with one minimizer
are one string of at most 84 bytes. In a bucket the distinct strings are the
text of a run-length index: its Burrows-Wheeler transform kept as runs, with text positions sampled
at the runs' heads. Longest matches with the lexicographic predecessor are
compared at the heads alone and stream on from there, one less with each
position; where they fall below a window, a new class of equal windows begins,
and of a class all but the least document's windows are marked.

Equal minimizers and strings of one batch of documents are combined before the
shuffle: all but the least document's are marked at once. So a passage that a third of all
documents share is one string a batch. Buckets hold about `bucket_bytes` of
text each, on large inputs up to twice as much, whatever the input's size.
Only strings that also have half a window beside their minimizer in common with
another document's are indexed.

Defined cases: a null text is empty. A null doc_id sorts after all others, and
all such rows are one document. Rows of one doc_id are one document, each row
with its own result. Texts shorter than a window stay as they are. Other
columns pass by.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import map_in_arrow, named

WINDOW = 50
GRAM = 16
BUCKET_BYTES = 4_000_000
#: With more buckets than this they hold up to twice as much: every batch sends each bucket a row, and those grow with batches times buckets.
BUCKETS = 256
#: Text whose windows are worked out at once; a longer document is taken in overlapping pieces.
_BATCH_BYTES = 8_000_000
#: Windows whose minimizers are found at once, few enough for a core's cache.
_PIECE = 1 << 14
#: Shared minimizers that are put together before they are sent, and parts that their documents are dealt to: rows grow with the input, not with documents times tasks.
_SENT, _PARTS = 1 << 21, 1024
_POS_BITS = np.uint64(22)
_POS = np.uint64((1 << 22) - 1)
_LAST = (1 << 63) - 1
#: A span is start << _LEN | length.
_LEN = 24


def _words8(x: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as one number."""
    return np.ndarray(len(x) - 7, "<u8", x, strides=(1,)).copy()


def _mixed(v: np.ndarray) -> np.ndarray:
    v = v ^ (v >> np.uint64(31))
    v *= np.uint64(0x9E3779B97F4A7C15)
    v ^= v >> np.uint64(29)
    return v


def gram_hashes(x: np.ndarray) -> np.ndarray:
    g = _mixed(_words8(x))
    h = g[:-8] * np.uint64(0xBF58476D1CE4E5B9)
    h ^= g[8:]
    return _mixed(h)


def _minimizer_places(x: np.ndarray, window: int) -> np.ndarray:
    """Where each window's minimizer begins; of equal hashes in a window the leftmost counts."""
    width = window - GRAM + 1
    out = np.empty(len(x) - window + 1, np.int32)
    for a in range(0, len(out), _PIECE):
        k = min(_PIECE, len(out) - a)
        key = (gram_hashes(x[a : a + k + window - 1]) & ~_POS) | np.arange(k + width - 1, dtype=np.uint64)
        have = 1
        while have * 2 <= width:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        if have < width:
            key = np.minimum(key[:k], key[width - have :])
        out[a : a + k] = (key & _POS).astype(np.int32) + a
    return out


def strings_of(x: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, gram) of the strings that cut x's windows by minimizer; gram is the minimizer's place.

    doc: number of the document of each byte; no window crosses documents.
    """
    if len(x) < window:
        return (np.zeros(0, np.int64),) * 3
    at = _minimizer_places(x, window)
    ok = doc[: len(at)] == doc[window - 1 :]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | ~ok[:-1]
    starts = np.flatnonzero(new & ok)
    # a string ends where the next begins or windows stop being whole
    stop = np.flatnonzero(np.append(new | ~ok, True))
    ends = stop[np.searchsorted(stop, starts, side="right")]
    return starts, ends + window - 1, at[starts].astype(np.int64)


_PAD = 88


def _matrix(x: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The strings as rows of _PAD bytes, zero behind their end."""
    x = np.concatenate((x, np.zeros(_PAD, np.uint8)))
    m = np.lib.stride_tricks.sliding_window_view(x, _PAD)[starts]
    m[np.arange(_PAD) >= lens[:, None]] = 0
    return m


_ODD = _mixed(np.arange(1, _PAD // 8 + 1, dtype=np.uint64)) | np.uint64(1)


def _row_hashes(m: np.ndarray, lens: np.ndarray) -> np.ndarray:
    h = lens.astype(np.uint64)
    for k, w in enumerate(np.ascontiguousarray(m).view("<u8").T):
        h = _mixed((h ^ w) * _ODD[k])
    return h


def _same_rows(m: np.ndarray, lens: np.ndarray, order: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Class numbers, in `order`, of strings that are equal byte by byte; order sorts them by hash."""
    first = np.ones(len(order), bool)
    a, b = order[1:], order[:-1]
    near = np.flatnonzero(h[a] == h[b])
    first[near + 1] = (lens[a[near]] != lens[b[near]]) | (m[a[near]] != m[b[near]]).any(axis=1)
    return np.cumsum(first) - 1


class RunLengthIndex:
    """A Burrows-Wheeler transform in runs, with the text positions of the runs' heads.

    m, lens: the strings, each closed by an end mark that sorts before every
    byte; equal remainders sort by string. Suffix ranks come from prefix
    doubling; the full suffix array serves while building only.
    """

    def __init__(self, m: np.ndarray, lens: np.ndarray):
        n = lens.astype(np.int64)
        keep = np.arange(m.shape[1]) < n[:, None]
        self.text = m[keep]
        self.ends = np.repeat(np.cumsum(n), n)  # behind the string that a position is in
        self.item = np.repeat(np.arange(len(n)), n)
        total = len(self.text)
        left = self.ends - np.arange(total)
        used = np.zeros(256, bool)
        used[self.text] = True
        code = np.cumsum(used)  # from 1 on; 0 stands behind the end
        bits = max(1, int(code[-1]).bit_length())
        have = max(1, (63 - total.bit_length()) // bits)
        sym = np.zeros(total + have, np.int64)
        sym[:total] = code[self.text]
        rank = np.zeros(total, np.int64)
        for k in range(have):
            rank <<= bits
            rank += np.where(left > k, sym[k : k + total], 0)
        order, rank, ranks = self._ranked(rank)
        while have < m.shape[1] and ranks < total:
            nxt = np.zeros(total, np.int64)
            if have < total:
                nxt[:-have] = np.where(left[:-have] > have, rank[have:] + 1, 0)
            order, rank, ranks = self._ranked(rank * (total + 1) + nxt)
            have *= 2
        self.order = order  # equal remainders by position, that is by string
        before = np.full(total, 256, np.int16)  # what a string's first byte follows is like nothing else
        inside = np.ones(total, bool)
        inside[np.cumsum(n) - n] = False
        before[1:][inside[1:]] = self.text[:-1][inside[1:]]
        bwt = before[order]
        heads = np.ones(total, bool)
        heads[1:] = (bwt[1:] != bwt[:-1]) | (bwt[1:] == 256)
        self.heads = np.flatnonzero(heads)
        self.runs = bwt[self.heads]
        self.sampled = order[self.heads]

    @staticmethod
    def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Positions by key, equal keys by position; each position's rank among the distinct keys; how many those are."""
        total = len(key)
        place = total.bit_length()
        if total and int(key.max()).bit_length() + place <= 64:  # numbers sort far faster than places by number
            s = (key.astype(np.uint64) << np.uint64(place)) | np.arange(total, dtype=np.uint64)
            s.sort()
            order = (s & np.uint64((1 << place) - 1)).astype(np.int64)
            s >>= np.uint64(place)
        else:
            order = np.argsort(key, kind="stable")
            s = key[order]
        new = np.ones(total, np.int64)
        new[1:] = s[1:] != s[:-1]
        new = np.cumsum(new) - 1
        rank = np.empty(total, np.int64)
        rank[order] = new
        return order, rank, int(new[-1]) + 1 if total else 0

    def matches(self) -> np.ndarray:
        """Length of each position's match with its lexicographic predecessor, within both strings.

        Compared at the sampled heads; elsewhere the position before has the
        same symbol before it as its predecessor, so its match is one longer.
        """
        total = len(self.text)
        p = self.sampled
        q = self.order[np.maximum(self.heads - 1, 0)]
        room = np.minimum(self.ends[p] - p, self.ends[q] - q)
        room[self.heads == 0] = 0
        words = _words8(np.concatenate((self.text, np.zeros(8, np.uint8))))
        got, live, k = np.zeros(len(p), np.int64), np.flatnonzero(room > 0), 0
        while len(live):
            d = words[p[live] + k] ^ words[q[live] + k]
            same = np.bitwise_count((d & (~d + np.uint64(1))) - np.uint64(1)) >> 3  # bytes before the first that differs
            got[live] = np.minimum(k + same.astype(np.int64), room[live])
            k += 8
            live = live[(same == 8) & (room[live] > k)]
        at = np.full(total, -1, np.int64)
        at[p] = got + p
        return np.maximum.accumulate(at) - np.arange(total)


def marked_windows(m: np.ndarray, lens: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(string, window's offset), sorted, of the windows that a smaller document has too; the strings are distinct, doc is the least that has each."""
    index = RunLengthIndex(m, lens)
    order = index.order
    # a class begins where the match with what sorts before is too short; between equal windows nothing shorter sorts
    cls = np.cumsum(index.matches()[order] < window)
    whole = index.ends[order] - order >= window
    at, cls = order[whole], cls[whole]
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1])))
    own = doc[index.item[at]]
    least = np.repeat(np.minimum.reduceat(own, starts), np.diff(np.append(starts, len(at))))
    out = np.sort(at[own > least])
    start_of = np.cumsum(lens.astype(np.int64)) - lens
    return index.item[out], out - start_of[index.item[out]]


def _blob(*arrays: np.ndarray) -> bytes:
    raw = b"".join(a.tobytes() for a in arrays)
    return struct.pack("<II", len(arrays[0]), len(raw)) + zstandard.ZstdCompressor(level=1).compress(raw)


#: Bytes of a minimizer's hash: where documents are told apart by it, and within one document.
_ID, _OWN = 5, 3


def _low(h: np.ndarray, size: int) -> np.ndarray:
    return h & np.uint64((1 << 8 * size) - 1)


def _packed(ids: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(ids.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _unpacked(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel().astype(np.uint64)


def _batched(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple]:
    """(ids, text hashes, pieces, their offsets, shared minimizers) of some documents at a time; windows start in one piece each."""
    own: list[list] = [[], [], [], [], []]
    size = 0
    for b in batches:
        shared = b.column("ids").to_pylist() if "ids" in b.schema.names else [None] * b.num_rows
        for i, th, t, ids in zip(b.column("_doc").to_pylist(), b.column("_th").to_pylist(), b.column("text"), shared):
            data = (t.as_py() or "").encode("utf-8", "surrogatepass")
            for at in range(0, max(1, len(data) - window + 1), _BATCH_BYTES):
                piece = data[at : at + _BATCH_BYTES + window - 1]
                if len(piece) < window:
                    continue
                for col, v in zip(own, (i, th, piece, at, ids)):
                    col.append(v)
                size += len(piece)
                if size >= _BATCH_BYTES:
                    yield np.array(own[0], np.int64), np.array(own[1], np.int64), own[2], np.array(own[3], np.int64), own[4]
                    own, size = [[], [], [], [], []], 0
    if own[0]:
        yield np.array(own[0], np.int64), np.array(own[1], np.int64), own[2], np.array(own[3], np.int64), own[4]


def _strings(parts: list[bytes], window: int):
    lens = np.array([len(p) for p in parts], np.int64)
    x = np.frombuffer(b"".join(parts), np.uint8)
    no = np.repeat(np.arange(len(parts), dtype=np.int32), lens)
    starts, ends, gram = strings_of(x, no, window)
    h = _mixed(gram_hashes_at(x, gram)) if len(gram) else np.zeros(0, np.uint64)
    return x, starts, ends, gram, no[starts], (np.cumsum(lens) - lens), h


def _cut_by(bucket: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[int, int, int]]]:
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
    return order, zip(b[cuts].tolist(), cuts.tolist(), np.append(cuts[1:], len(b)).tolist())


def _in_two(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether another document has the same key."""
    if not len(key):
        return np.zeros(0, bool)
    order = np.argsort(key)
    k, d = key[order], doc[order]
    head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    out = np.empty(len(key), bool)
    out[order] = np.repeat(np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head), np.diff(np.append(head, len(k))))
    return out


def _alike(m: np.ndarray, lens: np.ndarray, off: np.ndarray, gram: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Which strings can share a window with one of another document.

    Equal windows have their minimizer at the same place, so half of the other
    bytes of a window, on its left or on its right, are equal too.
    """
    side = (window - GRAM) // 2
    cols = np.arange(GRAM + side)
    out = np.zeros(len(lens), bool)
    for first in (off - side, off):
        some = np.flatnonzero((first >= 0) & (first + len(cols) <= lens))
        part = np.zeros((len(some), _PAD), np.uint8)
        part[:, : len(cols)] = m[some[:, None], first[some, None] + cols]
        out[some[_in_two(_row_hashes(part, gram[some]), doc[some])]] = True
    return out


def _minimizers(batches: Iterator[pa.RecordBatch], buckets: int, window: int) -> Iterator[pa.RecordBatch]:
    """Blobs of (document, 40 bits of a minimizer) for the buckets; rows with a document are minimizers already known to be shared."""
    names = ["bucket", "blob", "doc"]
    for ids, _, parts, _, _ in _batched(batches, window):
        _, starts, _, _, of, _, h = _strings(parts, window)
        if not len(starts):
            continue
        doc = ids[of]
        order = np.lexsort((doc, h))
        g, d = h[order], doc[order]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])))  # a document counts once
        g, d = g[new], d[new]
        head = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        many = np.repeat(np.diff(np.append(head, len(g))) > 1, np.diff(np.append(head, len(g))))
        rows: list[tuple] = []
        if many.any():
            md, mg = d[many], g[many]
            o, cuts = _cut_by(md)
            for doc_id, a, b in cuts:
                rows.append((doc_id % buckets, _packed(mg[o[a:b]], _ID), doc_id))
        hd, hg = d[head], g[head]
        o, cuts = _cut_by(((hg >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64))
        for bucket, a, b in cuts:
            r = o[a:b][np.argsort(hd[o[a:b]], kind="stable")]
            rows.append((bucket, _blob(np.diff(hd[r], prepend=0), np.frombuffer(_packed(hg[r], _ID), np.uint8)), None))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int64()))], names)


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of one key at a time, of rows that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        no = b.column(key).to_numpy()
        cuts = np.flatnonzero(no[1:] != no[:-1]) + 1
        for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(no)]):
            if held and len(no) and held[-1].column(key)[0].as_py() != no[a]:
                yield pa.Table.from_batches(held)
                held = []
            if e > a:
                held.append(b.slice(a, e - a))
    if held:
        yield pa.Table.from_batches(held)


def _shared_of(g: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(doc, 40 bits) of a bucket's minimizers that two documents have."""
    known = g.filter(pc.is_valid(g.column("doc")))
    packed = known.column("blob").to_pylist()
    out_d = [np.repeat(known.column("doc").to_numpy(), np.array([len(p) // _ID for p in packed], np.int64))]
    out_i = [_unpacked(b"".join(packed), _ID)]
    docs, ids = [], []
    unpack = zstandard.ZstdDecompressor()
    for blob in g.filter(pc.is_null(g.column("doc"))).column("blob").to_pylist():
        k, size = struct.unpack_from("<II", blob)
        raw = unpack.decompress(blob[8:], max_output_size=size)
        docs.append(np.cumsum(np.frombuffer(raw, "<i8", k)))
        ids.append(_unpacked(raw[8 * k :], _ID))
    if docs:
        d, i = np.concatenate(docs), np.concatenate(ids)
        hit = _in_two(i, d)
        out_d.append(d[hit])
        out_i.append(i[hit])
    return np.concatenate(out_d), np.concatenate(out_i)


def _shared_minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs of (document, minimizer that two have) for the parts that documents are dealt to, of rows that are sorted by bucket."""

    def sent(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        d, i = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(d)
        d, i = d[order], i[order]
        o, cuts = _cut_by((_mixed(d.view(np.uint64)) % np.uint64(_PARTS)).astype(np.int64))
        rows = [(part, _blob(np.diff(d[o[a:b]], prepend=0), np.frombuffer(_packed(i[o[a:b]], _OWN), np.uint8))) for part, a, b in cuts]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary()))], ["part", "blob"])

    found, size = [], 0
    for g in _by_key(batches, "bucket"):
        found.append(_shared_of(g))
        size += len(found[-1][0])
        if size >= _SENT:
            yield sent(found)
            found, size = [], 0
    if size:
        yield sent(found)


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, ids), one row for each document, of blobs that are sorted by part."""
    unpack = zstandard.ZstdDecompressor()
    for g in _by_key(batches, "part"):
        found, ids = [], []
        for blob in g.column("blob").to_pylist():
            k, size = struct.unpack_from("<II", blob)
            raw = unpack.decompress(blob[8:], max_output_size=size)
            found.append(np.cumsum(np.frombuffer(raw, "<i8", k)))
            ids.append(np.frombuffer(raw, np.uint8, offset=8 * k).reshape(-1, _OWN))
        o, cuts = _cut_by(np.concatenate(found))
        docs, _, ends = zip(*cuts)
        offsets = pa.py_buffer(_OWN * np.array([0, *ends], np.int32))
        packed = pa.Array.from_buffers(pa.binary(), len(docs), [None, offsets, pa.py_buffer(np.concatenate(ids)[o].tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), packed], ["doc", "ids"])


def _map(batches: Iterator[pa.RecordBatch], buckets: int, window: int) -> Iterator[pa.RecordBatch]:
    """Blobs of strings for the buckets, and spans already known to go."""
    names = ["bucket", "blob", "doc", "th", "span"]
    for ids, ths, parts, offs, shared in _batched(batches, window):
        x, starts, ends, gram, of, base, h = _strings(parts, window)
        sets = [_unpacked(s, _OWN) for s in shared]
        # minimizers are looked up by document in one sorted list; 24 bits number a batch's documents
        keys = np.sort(np.concatenate([(np.uint64(k) << np.uint64(40)) | s for k, s in enumerate(sets)]))
        mine = (of.astype(np.uint64) << np.uint64(40)) | _low(h, _OWN)
        at = np.minimum(np.searchsorted(keys, mine), max(len(keys) - 1, 0))
        keep = keys[at] == mine if len(keys) else np.zeros(len(mine), bool)
        starts, ends, gram, of, h = starts[keep], ends[keep], gram[keep], of[keep], h[keep]
        if not len(starts):
            continue
        n = ends - starts
        m = _matrix(x, starts, n)
        rh = _row_hashes(m, n)
        doc = ids[of]
        order = np.lexsort((doc, rh))
        cls = _same_rows(m, n, order, rh)
        head = np.concatenate(([True], cls[1:] != cls[:-1]))
        least = doc[order][np.flatnonzero(head)][cls]
        gone = doc[order] > least
        at = starts - base[of] + offs[of]
        g = order[gone]
        g = g[np.argsort(starts[g], kind="stable")]
        if len(g):  # neighbours that meet are one span
            new = np.concatenate(([True], (of[g][1:] != of[g][:-1]) | (starts[g][1:] > ends[g][:-1])))
            a = np.flatnonzero(new)
            f, e = g[a], ends[g[np.append(a[1:], len(g)) - 1]]
            to = (_mixed(ths[of[f]].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.nulls(len(f), pa.binary()), pa.array(doc[f]), pa.array(ths[of[f]]), pa.array((at[f] << _LEN) + (e - starts[f]))], names)
        s = order[~gone]
        o, cuts = _cut_by(((h[s] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64))
        rows = []
        for bucket, a, b in cuts:
            r = np.sort(s[o[a:b]])
            text = m[r][np.arange(_PAD) < n[r][:, None]]
            rows.append((bucket, _blob(doc[r], ths[of[r]], at[r], n[r].astype(np.uint8), (gram[r] - starts[r]).astype(np.uint8), text)))
        k = len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), *(pa.nulls(k, pa.int64()) for _ in range(3))], names)


def gram_hashes_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """gram_hashes, at some positions."""
    w = np.lib.stride_tricks.sliding_window_view(x, GRAM)[at].copy().view("<u8")
    g = _mixed(w)
    return _mixed(g[:, 0] * np.uint64(0xBF58476D1CE4E5B9) ^ g[:, 1])


def _bucket_spans(blobs: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, text hash, span) to go, of all strings of one bucket."""
    cols: list[list[np.ndarray]] = [[] for _ in range(6)]
    unpack = zstandard.ZstdDecompressor()
    for blob in blobs:
        k, size = struct.unpack_from("<II", blob)
        raw = unpack.decompress(blob[8:], max_output_size=size)
        for c, (kind, a, b) in zip(cols, [("<i8", 0, 8), ("<i8", 8, 16), ("<i8", 16, 24), ("u1", 24, 25), ("u1", 25, 26)]):
            c.append(np.frombuffer(raw, kind, k, a * k))
        cols[5].append(np.frombuffer(raw, np.uint8, offset=26 * k))
    doc, th, at, n, off, text = map(np.concatenate, cols)
    n = n.astype(np.int64)
    starts = np.cumsum(n) - n
    gram = gram_hashes_at(text, starts + off)
    some = np.flatnonzero(_in_two(gram, doc))
    if not len(some):
        return (np.zeros(0, np.int64),) * 3
    doc, th, at, n, starts = doc[some], th[some], at[some], n[some], starts[some]
    m = _matrix(text, starts, n)
    h = _row_hashes(m, n)
    order = np.lexsort((doc, h))
    cls = _same_rows(m, n, order, h)
    first = order[np.concatenate(([True], cls[1:] != cls[:-1]))]  # a string's least document
    cls_of = np.empty(len(order), np.int64)
    cls_of[order] = cls
    alike = np.flatnonzero(_alike(m[first], n[first], off[some][first].astype(np.int64), gram[some][first], doc[first], window))
    kept = first[alike]
    item, offset = marked_windows(m[kept], n[kept], doc[kept], window)
    item = alike[item]
    # a string of another document than its least goes as a whole
    other = doc > doc[first][cls_of]
    spans = [(doc[other], th[other], (at[other] << _LEN) + n[other])]
    # of the least document itself, wherever it has the string, the marked windows
    same = np.flatnonzero(~other)
    if len(item):
        new = np.concatenate(([True], (item[1:] != item[:-1]) | (offset[1:] != offset[:-1] + 1)))
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(item)) - 1
        run_item, run_from, run_len = item[a], offset[a], offset[b] - offset[a] + window
        lo, hi = np.searchsorted(run_item, cls_of[same], "left"), np.searchsorted(run_item, cls_of[same], "right")
        times = hi - lo
        row = np.repeat(same, times)
        run = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        spans.append((doc[row], th[row], ((at[row] + run_from[run]) << _LEN) + run_len[run]))
    return tuple(np.concatenate(c) for c in zip(*spans))  # type: ignore[return-value]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_doc": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)), "_th": F.xxhash64("text")})


def bucket_count(size: int, bucket_bytes: int) -> int:
    """Buckets of about bucket_bytes; where that would be over BUCKETS, of up to twice as much."""
    n = max(1, -(-size // bucket_bytes))
    return n if n <= BUCKETS else max(BUCKETS, -(-n // 2))


def removed_spans(docs: DataFrame, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc, spans): pairs of text hash, and start and length of a byte span to go, of each id's rows (null: the largest number)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = bucket_count(size, bucket_bytes)
    keyed = _keyed(docs)
    grams = keyed.select("_doc", "_th", "text").mapInArrow(lambda b: _minimizers(b, buckets, window), "bucket bigint, blob binary, doc bigint")
    found = grams.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared_minimizers, "part bigint, blob binary")
    shared = found.repartition("part").sortWithinPartitions("part").mapInArrow(_by_document, "doc bigint, ids binary")
    # the same columns by the same key as in the join that applies the spans, so that one exchange of the texts serves both
    held = keyed.join(shared.withColumnRenamed("doc", "_doc"), "_doc")
    mapped = map_in_arrow(held, lambda b: _map(b, buckets, window), T.StructType.fromDDL("bucket bigint, blob binary, doc bigint, th bigint, span bigint"))

    def meet(key, g):
        known = g.filter(pc.is_null(g.column("blob"))).select(["doc", "th", "span"])
        blobs = g.column("blob").drop_null().to_pylist()
        if not blobs:
            return known
        return pa.concat_tables([known, pa.table(dict(zip(("doc", "th", "span"), _bucket_spans(blobs, window))))])

    met = mapped.groupBy("bucket").applyInArrow(meet, "doc bigint, th bigint, span bigint")
    return met.groupBy("doc").agg(F.collect_list(F.struct("th", "span")).alias("spans"))


def _runs(th: np.ndarray, spans: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the maximal runs that the rows' spans cover, in order; of a row's spans those with its text hash count."""
    flat = spans.flatten()
    row = np.repeat(np.arange(len(spans)), pc.fill_null(pc.list_value_length(spans), 0).to_numpy())
    mine = flat.field("th").to_numpy() == th[row]
    row, span = row[mine], flat.field("span").to_numpy()[mine]
    begin = span >> _LEN
    order = np.lexsort((begin, row))
    row, begin, length = row[order], begin[order], (span & ((1 << _LEN) - 1))[order]
    base = row << 40  # texts are shorter
    reach = np.maximum.accumulate(base + begin + length)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | ((base + begin)[1:] > reach[:-1])
    a = np.flatnonzero(new)
    return row[a], begin[a], (reach - base)[np.append(a[1:], len(row)) - 1] if len(a) else begin[a]


def suffix_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with kept (binary: the bytes that stay), n_bytes, n_removed, n_spans."""
    own = ("kept", "n_bytes", "n_removed", "n_spans")
    names = [c for c in docs.columns if c not in (*own, "_doc", "_th", "ids", "spans")]
    docs = docs.select(*map(named, names))
    lost = removed_spans(docs, window)
    met = _keyed(docs).join(lost.withColumnRenamed("doc", "_doc"), "_doc", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            row, begin, end = _runs(b.column("_th").to_numpy(), b.column("spans"))
            at = np.searchsorted(row, np.arange(b.num_rows + 1)).tolist()
            begin, end = begin.tolist(), end.tolist()
            for text, lo, hi in zip(b.column("text"), at, at[1:]):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                runs = list(zip(begin[lo:hi], end[lo:hi]))
                kept, last = [], 0
                for a, e in runs:
                    kept.append(data[last:a])
                    last = e
                kept.append(data[last:])
                for col, v in zip(out, (b"".join(kept), len(data), sum(e - a for a, e in runs), len(runs))):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out[0], pa.binary()), *(pa.array(c, pa.int64()) for c in out[1:])], [*names, *own])

    made = [T.StructField("kept", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in own[1:])]
    return map_in_arrow(met, cut, T.StructType([*docs.schema.fields, *made]))


def digest(docs: DataFrame) -> DataFrame:
    return suffix_dedup(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
