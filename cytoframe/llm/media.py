"""Media columns: text bytes as greyscale PNG samples, read back and hashed.

A PNG is built from zlib chunks, each row under the filter that suits it best;
reading tests every chunk's checksum and undoes the row filters with numpy, by
anti-diagonals of many images at once. The feature is a perceptual hash: the
image averaged to 32 x 32, its lowest 8 x 8 cosine-transform coefficients
compared with their median.

Defined cases: a null text is empty; an empty one is 576 bytes of padding. A
repeated row gives a repeated result. Other columns pass by untouched.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import map_in_arrow, named

UNIT = 576
WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IDAT_BYTES = 1 << 20


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _predicted(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """What each of the five row filters predicts of samples (int16), stacked by filter type."""
    far = left + up - corner
    a, b, c = np.abs(far - left), np.abs(far - up), np.abs(far - corner)
    nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    return np.stack((np.zeros_like(left), left, up, (left + up) >> 1, nearest))


#: Rows whose filters are weighed at once.
_ROWS = 1 << 14


def png_write(samples: bytes, width: int = WIDTH, filter_type: int | None = None, level: int = 1) -> bytes:
    """An 8-bit greyscale PNG of the samples; each row takes the filter that leaves the least sum of
    absolute signed values, of equal ones the lowest, or all take filter_type (0 to 4)."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    out = np.empty((len(rows), width + 1), np.uint8)
    for at in range(0, len(rows), _ROWS):
        own = rows[at : at + _ROWS].astype(np.int16)
        above = np.zeros((len(own) + 1, width + 1), np.int16)
        above[1:, 1:] = own
        if at:
            above[0, 1:] = rows[at - 1]
        left = above[1:, :-1].copy()
        left[:, 0] = 0
        tried = (own - _predicted(left, above[:-1, 1:], above[:-1, :-1])).astype(np.uint8)
        if filter_type is None:
            kind = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64).argmin(axis=0)
        else:
            kind = np.full(len(own), filter_type)
        out[at : at + _ROWS, 0] = kind
        out[at : at + _ROWS, 1:] = np.take_along_axis(tried, kind[None, :, None], axis=0)[0]
    packed = zlib.compress(out.tobytes(), level)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def unfilter(images: list[np.ndarray]) -> list[np.ndarray]:
    """The samples of images of one width (rows of a filter type and filtered samples), all unfiltered side by side.

    A sample rests on those to its left, above and between. Skewed by a row for
    each column, all three lie in the two skewed rows before, so a step works
    on a whole anti-diagonal of every image at once.
    """
    width = images[0].shape[1] - 1
    order = np.argsort([-len(x) for x in images], kind="stable")  # the tall first: those still under way are always a prefix
    tall = [len(images[i]) for i in order]
    if max((x[:, 0].max(initial=0) for x in images), default=0) > 4:
        raise ValueError("unknown row filter")
    steps = tall[0] + width - 1
    raw = np.zeros((steps, len(images), width), np.uint8)
    kind = np.zeros((steps, len(images), width), np.uint8)
    columns = np.arange(width)
    for k, i in enumerate(order):
        at = np.arange(tall[k])[:, None] + columns
        raw[at, k, columns] = images[i][:, 1:]
        kind[at, k, columns] = images[i][:, :1]
    done = np.zeros((steps + 2, len(images), width + 1), np.int16)  # two empty rows before, an empty column left
    live = len(images)
    for d in range(steps):
        while d >= tall[live - 1] + width - 1:
            live -= 1
        one, two = done[d + 1, :live], done[d, :live]
        guess = _predicted(one[:, :-1], one[:, 1:], two[:, :-1])
        done[d + 2, :live, 1:] = (raw[d, :live] + np.take_along_axis(guess, kind[None, d, :live], axis=0)[0]) & 255
        if d >= width - 1:
            continue
        done[d + 2, :live, d + 2 :] = 0  # columns whose first row is still to come
    out: list = [None] * len(images)
    for k, i in enumerate(order):
        out[i] = done[np.arange(tall[k])[:, None] + columns + 2, k, columns + 1].astype(np.uint8)
    return out


def png_rows(data: bytes) -> np.ndarray:
    """The filtered rows of an 8-bit greyscale PNG, each behind its filter type; a wrong checksum, order, stream or size raises ValueError."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, head, ended = 8, [], None, False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("cut chunk")
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(data) < at + 12 + n or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR" and n == 13:
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale image")
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as e:
        raise ValueError("the compressed stream is broken") from e
    if raw.size != head[1] * (head[0] + 1):
        raise ValueError("size")
    return raw.reshape(head[1], head[0] + 1)


def png_read(data: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG, row by row."""
    return unfilter([png_rows(data)])[0]


_COS = np.cos(np.pi * np.arange(8)[:, None] * (2 * np.arange(32)[None, :] + 1) / 64)


def _averaged(rows: np.ndarray, n: int) -> np.ndarray:
    """Area average of the first axis to n rows."""
    total = np.zeros((len(rows) + 1, rows.shape[1]))
    np.cumsum(rows, axis=0, dtype=np.float64, out=total[1:])
    edge = np.arange(n + 1) * (len(rows) / n)
    low = np.minimum(edge.astype(np.int64), len(rows) - 1)
    at = total[low] + (edge - low)[:, None] * rows[low]
    return np.diff(at, axis=0) * (n / len(rows))


def cosine_hash(rows: np.ndarray) -> bytes:
    """64 bits in 8 bytes: the low coefficients above their median."""
    small = _averaged(_averaged(rows, 32).T, 32).T
    low = np.round(_COS @ small @ _COS.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    return data + b"\xff" * (max(UNIT, -(-n // UNIT) * UNIT) - n), n


FIELDS = {
    "n_bytes": T.LongType(), "payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType(),
    "media_sha256": T.StringType(), "feature": T.StringType(), "feature_bits": T.BinaryType(), "filters": T.StringType(),
}
#: Rows of images that are unfiltered side by side, padding included.
_TOGETHER = 1 << 14


def _together(tall: list[int]) -> Iterator[list[int]]:
    """Numbers of images of like height, at most _TOGETHER rows in all when padded to the tallest, or one."""
    part: list[int] = []
    for i in sorted(range(len(tall)), key=lambda i: -tall[i]):
        if part and (len(part) + 1) * tall[part[0]] > _TOGETHER:
            yield part
            part = []
        part.append(i)
    if part:
        yield part


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """docs with the fields above; keep_media adds the PNG itself as binary column media.

    feature_bits is the hash as 8 bytes, feature the same as hexadecimal digits;
    filters names the row filters (0 to 4) that the PNG uses.
    """
    names = [c for c in docs.columns if c not in FIELDS and c != "media"]
    docs = docs.select(*map(named, names))
    at = names.index("text")
    kept = [i for i, c in enumerate(names) if keep_media or c != "text"]
    made = [T.StructField(k, v) for k, v in FIELDS.items()] + ([T.StructField("media", T.BinaryType())] if keep_media else [])
    spec = T.StructType([docs.schema.fields[i] for i in kept] + made)
    arrow = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}

    def of(texts: list[str | None]) -> list[tuple]:
        stored, raw, size = [], [], []
        for t in texts:
            payload, n = payload_of(t)
            stored.append(png_write(payload))
            raw.append(png_rows(stored[-1]))
            size.append(n)
        out: list = [None] * len(texts)
        for part in _together([len(r) for r in raw]):
            for i, rows in zip(part, unfilter([raw[i] for i in part])):
                back, png, bits = rows.tobytes(), stored[i], cosine_hash(rows)
                used = "".join(map(str, np.unique(raw[i][:, 0])))
                out[i] = size[i], len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(png), hashlib.sha256(png).hexdigest(), bits.hex(), bits, used, png
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done, texts, held = [], [], 0
            for t in b.column(at):
                texts.append(t.as_py())
                held += len(texts[-1] or "")
                if held > 4_000_000 or len(texts) >= 512:  # bounds what is held at once
                    done += of(texts)
                    texts, held = [], 0
            done += of(texts)
            cols = list(zip(*done)) or [()] * (len(FIELDS) + 1)
            new = [pa.array(c, arrow[f.dataType]) for c, f in zip(cols, made)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), *new], spec.names)

    return map_in_arrow(docs, run, spec)


def digest(docs: DataFrame) -> DataFrame:
    return media_columns(docs.select("doc_id", "text"))
