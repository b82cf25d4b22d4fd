"""Block gzip and its position indexes: blocks found from any byte, written from any task, and looked up by region.

A block-gzip file is a row of small gzip members that each say how long they
are. A virtual offset names a byte of it: the member's offset shifted by 16
bits, plus the place in what the member holds. An index has, for each
reference, bins of five sizes with the ranges of virtual offsets (chunks) of
what lies in them, and for each stretch of 16 kb the least offset of anything
that reaches into it.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow.fs

#: Bytes that one member holds at most before compression.
MEMBER = 65_280
#: Smallest bin's bits, and levels of bins below the whole. Fixed values.
MIN_SHIFT, DEPTH = 14, 5
#: A bin number that stands for counts instead of places. Fixed value.
_COUNTS = 37450


def located(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Arrow's file system of a path or address, and the path on it."""
    if ":/" not in uri:
        return pyarrow.fs.LocalFileSystem(), uri
    scheme, _, rest = uri.partition(":/")
    return pyarrow.fs.FileSystem.from_uri(f"{scheme}:///{rest.lstrip('/')}" if scheme == "file" else uri)


def opened(uri: str) -> tuple[BinaryIO, int]:
    """A file that can be read from any place, wherever Arrow's file systems reach, and its size."""
    fs, path = located(uri)
    f = fs.open_input_file(path)
    return f, f.size()


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member that says its own length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


#: The empty member that ends a file.
END = member(b"")


def member_size(head: bytes, at: int = 0) -> int | None:
    """Bytes of the member that begins at `at`, None if none does."""
    if head[at : at + 4] != b"\x1f\x8b\x08\x04" or len(head) < at + 12:
        return None
    (extra,) = struct.unpack_from("<H", head, at + 10)
    k, end = at + 12, at + 12 + extra
    while k + 4 <= min(end, len(head)):
        (n,) = struct.unpack_from("<H", head, k + 2)
        if head[k : k + 2] == b"BC" and n == 2 and k + 6 <= len(head):
            return struct.unpack_from("<H", head, k + 4)[0] + 1
        k += 4 + n
    return None


def members(f: BinaryIO, offset: int, ahead: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the members from the one that begins at offset on; reads `ahead` bytes at a time."""
    f.seek(offset)
    held, at = b"", 0
    while True:
        n = member_size(held, at)
        if n is None or len(held) < at + n:
            more = f.read(ahead)
            if not more:
                if n is not None or held[at:]:
                    raise ValueError(f"block gzip breaks off at byte {offset + at}")
                return
            held, offset, at = held[at:] + more, offset + at, 0
            if member_size(held) is None and len(held) >= 1 << 16:
                raise ValueError(f"no block gzip at byte {offset}")
            continue
        yield offset + at, zlib.decompress(held[at : at + n], 31)
        at += n


def first_member(f: BinaryIO, offset: int, size: int) -> int:
    """Offset of the first member that begins at or after a byte: its header is followed by another, or by the file's end."""
    at = offset
    while at < size:
        f.seek(at)
        held = f.read(3 << 16)
        k = held.find(b"\x1f\x8b\x08\x04")
        while k >= 0:
            n = member_size(held, k)
            if n and (at + k + n == size or len(held) > k + n and member_size(held, k + n)):
                return at + k
            k = held.find(b"\x1f\x8b\x08\x04", k + 1)
        at += max(len(held) - (1 << 16) - 32, 1)
    return size


class Writer:
    """Writes block gzip and knows the virtual offset of what comes next."""

    def __init__(self, f: BinaryIO, level: int = 6):
        self.f, self.level, self.offset, self.held = f, level, 0, bytearray()

    def tell(self) -> int:
        return self.offset << 16 | len(self.held)

    def write(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= MEMBER:
            self._out(MEMBER)

    def _out(self, n: int) -> None:
        made = member(bytes(self.held[:n]), self.level)
        del self.held[:n]
        self.f.write(made)
        self.offset += len(made)

    def close(self) -> None:
        if self.held:
            self._out(len(self.held))
        self.f.write(END)


def bin_of(start: int, end: int) -> int:
    """The smallest bin that holds [start, end)."""
    end = max(end, start + 1) - 1
    shift, first = MIN_SHIFT, ((1 << DEPTH * 3) - 1) // 7
    for level in range(DEPTH, 0, -1):
        if start >> shift == end >> shift:
            return first + (start >> shift)
        shift += 3
        first -= 1 << (level - 1) * 3
    return 0


def bins_over(start: int, end: int) -> set[int]:
    """Every bin that something over [start, end) can be in."""
    found, first = set(), 0
    for level in range(DEPTH + 1):
        shift = MIN_SHIFT + (DEPTH - level) * 3
        found.update(range(first + (start >> shift), first + (max(end, start + 1) - 1 >> shift) + 1))
        first += 1 << level * 3
    return found


def joined(chunks: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of virtual offsets in order; those that meet in a member are one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(chunks):
        if out and low >> 16 <= out[-1][1] >> 16:
            out[-1] = out[-1][0], max(out[-1][1], high)
        else:
            out.append((low, high))
    return out


class Index:
    """Bins and stretches of each reference: built while sorted rows are written, or read from a file."""

    def __init__(self) -> None:
        self.bins: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        self.stretches: dict[int, dict[int, int]] = defaultdict(dict)
        self.names: list[str] = []

    def add(self, reference: int, start: int, end: int, low: int, high: int) -> None:
        chunks = self.bins[reference][bin_of(start, end)]
        if chunks and chunks[-1][1] >> 16 == low >> 16:
            chunks[-1] = chunks[-1][0], high
        else:
            chunks.append((low, high))
        for k in range(start >> MIN_SHIFT, (max(end, start + 1) - 1 >> MIN_SHIFT) + 1):
            self.stretches[reference].setdefault(k, low)

    def chunks(self, reference: int, start: int, end: int) -> list[tuple[int, int]]:
        """Ranges of virtual offsets that hold all that overlaps [start, end)."""
        stretches = self.stretches.get(reference, {})
        # a stretch that nothing reaches into has no offset; the one before it bounds what begins later
        least = max((v for k, v in stretches.items() if k <= start >> MIN_SHIFT), default=0)
        over, bins = bins_over(start, end), self.bins.get(reference, {})
        return joined((low, high) for b in over & bins.keys() for low, high in bins[b] if high > least)

    def _body(self, n: int) -> bytes:
        out = []
        for r in range(n):
            bins, stretches = self.bins.get(r, {}), self.stretches.get(r, {})
            out.append(struct.pack("<i", len(bins)))
            for b, chunks in sorted(bins.items()):
                out.append(struct.pack("<Ii", b, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
            last, offsets = 0, []
            for k in range(max(stretches, default=-1) + 1):
                last = stretches.get(k, last)
                offsets.append(last)
            out.append(struct.pack(f"<i{len(offsets)}Q", len(offsets), *offsets))
        return b"".join(out)

    def alignment_bytes(self, n: int) -> bytes:
        """The index of an alignment file of n references."""
        return b"BAI\1" + struct.pack("<i", n) + self._body(n)

    def table_bytes(self, columns: tuple[int, int, int] = (1, 2, 3), comment: str = "#", skip: int = 0, zero_based: bool = True) -> bytes:
        """The index of a table of lines: columns of name, start and end; itself block gzip."""
        names = b"".join(n.encode() + b"\0" for n in self.names)
        head = b"TBI\1" + struct.pack("<8i", len(self.names), 0x10000 if zero_based else 0, *columns, ord(comment), skip, len(names))
        raw = head + names + self._body(len(self.names))
        return b"".join(member(raw[i : i + MEMBER]) for i in range(0, len(raw), MEMBER)) + END

    @classmethod
    def read(cls, uri: str) -> Index:
        """An index file of alignments (plain) or of a table of lines (block gzip)."""
        f, _ = opened(uri)
        with f:
            head = f.read(4)
            raw = b"".join(x for _, x in members(f, 0)) if head[:2] == b"\x1f\x8b" else head + f.read()
        self, (n,) = cls(), struct.unpack_from("<i", raw, 4)
        at = 8
        if raw[:4] == b"TBI\1":
            (names,) = struct.unpack_from("<i", raw, 32)
            self.names = [x.decode() for x in raw[36 : 36 + names].split(b"\0")[:-1]]
            at = 36 + names
        elif raw[:4] != b"BAI\1":
            raise ValueError(f"{uri} is no index of a known kind")
        for r in range(n):
            (n_bins,) = struct.unpack_from("<i", raw, at)
            at += 4
            for _ in range(n_bins):
                b, k = struct.unpack_from("<Ii", raw, at)
                v = struct.unpack_from(f"<{2 * k}Q", raw, at + 8)
                at += 8 + 16 * k
                if b != _COUNTS:
                    self.bins[r][b] = list(zip(v[::2], v[1::2]))
            (k,) = struct.unpack_from("<i", raw, at)
            self.stretches[r] = {i: v for i, v in enumerate(struct.unpack_from(f"<{k}Q", raw, at + 4)) if v}
            at += 4 + 8 * k
        return self
