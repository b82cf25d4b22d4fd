"""LM scoring: logistic context mixing of hashed-context bit predictors.

A text is the sequence of its lower-cased words and an end. The words that
training texts hold twice or more, at most VOCABULARY of them, the end and an
escape have a binary code (Huffman's), so a text is a sequence of bits, about
a dozen a word, each decided at a node of the code's tree. Five predictors of
a bit keep counts of zeros and ones: the node alone, and in hashed tables the
node with the word before, with the two words before, and with the last of the
COMMON commonest words; the fifth counts within the text, as far as it has come. Their log-odds are
combined by weights that a gate selects (how often the contexts were met),
learned online by gradient steps on every bit of all training texts, each
predicted without its own occurrence; the mixed probability is refined by an
adaptive map learned alongside. The score is the log10 probability of all bits
of a text, and of the words behind its escapes.

Such a word is one that the text had behind an escape before, or one that
training texts have (its count in a table of all words, which grows with the
input and stays distributed, less a discount), or a new one, spelled out: bit
by bit by a second mixer of the same kind, with the bytes before as contexts,
that learned from the distinct words behind escapes. These are shares that add
up to one, so the score is a probability of the whole text: each bit counts,
in its order, and no word is cheaper than its spelling allows.

The hashed tables grow with the training texts up to TABLE_BITS and are summed
over tasks. They and the code are broadcast: their size is bounded.

Defined cases: a null text is empty: one end token. A null doc_id counts as
empty text for the fold. Repeated rows are texts of their own. Other columns
pass unused. Without training rows every word is spelled by an even mixer.
"""

from __future__ import annotations

import copy
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, Written, held_out, meet, tidied

VOCABULARY = 1 << 18
#: Most slots, as powers of two, of the tables of the word before, the two before and the last common one.
TABLE_BITS = (21, 21, 20)
#: Slots of the speller's tables: of 1, 2 and 3 bytes before, and of the word so far.
SPELL_BITS = (16, 18, 20, 20)
DELTA = 0.3
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Distinct words held by a task before it hands on what it counted.
FLUSH_WORDS = 300_000
#: Words of a text after which its own counts start anew.
STRETCH = 1 << 16
#: Words, and bytes of spelling, whose bits are worked on at once.
_PIECE = 1 << 15
_LEVELS = 24
#: So many of the commonest words tell the language that a text is in at a place.
COMMON = 24
ESCAPE, END = 0, 1

#: One piece of work: texts and where the bits of each begin, the bits, their slots in each table, and log-odds that need no table.
Bits = tuple[tuple[np.ndarray, np.ndarray], np.ndarray, list[np.ndarray], list[np.ndarray]]


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words, then the end as an empty one."""
    out = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    out.append(b"")
    return out


def _mixed_hash(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)


# --- words as bits ----------------------------------------------------------


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, path): symbol s passes path[start[s] : start[s + 1]] from the root, each entry node * 2 + bit. At least two symbols."""
    n = len(counts)
    order = np.argsort(counts, kind="stable")
    weight = counts[order].tolist() + [0] * (n - 1)
    parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int64)
    leaf, inner = 0, n
    for made in range(n, 2 * n - 1):  # leaves and inner nodes are two queues in order of weight
        for bit in (0, 1):
            if leaf < n and (inner >= made or weight[leaf] <= weight[inner]):
                least, leaf = leaf, leaf + 1
            else:
                least, inner = inner, inner + 1
            weight[made] += weight[least]
            parent[least], side[least] = made, bit
    root = 2 * n - 2
    at, steps = np.empty(n, np.int64), []
    at[order] = np.arange(n)
    depth = np.zeros(n, np.int64)
    live = np.arange(n)
    while len(live):
        steps.append((live, (parent[at[live]] - n) * 2 + side[at[live]]))
        depth[live] += 1
        at[live] = parent[at[live]]
        live = live[at[live] != root]
    start = np.concatenate(([0], np.cumsum(depth)))
    path = np.empty(start[-1], np.int32)
    for k, (symbols, entry) in enumerate(steps):
        path[start[symbols + 1] - 1 - k] = entry
    return start, path


class Code:
    """Numbers and paths of the listed words, and sizes of the tables."""

    def __init__(self, words: list[bytes], counts: np.ndarray, escapes: int, ends: int, taught: int):
        self.number = dict(zip(words, range(2, len(words) + 2)))
        self.start, self.path = huffman(np.maximum(np.concatenate(([escapes, ends], counts)), 1).astype(np.int64))
        grown = max(10, int(taught).bit_length() + 1)
        self.bits = tuple(min(b, grown) for b in TABLE_BITS)
        self.sizes = [len(words) + 1, *(1 << b for b in self.bits)]

    def without_words(self) -> Code:
        """The same for tasks that see numbers only: it takes a fraction of the memory."""
        out = copy.copy(self)
        out.number = {}
        return out

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Symbols of a text's words, the end last."""
        out = np.fromiter(map(self.number.get, words, repeat(ESCAPE)), np.int32, len(words))
        out[-1] = END
        return out

    def pieces(self, texts: list[np.ndarray]) -> Iterator[Bits]:
        """Bits of texts (numbers), in order, some stretches at a time."""
        symbol = np.concatenate(texts)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(size) - size
        of = np.repeat(np.arange(len(texts)), size)
        inside = np.arange(len(symbol)) - first[of]
        # before a text come ends
        before = np.where(inside >= 1, symbol[np.maximum(np.arange(len(symbol)) - 1, 0)], END).astype(np.uint32)
        second = np.where(inside >= 2, symbol[np.maximum(np.arange(len(symbol)) - 2, 0)], END).astype(np.uint32)
        one = _mixed_hash((before + np.uint32(1)) * np.uint32(0x9E3779B1))
        two = _mixed_hash((one ^ (second + np.uint32(7)) * np.uint32(0x85EBCA77)) * np.uint32(0x2C1B3C6D))
        # the last word of the few commonest, which tells the language
        common = np.where((before > END) & (before < END + 1 + COMMON), np.arange(len(symbol)), -1)
        common = np.maximum(np.maximum.accumulate(common), first[of])
        last = _mixed_hash((before[common] + np.uint32(3)) * np.uint32(0xC2B2AE3D))
        deep = (self.start[1:] - self.start[:-1])[symbol]
        edges = np.flatnonzero((inside & (STRETCH - 1)) == 0)
        ends = np.append(edges[1:], len(symbol))
        at = k = 0
        while at < len(symbol):
            k = max(int(np.searchsorted(ends, at + _PIECE, "right")) - 1, k)  # whole stretches, at least one
            to = int(ends[k])
            d = deep[at:to]
            end = np.cumsum(d)
            begin = end - d
            entry = self.path[np.repeat(self.start[symbol[at:to]] - begin, d) + np.arange(end[-1])]
            node, bit = entry >> 1, entry & 1
            salt = node.astype(np.uint32) * np.uint32(0x27D4EB2F)
            slots = [node.astype(np.intp)]
            for h, b in zip((one, two, last), self.bits):
                slots.append(((np.repeat(h[at:to], d) + salt) * np.uint32(0x9E3779B1) >> np.uint32(32 - b)).astype(np.intp))
            own = edges[(edges >= at) & (edges < to)]
            heads = begin[own - at]
            new = np.concatenate(([True], np.diff(of[own]) > 0))
            yield (of[own[new]], heads[new]), bit, slots, [_so_far(node, np.repeat(np.arange(len(own), dtype=np.int32), np.diff(np.append(heads, end[-1]))), bit)]
            at, k = to, k + 1


def _so_far(node: np.ndarray, stretch: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Log-odds of each bit from the bits before it at its node and in its stretch; stretches come one after the other."""
    # by node in order of place, which keeps stretches in order: two passes over 16 bits each
    order = np.argsort((node & 0xFFFF).astype(np.uint16), kind="stable")
    if len(node) and node.max() > 0xFFFF:
        order = order[np.argsort((node >> 16)[order].astype(np.uint16), kind="stable")]
    k, t, b = node[order], stretch[order], bit[order].astype(np.int32)
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (t[1:] != t[:-1])))
    first = np.flatnonzero(new)
    first = np.repeat(first, np.diff(np.append(first, len(k))))
    ones = np.cumsum(b, dtype=np.int32) - b
    ones -= ones[first]
    zeros = np.arange(len(k)) - first - ones
    out = np.empty(len(k), np.float32)
    out[order] = _LOGS[np.minimum(ones, len(_LOGS) - 1)] - _LOGS[np.minimum(zeros, len(_LOGS) - 1)]
    return out


#: Logarithms of counts within a stretch, which has fewer words than this.
_LOGS = np.log(np.arange(1 << 17, dtype=np.float32) + np.float32(0.4))


# --- spelling as bits -------------------------------------------------------

_M = 0x9E3779B97F4A7C15
_BYTE, _K = np.arange(256, dtype=np.uint32)[:, None], np.arange(4, dtype=np.uint32)
_BITS = (_BYTE >> (np.uint32(7) - np.arange(8, dtype=np.uint32))) & np.uint32(1)
_HIGH = (np.uint32(1) << _K) | ((_BYTE >> np.uint32(4)) >> (np.uint32(4) - _K))
_LOW = (np.uint32(1) << _K) | ((_BYTE & np.uint32(15)) >> (np.uint32(4) - _K))


def _row(h: np.ndarray, bits: int) -> np.ndarray:
    """First of the 16 slots that a half byte's nodes have in a table."""
    return (_mixed_hash(h) >> np.uint32(36 - bits)) << np.uint32(4)


def _prefixes(x: np.ndarray, begin: np.ndarray, own: int) -> tuple[np.ndarray, int]:
    """Hash of the word before each byte of x, which begins anew at begin, and at the end of x; own: of the word that x goes on with."""
    one = np.ones(1, np.uint64)
    power = np.cumprod(np.concatenate((one, np.full(len(x), _M, np.uint64))))
    back = np.cumprod(np.concatenate((one, np.full(len(x), pow(_M, -1, 1 << 64), np.uint64))))
    q = np.cumsum(np.concatenate((one * np.uint64(own), x.astype(np.uint64) + np.uint64(1))) * back)
    last = np.searchsorted(begin, np.arange(len(x) + 1), "right") - 1  # before the first new word goes on the one under way
    gone = np.where(last >= 0, q[begin[np.maximum(last, 0)]], np.uint64(0)) if len(begin) else np.uint64(0)
    h = power * (q - gone)
    return ((h[:-1] ^ (h[:-1] >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(32)).astype(np.uint32), int(h[-1])


def spelled(words: list[bytes]) -> Iterator[Bits]:
    """Bits of the bytes of words, a space closing each; contexts don't reach beyond the word."""
    x = np.frombuffer(b" ".join([*words, b""]), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, own = np.concatenate(([0], ends[:-1])), 0
    for at in range(0, len(x), _PIECE):
        part = x[at : at + _PIECE]
        position = np.arange(at, at + len(part))
        of = np.searchsorted(ends, position, "right")
        inside = position - starts[of]
        hashes = []
        for order in (1, 2, 3):
            h = np.full(len(part), order, np.uint32)
            for back in range(order, 0, -1):
                b = x[np.maximum(position - back, 0)].astype(np.uint32)
                b[inside < back] = 0
                h = h * np.uint32(0x2C1B3C6D) + b + np.uint32(1)
            hashes.append(h)
        whole, own = _prefixes(part, np.flatnonzero(inside == 0), own)
        slots = []
        for h, bits in zip([*hashes, whole], SPELL_BITS):
            low = h + ((part >> 4).astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
            slots.append(np.concatenate((_row(h, bits)[:, None] + _HIGH[part], _row(low, bits)[:, None] + _LOW[part]), axis=1).ravel().astype(np.intp))
        heads = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        yield (of[heads], heads * 8), _BITS[part].ravel().astype(np.int32), slots, []


# --- mixing -----------------------------------------------------------------

_EDGES, _FEW = np.array([1, 2, 4, 10, 30], np.float32), np.array([1, 3, 10], np.float32)
SETS = (len(_EDGES) + 1) * (len(_FEW) + 1)


class Mixer:
    """Tables of counts, weights by gate, and the adaptive map. gate: the two tables whose counts select the weights; more: inputs without a table."""

    def __init__(self, tables: list[np.ndarray], gate: tuple[int, int], more: int = 0):
        self.counts, self.gate = [t.reshape(-1, 2) for t in tables], gate
        self.inputs = len(tables) + more + 1
        self.weights = np.full((SETS, self.inputs), 1.0 / (self.inputs - 1), np.float32)
        self.weights[:, -1] = 0
        self.steps = np.ones((SETS, self.inputs), np.float32)
        p = 1 / (1 + np.exp(-((np.arange(_LEVELS) + 0.5) / _LEVELS * 24 - 12)))
        self.map = np.tile(np.stack([1 - p, p], axis=1) * 40, (SETS, 1, 1))
        self.seen = 0
        self._made: dict[bool, tuple] = {}

    def _views(self, without: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """By slot and bit: log-odds of all counts, or of those without one such bit; and the gates' parts."""
        odds, met = [], [np.zeros(0, np.uint8)] * 2
        for j, t in enumerate(self.counts):
            n = t.astype(np.float32)
            both = np.empty_like(n)
            for bit in (0, 1):
                one, zero = (np.maximum(n[:, 1] - bit, 0), np.maximum(n[:, 0] - (1 - bit), 0)) if without else (n[:, 1], n[:, 0])
                both[:, bit] = np.log((one + np.float32(DELTA)) / (zero + np.float32(DELTA)))
            odds.append(both.ravel() if without else both[:, 0].copy())
            if j in self.gate:
                edges, step = ((_EDGES, len(_FEW) + 1), (_FEW, 1))[self.gate.index(j)]
                met[self.gate.index(j)] = (np.searchsorted(edges, n.sum(axis=1) - without, side="right") * step).astype(np.uint8)
        return odds, met

    def _inputs(self, bit: np.ndarray, slots: list[np.ndarray], more: list[np.ndarray], without: bool) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of each input and the gate; without: the tables hold these very bits, and each is taken out."""
        if without not in self._made:
            self._made[without] = self._views(without)
        odds, met = self._made[without]
        st = np.empty((self.inputs, len(bit)), np.float32)
        for j, s in enumerate(slots):
            np.take(odds[j], 2 * s + bit if without else s, out=st[j], mode="wrap")
        for j, x in enumerate(more, len(slots)):
            st[j] = x
        st[-1] = 0.3
        return st, (met[0][slots[self.gate[0]]] + met[1][slots[self.gate[1]]]).astype(np.intp)

    def _dot(self, st: np.ndarray, gate: np.ndarray) -> np.ndarray:
        dot = np.zeros(len(gate), np.float32)
        for x, w in zip(st, self.weights.T.copy()):
            dot += x * w.take(gate)
        return np.clip(dot, -11.99, 11.99, out=dot)

    def learn(self, pieces: Iterator[Bits], rate: float = 0.7, chunk: int = 1 << 15) -> None:
        for _, bits, slots, more in pieces:
            for at in range(0, len(bits), chunk):
                part = slice(at, at + chunk)
                b = bits[part]
                st, gate = self._inputs(b, [s[part] for s in slots], [m[part] for m in more], True)
                dot = self._dot(st, gate)
                err = b - 1 / (1 + np.exp(-dot))
                n = np.maximum(np.bincount(gate, minlength=SETS), 1)[:, None]
                g = np.stack([np.bincount(gate, err * x, SETS) for x in st], axis=1) / n
                self.steps += g * g * 100
                self.weights += (rate * g / np.sqrt(self.steps)).astype(np.float32)
                level = ((dot + 12) * np.float32(_LEVELS / 24)).astype(np.int32)
                self.map += np.bincount((gate * _LEVELS + level) * 2 + b, minlength=self.map.size).reshape(self.map.shape)
                self.seen += len(b)

    def log10(self, pieces: Iterator[Bits], n: int) -> np.ndarray:
        """log10 probability of the bits of each of n texts."""
        out = np.zeros(n)
        refined = np.log(self.map[:, :, 1] / self.map[:, :, 0]).ravel().astype(np.float32)
        for of, bit, slots, more in pieces:
            st, gate = self._inputs(bit, slots, more, False)
            dot = self._dot(st, gate)
            dot += refined[gate * _LEVELS + ((dot + 12) * np.float32(_LEVELS / 24)).astype(np.int32)]
            # log(1 + e^x) of the bits that came; x is within 20, so it neither overflows nor vanishes
            lost = np.log1p(np.exp(dot * (np.float32(0.5) - bit.astype(np.float32))))
            np.subtract.at(out, of[0], np.add.reduceat(lost, of[1], dtype=np.float64))
        return out / np.log(10)


#: What reads a batch: lists of whose bits are worked on together.
Reader = Callable[[pa.RecordBatch], Iterator[Iterator[Bits]]]


#: Rows of a batch that are worked on, and handed on, at once.
_ROWS = 1024


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches in parts of few rows, so that what Python makes of one is bounded by these."""
    for b in batches:
        for at in range(0, b.num_rows, _ROWS):
            yield b.slice(at, _ROWS)


def _added(table: np.ndarray) -> list[np.ndarray]:
    """Parts in which a table is summed, of at most 64 Ki counts."""
    return np.array_split(table, max(1, len(table) >> 16))


def fit_mixer(taught: DataFrame, reader: Reader, sizes: list[int], gate: tuple[int, int], more: int = 0) -> Fitted:
    """A mixer of what reader makes of taught. Tables and gradients of every task are summed by the executors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, some = [np.zeros(2 * n, np.uint32) for n in sizes], False
        for b in batches:
            for pieces in reader(b):
                for _, bit, slots, _more in pieces:
                    some = True
                    for table, s in zip(tables, slots):
                        np.add.at(table, 2 * s + bit, np.uint32(1))
        if some:
            rows = [(j, i, zlib.compress(c.tobytes(), 1)) for j, t in enumerate(tables) for i, c in enumerate(_added(t))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["j", "i", "data"])

    def total(key, g):
        added = sum(np.frombuffer(zlib.decompress(d.as_py()), np.uint32).astype(np.uint64) for d in g.column("data"))
        data = zlib.compress(np.minimum(added, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)
        return pa.table({"j": [key[0].as_py()], "i": [key[1].as_py()], "data": pa.array([data], pa.binary())})

    spec = "j bigint, i bigint, data binary"
    got = taught.mapInArrow(tidied(count), spec).groupBy("j", "i").applyInArrow(total, spec).toArrow()  # as many rows and bytes as the tables have, whatever the input
    found = {(j, i): np.frombuffer(zlib.decompress(d), np.uint32) for j, i, d in zip(*(c.to_pylist() for c in got.columns))}
    empty = [np.zeros(2 * n, np.uint32) for n in sizes]
    tables = [np.concatenate([found[j, i] for i in range(len(_added(t)))]) if found else t for j, t in enumerate(empty)]
    shared = taught.sparkSession.sparkContext.broadcast(tables)
    model = Fitted(shared, gate, more)
    if not found:
        return model

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Mixer(shared.value, gate, more)
        start = own.map.copy()
        for b in batches:
            for pieces in reader(b):
                own.learn(pieces)
        if own.seen:
            yield pa.RecordBatch.from_arrays([pa.array([float(own.seen)]), pa.array([own.weights.astype(float).ravel().tolist()]), pa.array([(own.map - start).ravel().tolist()])], ["n", "w", "m"])

    # one row a task, summed by the executors
    each = taught.mapInArrow(tidied(learn), "n double, w array<double>, m array<double>")
    named = each.selectExpr("n", "posexplode(concat(transform(w, x -> x * n), m)) AS (at, x)").groupBy("at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    flat = sorted((r["at"], r["x"], r["n"]) for r in named.collect())  # one row for each weight and cell of the map
    x = np.array([v for _, v, _ in flat])
    model.weights = x[: len(x) - SETS * _LEVELS * 2] / flat[0][2]
    model.map = x[len(x) - SETS * _LEVELS * 2 :]
    return model


class Fitted:
    """What a worker makes its mixer of: the broadcast tables, and the weights and map that were learned, if any were."""

    def __init__(self, tables, gate: tuple[int, int], more: int):
        self.tables, self.gate, self.more, self.weights, self.map = tables, gate, more, None, None

    def mixer(self) -> Mixer:
        out = Mixer(self.tables.value, self.gate, self.more)
        if self.weights is not None:
            out.weights = self.weights.reshape(out.weights.shape).astype(np.float32)
            out.map += self.map.reshape(out.map.shape)
        return out


# --- whole texts ------------------------------------------------------------


def word_table(docs: DataFrame) -> DataFrame:
    """(token, c, n): counts of every word over training texts, and over all.

    docs: learn, text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, Counter] = {True: Counter(), False: Counter()}

        def rows():
            for learn, c in held.items():
                n = pa.array(list(c.values()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), n if learn else pa.array([0] * len(c), pa.int64()), n], ["token", "c", "n"])
                c.clear()

        for b in batches:
            for learn, text in zip(b.column(0).to_pylist(), b.column(1)):
                held[learn].update(tokens(text.as_py()))
                if len(held[learn]) > FLUSH_WORDS:
                    yield from rows()
        yield from rows()

    return docs.select("learn", "text").mapInArrow(tidied(run), "token binary, c bigint, n bigint").groupBy("token").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def encoded(docs: DataFrame, code) -> DataFrame:
    """(uid, doc_id, learn, n_bytes, symbols, behind): each text as numbers, 4 bytes each, and its words behind escapes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for b in _slices(batches):
            size, symbols, behind = [], [], []
            for text in b.column(2):
                words = tokens(text.as_py())
                s = code.value.numbers(words)
                size.append(sum(map(len, words)) + len(words))
                symbols.append(s.astype("<i4").tobytes())
                behind.append([words[i] for i in np.flatnonzero(s == ESCAPE).tolist()])
            ids = pa.array(range(uid, uid + len(size)), pa.int64())
            uid += len(size)
            yield pa.RecordBatch.from_arrays([ids, b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(symbols, pa.binary()), pa.array(behind, pa.list_(pa.binary()))], ["uid", "doc_id", "learn", "n_bytes", "symbols", "behind"])

    return docs.select("doc_id", "learn", "text").mapInArrow(tidied(run), "uid bigint, doc_id bigint, learn boolean, n_bytes bigint, symbols binary, behind array<binary>")


def _some(b: pa.RecordBatch, column: int) -> Iterator[list[np.ndarray]]:
    """Texts of a column of symbols, some at a time."""
    part, held = [], 0
    for t in b.column(column):
        part.append(np.frombuffer(t.as_py(), "<i4"))
        held += len(part[-1])
        if held >= _PIECE:
            yield part
            part, held = [], 0
    if part:
        yield part


def listed_words(words: DataFrame) -> tuple[Column, DataFrame]:
    """(condition, words under it): the commonest of the words met twice or more, as many as fit in VOCABULARY by their histogram."""
    level = F.floor(F.log2(F.greatest("c", F.lit(1))) * 8).cast("int")
    left, cut = VOCABULARY, None
    for r in words.where("c > 1 AND token <> X''").groupBy(level.alias("k")).count().orderBy(F.desc("k")).collect():  # at most 8 rows for each bit of a count
        if r["count"] > left:
            break
        left, cut = left - r["count"], r["k"]
    common = (F.col("c") > 1) & (F.col("token") != F.lit(b"")) & (level >= cut) if cut is not None else F.lit(False)
    return common, words.where(common)


def lm_scores(docs: DataFrame, learn: Column | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row; learn says which rows teach."""
    spark = docs.sparkSession
    learn = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("bigint"), "text", learn.alias("learn"))
    words = Written(word_table(docs)).df
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    base = F.log10((F.col("c") + 0.5) / (n + 0.5 * (v + 1)))
    common, found = listed_words(words)
    found = found.select("token", "c").toArrow()  # at most VOCABULARY rows, as the histogram proves
    names, counts = found["token"].to_pylist(), np.asarray(found["c"].to_pylist(), np.int64)
    order = sorted(range(len(names)), key=lambda i: (-counts[i], names[i]))
    names, counts = [names[i] for i in order], counts[order]
    ends = words.where("token = X''").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    whole = Code(names, counts, n - ends - int(counts.sum()), ends, n)
    listed = spark.sparkContext.broadcast(whole)
    texts = Written(encoded(docs, listed)).df
    listed.destroy()
    code = spark.sparkContext.broadcast(whole.without_words())
    del whole
    taught = texts.where("learn").select("symbols")

    def read_texts(b: pa.RecordBatch) -> Iterator[Iterator[Bits]]:
        for part in _some(b, 0):
            yield code.value.pieces(part)

    model = fit_mixer(taught, read_texts, code.value.sizes, (1, 2), 1)

    # words behind escapes
    rare = words.where(~common & (F.col("token") != F.lit(b"")))
    r = rare.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("n1")).first()
    n2 = words.where("c = 2").count()
    discount = r["n1"] / (r["n1"] + 2 * n2) if r["n1"] and n2 else 0.5

    def read_words(b: pa.RecordBatch) -> Iterator[Iterator[Bits]]:
        w = b.column(0).to_pylist()
        for at in range(0, len(w), 4096):
            yield spelled(w[at : at + 4096])

    speller = fit_mixer(rare.where("c > 0").select("token"), read_words, [1 << b for b in SPELL_BITS], (3, 2))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = speller.mixer()
        for b in batches:
            w = b.column(0).to_pylist()
            c = b.column(1).to_numpy(zero_copy_only=False).astype(float)
            new = np.flatnonzero(c == 0)
            out = np.log10(np.maximum(c - discount, 1e-9) / max(r["n"], 1))
            for at in range(0, len(new), 4096):
                part = new[at : at + 4096]
                out[part] = own.log10(spelled([w[i] for i in part]), len(part))
            if r["n"]:
                out[new] += np.log10(discount * r["v"] / r["n"])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out)], ["token", "c", "n", "inner"])

    rare = Written(rare.mapInArrow(tidied(spell), "token binary, c bigint, n bigint, inner double")).df
    speller.tables.destroy()
    # how often a word behind an escape, the first of each training text aside, is one that the text had before
    seen = texts.where("learn").agg(F.sum(F.greatest(F.size("behind") - 1, F.lit(0))), F.sum(F.size("behind") - F.size(F.array_distinct("behind")))).first()
    again = ((seen[1] or 0) + 1) / ((seen[0] or 0) + 2)
    values = np.concatenate(([0.0], np.log10((np.concatenate(([ends], counts)) + 0.5) / (n + 0.5 * (v + 1)))))
    values = spark.sparkContext.broadcast(values)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, new_word = model.mixer(), math.log10(1 - again)
        for b in _slices(batches):
            score, base, size, known = [], [], [], []
            for part in _some(b, 2):
                score += mixer.log10(code.value.pieces(part), len(part)).tolist()
                every, own = np.concatenate(part), [len(s) for s in part]
                heads = np.cumsum(own) - own
                base += np.add.reduceat(values.value[every], heads).tolist()
                size += own
                known += np.add.reduceat((every != ESCAPE).astype(np.int64), heads).tolist()
            rows: list = [[], [], []]  # uid, token, times
            for i, (uid, behind) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist())):
                times: dict[bytes, int] = {}
                for k, w in enumerate(behind):
                    had = times.get(w, 0)
                    times[w] = had + 1
                    if k:
                        score[i] += math.log10(again * had / k) if had else new_word
                rows[0] += [uid] * len(times)
                rows[1] += times.keys()
                rows[2] += times.values()
            m = len(rows[0])
            own = [b.column(1).to_pylist(), size, known, base, score, b.column(4).to_pylist()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.column(0).to_pylist() + rows[0], pa.int64()), pa.array([None] * len(score) + rows[1], pa.binary()), pa.array([0] * len(score) + rows[2], pa.int64()), *(pa.array(y + [None] * m, t) for y, t in zip(own, kinds))],
                ["uid", "token", "times", "doc_id", "n_tokens", "own_known", "own_base", "own_score", "n_bytes"],
            )

    spec = "uid bigint, token binary, times bigint, doc_id bigint, n_tokens bigint, own_known bigint, own_base double, own_score double, n_bytes bigint"
    rows = Written(texts.select("uid", "doc_id", "symbols", "behind", "n_bytes").mapInArrow(tidied(score), spec)).df
    for shared in (code, values, model.tables):  # what follows reads written tables only
        shared.destroy()
    met = meet(rows.where("token IS NOT NULL").select("uid", "token", "times"), rare.withColumn("base", base), "token", rows.count())
    per = met.groupBy("uid").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(F.col("times") * F.col("base")).alias("base"), F.sum("inner").alias("inner"))
    per = rows.where("token IS NULL").drop("token", "times").join(per, "uid", "left").na.fill(0, ["known", "base", "inner"])
    score_ = F.col("own_score") + F.col("inner")
    return per.select(
        "doc_id", "n_tokens", (F.col("own_known") + F.col("known")).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("own_base") + F.col("base")).alias("base_score"), score_.alias("score"), (-score_ * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def digest(docs: DataFrame) -> DataFrame:
    test = held_out(F.col("doc_id"), 5, 1)
    return lm_scores(docs, ~test).withColumn("held_out", test)
