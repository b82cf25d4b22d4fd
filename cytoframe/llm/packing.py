"""Best-fit packing: bounded-space online best-fit into token sequences.

Texts become ids with a public byte-level vocabulary; only documents longer
than a sequence are cut, the first piece taking the odd rest. Pieces are dealt
to groups by hash, and each group is packed on its own by an online best-fit
in the order of arrival: it never looks ahead or sorts by length. At most
`open_bins` bins are open, in a bitset keyed by free space: the fullest bin
that a piece fits takes it, and where a new bin would be one too many the
fullest closes. A group holds about `group_pieces` lengths, whatever the size
of the input, so a task's memory is bounded and no bin waits for another task.

Defined cases: a null text is empty and is the single end id. Repeated rows are
packed each on their own. Other columns are not needed and stay out of the result.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Written, give_back

SEQUENCE = 2048
GROUP_PIECES = 65_536
OPEN_BINS = 64
CACHE_WORDS = 600_000
#: A space with white space beside it: there the cut before a space is not a token's edge.
_LOOSE = re.compile(r" \s|\s ")


#: Words that are encoded as one text.
_RUN = 20_000


class _Words(dict):
    """Ids of words, for about `most` of them at a time; the new words of some texts are encoded together.

    A key is a word after a space, or, behind a NUL, a part with no space before
    it; a word with marks is made of entries of its own.
    """

    def __init__(self, tok):
        self.tok, self.most = tok, CACHE_WORDS
        vocabulary = tok.get_vocab()
        self.heads = {}
        for mark, first in ((" ", "\u0120"), ("\n", "\u010a")):  # as byte-level vocabularies write a space and a line break
            self.heads[mark] = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
            self.heads[mark][[i for t, i in vocabulary.items() if t[:1] == first]] = True

    @staticmethod
    def _parts(key: str) -> list[str]:
        bare = key[:1] == "\0"
        first, *rest = _cut(key[1:] if bare else " " + key)
        return ["\0" + first if bare else first[1:], *("\0" + p for p in rest)]

    def __missing__(self, key: str) -> bytes:
        parts = self._parts(key)
        if len(parts) == 1:
            found = _pack_ids(self.tok.encode(key[1:] if key[:1] == "\0" else " " + key, add_special_tokens=False).ids)
        else:
            found = b"".join([self[p] for p in parts])
        self[key] = found
        return found

    def of(self, texts: list[list[str]]) -> Iterator[bytes]:
        """Ids of texts, given as their words."""
        had = [list(map(self.get, t)) for t in texts]
        new = {w for t, ids in zip(texts, had) if None in ids for w, x in zip(t, ids) if x is None}
        if len(self) + len(new) > self.most:  # too many: of the others only those of these texts stay
            stay = {w: x for t, ids in zip(texts, had) for w, x in zip(t, ids) if x is not None}
            self.clear()
            self.update(stay)
        self._learn(new)
        for t, ids in zip(texts, had):
            yield b"".join([self[w] if x is None else x for w, x in zip(t, ids)] if None in ids else ids)

    def _learn(self, new: set[str]) -> None:
        plain, bare, made = {w for w in new if w.isalpha()}, set(), []
        for w in new - plain:
            parts = self._parts(w)
            if len(parts) > 1:
                made.append((w, parts))
            for p in parts:
                if p not in self:
                    if p.isalpha():
                        plain.add(p)
                    elif p[1:].isalpha() and p[:1] == "\0":
                        bare.add(p[1:])
        self._encode(list(plain), " ", "", 0)
        self._encode(list(bare), "\n", "\0", 4)
        for w, parts in made:
            self[w] = b"".join([self[p] for p in parts])

    def _encode(self, words: list[str], mark: str, before: str, skip: int) -> None:
        """Words of letters as one text; skip: bytes of the mark. Between letters a space begins a token and a line break is one, and no other token begins with them."""
        for at in range(0, len(words), _RUN):
            run = words[at : at + _RUN]
            ids = np.array(self.tok.encode_batch_fast([mark + mark.join(run)], add_special_tokens=False)[0].ids, "<u4")
            heads = np.flatnonzero(self.heads[mark][ids])
            if len(heads) != len(run):  # not a byte-level vocabulary: each is encoded on its own when it is asked for
                continue
            data, ends = ids.tobytes(), (4 * np.append(heads, len(ids))).tolist()
            self.update(zip([before + w for w in run], [data[a + skip : b] for a, b in zip(ends, ends[1:])]))


def _worker_store(path: str) -> tuple:
    """This Python worker's tokenizer and the ids of words that it has met, kept between its tasks."""
    store = sys.modules.setdefault("_cyto_worker_store", types.ModuleType("_cyto_worker_store")).__dict__
    if path not in store:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = Tokenizer.from_file(path)
        store[path] = tok, _Words(tok), [t.content for t in tok.get_added_tokens_decoder().values()]
    return store[path]


def _pack_ids(ids) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def _cut(word: str) -> list[str]:
    """Parts of a word with tokens of their own: at a single line break, and before the marks after its last letter or digit."""
    head, found, tail = word.partition("\n")
    if found and head[-1:].strip() and tail[:1].strip() and "\n" not in tail:
        return [*_cut(head), "\n", *_cut(tail)]
    core = word.rstrip(_MARKS)
    if len(core) < len(word) and core[-1:].isalnum():
        return [core, word[len(core) :]]
    return [word]


def encode_texts(texts: list[str], path: str, cache_words: int = CACHE_WORDS) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text.

    A token never reaches over the cut before a space that stands alone
    between two other characters, so such texts are cut there; a worker keeps
    the ids of words, and of their parts, that it has met. Other texts go in whole,
    those that hold a special token's name among them.
    """
    tok, words, special = _worker_store(path)
    words.most = cache_words
    out: list = []
    for t in texts:
        # white space but spaces and line breaks isn't printable; the slower pattern is for texts that have some
        if "  " in t or " \n" in t or "\n " in t or t[:1] == " " or t[-1:] == " " or (not t.replace("\n", "").isprintable() and ("\0" in t or _LOOSE.search(t))) or any(s in t for s in special):
            out.append(_pack_ids(tok.encode(t, add_special_tokens=False).ids))
        else:
            out.append(("\0" + t).split(" "))  # the mark: no space before the first
    found = words.of([x for x in out if isinstance(x, list)])
    return [next(found) if isinstance(x, list) else x for x in out]


def token_pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, keep_ids: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, end id 0 included; keep_ids adds the ids' bytes. A worker keeps the ids of cache_words words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for b in batches:
            ids, column = b.column(0).to_pylist(), b.column(1)
            rows = []
            at = 0
            while at < len(ids):
                end, size, texts = at, 0, []
                while end < len(ids) and (end == at or size < 1_000_000):  # bounds what is held at once
                    texts.append(column[end].as_py() or "")
                    size += len(texts[-1])
                    end += 1
                for doc, data in zip(ids[at:end], encode_texts(texts, tokenizer, cache_words)):
                    data += b"\0\0\0\0"
                    n = len(data) // 4
                    first = n % sequence or sequence
                    start, length, k = 0, first, 0
                    while start < n:
                        part = data[4 * start : 4 * (start + length)]
                        rows.append((doc, k, start, length, zlib.crc32(part), part if keep_ids else None))
                        start, length, k = start + length, sequence, k + 1
                at = end
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            keep = 6 if keep_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:keep], kinds)], names[:keep])

    spec = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, spec)


def best_fit(lengths, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS) -> list[tuple[int, int]]:
    """(bin, offset) of each length, in the order given, with a bounded number of open bins."""
    free: dict[int, list[int]] = {}
    bits, opened, made, out = 0, 0, 0, []
    for n in lengths:
        fits = bits >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1  # the least room that holds it
            stack = free[room]
            b = stack.pop()
            if not stack:
                bits &= ~(1 << room)
            opened -= 1
        else:
            if opened >= open_bins:  # the fullest closes
                room = (bits & -bits).bit_length() - 1
                stack = free[room]
                stack.pop()
                if not stack:
                    bits &= ~(1 << room)
                opened -= 1
            b, room = made, sequence
            made += 1
        out.append((b, sequence - room))
        left = room - n
        if left:
            free.setdefault(left, []).append(b)
            bits |= 1 << left
            opened += 1
    return out


def pack(pieces: DataFrame, sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES, open_bins: int = OPEN_BINS) -> DataFrame:
    """pieces with sequence_id and offset; each group takes its pieces as they arrive, in the order of a hash, which mixes lengths."""
    held = Written(pieces)
    n = held.df.count()
    groups = max(1, -(-n // group_pieces))
    arrival = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = held.df.withColumn("arrival", arrival).withColumn("group", F.pmod("arrival", F.lit(groups)))
    names = pieces.columns

    def run(key, g):
        g = g.sort_by([(c, "ascending") for c in ("arrival", "doc_id", "piece", "length")])
        placed = best_fit(g.column("length").to_pylist(), sequence, open_bins)
        base = key[0].as_py() << 32
        return (
            g.select(names)
            .append_column("sequence_id", pa.array([base + b for b, _ in placed], pa.int64()))
            .append_column("offset", pa.array([o for _, o in placed], pa.int64()))
        )

    spec = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return dealt.groupBy("group").applyInArrow(run, spec)


def digest(docs: DataFrame, tokenizer: str | None = None, **parameters) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return pack(token_pieces(docs, tokenizer, **parameters))
