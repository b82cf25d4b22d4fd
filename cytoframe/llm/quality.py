"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Texts are counted as hashed trigrams of character shapes (case, digits, spaces,
each punctuation mark) and as hashed words, with a few style rates. A bounded sample of labelled
rows (`sample`, by hash of id) gives the inverse document frequencies, the
latent space (randomised SVD) and the labelled vectors, which are broadcast:
their size is sample x dims numbers whatever the input's size. Every document
is then held against all of them by exact blocked cosine products, and the
labels of its `k` nearest vote with weights by similarity.

Defined cases: a null or empty text, or any without a feature, gets the
sample's mean label. A labelled doc_id with several labels counts with their
mean, one with several rows with the row of the least text hash; null labels don't count. Without any labelled row every score is 0.5.
Other columns pass by. Repeated rows get the same score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import give_back, held_out, map_in_arrow, named

SAMPLE, DIMS, K = 6000, 64, 15
POWER = 4.0
THRESHOLD = 0.3
HASHED, TERMS, STYLE = 2032, 2048, 16
FEATURES = HASHED + TERMS + STYLE
#: Weight of the words beside that of the character shapes.
TERM_WEIGHT = 0.7
_BATCH_BYTES = 2_000_000
#: Rows that are weighed at once.
_ROWS = 256


def _shapes() -> tuple[np.ndarray, int]:
    out = np.zeros(256, np.int64)
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    for c in range(256):
        ch = chr(c)
        if c >= 128 or "a" <= ch <= "z":
            out[c] = 1
        elif "A" <= ch <= "Z":
            out[c] = 2
        elif "0" <= ch <= "9":
            out[c] = 3
        elif ch == "\n":
            out[c] = 4
        elif c in marks:
            out[c] = 6 + marks.index(c)
        else:
            out[c] = 5
    return out, 6 + len(marks)


_SHAPE, _N = _shapes()
#: A trigram's feature: a multiplicative hash of its number.
_SLOT = ((np.arange(_N**3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % HASHED


def _style(text: str) -> np.ndarray:
    """Rates in 0..1: repeated neighbours, distinct words and lines, lengths, kinds of characters."""
    out = np.zeros(STYLE)
    words = text.split()
    n = len(words)
    if not n:
        return out
    lines = text.split("\n")
    out[0] = sum(map(str.__eq__, words, words[1:])) / n
    out[1] = len(set(words)) / n
    out[2] = min(1.0, np.log1p(n) / 10)
    out[3] = min(1.0, len(text) / n / 20)
    out[4] = len(set(lines)) / len(lines)
    out[5] = min(1.0, len(lines) / n)
    for i in (0, 1):
        out[8 + i * 4 : 12 + i * 4] = [out[i] > c for c in (0.1, 0.3, 0.5, 0.8)]
    return out


def counts(texts: list[str]) -> np.ndarray:
    """texts x FEATURES: counts of trigrams and words, then style rates; whole texts in bounded pieces."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    at = 0
    while at < len(texts):
        size, end, parts = 0, at, []
        while end < len(texts) and (end == at or size < _BATCH_BYTES):
            parts.append(texts[end].encode("utf-8", "surrogatepass"))
            size += len(parts[-1])
            end += 1
        if len(parts) == 1:
            data = parts[0]
            for i in range(0, max(0, len(data) - 2), _BATCH_BYTES):
                c = _SHAPE[np.frombuffer(data[i : i + _BATCH_BYTES + 2], np.uint8)]
                out[at, :HASHED] += np.bincount(_SLOT[(c[:-2] * _N + c[1:-1]) * _N + c[2:]], minlength=HASHED)
        else:
            lens = np.array([len(p) for p in parts])
            c = _SHAPE[np.frombuffer(b"".join(parts), np.uint8)]
            doc = np.repeat(np.arange(len(parts)), lens)
            inside = doc[:-2] == doc[2:]
            key = _SLOT[(c[:-2] * _N + c[1:-1]) * _N + c[2:]] + HASHED * doc[:-2]
            out[at:end, :HASHED] = np.bincount(key[inside], minlength=HASHED * len(parts)).reshape(-1, HASHED)
        for i, data in zip(range(at, end), parts):
            words = data.lower().split()
            out[i, HASHED:-STYLE] = np.bincount(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % TERMS, minlength=TERMS)
            out[i, -STYLE:] = _style(texts[i])
        at = end
    return out


class Model:
    """Inverse frequencies, the latent space and the labelled vectors in it. spend: the counts x are weighed in place and not usable afterwards."""

    def __init__(self, x: np.ndarray, y: np.ndarray, dims: int, k: int, seed: int = 3, spend: bool = False):
        self.k, self.y, self.mean = min(k, len(y)), y.astype(np.float32), float(y.mean()) if len(y) else 0.5
        if not len(y):
            return
        self.idf = np.log((1 + len(x)) / (1 + sum((x[i : i + _ROWS] > 0).sum(axis=0) for i in range(0, len(x), _ROWS)))).astype(np.float32) + 0.1
        w = self._weigh(x, spend)
        rng = np.random.default_rng(seed)
        q = rng.standard_normal((w.shape[1], min(dims + 16, w.shape[1]))).astype(np.float32)
        for _ in range(4):
            q, _r = np.linalg.qr(w.T @ (w @ q))
        _u, s, vt = np.linalg.svd(w @ q, full_matrices=False)
        rank = int((s > 1e-4 * s[0]).sum()) if s[0] > 0 else 1
        self.space = (q @ vt.T)[:, : min(dims, rank)].astype(np.float32)
        self.vectors = self._unit(w @ self.space)

    def _weigh(self, x: np.ndarray, spend: bool = False) -> np.ndarray:
        """Counts weighed, some rows at a time; spend: in place, so that no second table of that size is needed."""
        x = x if spend else x.copy()
        for at in range(0, len(x), _ROWS):
            w = x[at : at + _ROWS]
            np.log1p(w[:, :-STYLE], out=w[:, :-STYLE])
            w[:, :-STYLE] *= self.idf[:-STYLE]
            for part, weight in ((slice(0, HASHED), 1.0), (slice(HASHED, -STYLE), TERM_WEIGHT)):
                w[:, part] *= weight / np.maximum(np.linalg.norm(w[:, part], axis=1, keepdims=True), 1e-9)
        return x

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray, block: int = 256) -> np.ndarray:
        out = np.full(len(x), self.mean)
        if not len(self.y):
            return out
        some = np.flatnonzero(x[:, :HASHED].any(axis=1))
        for at in range(0, len(some), block):
            rows = some[at : at + block]
            cos = self._unit(self._weigh(x[rows]) @ self.space) @ self.vectors.T
            near = np.argpartition(cos, cos.shape[1] - self.k, axis=1)[:, cos.shape[1] - self.k :]
            c = np.take_along_axis(cos, near, axis=1).astype(np.float64)
            # the farthest neighbour's distance sets the scale, so that weights fall off alike in dense and sparse places
            far = np.maximum(1 - c, 0)  # cosines of equal vectors come out a little over 1
            w = np.exp(-POWER * far / np.maximum(far.max(axis=1, keepdims=True), 1e-6))
            out[rows] = (w * self.y[near]).sum(axis=1) / w.sum(axis=1)
        return np.clip(out, 0.0, 1.0)


def _featured(docs: DataFrame) -> DataFrame:
    """(y, slots, values): sparse counts of the few sampled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = counts([t or "" for t in b.column(0).to_pylist()])
            slots = [np.flatnonzero(r).astype("<u2") for r in x]
            vals = [r[s].astype("<f4").tobytes() for r, s in zip(x, slots)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([s.tobytes() for s in slots], pa.binary()), pa.array(vals, pa.binary())], ["y", "slots", "vals"])

    return docs.mapInArrow(run, "y double, slots binary, vals binary")


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, sample: int = SAMPLE, dims: int = DIMS, k: int = K) -> Model:
    """learn: a condition on doc_id that says which labelled rows may be used."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
    known = known.where(learn) if learn is not None else known
    picked = known.groupBy("doc_id").agg(F.avg("quality").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` pairs of numbers, so this side's size is bounded
    mine = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    one = mine.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("y").alias("y"))  # of rows that share an id, the one of the least hash
    rows = _featured(one.select("text", "y")).toArrow()
    order = sorted(range(len(rows)), key=lambda i: (rows["slots"][i].as_py(), rows["vals"][i].as_py(), rows["y"][i].as_py()))
    x, y = np.zeros((len(order), FEATURES), np.float32), np.zeros(len(order))
    for at, i in enumerate(order):
        x[at, np.frombuffer(rows["slots"][i].as_py(), "<u2")] = np.frombuffer(rows["vals"][i].as_py(), "<f4")
        y[at] = rows["y"][i].as_py()
    del rows, order
    model = Model(x, y, dims, k, spend=True)
    del x
    give_back()  # the driver goes on for long with what is left of this
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, learn: Column | None = None, **parameters) -> DataFrame:
    """docs with quality_score, double in 0..1."""
    names = [c for c in docs.columns if c != "quality_score"]
    docs = docs.select(*map(named, names))
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, learn, **parameters))
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            got = [model.value.score(counts(texts[i : i + 512])) for i in range(0, len(texts), 512)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(got) if got else [], pa.float64())], [*names, "quality_score"])

    return map_in_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())]))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    test = held_out(F.col("doc_id"), 5, 0)
    return quality_scores(docs.select("doc_id", "text"), labels, ~test).select(
        "doc_id",
        test.alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
