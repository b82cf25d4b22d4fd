"""Language ID: a linear-chain conditional random field over the words of a text.

Each word's label is a language. Emissions sum the weights of hashed affix,
n-gram and lexicon features; transitions between neighbouring words are learned
with them by gradient steps on the likelihood of a bounded sample of labelled
texts (`per_label` whole texts of each language). Prediction is exact
forward-backward over the whole text, in which languages may switch; the
document's language is the one with the largest sum of word marginals.

Texts are cut in lanes of `LANE` words whose transfer matrices are multiplied
side by side, so that very long texts run as fast as many short ones.

Defined cases: a null text, or one without a letter, is `und` with score 0, and
so is every text if nothing was learned. Rows with a null lang teach nothing.
Ties go to the first label in order. Other columns pass by; repeated rows get
the same result.
"""

from __future__ import annotations

import sys
import types
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import held_out, map_in_arrow, named

PER_LABEL, MAX_TEXTS = 250, 4000
#: Most characters of all texts that are learned from; one with over a sixteenth of them is passed over.
MAX_CHARS = 16_000_000
SLOTS = 1 << 16
EPOCHS, RATE = 4, 0.3
LANE = 32
#: Words held at once while labelling, unless one text has more.
_BATCH_WORDS = 300_000
#: Words times squared labels worked on at once.
_BATCH_CELLS = 16_000_000
CACHE_WORDS = 200_000


_OUTER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’…¿¡—–"


def bare(token: str) -> str:
    """The token's letters inside its outer punctuation, lower-cased; empty without a letter."""
    w = token.strip(_OUTER).lower()
    return w if w.isalpha() else "".join(c for c in w if c.isalpha())


def features(words: list[str], lexicon: set[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(slot, word number) of all features of the words.

    Of each word between two marks: the bigrams and trigrams of its bytes, which
    hold the affixes of one and two; the affixes of three; and the word itself
    where the lexicon has it. Each is hashed to one of SLOTS.
    """
    data = [b"^%b$" % w.encode("utf-8", "surrogatepass") for w in words]
    lens = np.fromiter(map(len, data), np.int64, len(data))
    x = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(data)), lens)
    two = (x[:-1] << np.uint64(8)) | x[1:]
    three = (two[:-1] << np.uint64(8)) | x[2:]
    four = (three[:-1] << np.uint64(8)) | x[3:]
    in2, in3 = word[:-1] == word[1:], word[:-2] == word[2:]
    ends = np.cumsum(lens)
    long_ = np.flatnonzero(lens >= 5)
    at = [np.flatnonzero(in2), np.flatnonzero(in3), (ends - lens)[long_], ends[long_] - 4]
    parts = [two[at[0]], three[at[1]], four[at[2]] | np.uint64(1 << 40), four[at[3]] | np.uint64(2 << 40)]
    known = np.array([i for i, w in enumerate(words) if lexicon is None or w in lexicon], np.int64)
    parts.append(np.fromiter((zlib.crc32(data[i]) for i in known), np.uint64, len(known)) | np.uint64(3 << 40))
    slots = (np.concatenate(parts) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    return slots.astype(np.int64) % SLOTS, np.concatenate([word[at[0]], word[at[1]], long_, long_, known])


def emissions(weights: np.ndarray, slots: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(word, weights[slots, j], n) for j in range(weights.shape[1])], axis=1)


class Lanes:
    """How the words of several texts lie in lanes of equal length."""

    def __init__(self, sizes: np.ndarray):
        per = -(-sizes // LANE)
        self.first = np.concatenate(([0], np.cumsum(per)))[:-1]
        self.per, self.n = per, int(per.sum())
        text = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.text, self.lane, self.step = text, self.first[text] + inside // LANE, inside % LANE


def marginals(e: np.ndarray, a: np.ndarray, lanes: Lanes, want_pairs: bool = False):
    """Word marginals (words x labels), and the expected counts of neighbouring labels.

    e: exp(emission) of each word, scaled at will; a: exp(transition). The chain
    starts and ends free, from a uniform label.
    """
    k = a.shape[0]
    es = np.ones((LANE, lanes.n, k))
    real = np.zeros((LANE, lanes.n), bool)
    es[lanes.step, lanes.lane] = e
    real[lanes.step, lanes.lane] = True
    m = np.broadcast_to(np.eye(k), (lanes.n, k, k)).copy()
    for s in range(LANE):
        on = real[s]
        if not on.all():
            m[on] = (m[on].reshape(-1, k) @ a).reshape(-1, k, k) * es[s][on][:, None, :]
        else:
            m = (m.reshape(-1, k) @ a).reshape(-1, k, k) * es[s][:, None, :]
        if s % 4 == 3:
            m /= m.max(axis=(1, 2), keepdims=True)
    fore, back = np.full((lanes.n, k), 1.0 / k), np.ones((lanes.n, k))
    for j in range(1, int(lanes.per.max(initial=0))):
        at = lanes.first[lanes.per > j] + j
        v = np.einsum("li,lij->lj", fore[at - 1], m[at - 1])
        fore[at] = v / v.sum(axis=1, keepdims=True)
    for j in range(int(lanes.per.max(initial=0)) - 1, 0, -1):
        at = lanes.first[lanes.per > j] + j
        v = np.einsum("lij,lj->li", m[at], back[at])
        back[at - 1] = v / v.sum(axis=1, keepdims=True)
    alphas = np.empty((LANE + 1, lanes.n, k))
    alphas[0] = fore
    for s in range(LANE):
        v = (alphas[s] @ a) * es[s]
        v /= v.sum(axis=1, keepdims=True)
        alphas[s + 1] = np.where(real[s][:, None], v, alphas[s])
    out = np.empty_like(es)
    pairs = np.zeros((k, k))
    beta = back
    for s in range(LANE - 1, -1, -1):
        g = alphas[s + 1] * beta
        out[s] = g / g.sum(axis=1, keepdims=True)
        eb = es[s] * beta
        if want_pairs:
            on = real[s].copy()
            if s == 0:
                on[lanes.first[lanes.per > 0]] = False  # no word before the first
            z = np.einsum("li,ij,lj->l", alphas[s], a, eb)
            pairs += a * (alphas[s][on].T @ (eb[on] / z[on][:, None]))
        v = eb @ a.T
        v /= v.sum(axis=1, keepdims=True)
        beta = np.where(real[s][:, None], v, beta)
    return out[lanes.step, lanes.lane], pairs


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray, trans: np.ndarray, lexicon: set[str]):
        self.labels, self.weights, self.trans, self.lexicon = labels, weights, trans, lexicon
        self.key = f"crf-{uuid.uuid4().hex}"

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.labels:
            return [("und", 0.0)] * len(texts)
        store = sys.modules.setdefault("_cyto_worker_store", types.ModuleType("_cyto_worker_store")).__dict__
        known, rows = store.setdefault(self.key, ({}, [np.zeros((1, len(self.labels)))]))
        tokens = [t.split() if t else [] for t in texts]
        out: list[tuple[str, float]] = []
        at = 0
        most = min(_BATCH_WORDS, _BATCH_CELLS // len(self.labels) ** 2)
        while at < len(texts):
            end, n = at, 0
            while end < len(texts) and (end == at or n < most):
                n += len(tokens[end])
                end += 1
            if len(known) > CACHE_WORDS:
                known.clear()
                rows[0] = rows[0][:1]
            part = tokens[at:end]
            fresh = list({w for ws in part for w in ws if w not in known})
            bares = list(map(bare, fresh))
            new = [b for b in bares if b]
            base = len(rows[0])
            number = iter(range(base, base + len(new)))
            known.update((w, next(number) if b else 0) for w, b in zip(fresh, bares))
            if new:
                rows[0] = np.concatenate((rows[0], emissions(self.weights, *features(new, self.lexicon), len(new))))
            ids = np.fromiter((known[w] for ws in part for w in ws), np.int64, n)
            lanes = Lanes(np.array([len(ws) for ws in part], np.int64))
            em = rows[0][ids]
            e = np.exp(np.maximum(em - em.max(axis=1, keepdims=True), -30)) if n else em
            g, _ = marginals(e, np.exp(self.trans), lanes) if n else (e, None)
            letters = ids > 0
            total = np.stack([np.bincount(lanes.text[letters], g[letters, j], len(part)) for j in range(len(self.labels))], axis=1)
            mass = total.sum(axis=1)
            best = np.round(total, 9).argmax(axis=1)
            out += [(self.labels[b], float(min(1.0, t[b] / z))) if z > 0 else ("und", 0.0) for b, t, z in zip(best, total, mass)]
            at = end
        return out


def train(texts: list[tuple[str, str]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 5) -> Model:
    """texts: (text, label); labels are sorted, so equal samples in any order give one model."""
    texts = sorted(texts)
    labels = sorted({y for _, y in texts})
    words = [[b for b in map(bare, t.split()) if b] for t, _ in texts]
    lexicon = {w for ws in words for w in ws}
    names = sorted(lexicon)
    number = {w: i for i, w in enumerate(names)}
    k = len(labels)
    w, trans = np.zeros((SLOTS, k)), np.zeros((k, k))
    gw, gt = np.full((SLOTS, k), 1e-3), np.full((k, k), 1e-3)
    rng = np.random.default_rng(seed)
    use = np.array([i for i, ws in enumerate(words) if ws], np.int64)
    for _ in range(epochs if k else 0):
        rng.shuffle(use)
        for at in range(0, len(use), 128):
            batch = use[at : at + 128]
            ids = np.concatenate([[number[x] for x in words[i]] for i in batch]).astype(np.int64)
            own, back = np.unique(ids, return_inverse=True)
            lanes = Lanes(np.array([len(words[i]) for i in batch], np.int64))
            y = np.array([labels.index(texts[i][1]) for i in batch])
            slots, word = features([names[i] for i in own])
            em = emissions(w, slots, word, len(own))
            e = np.exp(np.maximum(em - em.max(axis=1, keepdims=True), -30))[back]
            g, pairs = marginals(e, np.exp(trans), lanes, True)
            gold = y[lanes.text]
            d = -g
            d[np.arange(len(d)), gold] += 1
            dw = np.stack([np.bincount(back, d[:, j], len(own)) for j in range(k)], axis=1)
            grad = np.stack([np.bincount(slots, dw[word, j], SLOTS) for j in range(k)], axis=1) / len(batch)
            grad -= 1e-4 * w
            gw += grad**2
            w += rate * grad / np.sqrt(gw)
            seen = np.bincount(y, np.array([len(words[i]) - 1 for i in batch]), k)
            gtr = (np.diag(seen) - pairs) / len(batch) - 0.5 * trans
            gt += gtr**2
            trans = np.clip(trans + rate * gtr / np.sqrt(gt), -5, 5)
    return Model(labels, w.astype(np.float32), trans, lexicon)


def fit(docs: DataFrame, learn: Column | None = None, per_label: int = PER_LABEL, max_texts: int = MAX_TEXTS, max_chars: int = MAX_CHARS) -> Model:
    """A model of at most per_label texts of each label, max_texts and max_chars in all, in the order of a hash."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    rows = rows.where(learn) if learn is not None else rows
    order = F.xxhash64("doc_id", F.lit(11))
    ids = rows.select("doc_id", "lang", order.alias("o"), F.xxhash64("text").alias("th"), F.length("text").alias("size")).where(F.col("size") <= max_chars // 16)
    few = ids.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("o", "doc_id", "th"))).where(F.col("r") <= per_label)
    few = few.orderBy("r", "lang").limit(max_texts)
    upto = F.sum("size").over(Window.orderBy("r", "lang", "o", "doc_id", "th").rowsBetween(Window.unboundedPreceding, 0))  # over at most max_texts rows
    few = few.withColumn("upto", upto).where(F.col("upto") <= max_chars).select("doc_id", "lang", "th").distinct()
    # at most max_texts rows of ids, so this side's size is bounded
    got = rows.withColumn("th", F.xxhash64("text")).join(F.broadcast(few), ["doc_id", "lang", "th"]).select("text", "lang").distinct()
    return train([(r["text"], r["lang"]) for r in got.toLocalIterator()])


def language_of(docs: DataFrame, learn: Column | None = None, **parameters) -> DataFrame:
    """docs with lang_pred and lang_score."""
    names = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, learn, **parameters))
    docs = docs.select(*map(named, names))
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = model.value.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], [*names, "lang_pred", "lang_score"])

    return map_in_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]))


def digest(docs: DataFrame) -> DataFrame:
    test = held_out(F.col("doc_id"), 3, 1)
    return language_of(docs.select("doc_id", "text", "lang"), ~test).select(
        "doc_id", test.alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )
