"""The training-text operators against brute force, and on awkward rows."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cytoframe.llm import _common, _tiles, embed_dedup, langid, line_dedup, lm, media, mixing, packing, quality, queries, simhash, suffix_dedup

DATA = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long_ = "alpha beta gamma delta epsilon " * 3000
    line = "this very line is in many documents"
    rows = [
        (1, "one two three\n" + line, "en", "x", 1, 9), (2, line + "\nfour five", "en", "x", 1, 9), (2, line + "\nfour five", "en", "x", 1, 9),
        (None, line, None, None, None, None), (3, None, "de", "y", None, 1), (4, "", "de", "y", 0, 1), (5, " \n\t\n", None, "y", 0, 1),
        (6, long_, "fr", None, 5, 1), (7, long_, "fr", None, 5, 1), (8, "été à l'école !!! 123", "fr", "z", 5, 1), (9, "1234 5678", "en", "z", 5, 1), (None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long").withColumns({"component_id": F.lit(5), "dropped": F.lit("d"), "feature": F.lit(1.5), "_t": F.lit("u")})


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def test_op1_separates_and_defines_odd_rows(spark, docs, odd):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.digest(docs, labels).collect()}
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    test = [(got[i]["score"], q) for i, q in y.items() if zlib.crc32(str(i).encode()) % 5 == 0]
    good, bad = [s for s, q in test if q], [s for s, q in test if not q]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert good and bad and np.mean([g > b for g in good for b in bad]) > 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert quality.digest(odd, labels).count() == odd.count()
    assert {r["score"] for r in quality.digest(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.digest(spark.createDataFrame([], EMPTY), labels).count() == 0


def test_op1_votes_are_exact_cosines():
    rng = np.random.default_rng(1)
    x = np.floor(rng.random((60, quality.FEATURES)).astype(np.float32) * 3)
    m = quality.Model(x, (rng.random(60) > 0.5).astype(float), 16, 5)
    assert np.allclose(m.score(x[:20], block=7), m.score(x[:20], block=64), atol=1e-6)
    v = m._unit(m._weigh(x[:1]) @ m.space)
    near = np.argsort(-(v @ m.vectors.T)[0])[:5]
    c = (v @ m.vectors.T)[0, near].astype(float)
    w = np.exp(-quality.POWER * (1 - c) / (1 - c).max())
    assert abs(m.score(x[:1])[0] - (w * m.y[near]).sum() / w.sum()) < 1e-6


def test_op1_weighs_in_place():
    import tracemalloc

    rng = np.random.default_rng(2)
    x, y = rng.poisson(0.1, (1500, quality.FEATURES)).astype(np.float32), (rng.random(1500) > 0.5).astype(float)
    a = quality.Model(x.copy(), y, 16, 5)
    own = x.copy()
    tracemalloc.start()
    b = quality.Model(own, y, 16, 5, spend=True)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < x.nbytes and np.array_equal(a.vectors, b.vectors) and np.array_equal(a.space, b.space)


def test_op1_copies_of_one_labelled_text(spark):
    rows = [(i, "The same labelled text, many times. " * 3) for i in range(50)] + [(60 + i, f"Another text; number {i}! " * (i + 1)) for i in range(20)] + [(0, "a repeated id")] * 30
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(80)], "doc_id long, quality int")
    got = quality.digest(d, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and not np.isnan(r["score"]) for r in got)
    assert len(quality.fit(d, labels).y) == 70  # a row for each id


def water(sizes, weights, share=1.5, most=2):
    left, cap, out = share * sum(sizes), [most * s for s in sizes], [0.0] * len(sizes)
    live = set(range(len(sizes)))
    while live:
        level = left / sum(weights[i] for i in live)
        full = [i for i in live if weights[i] * level >= cap[i]]
        for i in full or live:
            out[i] = cap[i] if full else weights[i] * level
        if not full:
            break
        left -= sum(cap[i] for i in full)
        live -= set(full)
    return out


def test_op2_targets_and_taken(spark, docs, odd):
    for d in (docs, odd):
        rows = mixing.digest(d).collect()
        src = collections.defaultdict(list)
        for r, s in zip(d.select("doc_id", "text", "source").collect(), range(10**9)):
            src[r["source"]].append(len(WORD.findall(r["text"] or "")))
        names = sorted((s for s in src if s is not None), key=lambda s: s.encode()) + ([None] if None in src else [])
        want = water([sum(src[s]) for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
        assert sorted(round(x, 6) for x in {(r["source_size"], r["target"]) for r in rows} for x in x) == sorted(round(x, 6) for x in {(sum(src[s]), t) for s, t in zip(names, want)} for x in x)
        assert len(rows) == d.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
        taken = collections.Counter()
        for r in rows:
            taken[r["source_size"], round(r["target"], 6)] += r["taken"]
            assert sum(x["words"] for x in r["shards"]) == r["taken"] and [x["shard"] for x in r["shards"]] == sorted({x["shard"] for x in r["shards"]})
        due = collections.Counter()
        for s, t in zip(names, want):
            due[sum(src[s]), round(t, 6)] += round(t)
        assert all(abs(taken[k] - n) <= len(names) for k, n in due.items())
        key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
        assert sorted(map(key, rows)) == sorted(map(key, mixing.digest(d.repartition(3)).collect()))
    assert mixing.digest(spark.createDataFrame([], EMPTY)).count() == 0


def test_op2_tree_and_texts(spark, docs):
    q = spark.createDataFrame([(0, 300), (1, 5000), (2, 20), (3, 0), (4, 1)], "rank int, draws bigint")
    got = mixing.split_tree(q, 5).groupBy("rank").agg(F.sum("draws").alias("n"), F.count("*").alias("k")).collect()
    assert {r["rank"]: r["n"] for r in got} == {0: 300, 1: 5000, 2: 20, 3: 0, 4: 1} and {r["k"] for r in got} == {5}
    u = "(shiftrightunsigned(xxhash64(id, 5L), 11) / 9007199254740992.0D)"
    h = spark.range(20_000).selectExpr(mixing._hypergeometric("30L", "50L", "20L", u) + " AS x").agg(F.avg("x"), F.variance("x")).first()
    assert abs(h[0] - 7.5) < 0.06 and abs(h[1] - 20 * 30 / 80 * 50 / 80 * 60 / 79) < 0.15
    m = mixing.mix(docs).groupBy("shard").agg(F.sum(mixing.words(F.col("text"))).alias("n")).collect()
    d = mixing.digest(docs).select(F.explode("shards").alias("s")).groupBy("s.shard").agg(F.sum("s.words").alias("n")).collect()
    assert {r["shard"]: r["n"] for r in m} == {r["shard"]: r["n"] for r in d}
    # each shard has the blocks of each source that the tree gives it
    draws = mixing.mix_draws(docs, shards=7).select("source", F.explode("draws").alias("z")).groupBy("source", "z.shard").agg(F.count_distinct("z.pass", "z.block").alias("n")).collect()
    plan = mixing.quotas(mixing.source_targets(docs.select("source", mixing.words(F.col("text")).alias("size"))))
    tree = mixing.split_tree(plan.select("rank", "draws"), 7).join(plan.select("rank", "source"), "rank").where("draws > 0").collect()
    assert {(r["source"], r["shard"]): r["n"] for r in draws} == {(r["source"], r["shard"]): r["draws"] for r in tree}


def test_op2_permutation_and_clashing_names(spark, docs):
    for n in (1, 2, 3, 64, 65, 1000):
        x = spark.range(n).selectExpr("id AS k", f"{n}L AS n", f"cast((length(bin(greatest({n}L - 1, 1L))) + 1) div 2 as int) AS low_bits").selectExpr("*", "shiftleft(1L, low_bits) - 1 AS low_mask", f"shiftleft(1L, length(bin(greatest({n}L - 1, 1L))) - low_bits) - 1 AS high_mask")
        got = [r[0] for r in x.selectExpr(mixing._permuted("k", "n", "5L, 1, 0") + " AS p").collect()]
        assert sorted(got) == list(range(n)) and (n < 64 or got != sorted(got))
    odd_names = ["rank", "weight", "step", "blocks", "parts", "n_docs", "ends", "shard", "place", "size", "draws", "_d", "_w", "a`b", "x y"]
    d = docs.limit(20)
    for c in odd_names:
        d = d.withColumn(c, F.lit(7))
    m = mixing.mix(d)
    assert set(odd_names) <= set(m.columns) and len(m.columns) == len(set(m.columns)) and m.where("size = 7 AND `a``b` = 7").count() == m.count() > 0
    assert mixing.mix_draws(d).count() == 20


def groups(n, linked):
    lab = list(range(n))

    def find(i):
        while lab[i] != i:
            i = lab[i]
        return i

    for i, j in linked:
        a, b = sorted((find(i), find(j)))
        lab[b] = a
    return [find(i) for i in range(n)]


def test_op3_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base, base[:10] + 0.02 * rng.standard_normal((10, 16)), base[:1] + 0.05 * rng.standard_normal((60, 16)), base[:5], 3 * base[:3]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0] * 3), (904, [1.0, None] * 8), (905, [float("inf")] + [0.0] * 15), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(None).cast("int"))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T >= 0.95
    np.fill_diagonal(s, False)
    lab = groups(len(x), np.argwhere(s).tolist())
    monkeypatch.setattr(embed_dedup.neighbour_links, "__defaults__", (0.95, 6, 16, 32_768, 7))
    for d in (df, df.repartition(5)):
        got = {r["vec_id"]: r for r in embed_dedup.digest(d).collect()}
        assert len(got) == len(rows)
        for i in range(len(x)):
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (int(s[i].sum()), lab[i], lab[i] == i)
        for i in (900, 901, 902, 903, 904, 905):
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
        assert (got[None]["n_links"], got[None]["component_id"]) == (0, None)
    assert embed_dedup.digest(df.limit(0)).count() == 0


def test_op3_every_length_and_planted_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for n, dim in enumerate((2, 3, 4, 5, 6, 7)):  # more lengths than have forests
        v = rng.standard_normal(dim)
        for k in range(3):
            rows.append((10 * n + k, (v * (k + 1)).tolist()))
            want[10 * n + k] = (2, 10 * n)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == want
    x = rng.standard_normal((12_000, 64))
    y = x[:1000] / np.linalg.norm(x[:1000], axis=1, keepdims=True)
    r = rng.standard_normal(y.shape)
    r -= (r * y).sum(axis=1, keepdims=True) * y
    near = 0.951 * y + np.sqrt(1 - 0.951**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    d = spark.createDataFrame([(i, v) for i, v in enumerate(np.concatenate([x, near]).astype(np.float32).tolist())], "vec_id long, embedding array<float>").cache()
    monkeypatch.setattr(embed_dedup.neighbour_links, "__defaults__", (0.95, 6, 256, 65_536, 7))  # leaves small enough for five splits
    kept = {r["vec_id"]: r["component_id"] for r in embed_dedup.digest(d).collect()}
    assert np.mean([kept[12_000 + i] == i for i in range(1000)]) >= 0.995


def test_op4_base_counts_and_probabilities(spark, docs, texts, odd):
    got = {r["doc_id"]: r for r in lm.digest(docs).collect()}
    tok = {i: WORD.findall(fold(t or "")) + [""] for i, t in texts.items()}
    test = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tok}
    c = collections.Counter(w for i, ws in tok.items() if not test[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tok.items():
        base = sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert abs(got[i]["base_score"] - base) < 1e-6 * max(1, abs(base))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"], got[i]["held_out"]) == (len(ws), sum(c[w] > 0 for w in ws), n, test[i])
        assert got[i]["score"] < 0
    assert lm.digest(odd).count() == odd.count()
    assert lm.digest(spark.createDataFrame([], EMPTY)).count() == 0


def test_op4_null_ids_stay_null(spark, odd):
    got = [r["doc_id"] for r in lm.digest(odd).collect()]
    assert got.count(None) == 2 and 0 not in got


def test_op4_charges_the_whole_of_a_long_word(spark):
    letters = np.frombuffer(b"0123456789abcdef", "S1")
    long_ = b"".join(np.random.default_rng(4).choice(letters, 20_000).tolist()).decode()
    rows = [(i, f"one two three {i} deadbeef", "en") for i in range(40)] + [(100, long_[:10_000], "en"), (101, long_, "en")]
    got = {r["doc_id"]: r["score"] for r in lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id") < 100).collect()}
    # 16 even letters are 1.2 digits a byte; no model of other text does better
    assert got[101] < -1.2 * 20_000 and abs(got[101] / got[100] - 2) < 0.1


def test_op4_score_depends_on_the_order_of_words(spark, docs):
    rows = [(r["doc_id"], r["text"] or "", r["lang"]) for r in docs.collect()]
    rng = np.random.default_rng(3)
    mixed = [(i + 10**9, " ".join(rng.permutation(t.split()).tolist()), g) for i, t, g in rows]
    d = spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["score"] for r in lm.lm_scores(d, (F.col("doc_id") < 10**9) & (F.col("doc_id") % 5 > 0)).collect()}
    test = [i for i, t, _ in rows if i % 5 == 0]
    assert sum(got[i] for i in test) > 0.99 * sum(got[i + 10**9] for i in test)
    assert sum(got[i] != got[i + 10**9] for i in test) > 0.8 * sum(len((t or "").split()) > 1 for i, t, _ in rows if i % 5 == 0)


def fitted(pieces, sizes, gate, more):
    tables = [np.zeros(2 * n, np.uint32) for n in sizes]
    for _, bit, slots, _m in pieces():
        for table, x in zip(tables, slots):
            np.add.at(table, 2 * x + bit, np.uint32(1))
    m = lm.Mixer(tables, gate, more)
    for _ in range(20):
        m.learn(pieces())
    return m


def test_op4_next_words_are_a_distribution():
    words = [b"the", b"then", b"other", b"thin", b"that"]
    code = lm.Code(words, np.array([9, 5, 4, 4, 2]), 3, 6, 33)
    rng = np.random.default_rng(1)
    texts = [np.append(rng.choice([2, 2, 2, 3, 4, 5, 6, 0], 6), lm.END) for _ in range(30)] + [np.array([2, 3, 2, 3, 2, 3, lm.END])] * 10
    m = fitted(lambda: code.pieces(texts), code.sizes, (1, 2), 1)
    for before in ([], [2], [2, 3, 2], [5, 0, 0, 4]):
        p = m.log10(code.pieces([np.array([*before, x]) for x in range(7)]), 7)
        whole = m.log10(code.pieces([np.array(before)]), 1)[0] if before else 0.0
        assert abs((10.0 ** (p - whole)).sum() - 1) < 1e-5
    # a context says more than the word's count: 2 then 3 is what one text keeps repeating
    assert m.log10(code.pieces([np.array([2, 3, 2, 3])]), 1)[0] > m.log10(code.pieces([np.array([2, 2, 3, 3])]), 1)[0]
    one = m.log10(code.pieces(texts), len(texts))
    parts = np.concatenate([m.log10(code.pieces([t]), 1) for t in texts])
    assert np.allclose(one, parts)


def test_op4_code_and_counts_within_a_text():
    counts = np.array([1, 1, 50, 20, 7, 7, 3, 2, 1])
    start, path = lm.huffman(counts)
    codes = ["".join(str(e & 1) for e in path[a:b]) for a, b in zip(start, start[1:])]
    assert sum(2.0 ** -len(c) for c in codes) == 1 and not any(b.startswith(a) for a in codes for b in codes if a != b)
    heap, best = sorted(counts.tolist()), 0
    while len(heap) > 1:
        best += heap[0] + heap[1]
        heap = sorted([heap[0] + heap[1], *heap[2:]])
    assert int(counts @ np.array([len(c) for c in codes])) == best
    rng = np.random.default_rng(2)
    key, bit, part = rng.choice([0, 1, 2, 70_000, 131_073], 200), rng.integers(0, 2, 200).astype(np.uint32), np.arange(200) // 70
    same = (key[:, None] == key) & (part[:, None] == part) & (np.arange(200)[:, None] > np.arange(200))
    want = [np.log(((r & (bit == 1)).sum() + 0.4) / ((r & (bit == 0)).sum() + 0.4)) for r in same]
    assert np.allclose(lm._so_far(key, part, bit), want, atol=1e-5)


def test_op4_long_texts_in_stretches(monkeypatch):
    words = [b"a", b"b", b"c"]
    code = lm.Code(words, np.array([5, 5, 5]), 1, 1, 1000)
    text = np.append(np.random.default_rng(7).integers(0, 5, 3000), lm.END)
    whole = [tuple(map(len, (x[1], *x[2]))) for x in code.pieces([text])]
    monkeypatch.setattr(lm, "STRETCH", 256)
    monkeypatch.setattr(lm, "_PIECE", 600)
    parts = list(code.pieces([text, text[:100]]))
    assert len(parts) > 3 and sum(len(x[1]) for x in parts if True) > whole[0][0]
    assert np.concatenate([x[1] for x in parts])[: whole[0][0]].tolist() == np.concatenate([x[1] for x in code.pieces([text])]).tolist()


def test_op4_spelling_is_a_distribution(monkeypatch):
    words = [b"the", b"then", b"other", b"thin", b"that", b""] * 3
    m = fitted(lambda: lm.spelled(words), [1 << b for b in lm.SPELL_BITS], (3, 2), 0)
    every = [bytes([i]) for i in range(256) if i != 32]
    # what begins with a byte has that byte's share: of the empty word and all first bytes
    first = [next(lm.spelled([w])) for w in every]
    share = [m.log10(iter([(of, bit[:8], [s[:8] for s in slots], [])]), 1)[0] for of, bit, slots, _ in first]
    assert abs((10.0 ** np.array(share)).sum() + 10.0 ** m.log10(lm.spelled([b""]), 1)[0] - 1) < 1e-5
    assert m.log10(lm.spelled([b"the"]), 1)[0] > m.log10(lm.spelled([b"xqz"]), 1)[0]
    whole = m.log10(lm.spelled(words), len(words))
    monkeypatch.setattr(lm, "_PIECE", 7)
    assert np.allclose(m.log10(lm.spelled(words), len(words)), whole)


def test_op4_tells_texts_of_the_corpus_and_repeats_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")  # enough to learn from
    got = lm.digest(docs).collect()
    rows = {r["doc_id"]: r for r in got}
    test = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test)
    assert all(r["bits_per_byte"] > 0 for r in got)
    flat = {i: -(len(t or "") + 1) * np.log10(2) * 8 for i, t in ((r["doc_id"], r["text"]) for r in docs.collect())}
    assert sum(rows[i]["score"] for i in flat) > 0.5 * sum(flat.values())
    unlike = " ".join(f"zq{i}x" for i in range(60))
    d = spark.createDataFrame([(1, unlike + " end"), (2, unlike + " end"), (3, unlike.replace("zq", "vw") + " end")] + [(10 + i, "some plain words here") for i in range(20)], "doc_id long, text string")
    twice, _, once = sorted((r for r in lm.lm_scores(d).collect() if r["doc_id"] < 10), key=lambda r: r["doc_id"])
    assert twice["score"] > once["score"] + 5


def line_truth(rows):
    strip = lambda s: fold(s.strip(" \t\n\x0b\f\r"))
    own = collections.defaultdict(set)
    for i, t in rows:
        for ln in (t or "").split("\n"):
            if len(strip(ln)) >= 10:
                own[strip(ln)].add(i)
    least = {k: min(v, key=lambda i: (i is None, i)) for k, v in own.items() if len(v) > 1}
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [ln for ln in ls if not (strip(ln) in least and least[strip(ln)] != i)]
        out.append((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_op5_against_brute_force_and_sql(spark, docs, odd):
    for d in (docs, odd):
        rows = [(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()]
        assert sorted(map(tuple, line_dedup.digest(d).collect()), key=str) == line_truth(rows)
        c = duckdb.connect()
        c.register("documents", d.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
        assert sorted(c.execute(line_dedup.SQL).fetchall(), key=str) == line_truth(rows)
    assert line_dedup.digest(spark.createDataFrame([], EMPTY)).count() == 0
    assert set(line_dedup.line_dedup(odd).columns) >= {"size", "component_id", "feature", "_t"}


def fp_truth(t):
    w = WORD.findall(fold(t or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_op6_against_all_pairs(spark, docs, odd):
    for d in (docs, odd):
        rows = [(r["doc_id"], fp_truth(r["text"])) for r in d.select("doc_id", "text").collect()]
        f = np.array([x for _, x in rows], np.uint64)
        link = np.argwhere(np.bitwise_count(f[:, None] ^ f[None, :]) <= 4)
        lab = groups(len(rows), link.tolist())
        least = {}
        for (i, _), g in zip(rows, lab):
            if i is not None:
                least[g] = min(least.get(g, i), i)
        want = sorted((str(i), f"{x:016x}", str(least.get(g))) for (i, x), g in zip(rows, lab))
        assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.digest(d).collect()) == want
    assert simhash.digest(spark.createDataFrame([], EMPTY)).count() == 0


def test_op6_long_lists_lose_no_link(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 30)
    f = np.unique(np.concatenate([base, base[:1] ^ (1 << rng.integers(0, 62, 200)), base[:20] ^ 0b1111, base[:20] ^ 0b11111]))
    lab = groups(len(f), np.argwhere(np.bitwise_count(f[:, None] ^ f[None, :]) <= 4).tolist())
    e = simhash.fingerprint_links(spark.createDataFrame([(int(x),) for x in f], "fp long"), list_cap=16, bucket_rows=100)
    comp = {r["node"]: r["component"] for r in _common.connected_components(e).collect()}
    assert [comp.get(int(x), int(x)) for x in f] == [int(f[g]) for g in lab]
    assert len(simhash.TRIPLES) == 20


def test_op6_near_duplicates_by_shingles(spark, odd):
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(400)]
    rows, plan = [], []
    for g in range(40):
        base = rng.choice(words, 120 + g).tolist()
        rows.append((10 * g, " ".join(base)))
        for k, changes in enumerate((0, 1, 2, 3, 12, 40), 1):
            t = list(base)
            for at in rng.choice(len(t), changes, replace=False):
                t[at] = f"x{rng.integers(10**6)}"
            rows.append((10 * g + k, " ".join(t)))
    def shingles(t):
        w = fold(t).split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = [shingles(t) for _, t in rows]
    alike = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if rows[i][0] // 10 == rows[j][0] // 10 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    lab = groups(len(rows), alike)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wrong = [i for i, (d, _) in enumerate(rows) if got[d] != rows[lab[i]][0]]
    assert len(wrong) <= 0.02 * len(rows) and all(got[d] % 10 >= 0 and got[d] // 10 == d // 10 for d, _ in rows)
    assert len({rows[g][0] for g in lab}) > 80  # changed texts are not all one group
    for list_cap, bucket in ((8, 64),):
        fps = simhash.Written(spark.createDataFrame(rows, "doc_id long, text string").select(F.sha2("text", 256).alias("h")).select(F.unhex("h").alias("fp"))).df.distinct()
        assert simhash.wide_links(fps.withColumn("group", F.xxhash64("fp")), 30, 0, list_cap, bucket).count() == 0
    o = simhash.near_duplicates(odd).collect()
    assert len(o) == odd.count() and {r["component_id"] for r in o if r["doc_id"] in (3, 4, 5)} == {3} and {r["component_id"] for r in o if r["doc_id"] in (6, 7)} == {6}
    assert simhash.near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0


@pytest.mark.parametrize("n,seed,shorts", [(40, 3, (2, 1000)), (160, 4, (16,))])
def test_op6_near_duplicates_in_long_lists(spark, monkeypatch, n, seed, shorts):
    """Many texts about as similar as asked for, so that lists are long and many candidates are no links: the groups don't depend on how lists are cut."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(160)]
    rows = []
    for i in range(n):
        t = list(base)
        for at in rng.choice(160, int(rng.integers(1, 8)), replace=False):
            t[at] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(t)))
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    alike = [(i, j) for i in range(n) for j in range(i + 1, n) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    lab = groups(n, alike)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    monkeypatch.setattr(simhash, "FEW", 8 if n > 100 else 512)
    for short in shorts:
        monkeypatch.setattr(simhash, "SHORT", short)
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
        seen.append(got)
    assert seen[0] == seen[-1]
    right = sum(got[i] == rows[lab[i]][0] for i in range(n))
    assert len(set(lab)) > 1 and right >= 0.95 * n


def repeat_truth(rows):
    rows = [((2**63 - 1) if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in rows:
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in rows:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        g = gone[: len(b)]
        kept = np.frombuffer(b, np.uint8)[~g].tobytes()
        out.append((str(None if i == 2**63 - 1 else i), len(b), int(g.sum()), int((g & ~np.concatenate(([False], g[:-1]))[: len(g)]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def op7(d):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digest(d).collect())


@pytest.mark.parametrize("batch", [2_000_000, 3000])
def test_op7_against_brute_force(spark, docs, odd, monkeypatch, batch):
    monkeypatch.setattr(suffix_dedup, "_BATCH_BYTES", batch)
    monkeypatch.setattr(suffix_dedup.removed_spans, "__defaults__", (50, 60_000))
    rng = np.random.default_rng(8)
    parts = ["".join(rng.choice(list("abcd "), 120)) for _ in range(6)]
    made = [(i, "".join(p[rng.integers(0, 60) :][: rng.integers(10, 110)] for p in rng.choice(parts, 5))) for i in range(60)] + [(70, "a" * 300), (71, "a" * 120), (72, "ab" * 90)]
    more = spark.createDataFrame(made, "doc_id long, text string")
    for d in (odd, more, docs.where("n_chars < 6000")):
        assert op7(d) == repeat_truth([(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()])
    assert suffix_dedup.digest(spark.createDataFrame([], EMPTY)).count() == 0


def test_op7_index_runs_and_matches():
    rng = np.random.default_rng(4)
    strings = sorted({bytes(rng.choice([97, 98], rng.integers(5, 80)).astype(np.uint8)) for _ in range(40)})
    lens = np.array([len(s) for s in strings])
    m = np.array([list(s.ljust(88, b"\0")) for s in strings], np.uint8)
    ix = suffix_dedup.RunLengthIndex(m, lens)
    start = np.cumsum(lens) - lens
    suf = [(strings[k][p:], k) for k in range(len(strings)) for p in range(len(strings[k]))]
    pos = {(s, k): start[k] + len(strings[k]) - len(s) for s, k in suf}
    order = sorted(suf)
    assert ix.order.tolist() == [pos[x] for x in order]
    match = ix.matches()
    for (a, _), (b, k) in zip(order, order[1:]):
        common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert match[pos[b, k]] == common
    assert len(ix.runs) == len(ix.sampled) < len(ix.text)


def test_op7_ranks_of_short_and_long_keys():
    rng = np.random.default_rng(5)
    for top in (50, 1 << 62):
        key = rng.integers(0, top, 500)
        key[::3] = key[0]
        order, rank, ranks = suffix_dedup.RunLengthIndex._ranked(key)
        assert order.tolist() == np.argsort(key, kind="stable").tolist()
        values, number = np.unique(key, return_inverse=True)
        assert rank.tolist() == number.tolist() and ranks == len(values)


def test_op7_indexes_only_strings_that_can_share_a_window(monkeypatch):
    """Many strings around one minimizer, of which two share windows with another document's, and two only with their own."""
    rng = np.random.default_rng(6)
    gram = b"the minimizer is"
    side = [bytes(rng.integers(97, 123, 34).astype(np.uint8)) for _ in range(60)]
    strings = [side[2 * k] + gram + side[2 * k + 1] for k in range(20)]
    strings += [strings[0][10:], strings[3][:-10]]  # of other documents than strings 0 and 3
    strings += [strings[5][12:]]  # of the same document as string 5
    doc = np.array([*range(20), 30, 31, 5])
    n = np.array([len(s) for s in strings])
    m = np.array([list(s.ljust(88, b"\0")) for s in strings], np.uint8)
    off = np.array([s.index(gram) for s in strings])
    hashes = np.full(len(n), 7, np.uint64)
    assert np.flatnonzero(suffix_dedup._alike(m, n, off, hashes, doc, 50)).tolist() == [0, 3, 20, 21]
    seen = []
    real = suffix_dedup.marked_windows
    monkeypatch.setattr(suffix_dedup, "marked_windows", lambda m, *a: seen.append(len(m)) or real(m, *a))
    blob = suffix_dedup._blob(doc, doc * 11, doc * 0, n.astype(np.uint8), off.astype(np.uint8), np.frombuffer(b"".join(strings), np.uint8))
    gone, _, span = suffix_dedup._bucket_spans([blob], 50)
    assert seen == [4] and sorted(zip(gone.tolist(), (span & ((1 << 24) - 1)).tolist())) == [(30, 74), (31, 74)]


def test_op7_rows_sent_stay_few():
    """Rows that go back to documents don't grow with documents times buckets, each document gets one, and buckets grow before there are very many."""
    rows = []
    for bucket in range(40):
        ids = np.arange(3, dtype=np.uint64) + np.uint64(10 * bucket)
        docs = np.array([1, 2, 2])
        ids[1] = ids[0]  # documents 1 and 2 share one, the other is alone
        rows.append((bucket, suffix_dedup._blob(np.diff(docs, prepend=0), np.frombuffer(suffix_dedup._packed(ids, 5), np.uint8)), None))
        rows.append((bucket, suffix_dedup._packed(np.array([5000 + bucket], np.uint64), 5), 1))
    t = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int64()))], ["bucket", "blob", "doc"])
    sent = pa.Table.from_batches(suffix_dedup._shared_minimizers(t.slice(a, 7) for a in range(0, 80, 7)))
    assert sent.num_rows == 2
    twice = pa.concat_tables([sent, sent]).sort_by("part").combine_chunks().to_batches()[0]  # as of two tasks
    out = pa.Table.from_batches(suffix_dedup._by_document(twice.slice(a, 1) for a in range(4)))
    got = {d: sorted(set(suffix_dedup._unpacked(i, 3).tolist())) for d, i in zip(out["doc"].to_pylist(), out["ids"].to_pylist())}
    assert out.num_rows == 2 and got == {1: sorted([*range(0, 400, 10), *range(5000, 5040)]), 2: list(range(0, 400, 10))}
    assert suffix_dedup.bucket_count(0, 10) == 1 and suffix_dedup.bucket_count(2560, 10) == 256
    assert suffix_dedup.bucket_count(5120, 10) == 256 and suffix_dedup.bucket_count(102_400, 10) == 5120


def test_op8_round_trip(spark, docs, texts, odd):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    for d in (docs, odd):
        rows = packing.digest(d).collect()
        by = collections.defaultdict(list)
        for r in d.select("doc_id", "text").collect():
            ids = np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
            first = len(ids) % 2048 or 2048
            cuts = [0, *range(first, len(ids) + 1, 2048)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                by[str(r["doc_id"])].append((k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
        got = collections.defaultdict(list)
        for r in rows:
            got[str(r["doc_id"])].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in by.items()}
        seqs = collections.defaultdict(list)
        for r in rows:
            seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        for s in seqs.values():
            s.sort()
            assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and s[-1][0] + s[-1][1] <= 2048
        total = sum(r["length"] for r in rows)
        assert len(seqs) <= 1.06 * -(-total // 2048) + 2
    assert packing.digest(spark.createDataFrame([], EMPTY)).count() == 0


def test_op8_cuts_are_token_edges_and_fullest_closes():
    from public_tokenizers import path

    p = path("byte_bpe_50k.json")
    tok = packing._worker_store(p)[0]
    for t in ["a  b\n c", "", "\n", " x", "don't. stop!! 3²,", "a b c\x1cd e\x85", "x\n\ny z", "  ", "a,b ... c", "é\n q w", "a\0b \0c", "tab\tx y", "x <|endoftext|> y", "it's 'll !\n\"q\" r"]:
        assert packing.encode_texts([t], p)[0] == packing._pack_ids(tok.encode(t, add_special_tokens=False).ids), t
    placed = packing.best_fit([60, 50, 70, 30], 100, open_bins=2)  # opening the third closes the bin of 60, the fullest
    assert placed == [(0, 0), (1, 0), (2, 0), (2, 70)]
    assert packing.best_fit([60, 50, 45, 40], 100)[2:] == [(1, 50), (0, 60)]
    lengths = np.random.default_rng(3).integers(1, 2049, 20_000).tolist()
    bins = [max(b for b, _ in packing.best_fit(lengths, open_bins=n)) + 1 for n in (packing.OPEN_BINS, 20_000)]
    assert bins[0] > bins[1] and sum(lengths) / 2048 / bins[0] > 0.97  # the bound closes bins, at little loss


def test_op4_leaves_no_broadcast_and_hands_on_few_rows_at_once(spark, monkeypatch):
    import os

    kind, made = type(spark.sparkContext), []
    make = kind.broadcast
    monkeypatch.setattr(kind, "broadcast", lambda self, v: made.append(make(self, v)) or made[-1])
    d = spark.createDataFrame([(i, f"some words and word{i} again") for i in range(40)], "doc_id long, text string")
    got = lm.lm_scores(d)
    assert len(made) == 5 and not any(os.path.exists(b._path) for b in made)
    assert got.count() == 40
    b = pa.RecordBatch.from_pydict({"x": list(range(2500))})
    assert [p.num_rows for p in lm._slices(iter([b]))] == [1024, 1024, 452]


def test_op8_new_words_are_encoded_together():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    class Counting:
        def __init__(self, tok):
            self.tok, self.calls = tok, 0

        def __getattr__(self, name):
            self.calls += name.startswith("encode")
            return getattr(self.tok, name)

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    letters = np.array(list("abcdeéñßX"))
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(letters, rng.integers(1, 12)))
    texts = ["".join(word() + str(rng.choice(["", ",", ".", "!!", ".\n" + word(), "\n" + word() + ","])) + " " for _ in range(200)) + "end" for _ in range(20)]
    want = [packing._pack_ids(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    seen = Counting(tok)
    words = packing._Words(seen)
    split = [("\0" + t).split(" ") for t in texts]
    assert list(words.of(split)) == want and seen.calls < 50 and len(words) > 2000
    words.most = 300
    for _ in range(2):  # too many words: they are dropped and met again
        assert [next(words.of([s])) for s in split] == want and len(words) < 1200
    words.heads = {m: h & False for m, h in words.heads.items()}  # no byte-level vocabulary
    words.clear()
    assert list(words.of(split)) == want


def test_op8_packs_in_the_order_of_arrival(spark):
    rows = [(i, 0, 0, int(n), 7) for i, n in enumerate(np.random.default_rng(5).integers(1, 2049, 3000))]
    d = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(d, group_pieces=10_000).withColumn("arrival", F.xxhash64("doc_id", "piece", "ids_crc32")).orderBy("arrival").collect()
    free, made = {}, 0  # by plain search: the open bin with the least room that holds the piece, else a new one, the fullest making way
    for r in got:
        fit = [(room, b) for b, room in free.items() if room >= r["length"]]
        if fit:
            room = min(fit)[0]
            b = r["sequence_id"]
            assert free[b] == room
        else:
            if len(free) >= packing.OPEN_BINS:
                least = min(free.values())
                free.pop([b for b, x in free.items() if x == least][-1])
            b, room = made, 2048
            made += 1
            assert r["sequence_id"] == b
        assert r["offset"] == 2048 - room
        free.pop(b, None)
        if room > r["length"]:
            free[b] = room - r["length"]  # the latest of its room


def png_truth(data):
    """The samples of a PNG, a byte at a time."""
    at, packed = 8, b""
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        packed += data[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    raw, out, above = zlib.decompress(packed), b"", [0] * 64
    for y in range(0, len(raw), 65):
        row = []
        for x, v in enumerate(raw[y + 1 : y + 65]):
            a, b, c = row[x - 1] if x else 0, above[x], above[x - 1] if x else 0
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            row.append((v + [0, a, b, (a + b) // 2, near][raw[y]]) % 256)
        above, out = row, out + bytes(row)
    return out


def feature_truth(payload):
    x = np.frombuffer(payload, np.uint8).reshape(-1, 64).astype(float)
    rows = [sum(max(0.0, min(y + 1, (i + 1) * len(x) / 32) - max(y, i * len(x) / 32)) * x[y] for y in range(int(i * len(x) / 32), min(len(x), int((i + 1) * len(x) / 32) + 1))) * 32 / len(x) for i in range(32)]
    small = np.array(rows).reshape(32, 32, 2).mean(axis=2)
    low = [round(sum(small[y, x] * np.cos(np.pi * u * (2 * y + 1) / 64) * np.cos(np.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
    mid = np.median(low[1:])
    return f"{int(''.join(str(int(c > mid)) for c in low), 2):016x}"


def test_op9_round_trip(spark, docs, texts, odd):
    for d in (docs, odd):
        rows = media.digest(d).collect()
        assert len(rows) == d.count()
        for r in rows:
            if r["doc_id"] in texts and d is docs:
                raw = (texts[r["doc_id"]] or "").encode()
                pay = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
                assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:]))
                assert len(r["feature"]) == 16 and bytes(r["feature_bits"]).hex() == r["feature"] == feature_truth(pay)
    kept = media.media_columns(docs.limit(5), keep_media=True).collect()
    assert all(hashlib.sha256(r["media"]).hexdigest() == r["media_sha256"] and len(r["media"]) == r["media_bytes"] for r in kept)
    assert {k for r in media.digest(docs).select("filters").distinct().collect() for k in r[0]} == set("01234")
    for r in kept:
        assert png_truth(bytes(r["media"])) == media.payload_of(r["text"])[0]


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4, None])
def test_op9_png_filters_and_checksums(kind):
    data = np.random.default_rng(kind or 9).integers(0, 256, 576, np.uint8).tobytes()
    png = media.png_write(data, filter_type=kind)
    assert media.png_read(png).tobytes() == data
    for at in (12, 30, len(png) - 3):
        with pytest.raises(ValueError):
            media.png_read(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])
    broken = png[:33] + media._chunk(b"IDAT", b"no deflate stream") + media._chunk(b"IEND", b"")
    for bad in (broken, png[:8] + media._chunk(b"IHDR", b"short") + png[33:], png[:40], b""):
        with pytest.raises(ValueError):
            media.png_read(bad)


def test_op9_average_and_paeth():
    rng = np.random.default_rng(9)
    images, plain = [], []
    for tall in (7, 1, 12, 3):
        rows = rng.integers(0, 256, (tall, 5)).astype(int)
        raw = np.zeros((tall, 6), np.uint8)
        for y in range(tall):
            raw[y, 0] = rng.integers(0, 5)
            for x in range(5):
                a, b = rows[y, x - 1] if x else 0, rows[y - 1, x] if y else 0
                c = rows[y - 1, x - 1] if x and y else 0
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                raw[y, x + 1] = (rows[y, x] - [0, a, b, (a + b) // 2, near][raw[y, 0]]) % 256
        images.append(raw)
        plain.append(rows)
    assert [x.tolist() for x in media.unfilter(images)] == [x.tolist() for x in plain]


def test_op10_held_out_accuracy_and_odd_rows(spark, docs, odd):
    rows = langid.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in test]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    got = {r["doc_id"]: r for r in langid.digest(odd).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (3, 4, 5, 9))
    assert {r["lang_pred"] for r in langid.language_of(docs.limit(5), F.lit(False)).collect()} == {"und"}
    assert langid.digest(spark.createDataFrame([], EMPTY)).count() == 0


def test_op10_forward_backward():
    rng = np.random.default_rng(0)
    e, a = rng.random((70, 3)), rng.random((3, 3))
    g, pairs = langid.marginals(e, a, langid.Lanes(np.array([65, 0, 5])), True)
    at, want = 0, np.zeros((3, 3))
    for n in (65, 5):
        x = e[at : at + n]
        al, v = np.zeros((n, 3)), np.full(3, 1 / 3)
        for i in range(n):
            v = (v @ a) * x[i]
            v /= v.sum()
            al[i] = v
        be = np.ones(3)
        for i in range(n - 1, -1, -1):
            p = al[i] * be
            assert np.allclose(g[at + i], p / p.sum())
            if i:
                q = a * np.outer(al[i - 1], x[i] * be)
                want += q / q.sum()
            be = a @ (x[i] * be)
            be /= be.sum()
        at += n
    assert np.allclose(pairs, want)


def test_components_of_paths_and_stars(spark):
    rng = np.random.default_rng(6)
    e = [(i, i + 1) for i in range(100, 160)] + [(5, int(x)) for x in range(200, 260)] + [(7, 7)] + [tuple(map(int, x)) for x in rng.integers(300, 400, (60, 2))]
    got = {r["node"]: r["component"] for r in _common.connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    ids = sorted({x for p in e for x in p})
    lab = groups(len(ids), [(ids.index(a), ids.index(b)) for a, b in e])
    for x, g in zip(ids, lab):
        assert got.get(x, x) == ids[g]


def test_components_of_a_long_path(spark):
    e = spark.range(5000).selectExpr("id + 1 AS a", "id AS b")
    assert _common.connected_components(e).agg(F.max("component"), F.count("*")).first() == (0, 5001)


def test_components_in_one_bucket_take_few_jobs_and_equal_those_of_many(spark):
    e = spark.range(3000).selectExpr("xxhash64(id) % 2000 AS a", "xxhash64(id, 1) % 2000 AS b").localCheckpoint()
    found = {}
    for size in (1 << 16, 400):
        spark.sparkContext.setJobGroup(f"components-{size}", "")
        found[size] = _common.connected_components(e, size)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components-{size}"))
        found[size] = sorted(map(tuple, found[size].collect()))
        assert size == 400 or jobs < 12
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found[400] == found[1 << 16] and len(found[400]) > 1000


def test_hot_keys_meet_every_row(spark):
    rows = spark.range(4000).selectExpr("IF(id < 2500, 0, id) AS key", "id AS x")
    table = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("x").alias("first"))
    got = _common.meet(rows, table, "key", 4000)
    assert got.count() == 4000 and got.where("first <> IF(x < 2500, 0, x)").count() == 0


def test_tiles_meet_every_pair_once(spark):
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(2, i) for i in range(3)], "key int, x int")
    t = _tiles.tiled(rows, "key", F.xxhash64("x"), 8).collect()
    met = collections.Counter()
    by = collections.defaultdict(list)
    for r in t:
        by[r["key"], r["t0"], r["t1"]].append((r["x"], r["block"]))
    for (k, a, b), xs in by.items():
        met.update((k, *sorted((x, y))) for i, (x, p) in enumerate(xs) for y, q in xs[i + 1 :] if a == b or p != q)
    assert set(met.values()) == {1} and len(met) == 50 * 49 // 2 + 3


def test_pipeline_stages(spark, docs):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [d.count()]
    for name, stage in corpus_pipeline.STAGES:
        d = _common.written(stage(spark, d, DATA))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert d.columns == list(corpus_pipeline.COLUMNS)
        seen.append(d.count())
    assert seen[1] < seen[0] and seen[2] == seen[1] and seen[3] <= seen[2] and seen[5] >= seen[4]
    assert corpus_pipeline.run(spark, DATA).agg(F.sum("length")).first()[0] == d.agg(F.sum("length")).first()[0]


def test_pipeline_on_odd_rows(spark, odd):
    d = odd.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        d = _common.written(stage(spark, d, DATA))
    assert d.where("doc_id IS NULL OR doc_id IS NOT NULL").count() == d.count()
    e = spark.createDataFrame([], EMPTY)
    for _, stage in corpus_pipeline.STAGES:
        e = _common.written(stage(spark, e, DATA))
    assert e.count() == 0
    twice = spark.createDataFrame([(7, "one text of a few words in all", "en", "x", 1)] * 3 + [(8, "one text of a few words in all", "en", "x", 1), (7, "quite another one under the same name here", "en", "x", 1)], EMPTY)
    kept = sorted((r["doc_id"], r["text"][:3]) for r in corpus_pipeline.near_duplicate_stage(spark, twice, DATA).collect())
    assert kept == [(7, "one"), (7, "qui")]


def test_columns_of_any_name_and_type(spark):
    d = spark.createDataFrame([(1, "one line of a text\nand another", "en", "x", 1), (2, "one line of a text", "en", "x", 1)], EMPTY).withColumns({"a`b": F.lit(1), "x.y": F.struct(F.lit(1).alias("p q"), F.lit("s").alias("r.s"))})
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    for out in (quality.quality_scores(d, labels), line_dedup.line_dedup(d), suffix_dedup.suffix_dedup(d), media.media_columns(d), mixing.mix_draws(d), langid.language_of(d)):
        row = out.where("doc_id = 1").first().asDict()
        assert row["a`b"] == 1 and row["x.y"]["p q"] == 1


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
