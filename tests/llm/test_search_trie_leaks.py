"""Operators 11 to 13 against brute force, and on awkward rows."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from cytoframe.llm import decontaminate, queries, search, trie

DATA = "/root/testdata/sf0.001"


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


# -- 11


def trie_truth(rows, fan_out=20):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            content = f"{len(role or '')}:{role or ''}:{text or ''}"
            own[c].append(((turn is not None, turn or 0), hashlib.md5(content.encode()).hexdigest(), (role or "", text or "")))
    own = {c: [t for *_, t in sorted(x)] for c, x in own.items()}
    made = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - int(math.fmod(c, fan_out)), [])[:h] + x[h:]
    nodes = collections.defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            nodes[tuple(made[c][:d])].append(c)
    children = collections.Counter(k[:-1] for k in nodes if k)
    saved, leaves = collections.Counter(), collections.Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(members) - 1) * len(re.findall("[^\x20\x09-\x0d]+", k[-1][1])) if k else 0
            leaves[k[:d]] += k not in children
    return sorted(
        (m[0], len(k), nodes[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], sha(",".join(str(c) for c in m if len(made[c]) == len(k))))
        for k, m in nodes.items()
    )


def trie_rows(df):
    return sorted(map(tuple, trie.digest(df).collect()))


SPEC = "conv_id long, turn long, role string, text string"


def key(r):
    return tuple((x is not None, x) for x in r)


def test_op11_equals_brute_force(spark):
    df = spark.read.parquet(f"{DATA}/conversations.parquet")
    assert sorted(trie_rows(df), key=key) == sorted(trie_truth(map(tuple, df.select("conv_id", "turn", "role", "text").collect())), key=key)


def test_op11_odd_rows_and_any_partitioning(spark):
    rows = [(20, 0, "user", "one two"), (20, 1, "user", "three"), (20, 1, "user", "three"), (20, None, None, None), (25, 0, None, "x"), (25, 3, "user", None), (25, 3, "a", ""),
            (None, 0, "user", "nobody"), (-21, 0, "u", "minus"), (-20, 0, "u", "donor"), (-20, 1, "u", "donor"), (7, 0, "u", "")]
    rows += [(c, t, "user", f"turn {t} of " + "many words " * 3) for c in range(100, 140) for t in range(c % 7)]  # copies
    rows += [(60, t, "user", str(t // 2)) for t in range(900)] + [(61, t, "user", str(t // 2)) for t in range(905)]  # long ones
    want = sorted(trie_truth(rows), key=key)
    for n in (1, 7):
        df = spark.createDataFrame(rows, SPEC).repartition(n).withColumns({"depth": F.lit("x"), "c": F.lit(1), "a": F.lit(2.5)})
        assert sorted(trie_rows(df), key=key) == want
    assert trie_rows(spark.createDataFrame([], SPEC)) == []


def test_op11_sql_on_odd_rows(spark):
    rows = [(20, 0, "user", "one"), (20, 1, None, "two"), (25, None, "user", None), (25, 1, "user", "q"), (41, 1, "user", "q"), (None, 1, "user", "q")]
    c = duckdb.connect()
    c.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    c.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert sorted(c.execute(trie.SQL).fetchall(), key=key) == sorted(trie_rows(spark.createDataFrame(rows, SPEC)), key=key) == sorted(trie_truth(rows), key=key)


def test_op11_end_lists_longer_than_a_block(spark, monkeypatch):
    rows = [(c, 0, "user", "same") for c in range(200)]
    want = trie_truth(rows)
    monkeypatch.setattr(trie, "BLOCK", 7)
    assert trie_rows(spark.createDataFrame(rows, SPEC)) == want


# -- 12


def words(t):
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", fold(t)) if w]


def leak_truth(docs, items, window=10):
    held = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            held[tuple(w[k : k + n])].add(i)
    lengths, out = {len(k) for k in held}, []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if x := held.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= x
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted("" if x is None else str(x) for x in found))), bool(hit)))
    return sorted(out, key=key)


def leak_rows(d, b):
    return sorted(map(tuple, decontaminate.digest(d, b).collect()), key=key)


def test_op12_equals_brute_force(spark):
    d, b = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    want = leak_truth([(r["doc_id"], r["text"]) for r in d.collect()], [(r["item_id"], r["text"]) for r in b.collect()])
    assert leak_rows(d, b) == want and any(r[2] for r in want) and not all(r[2] for r in want)


@pytest.fixture(scope="module")
def odd(spark):
    base = " ".join(f"w{i}" for i in range(40))
    docs = [(1, base), (1, base), (1, "w3, W4; w5"), (None, "x " + base.upper() + " y"), (2, None), (3, ""), (4, "?!"), (5, "alpha"), (6, "alpha beta alpha beta"), (7, "the " * 3000), (8, "ñandú Ñandú ÉTÉ"), (9, base.replace("w20", "z"))]
    items = [(1, " ".join(f"w{i}" for i in range(5, 30))), (1, "alpha beta"), (2, "alpha"), (None, "ñandú Ñandú"), (3, None), (4, "--"), (5, "the " * 12), (10, " ".join(f"w{i}" for i in range(5, 15))), (6, "not there at all")]
    more = {"row": F.lit("r"), "token": F.lit(1), "n_hit": F.lit(2.5), "words": F.lit("w"), "wid": F.lit(0), "items": F.lit("i"), "c`d.e": F.lit(3)}
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string").withColumns(more), spark.createDataFrame(items, "item_id long, text string").withColumns(more)


def test_op12_odd_rows(spark, odd, monkeypatch):
    docs, items, d, b = odd
    want = leak_truth(docs, items)
    assert leak_rows(d, b) == want
    assert leak_rows(d.repartition(5), b.repartition(3)) == want
    monkeypatch.setattr(decontaminate, "SMALL_ROWS", 0)  # as for a benchmark that is too large to broadcast
    assert leak_rows(d, b) == want
    out = decontaminate.contamination(d, b)
    assert out.count() == len(docs) and {"token", "wid", "c`d.e"} <= set(out.columns)
    spans = {tuple(s) for r in out.where("doc_id = 6").collect() for s in r["spans"]}
    assert spans == {(0, 2), (2, 2)}
    assert leak_rows(d, b.limit(0)) == leak_truth(docs, []) and leak_rows(d.limit(0), b) == []


def test_op12_no_python_on_the_path(spark, odd):
    plan = decontaminate.digest(odd[2], odd[3])._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExternalRDD", plan)


def test_op12_op13_sql_on_odd_rows(spark, odd):
    docs, items, d, b = odd
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.execute("create table benchmark (item_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", docs)
    c.executemany("insert into benchmark values (?, ?)", items)
    assert sorted(c.execute(decontaminate.SQL).fetchall(), key=key) == leak_truth(docs, items)


# -- 13


def search_truth(docs, items, top=20):
    term = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", fold(t))
    docs = [(i, term(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in docs), sum(len(w) for _, w in docs)
    df = collections.Counter(t for _, w in docs for t in set(w))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for t, k in df.items()}
    held, out = collections.defaultdict(collections.Counter), []
    for i, t in items:
        held[i].update(term(t))
    for i, q in held.items():
        scores = []
        for j, w in docs:
            tf, m = collections.Counter(w), 75 + (25 * len(w) * n_docs) // n_terms if n_terms else 0
            scores.append((-sum(k * weight.get(t, 0) * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m)) for t, k in q.items() if tf[t]), j is None, j or 0, j))
        out += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(sorted(scores, key=lambda x: x[:3])[:top]) if s]
    return sorted(out, key=key)


def search_rows(d, b, **more):
    return sorted(map(tuple, search.lexical_search(d, b, **more).collect()), key=key)


def test_op13_equals_brute_force(spark):
    d, b = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    want = search_truth([(r["doc_id"], r["text"]) for r in d.collect()], [(r["item_id"], r["text"]) for r in b.collect()])
    assert search_rows(d, b) == want
    assert search_rows(d.repartition(5), b, lead_share=0.5) == want


def test_op13_pruning_keeps_the_top(spark):
    """Frequent and rare terms, many ties, few results: whatever the partial sums say, the ranks are those of all terms."""
    docs = [(i, " ".join(w for j, w in enumerate(("the", "of", "a", "b", "c", "d", "e", "f", "g")) if i % (j + 1) == 0) + " the" * (i % 5)) for i in range(400)]
    items = [(0, "the of"), (1, "g the the"), (2, "the the of a b c d e f g"), (3, "e f nothere"), (4, "nothere")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for top, share in ((3, 0.01), (20, 0.01), (20, 1.0), (1000, 0.01)):
        assert search_rows(d, b, k=top, lead_share=share) == search_truth(docs, items, top)


def test_op13_odd_rows(spark, odd):
    docs, items, d, b = odd
    assert search_rows(d, b) == search_truth(docs, items)
    assert search_rows(d.limit(0), b) == [] == search_rows(d, b.limit(0))
    nothing = spark.createDataFrame([(1, None), (2, " . ")], "doc_id long, text string")
    assert search_rows(nothing, b) == []


def test_queries_are_registered():
    assert {"op11_prefix_trie", "op12_decontamination", "op13_ranked_search"} <= queries.queries().keys() & queries.oracle_sql().keys()
