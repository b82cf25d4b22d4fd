"""Benchmark decontamination: a prefix-filtered set join of item windows with documents, in DataFrame functions only.

A window is `window` consecutive words of an item; an item of fewer words is
one window. As sets of shingles a document must hold every shingle of a window
that occurs in it, so one necessary prefix token is enough: the rarest of the
window's shingles, by their counts over all documents. Documents' shingles meet
these tokens only; a match says where the window would begin, the bounds of
length and position say whether it fits there, and the words are compared one
by one. Nothing is decided by a hash.

Every document is read and cut into words once, into a written table. Tokens
are broadcast once they have been counted; a benchmark with more windows than
that meets the shingles in a join by token that adaptive execution can split,
and then a position carries the words around it instead of the text. What is
counted or joined has a row for each position of a document; no list of all
positions of a shingle and no pair of documents is made.

Defined cases: null and empty texts and texts of separators have no word: such
an item has no window, such a document is clean. Rows that repeat a doc_id are
documents of their own, null ids too. Rows of one item_id are one item with the
windows of all of them; a null item_id is an item, written as an empty string.
Without items every document is clean. Other columns of documents pass by in
`contamination`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, Written, named, small
from ..functions.tables import SMALL_ROWS

WINDOW = 10
#: Words of a shingle, where the window has as many.
SHINGLE = 3
_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_ADDED = ("n_words", "n_hit", "n_items", "items", "spans", "contaminated")


def words(text: Column) -> Column:
    """A-Z lower-cased, cut at everything in ASCII that is neither letter nor digit."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), _SEPARATORS), "")


def shingled(rows: DataFrame, widths: list[int]) -> DataFrame:
    """rows (…, words) with pos, width and token: a hash of the `width` words from word pos on, for every position and width."""
    n = F.size("words")
    shifted = [F.slice("words", i + 1, n).alias(f"_w{i}") for i in range(max(widths, default=1))]
    at = rows.select("*", *shifted).withColumn("_z", F.arrays_zip(*[f"_w{i}" for i in range(len(shifted))]))
    at = at.select(*rows.columns, F.posexplode("_z").alias("pos", "_z"))

    def token(width: int) -> Column:
        there = F.col(f"_z._w{width - 1}").isNotNull()
        return F.when(there, F.xxhash64(F.lit(width), *[F.col(f"_z._w{i}") for i in range(width)]))

    if len(widths) == 1:
        at = at.withColumn("width", F.lit(widths[0])).withColumn("token", token(widths[0]))
    else:
        each = F.array(*[F.struct(F.lit(w).alias("width"), token(w).alias("token")) for w in widths])
        at = at.withColumn("_t", F.explode(each)).select("*", "_t.width", "_t.token").drop("_t")
    return at.where(F.col("token").isNotNull()).drop("_z")


def item_windows(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(wid, words, length, width) of the distinct windows, and (wid, item_id) of the items that hold them."""
    cut = items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    cut = cut.withColumn("length", F.least(F.size("words"), F.lit(window)))
    each = cut.select("item_id", "words", "length", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("length"))).alias("at"))
    each = Written(each.select("item_id", F.expr("slice(words, at + 1, length)").alias("words"), "length").distinct()).df
    distinct = each.select("words", "length").distinct().withColumn("width", F.least("length", F.lit(SHINGLE)))
    distinct = Written(distinct.withColumn("wid", F.monotonically_increasing_id())).df
    return distinct, Written(each.join(distinct.select("words", "wid"), "words").select("wid", "item_id")).df


def prefixes(docs: DataFrame, windows: DataFrame, widths: list[int]) -> DataFrame:
    """(wid, words, length, token, offset) of windows that may occur: the rarest shingle, and the words before it."""
    of = shingled(windows.drop("width"), widths).where("width = least(length, %d)" % SHINGLE)
    of = Written(of.select("wid", "token", F.col("pos").alias("offset"))).df
    vocabulary = small(Written(of.select("token").distinct()).df)
    counts = shingled(docs.select("words"), widths).join(vocabulary, "token").groupBy("token").agg(F.count("*").alias("n"))
    ranked = of.join(small(Written(counts).df), "token", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("r"))
    return windows.join(ranked.where("r.n > 0").select("wid", "r.token", "r.offset"), "wid").drop("width")


def occurrences(docs: DataFrame, windows: DataFrame, window: int) -> DataFrame:
    """(row, start, length, wid): every place in docs (row, n_words, words) where a window occurs."""
    widths = sorted(r["width"] for r in windows.select("width").distinct().collect()) or [SHINGLE]  # SHINGLE numbers at most
    rare = Written(prefixes(docs, windows, widths)).df.withColumnsRenamed({"words": "_words", "length": "_length"})
    at = shingled(docs.select("row", "n_words", "words"), widths).drop("width")
    if rare.count() <= SMALL_ROWS:
        rare, first = F.broadcast(rare), F.lit(0)
    else:
        at = at.withColumn("_first", F.greatest(F.col("pos") - (window - 1), F.lit(0))).withColumn("words", F.expr(f"slice(words, _first + 1, {2 * window - 1})"))
        first = F.col("_first")
    start = F.col("pos") - F.col("offset")
    met = at.join(rare, "token").where((start >= 0) & (start + F.col("_length") <= F.col("n_words")))
    met = met.where(F.slice("words", start - first + 1, F.col("_length")) == F.col("_words"))
    return met.select("row", start.alias("start"), F.col("_length").alias("length"), "wid")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_hit (words inside occurrences), n_items, items (their ids as sorted text), spans (start and length of occurrences) and contaminated."""
    kept = F.struct(*[named(c) for c in docs.columns if c not in _ADDED])
    cut = Written(docs.select(kept.alias("doc"), words(F.col("text")).alias("words")).withColumn("row", F.monotonically_increasing_id()).withColumn("n_words", F.size("words").cast("long"))).df
    windows, holders = item_windows(items, window)
    found = Written(occurrences(cut, windows, window)).df
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.groupBy("row", "start").agg(F.max("length").alias("length")).withColumn("end", F.col("start") + F.col("length"))
    fresh = F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))
    hit = spans.withColumn("fresh", F.greatest(fresh, F.lit(0))).groupBy("row").agg(
        F.sum("fresh").alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "length"))).alias("spans")
    )
    of = found.select("row", "wid").distinct().join(holders, "wid").select("row", "item_id").distinct()
    of = of.groupBy("row").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("items"))
    added = {"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "n_items": F.coalesce("n_items", F.lit(0)).cast("long"), "items": F.coalesce("items", F.array().cast("array<string>")), "contaminated": F.col("n_hit").isNotNull()}
    return cut.select("doc", "row", "n_words").join(hit, "row", "left").join(of, "row", "left").withColumns(added).select("doc.*", *_ADDED)


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = contamination(docs.select("doc_id", "text"), items)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


_WORDS_SQL = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS_SQL} AS ws FROM documents),
i AS (SELECT item_id, ws, least(len(ws), {WINDOW}) AS l FROM (SELECT item_id, {_WORDS_SQL} AS ws FROM benchmark) WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, l, list_slice(ws, k + 1, k + l) AS win FROM (SELECT item_id, ws, l, unnest(range(len(ws) - l + 1)) AS k FROM i)),
x AS (SELECT rid, l, st, list_slice(ws, st + 1, st + l) AS win
      FROM (SELECT rid, ws, l, unnest(range(len(ws) - l + 1)) AS st FROM d, (SELECT DISTINCT l FROM i) WHERE len(ws) >= l)),
h AS (SELECT x.rid, x.st, x.l, w.item_id FROM x JOIN w ON x.l = w.l AND x.win = w.win),
n AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(st, st + l)) AS pos FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(coalesce(CAST(item_id AS VARCHAR), ''), ',' ORDER BY coalesce(CAST(item_id AS VARCHAR), '')) AS ids
      FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY rid)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, n.rid IS NOT NULL AS contaminated
FROM d LEFT JOIN n ON d.rid = n.rid LEFT JOIN t ON d.rid = t.rid
"""
