"""Ranked lexical search: term-bucketed postings, integer scores of matches, sums by item and document, top k by row number.

`postings` is the index of every term of every document: blocks of a term's
postings, dealt by term (a frequent term over SALT parts), sorted by term
within files, so that a file's statistics tell which terms it has.

A search joins item terms with postings, scores each match and sums by item
and document. Frequent terms match most documents and decide few ranks, so the
work goes in steps that leave the result exact:

1. the rarest terms of each item, together in about a hundredth of the
   documents, are summed; an item's k-th best of these partial sums can only be
   exceeded by its k-th best score;
2. the most frequent terms of an item whose greatest possible scores add up to
   less than that can't lift a document to the top on their own: only documents
   with one of the other terms are candidates, and of those only the ones that
   the frequent terms could still lift far enough;
3. candidates get the scores of all their terms, and the top k are kept in each
   task before the rows of an item meet.

Defined cases: null and empty texts and texts of separators only have no term:
they aren't counted and never found, and such items find nothing. Rows that
repeat a doc_id are documents of their own; equal ones rank by the hash of the
text's row. A null doc_id ranks after the others of its score. Rows of one
item_id, null too, are one item with the terms of all of them. Empty tables
give an empty result. Other columns of either table are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import LOWER, UPPER, Written, map_in_arrow, small

TOP = 20
#: Parts over which the postings of one term are dealt.
SALT = 16
#: Share of all documents that an item's rarest terms may be in for its first, partial sums.
LEAD_SHARE = 0.01
#: Postings that a worker lists by term at once.
FLUSH = 500_000
#: Bytes as terms see them: A-Z lower-cased, every separator a space. Bytes of 128 and more are parts of a term.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

_POSTINGS = T.StructType().add("term", "string").add("block", "long").add("rows", T.ArrayType(T.LongType())).add("tfs", T.ArrayType(T.IntegerType())).add("ns", T.ArrayType(T.IntegerType()))


def term_blocks(texts: DataFrame) -> DataFrame:
    """(term, block, rows, tfs, ns, ids) of texts (row, id, text): the postings of about FLUSH consecutive rows, listed by term, as a worker read them.

    A posting is a text's row, the term's count in it and the text's number of
    terms. The empty term lists every text that has any, with their ids. block is
    the first row.
    """
    spec = T.StructType([*_POSTINGS.fields, T.StructField("ids", T.ArrayType(texts.schema["id"].dataType))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, terms, tfs, ns, ids, kind = [], [], [], [], [], None

        def out() -> pa.RecordBatch:
            coded = pa.array(terms, pa.binary()).dictionary_encode()
            code = coded.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            ends = np.append(0, np.cumsum(np.bincount(code))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.array(x, t)[order])) for x, t in ((rows, np.int64), (tfs, np.int32), (ns, np.int32))]
            block = pa.array(np.full(len(coded.dictionary), rows[0], np.int64))
            of = pa.array([ids if t == b"" else None for t in coded.dictionary.to_pylist()], pa.list_(kind))
            for x in (rows, terms, tfs, ns, ids):
                x.clear()
            return pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), block, *lists, of], spec.names)

        for b in batches:
            kind = b.column("id").type
            for row, id_, text in zip(b.column("row").to_pylist(), b.column("id").to_pylist(), b.column("text").cast(pa.binary())):
                words = (text.as_py() or b"").translate(_BYTES).split()
                if not words:
                    continue
                found = Counter(words)
                k = len(found) + 1
                ids.append(id_)
                rows += [row] * k
                ns += [len(words)] * k
                terms.append(b"")
                tfs.append(0)
                terms += found.keys()
                tfs += found.values()
                if len(rows) >= FLUSH:
                    yield out()
        if rows:
            yield out()

    return map_in_arrow(texts.select("row", "id", "text"), run, spec)


def listed(blocks: DataFrame) -> DataFrame:
    """(term, row, tf, n): one row for each posting."""
    each = blocks.select("term", F.explode(F.arrays_zip("rows", "tfs", "ns")).alias("p"))
    return each.select("term", F.col("p.rows").alias("row"), F.col("p.tfs").cast("long").alias("tf"), F.col("p.ns").cast("long").alias("n"))


def postings(docs: DataFrame) -> Written:
    """The index in blocks. row numbers the documents, in no order that means anything, and the same in every block."""
    blocks = term_blocks(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("id"), "text"))
    return Written(blocks.repartition(F.col("term"), F.pmod(F.xxhash64("block"), F.lit(SALT))).sortWithinPartitions("term", "block"))


def lexical_search(docs: DataFrame, items: DataFrame, k: int = TOP, lead_share: float = LEAD_SHARE) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, best first."""
    named_items = Written(items.groupBy("item_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text")).withColumn("row", F.monotonically_increasing_id())).df
    wanted = Written(listed(term_blocks(named_items.withColumnRenamed("item_id", "id")).where("term != ''")).select(F.col("row").alias("item"), "term", F.col("tf").alias("repeats"))).df
    index = postings(docs)
    n_docs, n_terms = listed(index.df.where("term = ''")).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()

    vocabulary = small(Written(wanted.select("term").distinct()).df)
    m = f"(100L - 25L + ((25L * n * {n_docs}L) div {n_terms}L))"
    impacts = Written(listed(index.df.join(vocabulary, "term")).select("term", "row", F.expr(f"(1000000000L * tf) div (1000L * tf + 12L * {m})").alias("impact")))
    each = index.df.where("term = ''").select(F.explode(F.arrays_zip("rows", "ids")).alias("p"))
    ids = Written(each.select(F.col("p.rows").alias("row"), F.col("p.ids").alias("doc_id"))).df
    index.drop()
    terms = impacts.df.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("most"))
    terms = terms.withColumn("w", F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long"))
    plan = wanted.join(terms, "term").withColumn("weight", F.col("w") * F.col("repeats")).withColumn("bound", F.col("weight") * F.col("most"))
    rarest = Window.partitionBy("item").orderBy("df", "term")
    plan = plan.withColumn("upto", F.sum("df").over(rarest)).withColumn("after", F.sum("bound").over(rarest.rowsBetween(0, Window.unboundedFollowing)))
    plan = Written(plan.withColumn("place", F.row_number().over(rarest)).select("item", "term", "weight", "bound", "after", "upto", "place")).df

    best = Window.partitionBy("item").orderBy(F.desc("score"))
    lead = plan.where((F.col("place") == 1) | (F.col("upto") <= 1000 + lead_share * n_docs))
    first = summed(impacts.df, lead).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    least = first.groupBy("item").agg(F.min("score").alias("least"), F.count("*").alias("_n")).where(F.col("_n") == k).select("item", "least")
    plan = Written(plan.join(least, "item", "left").withColumn("least", F.coalesce("least", F.lit(0))).withColumn("needed", F.col("after") >= F.col("least"))).df

    rest = plan.groupBy("item").agg(F.max("least").alias("least"), F.coalesce(F.sum(F.when(~F.col("needed"), F.col("bound"))), F.lit(0)).alias("rest"))
    candidates = summed(impacts.df, plan.where("needed")).join(small(Written(rest).df), "item")
    candidates = Written(candidates.where(F.col("score") + F.col("rest") >= F.col("least")).select("item", "row", "score")).df
    others = Written(plan.where("not needed").select("item", "term", "weight")).df
    more = impacts.df.join(small(Written(others.select("term").distinct()).df), "term").join(candidates.select("item", "row"), "row")
    more = more.join(small(others), ["item", "term"]).select("item", "row", (F.col("weight") * F.col("impact")).alias("score"))
    scores = candidates.unionByName(more).groupBy("item", "row").agg(F.sum("score").alias("score")).where("score > 0").join(ids, "row")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    top = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(small(named_items.select(F.col("row").alias("item"), "item_id")), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def summed(impacts: DataFrame, plan: DataFrame) -> DataFrame:
    """(item, row, score): the sums of the matches of the plan's terms."""
    terms = small(Written(plan.select("item", "term", "weight")).df)
    return impacts.join(terms, "term").groupBy("item", "row").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    return lexical_search(docs, items)


_TERM_SQL = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {_TERM_SQL}) AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {_TERM_SQL}) AS ws FROM benchmark),
q AS (SELECT item_id, t, count(*) AS reps FROM (SELECT item_id, unnest(ws) AS t FROM i) GROUP BY item_id, t),
s AS (SELECT count(*) AS nd, sum(len(ws))::BIGINT AS nt FROM d WHERE len(ws) > 0),
p AS (SELECT rid, any_value(doc_id) AS doc_id, t, count(*) AS tf, any_value(n) AS n FROM (SELECT rid, doc_id, len(ws) AS n, unnest(ws) AS t FROM d) GROUP BY rid, t),
f AS (SELECT t, floor(1000 * ln((2 * s.nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY t, s.nd),
m AS (SELECT q.item_id, p.rid, any_value(p.doc_id) AS doc_id,
        sum(q.reps * f.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (100 - 25 + ((25 * p.n * s.nd) // s.nt)))))::BIGINT AS score
      FROM q JOIN p ON q.t = p.t JOIN f ON f.t = q.t, s GROUP BY q.item_id, p.rid),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, rid)::INTEGER AS rank, doc_id, score FROM m WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
