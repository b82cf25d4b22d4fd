"""Conversation prefix trie: mergeable partial tries, hash-keyed tree merges, bottom-up rollup.

A node is a distinct sequence of first turns. Its key is its depth and 128 bits
that turns add to: each turn's hash, taken with its place, is xored in. So a
conversation's keys are running sums, which add up over parts of it, and a
conversation with a third of all turns is spread over many tasks like any other
rows (`functions.ordered.running`). No text leaves the first scan: rows hold hashes and counts.

* Partial tries: each task combines the rows of its part by node, with members
  counted, the smallest member and the members that end there.
* Merges: the parts' tables meet FAN at a time, keyed by node and part number,
  until one is left. A hot node has at most one row a part and batch in this.
  Lists of members that end at a node are merged in sorted blocks of BLOCK ids.
  The digest of a list is one sequential hash, so the blocks of one node pass
  through one task in order, a block at a time, ids only.
* Rollup: a node belongs to the path of its smallest member, and the nodes of
  one member make an unbroken end of its path, its chain. What hangs below a
  node is the chains of its members, less what lies above the node on its own
  chain: chains are summed once, from their ends, and added up by node. The
  number of steps doesn't grow with the depth.

Defined cases: a null role or text is empty. Turns of one number, null too, go
in the order of the md5 of their content; repeated rows are turns of their own.
Rows without a conv_id belong to no conversation and make no member. A rebuilt
conversation may be turnless; it is a member of the root and ends there. conv_id
modulo `fan_out` has the sign of conv_id, as in SQL. Without conversations there
is no root. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordered import running
from ._common import Written, map_in_arrow, meet
from .mixing import words

#: Tables that meet in one merge.
FAN = 32
#: Rows that a task combines at once, and ids of one block of a list.
COMBINE, BLOCK = 500_000, 65_536
#: Conversations that share the first turns of one of them.
FAN_OUT = 20

KEY = ["depth", "a", "b"]


def _turns(conversations: DataFrame) -> DataFrame:
    """(c, turn, content, words): the md5 of role and text, and the words of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, F.lit(":"), text).cast("binary"))
    return conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("c"), "turn", content.alias("content"), words(text).alias("words"))


def rebuilt(conversations: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """(c, depth, content, words, end): the turns of every rebuilt conversation, with a textless one at depth 0; end says that it is the last."""
    numbered = Written(running(_turns(conversations), ["c"], ["turn", "content"]).select("c", F.col("place").alias("pos"), "content", "words"))
    lengths = Written(numbered.df.groupBy("c").agg(F.count("*").alias("n"))).df
    plan = lengths.withColumn("h", F.crc32(F.col("c").cast("string").cast("binary")) % 4).withColumn("donor", F.col("c") - F.col("c") % fan_out)
    plan = plan.join(lengths.select(F.col("c").alias("donor"), F.col("n").alias("has")), "donor", "left")
    plan = plan.withColumn("taken", F.least("h", F.coalesce("has", F.lit(0)))).withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    plan = Written(plan.select("c", "donor", "n", "h", "taken", "length")).df
    first = numbered.df.where("pos <= 3").withColumnRenamed("c", "donor")
    head = plan.where("taken > 0").select("c", "donor", "taken", "length").join(first, "donor").where("pos <= taken").select("c", F.col("pos").alias("depth"), "content", "words", "length")
    own = meet(numbered.df, plan.select("c", "n", "h", "taken", "length"), "c", numbered.df.count()).where("pos > h")
    own = own.select("c", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "content", "words", "length")
    top = plan.select("c", F.lit(0).cast("long").alias("depth"), F.lit("").alias("content"), F.lit(0).cast("long").alias("words"), "length")
    every = top.unionByName(head).unionByName(own)
    return every.select("c", "depth", "content", "words", (F.col("depth") == F.col("length")).alias("end"))


def keyed(turns: DataFrame) -> DataFrame:
    """(c, depth, a, b, pa, pb, words, end): turns with the keys of their nodes and of the nodes' parents."""
    for x, seed in (("a", 1), ("b", 2)):
        turns = turns.withColumn(x, F.when(F.col("depth") > 0, F.xxhash64(F.lit(seed), "depth", "content")).otherwise(F.lit(0)).cast("long"))
    turns = turns.select("c", "depth", "words", "end", "a", "b", F.col("a").alias("pa"), F.col("b").alias("pb"))
    at = running(turns, ["c"], ["depth"], xors=("a", "b"))
    return at.select("c", *KEY, F.col("a").bitwiseXOR(F.col("pa")).alias("pa"), F.col("b").bitwiseXOR(F.col("pb")).alias("pb"), "words", "end")


_PARTIAL = T.StructType().add("depth", "long").add("a", "long").add("b", "long").add("pa", "long").add("pb", "long").add("n_convs", "long").add("conv_id", "long").add("words", "long").add("n_ends", "long").add("piece", "long")


def partial_tries(rows: DataFrame) -> DataFrame:
    """Each task's rows combined by node, COMBINE at a time: key, parent's key, members, smallest member, words, ends, and the task's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held, n = TaskContext.get().partitionId(), [], 0

        def out() -> pa.RecordBatch:
            x = pa.Table.from_batches(held).append_column("one", pa.array(np.ones(n, np.int64)))
            x = x.set_column(x.schema.get_field_index("end"), "end", x["end"].cast(pa.int64()))
            x = x.group_by([*KEY, "pa", "pb"]).aggregate([("one", "sum"), ("c", "min"), ("words", "max"), ("end", "sum")])
            x = x.select([*KEY, "pa", "pb", "one_sum", "c_min", "words_max", "end_sum"]).append_column("piece", pa.array(np.full(x.num_rows, piece, np.int64)))
            return x.rename_columns(_PARTIAL.names).combine_chunks().to_batches()[0]

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= COMBINE:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    return map_in_arrow(rows.select("c", *KEY, "pa", "pb", "words", "end"), run, _PARTIAL)


def merged(tables: DataFrame) -> DataFrame:
    """One table of nodes from partial ones: FAN pieces at a time are summed by key until one is left."""
    pieces = (tables.agg(F.max("piece")).first()[0] or 0) + 1
    while True:
        pieces = -(-pieces // FAN)
        tables = tables.groupBy(*KEY, "pa", "pb", (F.col("piece") % pieces).alias("piece")).agg(
            F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.sum("n_ends").alias("n_ends")
        )
        if pieces == 1:
            return tables.drop("piece")


def end_digests(rows: DataFrame) -> DataFrame:
    """(key, ends_sha256) of nodes where conversations end: the digest of their ids in ascending order.

    Ids are sorted in ranges by node and id; each task joins its ids in blocks,
    then the blocks of a node run through one hash in order.
    """
    sorted_ = rows.where("end").select(*KEY, "c").repartitionByRange(*KEY, "c").sortWithinPartitions(*KEY, "c")
    block = T.StructType().add("depth", "long").add("a", "long").add("b", "long").add("first", "long").add("ids", "string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = np.stack([b.column(k).to_numpy() for k in KEY])
            edge = (np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()
            ids = b.column("c").to_pylist()
            at = [(i, min(i + BLOCK, e)) for s, e in zip([0, *edge], [*edge, len(ids)]) for i in range(s, e, BLOCK)]
            starts = [s for s, _ in at]
            yield pa.RecordBatch.from_arrays([*[pa.array(k[starts]) for k in key], pa.array([ids[s] for s in starts], pa.int64()), pa.array([",".join(map(str, ids[s:e])) for s, e in at], pa.string())], block.names)

    blocks = map_in_arrow(sorted_, cut, block).repartition(*KEY).sortWithinPartitions(*KEY, "first")
    spec = T.StructType().add("depth", "long").add("a", "long").add("b", "long").add("ends_sha256", "string")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, None
        for b in batches:
            done = []
            for *key, ids in zip(*[b.column(c).to_pylist() for c in (*KEY, "ids")]):
                if key != last:
                    if last:
                        done.append((*last, sha.hexdigest()))
                    last, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if done:
                yield _batch(done, spec)
        if last:
            yield _batch([(*last, sha.hexdigest())], spec)

    return map_in_arrow(blocks, hashed, spec)


def _batch(rows: list[tuple], spec: T.StructType) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], spec.names)


def prefix_trie(conversations: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, n_ends, ends_sha256."""
    rows = Written(keyed(rebuilt(conversations, fan_out)))
    n_rows = rows.df.count()
    nodes = Written(merged(partial_tries(rows.df))).df
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    nodes = Written(running(nodes, ["conv_id"], ["depth"], sums=("saved",)).withColumn("above", F.col("saved") - (F.col("n_convs") - 1) * F.col("words"))).df

    chains = nodes.groupBy(F.col("conv_id").alias("c")).agg(F.max("saved").alias("total"), F.max_by((F.col("n_children") == 0).cast("long"), "depth").alias("leaf"), (F.max("depth") + 1).alias("n"))
    below = meet(rows.df.select("c", *KEY), Written(chains).df, "c", n_rows).groupBy(*KEY).agg(F.sum("total").alias("below"), F.sum("leaf").alias("n_leaves"))

    up = nodes.where("depth > 0").select(*KEY, F.struct((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).alias("parent"))
    parents = nodes.where("n_children > 0").select(F.struct(*KEY).alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    up = meet(up, parents, "parent", nodes.count()).drop("parent")

    out = nodes.join(below, KEY).join(up, KEY, "left").join(end_digests(rows.df), KEY, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("below") - F.col("above")).alias("saved_tokens"),
        "n_ends", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def digest(conversations: DataFrame) -> DataFrame:
    return prefix_trie(conversations).drop("n_ends")


#: Bit by bit, as SQL has no crc32; only its last two bits count.
_CRC = """list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: ascii(d)::BIGINT)),
  lambda s, x: list_reduce(list_concat([xor(s, x)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, 3988292384 * (r & 1))))"""
SQL = f"""
WITH t AS (SELECT conv_id AS c, turn, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), ':', coalesce(text, ''))) AS m,
             len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, m) AS pos, m, w FROM t),
l AS (SELECT c, c - c % {FAN_OUT} AS donor, xor({_CRC}, 4294967295) % 4 AS h FROM (SELECT DISTINCT c FROM o)),
g AS (SELECT l.c, l.h, least(l.h, count(d.pos)) AS took FROM l LEFT JOIN o d ON d.c = l.donor GROUP BY l.c, l.h),
r AS (SELECT c, 0 AS depth, '' AS m, 0 AS w FROM l
      UNION ALL SELECT l.c, o.pos, o.m, o.w FROM l JOIN o ON o.c = l.donor AND o.pos <= l.h
      UNION ALL SELECT o.c, o.pos - g.h + g.took, o.m, o.w FROM o JOIN g ON g.c = o.c WHERE o.pos > g.h),
k AS (SELECT c, depth, w, string_agg(m, '') OVER (PARTITION BY c ORDER BY depth ROWS UNBOUNDED PRECEDING) AS key,
        depth = max(depth) OVER (PARTITION BY c) AS last FROM r),
n AS (SELECT key, depth, min(c) AS conv_id, count(*) AS n_convs, max(w) AS w,
        string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last) AS ends FROM k GROUP BY key, depth),
ch AS (SELECT left(key, (32 * (depth - 1))::INTEGER) AS key, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
u AS (SELECT n.*, coalesce(ch.n_children, 0) AS n_children, (n.n_convs - 1) * n.w AS own FROM n LEFT JOIN ch ON n.key = ch.key AND n.depth = ch.depth),
s AS (SELECT k.key, k.depth, sum(u.own) AS saved, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves FROM u JOIN k ON k.c = u.conv_id AND k.depth <= u.depth GROUP BY 1, 2)
SELECT u.conv_id, u.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, u.n_convs::BIGINT AS n_convs, u.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(u.ends, '')) AS ends_sha256
FROM u JOIN s ON s.key = u.key AND s.depth = u.depth LEFT JOIN n p ON u.depth > 0 AND p.depth = u.depth - 1 AND p.key = left(u.key, (32 * (u.depth - 1))::INTEGER)
"""
