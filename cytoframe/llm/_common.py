"""Shared pieces: written tables in the shared folder, connected components, hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.tables import Written, meet, release, shared_dir, small, written  # noqa: F401

#: ASCII white space as the contracts define it.
WS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def map_in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], spec: StructType) -> DataFrame:
    """df.mapInArrow(run, spec), whatever the columns' names: Spark sees plain ones, run the real ones."""
    names, plain, made = df.columns, [f"c{i}" for i in range(len(df.columns))], [f"c{i}" for i in range(len(spec))]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(pa.RecordBatch.from_arrays(b.columns, names) for b in batches):
            yield pa.RecordBatch.from_arrays(out.columns, made)

    schema = StructType([StructField(n, f.dataType, f.nullable) for n, f in zip(made, spec.fields)])
    return df.toDF(*plain).mapInArrow(own, schema).toDF(*spec.names)


def give_back() -> None:
    """Returns memory that this worker has freed to the system, so that what an earlier task needed doesn't add to what the next one does."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, with memory given back before and after, when its own variables are gone."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return own


def named(name: str) -> Column:
    """The column of that very name, whatever marks are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id's decimal text falls in the fold; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Edges whose components one task works out at a time.
BUCKET_EDGES = 1 << 16


def _forest(edges: DataFrame, buckets: int) -> DataFrame:
    """(u, v), u > v: of each bucket of edges (u, v), its nodes with the least that they hang together with in it; connects what edges do."""

    def run(key, g):
        above: dict = {}

        def least(x):
            while (y := above.get(x, x)) != x:
                above[x] = above.get(y, y)
                x = y
            return x

        for u, v in zip(g.column("u").to_pylist(), g.column("v").to_pylist()):
            a, b = least(u), least(v)
            above[max(a, b)] = min(a, b)
        nodes = [x for x in above if least(x) != x]
        kinds = [g.schema.field(c).type for c in "uv"]
        return pa.table({"u": pa.array(nodes, kinds[0]), "v": pa.array([least(x) for x in nodes], kinds[1])})

    return edges.withColumn("bucket", F.pmod(F.xxhash64("u", "v"), F.lit(buckets))).groupBy("bucket").applyInArrow(run, edges.schema)


def connected_components(edges: DataFrame, bucket_edges: int = BUCKET_EDGES) -> DataFrame:
    """(node, component): component is the smallest node reachable over edges (a, b).

    Buckets of edges, as many as keep each to about bucket_edges, become stars,
    each in a task. One bucket is the answer; of several, the stars go through
    large-star and small-star steps in turns until the edge table stops changing;
    each is a minimum by key, combined before the shuffle, and a join back that
    adaptive execution can split where a hub is hot. Nothing but two
    numbers a round reaches the driver. Nodes without an edge are not returned.
    """
    e = Written(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    buckets = -(-e.df.count() // bucket_edges)
    if buckets:
        stars = Written(_forest(e.df, buckets).distinct() if buckets > 1 else _forest(e.df, buckets))
        e.drop()
        e = stars
    seen = None
    while buckets > 1:  # edges only ever get shorter, so it ends
        n, digest = e.df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if (n, digest) == seen or not n:
            break
        seen = (n, digest)
        both = e.df.union(e.df.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # the smallest neighbour of each u now bounds it from below; u > v throughout
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(low, "u")
        small = j.select(F.col("v").alias("u"), F.col("m").alias("v")).union(j.select("u", F.col("m").alias("v")))
        nxt = Written(small.where("u != v").distinct())
        e.drop()
        e = nxt
    # at the end every edge points from a node to the least of its component
    out = e.df.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return out.union(out.select("component", "component").distinct())
