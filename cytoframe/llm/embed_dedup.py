"""Embedding near-dedup over a forest of random-projection trees.

Vectors are split recursively by random directions at the median of a bounded
sample; those within `spill` of a split go to both sides. Whatever shares a
leaf in any of the trees is compared in double precision, and the links found
are united. A pair that shares several leaves is counted in the least of them.

Each of the commonest lengths of vectors has its own forest; vectors of any
other length are one leaf. A leaf beyond `leaf_cap` is compared in tiles of
bounded size, so the sample's bound limits speed, never the result. Equal
vectors are one entry from the start, and a leaf sends on counts and spanning
links, not pairs.

Defined cases: vectors that are null, zero or with null or non-finite
components link with nothing, vectors of different lengths not with each other. So do rows with a null
vec_id, whose component is null. Repeated rows are vectors of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Written, connected_components, meet
from ._tiles import spanning, tiled

COSINE = 0.95
TREES = 6
LEAF_CAP = 4096
#: Most vectors that the trees of one length are fitted on, and most bytes of them.
SAMPLE, SAMPLE_BYTES = 65_536, 1 << 25
#: Lengths, the commonest first, that have a forest. Vectors of any further length are one leaf.
LENGTHS = 4
#: Spill to either side of a split, in standard deviations of the projected difference of a pair at the threshold.
SPILL = 0.45
#: A node that spills more than this is as dense as the links themselves and stays a leaf.
MAX_SPILL = 0.75
#: Rows of a leaf that are held against all of it at once.
_ROWS = 512


def fit_tree(sample: np.ndarray, leaf: int, spill: float, seed: int) -> list[tuple]:
    """Nodes (direction, threshold, low child, high child); a child below 0 is leaf number -1 - child."""
    rng = np.random.default_rng(seed)
    nodes: list[list] = []
    leaves = 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf:
            for _ in range(3):
                d = rng.standard_normal(sample.shape[1])
                d /= np.linalg.norm(d)
                p = sample[rows] @ d
                at = float(np.median(p))
                low, high = rows[p <= at + spill], rows[p >= at - spill]
                if max(len(low), len(high)) <= len(rows) * (1 + MAX_SPILL) / 2:
                    k = len(nodes)
                    nodes.append([d, at, 0, 0])
                    nodes[k][2], nodes[k][3] = grow(low), grow(high)
                    return k
        leaves += 1
        return -leaves

    root = grow(np.arange(len(sample)))
    return [tuple(n) for n in nodes] if root >= 0 else []


def route(tree: list[tuple], x: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of each leaf that each row of x falls in."""
    if not tree:
        return np.arange(len(x)), np.zeros(len(x), np.int64)
    todo, rows, leaves = [(0, np.arange(len(x)))], [], []
    while todo:
        k, at = todo.pop()
        if not len(at):
            continue
        if k < 0:
            rows.append(at)
            leaves.append(np.full(len(at), -1 - k, np.int64))
            continue
        d, cut, low, high = tree[k]
        p = x[at] @ d
        todo += [(low, at[p <= cut + spill]), (high, at[p >= cut - spill])]
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(leaves) if leaves else np.zeros(0, np.int64)


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # the norm of tiny or huge components neither vanishes nor overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


#: A vector that can link: named, with finite components, not all zero.
VALID = (
    "vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 "
    "AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)"
)


def classes_of(vectors: DataFrame) -> DataFrame:
    """(embedding, first, n) of the valid distinct vectors."""
    return vectors.where(VALID).groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))


def fit_forests(classes: DataFrame, cosine: float, trees: int, leaf_cap: int, sample: int, seed: int) -> dict[int, tuple[int, float, list]]:
    """By length of vector: its number, spill and trees, each fitted on a sample that is bounded in rows and bytes."""
    common = classes.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()
    out = {}
    for number, (dim, n) in enumerate(common):
        rows = max(1, min(sample, SAMPLE_BYTES // (8 * dim)))
        picked = classes.where(F.size("embedding") == dim).orderBy(F.xxhash64("first")).limit(rows).select("embedding").toArrow().column(0).combine_chunks()
        x = _unit(np.asarray(picked.flatten().to_numpy(zero_copy_only=False), np.float64), dim)
        spill = SPILL * float(np.sqrt((2 - 2 * cosine) / dim))
        leaf = max(16, int(leaf_cap * 0.6 * len(x) / max(n, 1)))
        out[dim] = number, spill, [fit_tree(x, leaf, spill, seed + t) for t in range(trees)]
    return out


def neighbour_links(classes: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf_cap: int = LEAF_CAP, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """(node, n_links) counts and (node, other) spanning links in one frame: other is null for a count."""
    shared = classes.sparkSession.sparkContext.broadcast(fit_forests(classes, cosine, trees, leaf_cap, sample, seed))
    kind = "<f4" if dict(classes.dtypes)["embedding"] == "array<float>" else "<f8"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            at = lists.offsets.to_numpy().astype(np.int64)
            flat = np.asarray(lists.values.to_numpy(zero_copy_only=False), kind)
            dims = np.diff(at)
            rows, leaves = [], []
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                if dim not in shared.value:
                    rows.append(own)
                    leaves.append(np.full(len(own), (1 << 60) + dim, np.int64))
                    continue
                number, spill, forest = shared.value[dim]
                x = _unit(flat[(at[own][:, None] + np.arange(dim)).ravel()], dim)
                for t, tree in enumerate(forest):
                    r, leaf = route(tree, x, spill)
                    rows.append(own[r])
                    leaves.append((((number << 16) + t) << 40) + leaf)
            row, leaf = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (rows, leaves))
            order = np.lexsort((leaf, row))
            starts = np.searchsorted(row[order], np.arange(len(dims) + 1))
            ids = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(leaf[order], pa.int64()))
            data = flat[at[0] : at[-1]].tobytes() if len(dims) else b""
            width = np.dtype(kind).itemsize
            x = pa.Array.from_buffers(pa.binary(), len(dims), [None, pa.py_buffer(((at - at[0]) * width).astype(np.int32).tobytes()), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), x, ids], ["first", "n", "x", "leaves"])

    routed = classes.select("embedding", "first", "n").mapInArrow(assign, "first bigint, n bigint, x binary, leaves array<bigint>")
    met = tiled(Written(routed.withColumn("leaf", F.explode("leaves"))).df, "leaf", F.xxhash64("first"), leaf_cap)

    def compare(key, g):
        leaf, t0, t1 = (k.as_py() for k in key)
        g = g.sort_by("first")
        node, copies, block = (g.column(c).to_numpy() for c in ("first", "n", "block"))
        data = g.column("x").to_pylist()
        x = _unit(np.frombuffer(b"".join(data), kind), len(data[0]) // np.dtype(kind).itemsize)
        # leaves before this one that two rows share: their pair is counted there
        lists = g.column("leaves").combine_chunks()
        off = lists.offsets.to_numpy()
        flat, row = lists.values.to_numpy()[off[0] : off[-1]], np.repeat(np.arange(len(node)), np.diff(off))
        early = flat < leaf
        names, at = np.unique(flat[early], return_inverse=True)
        held = np.zeros((len(node), len(names)), np.float32)
        held[row[early], at] = 1
        hit, counts = np.empty((len(node), len(node)), bool), np.zeros(len(node), np.int64)
        for i in range(0, len(node), _ROWS):
            hit[i : i + _ROWS] = x[i : i + _ROWS] @ x.T >= cosine
            if t0 != t1:
                hit[i : i + _ROWS] &= block[i : i + _ROWS, None] != block[None, :]
        np.fill_diagonal(hit, False)
        linked = np.flatnonzero(hit.any(axis=1))
        for i in range(0, len(linked), _ROWS):
            own = linked[i : i + _ROWS]
            counts[own] = (hit[own] & (held[own] @ held.T == 0)) @ copies
        tree = np.array(spanning(len(linked), lambda i, js: hit[linked[i], linked[js]]), np.int64).reshape(-1, 2)
        some = counts > 0
        return pa.table({
            "node": pa.array(np.concatenate((node[some], node[linked[tree[:, 0]]])), pa.int64()),
            "n_links": pa.array(np.concatenate((counts[some], np.zeros(len(tree), np.int64))), pa.int64()),
            "other": pa.array([None] * int(some.sum()) + node[linked[tree[:, 1]]].tolist(), pa.int64()),
        })

    return met.groupBy("leaf", "t0", "t1").applyInArrow(compare, "node bigint, n_links bigint, other bigint")


def embedding_groups(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    vectors = vectors.select(F.col("vec_id").cast("bigint"), "embedding")
    classes = Written(classes_of(vectors)).df
    links = Written(neighbour_links(classes, cosine)).df
    counts = links.where("other IS NULL").groupBy(F.col("node").alias("first")).agg(F.sum("n_links").alias("others"))
    comps = connected_components(links.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = classes.join(counts, "first", "left").join(comps.withColumnRenamed("node", "first"), "first", "left").select(
        "embedding", "n", F.coalesce("component", "first").alias("component_id"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).cast("bigint").alias("n_links")
    )
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    valid = F.coalesce(F.expr(VALID), F.lit(False))
    with_links = meet(vectors.where(valid), Written(named).df, "embedding", total, 1000).select("vec_id", "n_links", "component_id")
    alone = vectors.where(~valid).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return with_links.unionByName(alone).withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(False)))


def digest(vectors: DataFrame) -> DataFrame:
    return embedding_groups(vectors)
