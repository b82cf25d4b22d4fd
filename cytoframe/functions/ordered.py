"""Long ordered groups in parts: running sums over borders of tasks, and blocks of rows with what lies around them.

A chromosome, or any other group, may be longer than a task should hold. Rows
are dealt in ranges of group and order; what a part needs to know of the parts
before is a few numbers for each group that crosses a border.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import Written, small

#: Rows of a block. A task's Python holds a few hundred bytes for each of them.
BLOCK = 25_000


def _starts(columns: list[pa.Array]) -> np.ndarray:
    """Where a run of equal keys begins."""
    n, changed = len(columns[0]), np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        a, b = c.slice(0, n - 1), c.slice(1)
        other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
        changed |= other.to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.flatnonzero(changed) + 1))


def _same(keys: list[str], left: str, right: str) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return on


def running(rows: DataFrame, keys: list[str], order: list[str], sums: tuple[str, ...] = (), xors: tuple[str, ...] = ()) -> DataFrame:
    """rows with place (1, 2, … by order within keys), and the named long columns as running sums or xors, own row included.

    The result is written: rows of equal order keep the places that they got. A
    group of any length is spread over tasks; what reaches the driver has at
    most two rows for each task.
    """
    names, folds = rows.columns, {"place": np.add, **dict.fromkeys(sums, np.add), **dict.fromkeys(xors, np.bitwise_xor)}
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    spec = T.StructType([*rows.schema.fields, T.StructField("place", T.LongType()), T.StructField("_part", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry = TaskContext.get().partitionId(), None, {}
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            key = [b.column(names.index(k)) for k in keys]
            starts = _starts(key)
            lengths, made = np.diff(np.append(starts, n)), {}
            for c, fold in folds.items():
                x = np.ones(n, np.int64) if c == "place" else b.column(names.index(c)).to_numpy()
                done = fold.accumulate(x)
                back = np.repeat(np.where(starts > 0, done[starts - 1], 0), lengths)
                x = done - back if fold is np.add else done ^ back
                if [k[0].as_py() for k in key] == last:
                    x[: lengths[0]] = fold(x[: lengths[0]], carry[c])
                made[c] = x
            last, carry = [k[n - 1].as_py() for k in key], {c: x[-1] for c, x in made.items()}
            cols = [pa.array(made[c]) if c in made else b.column(i) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(made["place"]), pa.array(np.full(n, part, np.int32))], spec.names)

    local = Written(dealt.mapInArrow(run, spec)).df
    key = F.struct(*keys)
    borders = [tuple(r) for r in local.groupBy("_part").agg(F.min(key), F.max(key)).orderBy("_part").collect()]
    crossing = list(dict.fromkeys(tuple(high) for (_, _, high), (_, low, _) in zip(borders, borders[1:]) if high == low))
    if not crossing:
        return local.drop("_part")
    spark, kinds = rows.sparkSession, [rows.schema[k] for k in keys]
    over = F.broadcast(spark.createDataFrame(crossing, T.StructType(kinds)))
    ends = local.alias("l").join(over.alias("o"), _same(keys, "l", "o"), "left_semi").groupBy(*keys, "_part").agg(*[F.max_by(c, "place").alias(c) for c in folds])
    so_far: dict[tuple, dict] = {}
    offsets = []
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):
        group = tuple(r[k] for k in keys)
        before = so_far.get(group, dict.fromkeys(folds, 0))
        offsets.append((*group, r["_part"], *before.values()))
        so_far[group] = {c: before[c] + r[c] if fold is np.add else before[c] ^ r[c] for c, fold in folds.items()}
    given = T.StructType([*kinds, local.schema["_part"], *[T.StructField(f"_{c}", T.LongType()) for c in folds]])
    joined = local.alias("l").join(F.broadcast(spark.createDataFrame(offsets, given)).alias("o"), _same([*keys, "_part"], "l", "o"), "left")

    def whole(c: str) -> Column:
        own, off = F.col(f"l.{c}"), F.coalesce(F.col(f"o._{c}"), F.lit(0))
        return own if c not in folds else (own + off if folds[c] is np.add else own.bitwiseXOR(off)).alias(c)

    return joined.select(*[whole(c) for c in [*names, "place"]])


def blocked(rows: DataFrame, keys: list[str], pos: str = "pos", size: int = BLOCK) -> DataFrame:
    """rows with place and block: `size` rows of one group that follow each other."""
    return running(rows, keys, [pos]).withColumn("block", F.floor((F.col("place") - 1) / size).cast("long"))


_EDGES = "block long, before array<struct<block:long,at:double,place:long>>, after array<struct<block:long,at:double,place:long>>, low double, high double, n long"


def with_halo(rows: DataFrame, keys: list[str], pos: str = "pos", size: int = BLOCK, reach: float = 0, sites: int = 0, beyond: int = 0) -> DataFrame:
    """Blocks with their surroundings: rows with place, block and own, and low, high and n, the ends and the length of the whole group.

    A row comes once with own, in its block, and once without for each block
    that it lies within `reach` or within `sites` rows of; and so do the next
    `beyond` rows on either side of what a block has by then. Only a table with
    a row for each block is gathered by group.
    """
    x = blocked(rows, keys, pos, size)
    at = F.col(pos).cast("double")
    edges = x.groupBy(*keys, "block").agg(F.min(at).alias("a"), F.max(at).alias("b"), F.min("place").alias("i"), F.max("place").alias("j"))

    def around(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("block").reset_index(drop=True)
        block, a, b, i, j = (g[c].tolist() for c in ("block", "a", "b", "i", "j"))
        before, after = [], []
        for k in range(len(g)):  # those that k's rows go to: later blocks reach back to k's end, earlier ones on to its start
            up = k + 1
            while up < len(g) and (a[up] - b[k] <= reach or i[up] - j[k] <= sites):
                up += 1
            down = k - 1
            while down >= 0 and (a[k] - b[down] <= reach or i[k] - j[down] <= sites):
                down -= 1
            after.append([{"block": block[m], "at": a[m], "place": i[m]} for m in range(k + 1, up)])
            before.append([{"block": block[m], "at": b[m], "place": j[m]} for m in range(down + 1, k)])
        return g[keys].assign(block=block, before=before, after=after, low=a[0], high=b[-1], n=j[-1])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    about = small(Written(edges.groupBy(*keys).applyInPandas(around, f"{kinds}, {_EDGES}")).df)
    x = x.join(about, [*keys, "block"])
    near = lambda e, d: (d <= reach) | (F.abs(e["place"] - F.col("place")) <= sites)
    to = F.concat(F.filter("after", lambda e: near(e, e["at"] - at)), F.filter("before", lambda e: near(e, at - e["at"])))
    own = F.array(F.struct(F.col("block").alias("block"), F.lit(True).alias("own")))
    every = F.concat(own, F.transform(to, lambda e: F.struct(e["block"].alias("block"), F.lit(False).alias("own"))))
    kept = [*rows.columns, "place"]
    out = x.withColumn("_to", F.explode(every)).select(*kept, F.col("_to.block").alias("block"), F.col("_to.own").alias("own"), "low", "high", "n")
    if not beyond:
        return out
    ends = out.groupBy(*keys, "block").agg(F.min("place").alias("i"), F.max("place").alias("j"))
    more = F.concat(*[F.array(F.col("i") - k, F.col("j") + k) for k in range(1, beyond + 1)])
    wanted = small(Written(ends.select(*keys, F.col("block").alias("_to"), F.explode(more).alias("place"))).df)
    extra = x.join(wanted, [*keys, "place"]).select(*kept, F.col("_to").alias("block"), F.lit(False).alias("own"), "low", "high", "n")
    return out.unionByName(extra)
