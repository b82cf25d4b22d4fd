"""Lists compared within themselves in bounded pieces, and spanning links instead of pairs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Written, small


def tiled(rows: DataFrame, key: str, spread: Column, cap: int) -> DataFrame:
    """rows with columns t0, t1, block: a list of over `cap` rows by key is cut in
    blocks and each two of its blocks meet in one tile, so no task gathers a whole
    long list. A short list is its own tile. Tile (i, i) compares a block with
    itself, tile (i, j) the rows of block i with those of block j.
    """
    long_ = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > cap).select(key, F.ceil(F.col("n") / cap).cast("int").alias("blocks"))
    r = rows.join(small(Written(long_).df), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    r = r.withColumn("block", F.pmod(spread, F.col("blocks")).cast("int"))
    r = r.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return r.withColumns({"t0": F.least("block", "_o"), "t1": F.greatest("block", "_o")}).drop("_o", "blocks")


def spanning(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what all links of n items connect; linked(i, js) says which js item i links with.

    Each item is held against those not reached yet only, so a dense group costs
    little and never more than its n - 1 links come out.
    """
    left, out = np.arange(n), []
    while left.size > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and left.size:
            i = queue.pop()
            hit = linked(i, left)
            if hit.any():
                reached = left[hit].tolist()
                out += [(i, j) for j in reached]
                queue += reached
                left = left[~hit]
    return out


def segments(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
    starts = np.concatenate(([0], edge))
    return starts, np.concatenate((edge, [len(sorted_keys)]))
