"""The matrix of sites and samples: products of samples summed by blocks, and bounded samples of its rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Samples of a tile's side, sites multiplied at once, partial tiles that are summed at once.
TILE, SITES, FAN = 512, 1024, 16

_TILES = "bi int, bj int, piece int, n long, tile binary, sums binary"


def complete_sites(sites: DataFrame, samples: list[str], value: Column) -> DataFrame:
    """(chrom, pos, row): the samples' values, in order, of the sites where every sample has one. One row a site, whatever the number of samples."""
    number = F.create_map(*(F.lit(x) for i, s in enumerate(samples) for x in (s, i)))
    x = sites.select("chrom", "pos", F.try_element_at(number, F.col("sample")).alias("_i"), value.cast("double").alias("_v")).where("_i IS NOT NULL AND _v IS NOT NULL")
    x = x.groupBy("chrom", "pos", "_i").agg(F.first("_v").alias("_v")).groupBy("chrom", "pos").agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_r"))
    return x.where(F.size("_r") == len(samples)).select("chrom", "pos", F.col("_r._v").alias("row"))


def _array(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.float64).tobytes()


def products(rows: DataFrame, n_samples: int, shift: float = 0.5) -> DataFrame:
    """(bi, bj, n, tile, sums): products of samples, summed over rows (row: an array of n_samples values), less the shift.

    Each task multiplies blocks of rows and keeps one tile for each two blocks
    of TILE samples; partial tiles are summed FAN at a time until one is left.
    What a task holds grows with the square of the samples, not with the sites.
    """
    cuts = list(range(0, n_samples, TILE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, tiles = 0, np.zeros(n_samples), {(i, j): np.zeros((len(range(n_samples)[i : i + TILE]), len(range(n_samples)[j : j + TILE]))) for i in cuts for j in cuts if i <= j}
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(-1, n_samples) - shift
            n += len(x)
            sums += x.sum(axis=0)
            for (i, j), t in tiles.items():
                t += x[:, i : i + TILE].T @ x[:, j : j + TILE]
        if n:
            p = TaskContext.get().partitionId()
            out = [(i // TILE, j // TILE, p, n, _array(t), _array(sums) if i == j == 0 else None) for (i, j), t in tiles.items()]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["bi", "bj", "piece", "n", "tile", "sums"])

    def summed(g: pd.DataFrame) -> pd.DataFrame:
        add = lambda c: _array(sum(np.frombuffer(v) for v in g[c])) if g[c].iloc[0] is not None else None
        return g.iloc[:1].assign(n=int(g["n"].sum()), tile=[add("tile")], sums=[add("sums")])

    out = rows.select("row").mapInArrow(run, _TILES)
    for fan in (FAN**3, FAN**2, FAN):  # pieces that are left after each round, then one
        out = out.withColumn("piece", F.col("piece") % fan).groupBy("bi", "bj", "piece").applyInPandas(summed, _TILES) if _pieces(rows) > fan else out
    return out.withColumn("piece", F.lit(0)).groupBy("bi", "bj", "piece").applyInPandas(summed, _TILES).drop("piece")


def _pieces(rows: DataFrame) -> int:
    """Tasks that a table with a shuffle below it is read by, at most."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _whole(tiles: pd.DataFrame, n_samples: int) -> tuple[int, np.ndarray, np.ndarray]:
    g, sums, n = np.zeros((n_samples, n_samples)), np.zeros(n_samples), 0
    for bi, bj, k, tile, s in tiles[["bi", "bj", "n", "tile", "sums"]].itertuples(index=False):
        i, j = slice(bi * TILE, min(bi * TILE + TILE, n_samples)), slice(bj * TILE, min(bj * TILE + TILE, n_samples))
        t = np.frombuffer(tile).reshape(i.stop - i.start, j.stop - j.start)
        g[i, j], g[j, i], n = t, t.T, k
        if s is not None:
            sums = np.frombuffer(s)
    return n, sums, g


def gram(rows: DataFrame, n_samples: int, shift: float = 0.5) -> tuple[int, np.ndarray, np.ndarray]:
    """(sites, sums, products) of the samples, for a decomposition on the driver: a number for each two samples."""
    return _whole(products(rows, n_samples, shift).toPandas(), n_samples)


def correlations(rows: DataFrame, samples: list[str], shift: float = 0.5) -> DataFrame:
    """(sample_a, sample_b, r) of each two samples, a before b; null where one of them doesn't vary."""
    k = len(samples)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        n, sums, p = _whole(g, k)
        cov = p - np.outer(sums, sums) / max(n, 1)
        var = np.diag(cov).copy()
        var[var <= 1e-12 * np.maximum(np.diag(p), 1e-300)] = np.nan
        i, j = np.triu_indices(k, 1)
        r = np.clip(cov[i, j] / np.sqrt(var[i] * var[j]), -1, 1)
        return pd.DataFrame({"sample_a": np.array(samples, object)[i], "sample_b": np.array(samples, object)[j], "r": r})

    out = products(rows, k, shift).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "sample_a string, sample_b string, r double")
    return out.withColumn("r", F.nanvl("r", F.lit(None).cast("double")))


def _draw(seed: int, *columns: str) -> Column:
    """A place in an order that the seed and a row's own values set."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)).cast("binary"))


def site_sample(rows: DataFrame, n_sites: int, seed: int = 42) -> DataFrame:
    """n_sites rows of a table (chrom, pos, …), all if it has fewer: those of least hash, so the same ones however rows are dealt. A task keeps n_sites rows at most."""
    return rows.withColumn("_h", _draw(seed, "chrom", "pos")).orderBy("_h", "chrom", "pos").limit(n_sites).drop("_h")


def sample_site_matrix(sites: DataFrame, samples: list[str], n_sites: int = 10_000, seed: int = 42) -> DataFrame:
    """(chrom, pos, row): levels of n_sites sites that every sample covers."""
    covered = sites.where("coverage > 0")
    return site_sample(complete_sites(covered, samples, F.col("n_meth") / F.col("coverage")), n_sites, seed)


def coverage_sample(sites: DataFrame, max_points: int = 200_000, seed: int = 42) -> DataFrame:
    """(sample, chrom, pos, coverage) of max_points rows, chosen like sites."""
    x = sites.select("sample", "chrom", "pos", "coverage").withColumn("_h", _draw(seed, "sample", "chrom", "pos"))
    return x.orderBy("_h", "sample", "chrom", "pos").limit(max_points).drop("_h")
