"""Models along a chromosome: hidden Markov segments, smoothers, imputation.

No task holds a chromosome: all work on blocks of sites. Markov chains join the
blocks' transfer matrices; smoothers and imputation see the sites around a
block. Results don't depend on the size of blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ordered
from ..functions.tables import Written, small
from . import matrix, ranges


class Chain:
    """A hidden Markov chain with sticky transitions and a uniform start, as products of transfer matrices.

    A stretch of sites is a matrix: how well each state before it goes with each
    state at its end, as sums over paths (floats, logarithms) and as the best
    path (whole numbers of 2^-28, so that sums come out the same in any order).
    Products are associative, so stretches are worked on side by side: in a task
    about sqrt(n) of them in one array, and blocks of a chromosome in tasks of
    their own. A missing observation says nothing; of equal paths the lower
    state wins, from the end on.
    """

    SCALE, NEVER = float(1 << 28), -(1 << 61)

    def __init__(self, means: list[float], self_loop: float, emission: str = "bernoulli", sd: float = 0.1):
        self.means, self.k, self.emission, self.sd = np.asarray(means, float), len(means), emission, sd
        k = self.k
        self.a = np.full((k, k), np.log((1 - self_loop) / max(k - 1, 1)) if k > 1 and self_loop < 1 else -np.inf)
        np.fill_diagonal(self.a, np.log(self_loop) if k > 1 else 0.0)
        self.ai = self.whole(self.a)

    def whole(self, x: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(x), np.rint(np.where(np.isfinite(x), x, 0) * self.SCALE), self.NEVER).astype(np.int64)

    def emissions(self, y: np.ndarray) -> np.ndarray:
        y, mu = np.asarray(y, float)[:, None], self.means
        if self.emission == "bernoulli":
            m = np.clip(mu, 1e-9, 1 - 1e-9)
            e = y * np.log(m) + (1 - y) * np.log1p(-m)
        else:
            e = -0.5 * ((y - mu) / self.sd) ** 2 - np.log(self.sd * np.sqrt(2 * np.pi))
        return np.where(np.isnan(e), -np.log(self.k), e)

    # a step of many vectors or matrices side by side; the last axis is the state

    def _sum(self, f: np.ndarray, a: np.ndarray) -> np.ndarray:
        x = f[..., :, None] + a
        top = x.max(axis=-2, keepdims=True)
        top = np.where(np.isfinite(top), top, 0)
        with np.errstate(divide="ignore"):
            return (top + np.log(np.exp(x - top).sum(axis=-2, keepdims=True)))[..., 0, :]

    def _best(self, f: np.ndarray, a: np.ndarray) -> np.ndarray:
        return np.maximum((f[..., :, None] + a).max(axis=-2), self.NEVER)

    def _cut(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sites as (stretches, sites of one, states), and which are there."""
        width = int(np.sqrt(len(e))) + 1
        count = -(-len(e) // width)
        padded = np.zeros((count * width, self.k), e.dtype)
        padded[: len(e)] = e
        return padded.reshape(count, width, self.k), (np.arange(count * width) < len(e)).reshape(count, width)

    def _products(self, e: np.ndarray, there: np.ndarray, step, a: np.ndarray, none) -> np.ndarray:
        """The matrix of each stretch."""
        m = np.full((len(e), self.k, self.k), none, e.dtype)
        m[:, np.arange(self.k), np.arange(self.k)] = 0
        for t in range(e.shape[1]):
            m = np.where(there[:, t, None, None], step(m, a) + e[:, t, None, :], m)
        return m

    def _fold(self, f: np.ndarray, products: np.ndarray, step) -> np.ndarray:
        """What comes into each stretch, and out of the last."""
        out = [f]
        for m in products:
            out.append(step(out[-1], m))
        return np.array(out)

    def summary(self, e: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """The block's matrices, sums and best; of a group's first block only the first row counts, from the start."""
        out = []
        for x, step, a, none in ((e, self._sum, self.a, -np.inf), (self.whole(e), self._best, self.ai, self.NEVER)):
            start = x[0] + (self.whole(-np.log(self.k)) if x.dtype == np.int64 else -np.log(self.k))
            cut, there = self._cut(x[1:] if first else x)
            ms = self._products(cut, there, step, a, none)
            m = np.full((self.k, self.k), none, x.dtype)
            if first:
                m[0] = self._fold(start, ms, step)[-1]
            else:
                np.fill_diagonal(m, 0)
                m = self._fold(m, ms, step)[-1]
            out.append(m)
        return out[0], out[1]

    def entry(self) -> tuple[np.ndarray, np.ndarray]:
        """What comes into a group's first block."""
        f, v = np.full(self.k, -np.inf), np.full(self.k, self.NEVER)
        f[0] = v[0] = 0
        return f, v

    def through(self, f: np.ndarray, v: np.ndarray, sums: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._sum(f, sums), self._best(v, best)

    def back(self, b: np.ndarray, sums: np.ndarray) -> np.ndarray:
        return self._sum(b, sums.T)

    def posteriors(self, e: np.ndarray, first: bool, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each site and state, from the sums that come in at either end of the block."""
        n, head = len(e), []
        if first:
            f = e[0] - np.log(self.k)
            head, e = [f[None]], e[1:]
        cut, there = self._cut(e)
        ms = self._products(cut, there, self._sum, self.a, -np.inf)
        now, fore = self._fold(f, ms, self._sum)[:-1], np.empty_like(cut)
        for t in range(cut.shape[1]):
            now = np.where(there[:, t, None], self._sum(now, self.a) + cut[:, t], now)
            fore[:, t] = now
        fore = np.concatenate([*head, fore.reshape(-1, self.k)[: len(e)]])
        ends = self._fold(b, ms[::-1].transpose(0, 2, 1), self._sum)[::-1]  # before each stretch, and at the block's end
        now, behind = ends[1:], np.empty_like(cut)
        for t in range(cut.shape[1] - 1, -1, -1):
            behind[:, t] = now
            now = np.where(there[:, t, None], self._sum(now + cut[:, t], self.a.T), now)
        behind = np.concatenate([*([ends[:1]] if first else []), behind.reshape(-1, self.k)[: len(e)]])
        post = fore + behind
        post -= post.max(axis=1, keepdims=True)
        post = np.exp(post)
        return (post / post.sum(axis=1, keepdims=True))[:n]

    def paths(self, e: np.ndarray, first: bool, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the best path to each state at the block's end, by site; the state before the block that each comes from)."""
        x, head = self.whole(e), 0
        if first:
            v, x, head = x[0] + self.whole(-np.log(self.k)), x[1:], 1
        cut, there = self._cut(x)
        now = self._fold(v, self._products(cut, there, self._best, self.ai, self.NEVER), self._best)[:-1]
        came = np.zeros(cut.shape, np.int8)
        for t in range(cut.shape[1]):
            came[:, t] = (now[..., :, None] + self.ai).argmax(axis=-2)
            now = np.where(there[:, t, None], self._best(now, self.ai) + cut[:, t], now)
        state, path = np.broadcast_to(np.arange(self.k), (len(cut), self.k)).copy(), np.zeros((*cut.shape[:2], self.k), np.int8)
        for t in range(cut.shape[1] - 1, -1, -1):
            path[:, t] = state
            state = np.where(there[:, t, None], np.take_along_axis(came[:, t].astype(np.int64), state, axis=1), state)
        ends = np.arange(self.k)
        for r in range(len(cut) - 1, -1, -1):  # a stretch ends in the state that the next one's path comes from
            path[r], ends = path[r][:, ends], state[r][ends]
        path = path.reshape(-1, self.k)[: len(x)]
        return np.concatenate([ends[None].astype(np.int8), path]) if head else path, ends


def hmm_segment(y: np.ndarray, means: list[float], self_loop: float, emission: str = "bernoulli", sd: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(most likely states, posteriors) of one sequence."""
    chain = Chain(means, self_loop, emission, sd)
    if not len(y):
        return np.zeros(0, int), np.zeros((0, chain.k))
    e = chain.emissions(y)
    f, v = chain.entry()
    path, _ = chain.paths(e, True, v)
    end = int(chain.through(f, v, *chain.summary(e, True))[1].argmax())
    return path[:, end].astype(int), chain.posteriors(e, True, f, np.zeros(chain.k))


def hmm_states(rows: DataFrame, keys: list[str], value: str, means: list[float], self_loop: float, emission: str = "bernoulli", sd: float = 0.1, min_sites: int = 5, block: int = ordered.BLOCK) -> DataFrame:
    """rows (keys, pos, value, ...) with state and posterior of the last state; groups below min_sites give nothing.

    A group is cut in blocks of sites. Their matrices, a row a block, are joined
    along the group; with what comes in at either end each block then gets its
    posteriors and its best path to each state at its end, and a last pass along
    the rows of blocks says which of these the whole path takes. The result
    doesn't depend on the size of blocks.
    """
    chain, names = Chain(means, self_loop, emission, sd), rows.columns
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    enough = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_sites).select(*keys)
    x = ordered.blocked(rows.join(small(Written(enough).df), keys, "left_semi"), keys, "pos", block)

    def summed(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("place")
        sums, best = chain.summary(chain.emissions(g[value].to_numpy(float)), bool(g["block"].iloc[0] == 0))
        return g[[*keys, "block"]].iloc[:1].assign(sums=[sums.ravel()], best=[best.ravel()])

    def along(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("block")
        sums, best = ([np.asarray(m).reshape(chain.k, chain.k) for m in g[c]] for c in ("sums", "best"))
        into, out, (f, v), b = [], [], chain.entry(), np.zeros(chain.k)
        for s, m in zip(sums, best):
            into.append((f, v))
            f, v = chain.through(f, v, s, m)
        for s in sums[::-1]:
            out.append(b)
            b = chain.back(b, s)
        return g[[*keys, "block"]].assign(f=[f for f, _ in into], v=[v for _, v in into], b=out[::-1], last=[-1] * (len(g) - 1) + [int(v.argmax())])

    matrices = x.select(*keys, "block", "place", value).groupBy(*keys, "block").applyInPandas(summed, f"{kinds}, block long, sums array<double>, best array<long>")
    ends = Written(matrices.groupBy(*keys).applyInPandas(along, f"{kinds}, block long, f array<double>, v array<long>, b array<double>, last int")).df

    def within(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("place")
        first, e = bool(g["block"].iloc[0] == 0), chain.emissions(g[value].to_numpy(float))
        f, v, b = (np.asarray(g[c].iloc[0]) for c in ("f", "v", "b"))
        path, came = chain.paths(e, first, v)
        return g[[*names, "block"]].assign(_paths=list(path.astype(np.int32)), _came=[came.astype(np.int32)] + [None] * (len(g) - 1), posterior=chain.posteriors(e, first, f, b)[:, -1])

    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    ends_at_first = [F.when((F.col("place") - 1) % block == 0, F.col(c)).alias(c) for c in ("f", "v", "b")]  # once a block, not in every row
    given = x.join(small(ends), [*keys, "block"]).select(*names, "block", "place", *ends_at_first)
    made = Written(given.groupBy(*keys, "block").applyInPandas(within, f"{spec}, block long, _paths array<int>, _came array<int>, posterior double")).df

    def taken(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("block")
        state, states = int(g["last"].iloc[-1]), []
        for came in g["_came"].tolist()[::-1]:
            states.append(state)
            state = int(came[state])
        return g[[*keys, "block"]].assign(_end=states[::-1])

    came = made.where("_came IS NOT NULL").select(*keys, "block", "_came").join(ends.select(*keys, "block", "last"), [*keys, "block"])
    end = Written(came.groupBy(*keys).applyInPandas(taken, f"{kinds}, block long, _end int")).df
    return made.join(small(end), [*keys, "block"]).select(*names, F.element_at("_paths", F.col("_end") + 1).alias("state"), "posterior")


def state_runs(states: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with `run`: the number of their stretch of one state."""
    from pyspark.sql import Window

    before = F.lag("state").over(Window.partitionBy(*keys).orderBy("pos"))
    x = ranges.islands(states.withColumn("_new", before.isNull() | (before != F.col("state"))), keys, "pos", F.col("_new"))
    return x.withColumnRenamed("island", "run").drop("_new")


def _runs_of(states: DataFrame, keys: list[str], state: int) -> DataFrame:
    r = state_runs(states, keys).where(F.col("state") == state)
    return r.groupBy(*keys, "run").agg(
        F.min("pos").alias("start"), (F.max("pos") + 1).cast("int").alias("end"), F.count("*").alias("n_cpgs"), F.avg("beta").alias("mean_beta"),
        F.try_divide(F.sum(F.col("beta") * F.col("coverage")), F.sum("coverage")).alias("weighted_beta"),
    ).drop("run")


def _betas(sites: DataFrame) -> DataFrame:
    return sites.where("coverage > 0").select("sample", "chrom", "pos", (F.col("n_meth") / F.col("coverage")).alias("beta"), F.col("coverage").cast("double").alias("coverage"))


#: Sites smoothed at once.
_BLOCK = 128


def gaussian_beta(pos: np.ndarray, beta: np.ndarray, cov: np.ndarray, bandwidth: float) -> np.ndarray:
    """Coverage-weighted Gaussian mean over sites within four bandwidths."""
    lo, hi = np.searchsorted(pos, pos - 4 * bandwidth, "left"), np.searchsorted(pos, pos + 4 * bandwidth, "right")
    out = np.empty(len(pos))
    for i in range(0, len(pos), _BLOCK):
        at = slice(i, min(i + _BLOCK, len(pos)))
        a, b = lo[at][0], hi[at][-1]
        d = pos[None, a:b] - pos[at, None]
        w = np.where(np.abs(d) <= 4 * bandwidth, np.exp(-0.5 * (d / bandwidth) ** 2), 0) * cov[a:b]
        total = w.sum(axis=1)
        out[at] = np.where(total > 0, (w @ beta[a:b]) / np.where(total > 0, total, 1), beta[at])
    return out


def smooth(sites: DataFrame, kernel: str = "gaussian", block: int = ordered.BLOCK, **parameters) -> DataFrame:
    """(sample, chrom, pos, beta, coverage, smoothed). A block sees as far around itself as the kernel reaches."""
    fn, halo = {
        "gaussian": (_grid_gaussian, {"reach": 4 * parameters.get("bandwidth", 1000) + 2 * max(1, int(parameters.get("bandwidth", 1000)) // 20), "beyond": 1}),
        "weighted": (lambda p, b, c, own, low, high, n, bandwidth=10_000: gaussian_beta(p, b, c, bandwidth)[own], {"reach": 4 * parameters.get("bandwidth", 10_000)}),
        "bsmooth": (lambda p, b, c, own, low, high, n, **more: bsmooth(p, b, c, **more)[own], {"reach": parameters.get("h", 1000) + 1, "sites": parameters.get("ns", 70) + 2}),
    }[kernel]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("place")
        own = g["own"].to_numpy(bool)
        value = fn(g["pos"].to_numpy(float), g["beta"].to_numpy(float), g["coverage"].to_numpy(float), own, g["low"].iloc[0], g["high"].iloc[0], g["n"].iloc[0], **parameters)
        return g.loc[own, ["sample", "chrom", "pos", "beta", "coverage"]].assign(smoothed=value)

    keys = ["sample", "chrom"]
    x = ordered.with_halo(_betas(sites), keys, size=block, **halo)
    return x.groupBy(*keys, "block").applyInPandas(run, "sample string, chrom string, pos int, beta double, coverage double, smoothed double")


def _grid_gaussian(pos, beta, cov, own, low, high, n, bandwidth: int = 1000) -> np.ndarray:
    """Interpolated to a grid from the chromosome's first site (low) on, filtered with coverage as weight (floor 0.1), and interpolated back; four sites at least."""
    at = pos[own]
    if n < 4:
        return beta[own]
    cell = max(1, int(bandwidth) // 20)
    sigma = max(bandwidth / cell, 0.5)
    r = int(4 * sigma + 0.5)
    cells = int(np.ceil((high + cell - low) / cell))  # of the whole chromosome
    first, last = int((at[0] - low) // cell), min(int((at[-1] - low) // cell) + 1, cells - 1)
    a, b = max(first - r, 0), min(last + r, cells - 1)
    grid = low + cell * np.arange(a, b + 1)
    level, weight = np.interp(grid, pos, beta), np.maximum(np.interp(grid, pos, cov), 0.1)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    pad = (r - (first - a), r - (b - last))  # at the chromosome's ends only
    top, below = np.convolve(np.pad(level * weight, pad, "edge"), k, "valid"), np.convolve(np.pad(weight, pad, "edge"), k, "valid")
    return np.clip(np.interp(at, low + cell * np.arange(first, last + 1), top / below), 0, 1)


def bsmooth(pos, beta, cov, ns: int = 70, h: int = 1000, degree: int = 2) -> np.ndarray:
    """Local polynomial with tricube weights; the bandwidth is h or what holds ns sites, whichever is wider."""
    n = len(pos)
    if n < 3:
        return beta.copy()
    out = np.empty(n)
    padded = np.concatenate((np.full(ns, -np.inf), pos, np.full(ns, np.inf)))
    for i in range(0, n, _BLOCK):
        own = np.arange(i, min(i + _BLOCK, n))
        d = np.sort(np.abs(padded[own[:, None] + np.arange(2 * ns + 1)] - pos[own, None]), axis=1)
        width = np.maximum(float(h), d[np.arange(len(own)), np.minimum(ns, np.isfinite(d).sum(axis=1)) - 1] + 1)
        a, b = np.searchsorted(pos, (pos[own] - width).min(), "left"), np.searchsorted(pos, (pos[own] + width).max(), "right")
        u = (pos[None, a:b] - pos[own, None]) / width[:, None]
        inside = np.abs(u) <= 1
        w = np.where(inside, np.clip(1 - np.abs(u) ** 3, 0, None) ** 3, 0) * cov[a:b]
        deg = np.minimum(degree, inside.sum(axis=1) - 1)
        for k in np.unique(deg):
            rows = np.flatnonzero(deg == k)
            x = u[rows, :, None] ** np.arange(k + 1)
            left, right = np.einsum("sj,sja,sjb->sab", w[rows], x, x), np.einsum("sj,sja,j->sa", w[rows], x, beta[a:b])
            total = w[rows].sum(axis=1)
            flat = np.where(total > 0, (w[rows] @ beta[a:b]) / np.where(total > 0, total, 1), beta[own[rows]])
            ok = np.abs(np.linalg.det(left)) > 1e-300
            out[own[rows]] = flat
            if ok.any():
                out[own[rows[ok]]] = np.linalg.solve(left[ok], right[ok][..., None])[:, 0, 0]
    return np.clip(out, 0, 1)


def pmd(sites: DataFrame, bandwidth: int = 10_000, threshold: float = 0.55, min_length: int = 100_000, self_loop: float = 0.999) -> DataFrame:
    """Partially methylated domains: long low stretches of the smoothed level."""
    x = smooth(sites, "weighted", bandwidth=bandwidth)
    s = hmm_states(x, ["sample", "chrom"], "smoothed", [0.5 * threshold, min(threshold + 0.25, 0.95)], self_loop, min_sites=10)
    return _runs_of(s, ["sample", "chrom"], 0).where(F.col("end") - F.col("start") >= min_length)


def hmr(sites: DataFrame, threshold: float = 0.3, density: float = 0.02, min_cpgs: int = 4, self_loop: float = 0.85) -> DataFrame:
    """Low stretches of the raw level: HMR, or LMR where sites are sparse."""
    s = hmm_states(_betas(sites), ["sample", "chrom"], "beta", [max(0.5 * threshold, 0.05), min((threshold + 1) / 2, 0.95)], self_loop)
    r = _runs_of(s, ["sample", "chrom"], 0).where((F.col("n_cpgs") >= min_cpgs) & (F.col("mean_beta") < threshold))
    return r.withColumn("kind", F.when(F.col("n_cpgs") / (F.col("end") - F.col("start")) < density, "LMR").otherwise("HMR"))


def dmr_hmm(dmc: DataFrame, self_loop: float = 0.95, min_cpgs: int = 5, delta: float = 0.1, alpha: float = 0.05) -> DataFrame:
    """Three Gaussian states of the difference; runs of the outer two that are long, large and significant."""
    x = dmc.select("chrom", "pos", F.col("meth_diff").cast("double").alias("meth_diff"), "qvalue")
    s = hmm_states(x, ["chrom"], "meth_diff", [-0.2, 0.0, 0.2], self_loop, "gaussian", 0.1)
    r = state_runs(s, ["chrom"]).where("state <> 1")
    g = r.groupBy("chrom", "run", "state").agg(F.min("pos").alias("start"), (F.max("pos") + 1).cast("int").alias("end"), F.count("*").alias("n_cpgs"), F.avg("meth_diff").alias("mean_meth_diff"), F.avg("qvalue").alias("mean_q"))
    ok = (F.col("n_cpgs") >= min_cpgs) & (F.abs("mean_meth_diff") >= delta) & (F.col("mean_q") < alpha)
    return g.where(ok).withColumn("dmr_type", F.when(F.col("state") == 2, "hyper").otherwise("hypo")).drop("run", "state")


def knn_impute(sites: DataFrame, samples: list[str], k: int = 5, max_distance: int = 10_000, block: int = ordered.BLOCK) -> DataFrame:
    """Missing betas of the site matrix from the sample's k nearest covered sites, weighted 1 / (distance + 1); sites beyond max_distance have no weight, so a block sees that far."""
    from . import sites as S

    m = S.site_matrix(sites, samples)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("place").reset_index(drop=True)
        pos, own = g["pos"].to_numpy(float), g["own"].to_numpy(bool)
        for s in samples:
            v = g[s].to_numpy(float)
            have, lost = np.flatnonzero(~np.isnan(v)), np.flatnonzero(np.isnan(v) & own)
            if not len(have) or not len(lost):
                continue
            at = np.searchsorted(have, lost)[:, None] + np.arange(-k, k)
            near = have[np.clip(at, 0, len(have) - 1)]
            d = np.where((at >= 0) & (at < len(have)), np.abs(pos[near] - pos[lost, None]), np.inf)
            first = np.argsort(d, axis=1, kind="stable")[:, :k]  # of two as near the one before
            near, d = np.take_along_axis(near, first, axis=1), np.take_along_axis(d, first, axis=1)
            w = np.where(d <= max_distance, 1 / (d + 1), 0)
            total = w.sum(axis=1)
            fill = v.copy()
            fill[lost] = np.where(total > 0, (w * v[near]).sum(axis=1) / np.where(total > 0, total, 1), np.nan)
            g[s] = fill
        return g.loc[own, ["chrom", "pos", *samples]]

    spec = "chrom string, pos int, " + ", ".join(f"`{s}` double" for s in samples)
    return ordered.with_halo(m, ["chrom"], size=block, reach=max_distance).groupBy("chrom", "block").applyInPandas(run, spec)


def pca(sites: DataFrame, samples: list[str], components: int = 2, n_sites: int | None = None, seed: int = 42) -> DataFrame:
    """Sample coordinates over complete sites, or n_sites of them: the samples' products are summed by the executors, their small eigenproblem solved here."""
    rows = matrix.complete_sites(sites.where("coverage > 0"), samples, F.col("n_meth") / F.col("coverage"))
    n, sums, g = matrix.gram(rows if n_sites is None else matrix.site_sample(rows, n_sites, seed), len(samples))
    g = g - g.mean(axis=0) - g.mean(axis=1)[:, None] + g.mean()  # each site less its mean over samples
    vals, vecs = np.linalg.eigh(g)
    order = np.argsort(vals)[::-1][:components]
    xy = vecs[:, order] * np.sqrt(np.maximum(vals[order], 0))
    xy *= np.where(xy[np.abs(xy).argmax(axis=0), np.arange(xy.shape[1])] < 0, -1, 1)
    rows = [(s, float(sums[i] / n + 0.5) if n else 0.0, *map(float, xy[i])) for i, s in enumerate(samples)]
    return sites.sparkSession.createDataFrame(rows, "sample string, mean_beta double, " + ", ".join(f"pc{i + 1} double" for i in range(xy.shape[1])))
