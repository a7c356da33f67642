"""Factorisations, distances, orderings.  Pixels stay in Spark; only feature x feature or zone x zone matrices reach the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import centroids
from .base import ratio
from .graph import medoids, resolution_sweep


# ---- moments and correlation -------------------------------------------------------------------------------------------

def gram(pixels: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and X'X of a vector column: each batch is reduced to one matrix before anything is sent."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, sums, n = None, None, 0
        for pdf in batches:
            x = np.array(pdf[vector].tolist(), dtype=float).reshape(len(pdf), -1)
            if len(x):
                total, sums, n = (x.T @ x, x.sum(axis=0), len(x)) if total is None else (total + x.T @ x, sums + x.sum(axis=0), n + len(x))
        if total is not None:
            yield pd.DataFrame({"n": [n], "sums": [sums.tolist()], "gram": [total.ravel().tolist()]})

    parts = pixels.select(vector).mapInPandas(run, "n long, sums array<double>, gram array<double>")
    flat = parts.select("n", F.posexplode(F.concat("sums", "gram")).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("i").toPandas()
    d = int((np.sqrt(1 + 4 * len(flat)) - 1) / 2)
    v = flat["v"].to_numpy()
    return int(flat["n"].iloc[0]) if len(flat) else 0, v[:d], v[d:].reshape(d, d)


def correlation(pixels: DataFrame, vector: str) -> np.ndarray:
    """Pearson correlations of the features; 0 for a constant one."""
    return _correlations(*gram(pixels, vector))


def _correlations(n: int, s: np.ndarray, g: np.ndarray) -> np.ndarray:
    cov = g / n - np.outer(s, s) / n**2
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.nan_to_num(cov / np.outer(sd, sd))


# ---- NMF ---------------------------------------------------------------------------------------------------------------

@dataclass
class Nmf:
    h: np.ndarray  # factors x features
    offset: float  # subtracted from all values, so that they are not negative
    representatives: list[int]
    labels: np.ndarray
    losses: list[float]


def _loadings(x: np.ndarray, h: np.ndarray, steps: int = 200, tolerance: float = 1e-6) -> np.ndarray:
    """Row-wise non-negative least squares x ~ w h by coordinate descent on the Gram matrix."""
    g, c = h @ h.T, x @ h.T
    w = np.maximum(0, c / np.maximum(g.sum(axis=1), 1e-12))
    for _ in range(steps):
        before = w.copy()
        for k in range(len(g)):
            if g[k, k] > 0:
                w[:, k] = np.maximum(0, w[:, k] + (c[:, k] - w @ g[k]) / g[k, k])
        if np.abs(w - before).max(initial=0) <= tolerance * max(1.0, np.abs(w).max(initial=0)):
            break
    return w


def _seeded(corr: np.ndarray, low: float, high: float, steps: int, alpha: float, seed: int) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Communities of the absolute correlations over a sweep of resolutions, their representatives, the first H."""
    strength = np.abs(corr)
    np.fill_diagonal(strength, 0)
    labels = resolution_sweep(strength, low, high, steps, alpha, seed)
    chosen = medoids(corr, labels)
    return labels, chosen, np.clip(corr[chosen], 1e-6, None)


def _summed(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Loss, W'W and W'X of rows."""
    w = _loadings(x, h)
    return np.concatenate(([float(((x - w @ h) ** 2).sum())], (w.T @ w).ravel(), (w.T @ x).ravel()))


def _iterated(h: np.ndarray, one_pass: Callable[[np.ndarray], np.ndarray], iterations: int, tolerance: float) -> list[float]:
    """Moves h, each time by the sums of one pass over all rows; the losses."""
    k, d = h.shape
    losses: list[float] = []
    for _ in range(iterations):
        v = one_pass(h)
        losses.append(float(v[0]))
        if len(losses) > 1 and losses[-2] - losses[-1] <= tolerance * losses[0]:
            break
        ww, wx = v[1:1 + k * k].reshape(k, k), v[1 + k * k:].reshape(k, d)
        for _ in range(20):
            for i in range(k):
                if ww[i, i] > 0:
                    h[i] = np.maximum(0, h[i] + (wx[i] - ww[i] @ h) / ww[i, i])
    return losses


def fit_nmf(pixels: DataFrame, vector: str, low: float = 0.8, high: float = 1.5, steps: int = 100, alpha: float = 0.7, iterations: int = 30, tolerance: float = 1e-4, seed: int = 42) -> Nmf:
    """Seeded NMF: communities of the absolute feature correlations over a sweep of resolutions give representatives; their
    clipped correlations are the first H.  Each iteration is one pass that returns W'W and W'X, never W."""
    labels, chosen, h = _seeded(correlation(pixels, vector), low, high, steps, alpha, seed)
    offset = min(0.0, float(pixels.select(F.array_min(vector).alias("m")).agg(F.min("m")).first()[0] or 0.0))

    def step(now: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            k, d = now.shape
            total = np.zeros(1 + k * k + k * d)
            for pdf in batches:
                total += _summed(np.array(pdf[vector].tolist(), dtype=float).reshape(-1, d) - offset, now)
            yield pd.DataFrame({"v": [total.tolist()]})
        return run

    def one_pass(now: np.ndarray) -> np.ndarray:
        parts = pixels.select(vector).mapInPandas(step(now), "v array<double>")
        return parts.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toPandas()["x"].to_numpy()

    losses = _iterated(h, one_pass, iterations, tolerance)
    return Nmf(h, offset, chosen, labels, losses)


def fit_nmf_of_rows(x: np.ndarray, low: float = 0.8, high: float = 1.5, steps: int = 100, alpha: float = 0.7, iterations: int = 30, tolerance: float = 1e-4, seed: int = 42) -> Nmf:
    """fit_nmf of the few rows that a task holds."""
    labels, chosen, h = _seeded(_correlations(len(x), x.sum(axis=0), x.T @ x), low, high, steps, alpha, seed)
    offset = min(0.0, float(x.min()))
    losses = _iterated(h, lambda now: _summed(x - offset, now), iterations, tolerance)
    return Nmf(h, offset, chosen, labels, losses)


def apply_nmf(pixels: DataFrame, vector: str, model: Nmf, name: str = "loadings") -> DataFrame:
    """pixels with their loadings on fixed factors; rows are independent, so this runs on streams as well."""
    h, offset = model.h, model.offset

    @F.pandas_udf("array<double>")
    def load(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), dtype=float).reshape(len(v), -1) - offset
        return pd.Series(_loadings(x, h).tolist())

    return pixels.withColumn(name, load(vector))


def reconstruct(loadings: DataFrame, factors: DataFrame, pixel: str = "pixel_id") -> DataFrame:
    """Long product of loadings (pixel, factor, z) and factors (factor, feature_id, h), shifted so that its least value is 1e-7."""
    product = loadings.join(F.broadcast(factors), "factor").groupBy(pixel, "feature_id").agg(F.sum(F.col("z") * F.col("h")).alias("v"))
    least = product.agg(F.min("v").alias("_least"))
    return product.crossJoin(F.broadcast(least)).select(pixel, "feature_id", (F.col("v") - F.col("_least") + 1e-7).alias("value"))


def centre_batches(loadings: DataFrame, batch: str, pixel: str = "pixel_id", factor: str = "factor", value: str = "z") -> DataFrame:
    """Batch correction by means: each factor's batch mean is moved to its overall mean."""
    own = loadings.groupBy(batch, factor).agg(F.avg(value).alias("_own"))
    every = loadings.groupBy(factor).agg(F.avg(value).alias("_all"))
    return loadings.join(F.broadcast(own), [batch, factor]).join(F.broadcast(every), factor).withColumn(value, F.col(value) - F.col("_own") + F.col("_all")).drop("_own", "_all")


def harmonise(pixels: DataFrame, vector: str, batch: str, clusters: int = 10, rounds: int = 10, theta: float = 2.0, sigma: float = 0.1, ridge: float = 1.0, seed: int = 0) -> DataFrame:
    """Batch correction by soft clusters: rounds of soft k-means on the unit sphere with a diversity penalty, then a ridge
    regression on batches in each cluster whose batch terms are subtracted.  A round is one pass that returns the sums by
    (cluster, batch); pixels are never gathered."""
    batches_of = [r[0] for r in pixels.select(batch).distinct().orderBy(batch).collect()]
    d = len(pixels.select(vector).first()[0])
    units = pixels.where(F.col(vector).isNotNull()).select(array_to_vector(vector).alias("features"))
    centres = np.array([c for c in KMeans(k=clusters, seed=seed, maxIter=10).fit(units).clusterCenters()])
    k, b = len(centres), len(batches_of)
    place = {v: i for i, v in enumerate(batches_of)}
    terms = np.zeros((k, b, d))
    sizes = np.ones((k, b)) / b

    def soft(x: np.ndarray, at: np.ndarray, c: np.ndarray, s: np.ndarray) -> np.ndarray:
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        r = np.exp(-2 * (1 - unit(x) @ unit(c).T) / sigma)
        share = s.sum(axis=1, keepdims=True) * s.sum(axis=0, keepdims=True) / max(s.sum(), 1e-12)
        r *= ((share + 1) / (s + 1)).T[at] ** theta
        return r / np.maximum(r.sum(axis=1, keepdims=True), 1e-300)

    def corrected(x: np.ndarray, at: np.ndarray, c: np.ndarray, s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = soft(x, at, c, s)
        return x - np.einsum("nk,knd->nd", r, t[:, at]), r

    for _ in range(rounds):
        now = (centres.copy(), sizes.copy(), terms.copy())

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, sx, cx = np.zeros((k, b)), np.zeros((k, b, d)), np.zeros((k, d))
            for pdf in parts:
                x, at = np.array(pdf["v"].tolist(), dtype=float).reshape(-1, d), pdf["b"].map(place).to_numpy()
                z, r = corrected(x, at, *now)
                for i in range(b):
                    mine = at == i
                    n[:, i] += r[mine].sum(axis=0)
                    sx[:, i] += r[mine].T @ x[mine]
                cx += r.T @ z
            yield pd.DataFrame({"v": [[*n.ravel().tolist(), *sx.ravel().tolist(), *cx.ravel().tolist()]]})

        parts = pixels.select(F.col(vector).alias("v"), F.col(batch).alias("b")).mapInPandas(run, "v array<double>")
        v = parts.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toPandas()["x"].to_numpy()
        sizes = v[:k * b].reshape(k, b)
        sx = v[k * b:k * b + k * b * d].reshape(k, b, d)
        mean = sx.sum(axis=1) / np.maximum(sizes.sum(axis=1)[:, None], 1e-12)
        terms = (sx - sizes[:, :, None] * mean[:, None]) / (sizes[:, :, None] + ridge)
        centres = v[k * b + k * b * d:].reshape(k, d) / np.maximum(sizes.sum(axis=1)[:, None], 1e-12)
    final = (centres, sizes, terms)

    @F.pandas_udf("array<double>")
    def correct(v: pd.Series, at: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), dtype=float).reshape(-1, d)
        return pd.Series(corrected(x, at.map(place).to_numpy(), *final)[0].tolist())

    return pixels.withColumn("harmonised", correct(vector, batch))


# ---- clusters, components, layout --------------------------------------------------------------------------------------

def kmeans(pixels: DataFrame, vector: str, k: int, seed: int = 42, name: str = "cluster") -> DataFrame:
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol=name)
    ready = pixels.withColumn("_features", array_to_vector(vector))
    return model.fit(ready).transform(ready).drop("_features")


def principal_components(matrix: np.ndarray, k: int = 3) -> np.ndarray:
    """Scores on the first k components of standardised rows (signs: the largest loading is positive)."""
    sd = matrix.std(axis=0)
    z = (matrix - matrix.mean(axis=0)) / np.where(sd == 0, 1, sd)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    sign = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)])
    return (u * s * sign)[:, :k]


def layout_2d(pixels: DataFrame, vector: str) -> DataFrame:
    """Two leading principal coordinates of each pixel (stands in for a neighbour embedding)."""
    n, s, g = gram(pixels, vector)
    mean = s / n
    _, vectors = np.linalg.eigh(g / n - np.outer(mean, mean))
    axes = vectors[:, ::-1][:, :2]
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), [0, 1]])

    def along(a: np.ndarray):
        terms = F.array(*map(F.lit, a.tolist()))
        return F.aggregate(F.zip_with(vector, terms, lambda x, w: x * w), F.lit(0.0), lambda t, x: t + x) - float(mean @ a)

    return pixels.withColumns({"layout_x": along(axes[:, 0]), "layout_y": along(axes[:, 1])})


def centroid_matrix(long: DataFrame, zone: str, feature: str = "feature_id", value: str = "value") -> pd.DataFrame:
    """Zones x features on the driver."""
    return centroids(long, zone, feature, value).toPandas().pivot(index=zone, columns=feature, values="mean").sort_index()


def centroid_distances(means: DataFrame, zone: str, feature: str = "feature_id", value: str = "mean") -> DataFrame:
    """a < b, L2 and cosine distance of zone means; and cosine distance over the union of their supports."""
    left = means.select(F.col(zone).alias("a"), feature, F.col(value).alias("x"))
    right = means.select(F.col(zone).alias("b"), feature, F.col(value).alias("y"))
    pairs = left.join(right, feature).where("a < b").groupBy("a", "b").agg(
        F.sqrt(F.sum(F.pow(F.col("x") - F.col("y"), 2))).alias("l2"), F.sum(F.col("x") * F.col("y")).alias("_xy"),
        F.sum(F.col("x") * F.col("x")).alias("_xx"), F.sum(F.col("y") * F.col("y")).alias("_yy"),
    )
    cosine = 1 - ratio(F.col("_xy"), F.sqrt("_xx") * F.sqrt("_yy"))
    clean = F.when((F.col("_xx") == 0) & (F.col("_yy") == 0), 0.0).when((F.col("_xx") == 0) | (F.col("_yy") == 0), 1.0).otherwise(cosine)
    return pairs.select("a", "b", "l2", cosine.alias("cosine"), clean.alias("union_cosine"))


# ---- small matrices on the driver --------------------------------------------------------------------------------------

def linkage(distance: np.ndarray, weighted: bool = True) -> list[tuple[int, int, float, int]]:
    """Agglomerative clustering (WPGMA, or UPGMA) of a distance matrix: (a, b, height, size) per merge."""
    d = np.array(distance, dtype=float)
    n = len(d)
    np.fill_diagonal(d, np.inf)
    names, size, out = list(range(n)), [1] * n, []
    alive = list(range(n))
    for step in range(n - 1):
        sub = d[np.ix_(alive, alive)]
        i, j = divmod(int(sub.argmin()), len(alive))
        a, b = alive[min(i, j)], alive[max(i, j)]
        out.append((min(names[a], names[b]), max(names[a], names[b]), float(d[a, b]), size[a] + size[b]))
        wa, wb = (0.5, 0.5) if weighted else (size[a] / (size[a] + size[b]), size[b] / (size[a] + size[b]))
        d[a] = d[:, a] = np.where(np.isinf(d[a]) | np.isinf(d[b]), np.inf, wa * np.where(np.isinf(d[a]), 0, d[a]) + wb * np.where(np.isinf(d[b]), 0, d[b]))
        d[a, a] = np.inf
        names[a], size[a] = n + step, size[a] + size[b]
        alive.remove(b)
    return out


def leaf_order(merges: list[tuple[int, int, float, int]], distance: np.ndarray) -> list[int]:
    """Leaves in the order, of all that turning the merges can give, whose neighbours' distances have the least sum; the
    smaller end first.

    For each merge the cheapest order with given outer leaves is known: of the outer and the meeting leaves of its two
    sides (one cubic step a merge; the tree has a few hundred leaves)."""
    n = len(merges) + 1
    if n == 1:
        return [0]
    leaves, cost = {i: [i] for i in range(n)}, {i: np.zeros((1, 1)) for i in range(n)}

    def met(a: int, b: int) -> np.ndarray:
        """Outer leaf of a x leaf of b that a's inner end meets: the cheapest."""
        d = distance[np.ix_(leaves[a], leaves[b])]
        return np.array([(row[:, None] + d).min(axis=0) for row in cost[a]])

    for k, (a, b, *_) in enumerate(merges):
        left = met(a, b)
        joined = np.array([(row[:, None] + cost[b]).min(axis=0) for row in left])
        size = len(leaves[a])
        whole = np.full((size + len(leaves[b]),) * 2, np.inf)
        whole[:size, size:], whole[size:, :size] = joined, joined.T
        leaves[n + k], cost[n + k] = leaves[a] + leaves[b], whole

    def traced(node: int, first: int, last: int) -> list[int]:
        """The cheapest order of a node's leaves between two of its places."""
        if node < n:
            return [node]
        a, b = merges[node - n][:2]
        size = len(leaves[a])
        if first >= size:
            return traced(node, last, first)[::-1]
        last -= size
        d = distance[np.ix_(leaves[a], leaves[b])]
        through = cost[a][first][:, None] + d + cost[b][:, last][None]
        i, j = np.unravel_index(int(through.argmin()), through.shape)
        return traced(a, first, int(i)) + traced(b, int(j), last)

    top = n + len(merges) - 1
    first, last = np.unravel_index(int(cost[top].argmin()), cost[top].shape)
    order = traced(top, int(first), int(last))
    return order if order[0] <= order[-1] else order[::-1]


def cut(merges: list[tuple[int, int, float, int]], k: int, least: int = 0) -> np.ndarray:
    """Labels of k clusters (numbered by first leaf); clusters of at most `least` leaves become -1."""
    n = len(merges) + 1
    parent = list(range(2 * n - 1))
    for step, (a, b, _, _) in enumerate(merges[:max(0, n - k)]):
        parent[a] = parent[b] = n + step

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    seen: dict[int, int] = {}
    labels = np.array([seen.setdefault(root(i), len(seen)) for i in range(n)])
    small = np.flatnonzero(np.bincount(labels, minlength=len(seen)) <= least)
    return np.where(np.isin(labels, small), -1, labels)


def fit_noise(mean: np.ndarray, cv: np.ndarray, rounds: int = 40) -> tuple[float, float]:
    """(a, k) of the noise model log2 cv = log2(mean^a + k) with the least sum of absolute errors: a grid that is narrowed
    around its best point round after round.  One point per feature."""
    x, y = np.asarray(mean, dtype=float), np.log2(cv)
    a, k, wide, deep = -0.5, float(np.median(cv)) / 2, 1.5, float(np.max(cv))
    for _ in range(rounds):
        tries = [(float(np.abs(y - np.log2(x**p + q)).sum()), p, q) for p in np.linspace(a - wide, a + wide, 9) for q in np.clip(np.linspace(k - deep, k + deep, 9), 0, None)]
        _, a, k = min(tries)
        wide, deep = wide * 0.7, deep * 0.7
    return float(a), float(k)


@dataclass
class SupportCurve:
    """Support vector regression of one number on another with a Gaussian kernel."""
    x: np.ndarray
    beta: np.ndarray
    bias: float
    gamma: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.exp(-self.gamma * (np.asarray(x, dtype=float)[:, None] - self.x) ** 2) @ self.beta + self.bias


def fit_support(x: np.ndarray, y: np.ndarray, gamma: float = 0.06, cost: float = 1.0, epsilon: float = 0.1, tolerance: float = 1e-9, steps: int = 1_000_000) -> SupportCurve:
    """The dual, coefficients between -cost and cost that add up to 0, by coordinate descent on the pair that violates the
    optimality conditions most; a step ends where a coefficient changes its sign or meets its bound.  One point a feature:
    the kernel is a matrix of the driver."""
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    kernel = np.exp(-gamma * (x[:, None] - x) ** 2)
    beta, slope = np.zeros(len(x)), -y.copy()  # kernel @ beta - y
    for _ in range(steps):
        up = np.where(beta < cost, -slope - np.where(beta >= 0, epsilon, -epsilon), -np.inf)
        down = np.where(beta > -cost, slope - np.where(beta <= 0, epsilon, -epsilon), -np.inf)
        i, j = int(up.argmax()), int(down.argmax())
        if up[i] + down[j] <= tolerance:
            break
        step = (up[i] + down[j]) / max(kernel[i, i] + kernel[j, j] - 2 * kernel[i, j], 1e-12)
        step = min(step, -beta[i] if beta[i] < 0 else cost - beta[i], beta[j] if beta[j] > 0 else cost + beta[j])
        beta[i] += step
        beta[j] -= step
        slope += step * (kernel[i] - kernel[j])
    return SupportCurve(x, beta, float((up[i] - down[j]) / 2) if len(x) else 0.0, gamma)


def noise_selection(long: DataFrame, feature: str, value: str, keep: int, model: str = "exponential") -> DataFrame:
    """The `keep` features whose coefficient of variation most exceeds the fitted exponential noise model of their mean.
    Means and deviations come from Spark, one row per feature reaches the driver for the fit."""
    stats = long.groupBy(feature).agg(F.avg(value).alias("mean"), (F.stddev_pop(value) / F.nullif(F.avg(value), F.lit(0))).alias("cv")).where("mean > 0 AND cv > 0")
    frame = stats.toPandas()
    if frame.empty:
        return stats.withColumn("excess", F.lit(None).cast("double"))
    if model == "support":
        curve = fit_support(np.log2(frame["mean"].to_numpy()), np.log2(frame["cv"].to_numpy()))
        frame["excess"] = np.log2(frame["cv"]) - curve.predict(np.log2(frame["mean"]))
        kind = dict(stats.dtypes)[feature]
        found = long.sparkSession.createDataFrame(frame[[feature, "mean", "cv", "excess"]], f"`{feature}` {kind}, mean double, cv double, excess double")
        return found.orderBy(F.desc("excess"), feature).limit(keep)
    a, k = fit_noise(frame["mean"].to_numpy(), frame["cv"].to_numpy())
    return stats.withColumn("excess", F.log2("cv") - F.log2(F.pow(F.col("mean"), F.lit(a)) + k)).orderBy(F.desc("excess"), feature).limit(keep)


def noise_ranking(long: DataFrame, feature: str, value: str, keep: int) -> DataFrame:
    """Features by how far their coefficient of variation exceeds a fitted exponential noise model of the mean (log CV is
    fitted by a line in log mean on one row per feature); the `keep` largest."""
    stats = long.groupBy(feature).agg(F.avg(value).alias("mean"), (F.stddev_pop(value) / F.nullif(F.avg(value), F.lit(0))).alias("cv")).where("mean > 0 AND cv > 0")
    logs = stats.withColumns({"_x": F.log2("mean"), "_y": F.log2("cv")})
    fit = logs.agg(F.covar_pop("_x", "_y").alias("c"), F.var_pop("_x").alias("v"), F.avg("_x").alias("mx"), F.avg("_y").alias("my"))
    slope = F.coalesce(ratio(F.col("c"), F.col("v")), F.lit(0.0))
    out = logs.crossJoin(F.broadcast(fit)).withColumn("excess", F.col("_y") - (F.col("my") + slope * (F.col("_x") - F.col("mx"))))
    return out.select(feature, "mean", "cv", "excess").orderBy(F.desc("excess"), feature).limit(keep)


def subsets(n: int, limit: int = 200) -> list[tuple[int, ...]]:
    """Subsets of components, largest first, at most `limit`."""
    from itertools import combinations

    out: list[tuple[int, ...]] = []
    for size in range(n, 0, -1):
        for c in combinations(range(n), size):
            if len(out) == limit:
                return out
            out.append(c)
    return out


def clean_heatmap(matrix: pd.DataFrame, k: int, sparse: float = 0.5, least: int = 4) -> tuple[list, list, np.ndarray]:
    """Rows and columns in the order of a WPGMA tree on cosine distances over united supports, and clusters of rows; rows that
    are zero in more than `sparse` of the columns are held out and put last (-1)."""
    share = (matrix != 0).mean(axis=1)
    dense = matrix[share >= 1 - sparse]

    def ordered(m: np.ndarray) -> tuple[list[int], np.ndarray, list]:
        norm = np.linalg.norm(m, axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            d = 1 - m @ m.T / np.outer(norm, norm)
        d = np.where((norm[:, None] == 0) & (norm[None, :] == 0), 0, np.where((norm[:, None] == 0) | (norm[None, :] == 0), 1, d))
        merges = linkage(d)
        return leaf_order(merges, d), d, merges

    rows, _, merges = ordered(dense.to_numpy(dtype=float)) if len(dense) else ([], None, [])
    columns, _, _ = ordered(matrix.to_numpy(dtype=float).T)
    labels = cut(merges, k, least) if len(dense) > 1 else np.full(len(dense), -1)
    out = [*dense.index[rows], *matrix.index[share < 1 - sparse]]
    return out, list(matrix.columns[columns]), np.concatenate((labels[rows].astype(int), np.full(int((share < 1 - sparse).sum()), -1)))
