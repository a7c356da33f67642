"""Two-dimensional layouts by neighbour embedding, and factors that two sets of features share.

Layouts of zones and molecules are made on the driver: their number is bounded by the model.  Pixels are laid out through
landmarks: a bounded sample is embedded, every pixel is then placed among its nearest landmarks in one pass without a
shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import gram

#: Pixels that are embedded for a pixel layout, about; all others are placed among them.
LANDMARKS = 1000


def matrix_of(vectors: list) -> np.ndarray:
    return np.array(vectors, dtype=float) if len(vectors) else np.zeros((0, 1))


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.clip((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T, 0, None)


def affinities(d: np.ndarray, perplexity: float) -> np.ndarray:
    """Row-wise Gaussian weights of squared distances, each row of the given perplexity (bisection of all rows at once);
    an infinite distance weighs nothing."""
    low, high = np.zeros(len(d)), np.full(len(d), np.inf)
    beta = np.ones(len(d))
    shifted = d - d.min(axis=1, keepdims=True)
    for _ in range(60):
        w = np.exp(-np.where(np.isinf(d), np.inf, shifted * beta[:, None]))
        w /= w.sum(axis=1, keepdims=True)
        entropy = -(w * np.log(np.where(w > 0, w, 1))).sum(axis=1)
        wide = entropy > np.log(perplexity)
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    return w


def tsne(points: np.ndarray, perplexity: float = 30.0, stages: tuple = ((500, 1.2), (100, 2.5)), start: np.ndarray | None = None, rate: float | None = None) -> np.ndarray:
    """Stochastic neighbour embedding with Student tails, exact, in stages of (steps, exaggeration).  Starts from two given
    coordinates or the leading principal ones, so it is deterministic.  The rate is the number of points (100 at least) unless
    given.  For matrices of a few thousand rows."""
    n = len(points)
    rate = rate or max(100.0, n)
    if n < 3:
        return np.column_stack((np.arange(n, dtype=float), np.zeros(n)))
    x = np.asarray(points, dtype=float)
    d = squared_distances(x, x)
    np.fill_diagonal(d, np.inf)
    p = affinities(d, min(perplexity, (n - 1) / 3 + 1e-9))
    p = (p + p.T) / (2 * n)
    if start is None:
        u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
        start = (u * s)[:, :2]
        start = np.pad(start, ((0, 0), (0, 2 - start.shape[1])))
    y = (start - start.mean(axis=0)) / max(start[:, 0].std(), 1e-12) * 1e-2
    y = y + 1e-6 * np.random.default_rng(0).normal(size=y.shape)  # equal rows must be able to part
    speed, gain = np.zeros_like(y), np.ones_like(y)
    for steps, exaggeration in stages:
        for step in range(steps):
            q = 1 / (1 + squared_distances(y, y))
            np.fill_diagonal(q, 0)
            w = (exaggeration * p - q / q.sum()) * q
            slope = 4 * (w.sum(axis=1)[:, None] * y - w @ y)
            gain = np.clip(np.where((slope > 0) == (speed > 0), gain * 0.8, gain + 0.2), 0.01, None)
            speed = (0.5 if step < 50 else 0.8) * speed - rate * gain * slope
            length = np.linalg.norm(speed, axis=1, keepdims=True)
            y = y + speed * np.minimum(1, 5 / np.maximum(length, 1e-12))
            y -= y.mean(axis=0)
    return y


def fuzzy_graph(d: np.ndarray, neighbours: int) -> np.ndarray:
    """Symmetric memberships: along each row exp(-(distance - nearest) / width) for its nearest neighbours, the width set so
    that they sum to log2 of their number; both directions are united as probabilities."""
    n = len(d)
    k = min(neighbours, n - 1)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    r = np.take_along_axis(d, near, axis=1)
    excess = r - r[:, :1]
    low, high = np.zeros(n), np.full(n, np.inf)
    width = np.ones(n)
    for _ in range(60):
        total = np.exp(-excess / np.maximum(width, 1e-12)[:, None]).sum(axis=1)
        wide = total > max(np.log2(k), 1e-9) if k > 1 else np.ones(n, bool)
        low, high = np.where(wide, low, width), np.where(wide, width, high)
        width = np.where(np.isinf(high), width * 2, (low + high) / 2)
    w = np.zeros((n, n))
    np.put_along_axis(w, near, np.exp(-excess / np.maximum(width, 1e-12)[:, None]), axis=1)
    return w + w.T - w * w.T


def umap(points: np.ndarray, neighbours: int = 15, spread: float = 0.1, steps: int = 300, rate: float = 1.0) -> np.ndarray:
    """Layout whose curve 1 / (1 + a d^2b) matches the fuzzy graph of nearest neighbours in cross-entropy, by steps along the
    whole gradient (no sampling, so it is deterministic).  `spread`: distance below which points count as together.  For
    matrices of a few thousand rows."""
    n = len(points)
    if n < 3:
        return np.column_stack((np.arange(n, dtype=float), np.zeros(n)))
    x = np.asarray(points, dtype=float)
    d = np.sqrt(squared_distances(x, x))
    np.fill_diagonal(d, np.inf)
    w = fuzzy_graph(d, neighbours)
    grid = np.linspace(0.01, 3, 300)
    target = np.where(grid <= spread, 1.0, np.exp(-(grid - spread)))
    a, b = min(((a, b) for a in np.linspace(0.5, 2.5, 41) for b in np.linspace(0.5, 1.5, 41)), key=lambda t: ((1 / (1 + t[0] * grid ** (2 * t[1])) - target) ** 2).sum())
    # the leading non-constant eigenvectors of the graph are the start
    degree = np.maximum(w.sum(axis=1), 1e-12)
    _, vectors = np.linalg.eigh(np.eye(n) - w / np.sqrt(np.outer(degree, degree)))
    y = vectors[:, 1:3] * np.sign(vectors[np.abs(vectors[:, 1:3]).argmax(axis=0), [1, 2]])
    y = 10 * y / np.maximum(np.abs(y).max(axis=0), 1e-12) + 1e-4 * np.random.default_rng(0).normal(size=(n, 2))
    share = w.sum() / n**2
    for step in range(steps):
        d2 = squared_distances(y, y)
        np.fill_diagonal(d2, 1)
        curve = 1 / (1 + a * d2**b)
        pull = w * 2 * a * b * (0.001 + d2) ** (b - 1) * curve
        push = share * (1 - w) * 2 * b * curve / (0.001 + d2)
        np.fill_diagonal(push, 0)
        force = push - pull
        move = force.sum(axis=1)[:, None] * y - force @ y
        y = y + rate * (1 - step / steps) * np.clip(move, -4, 4) * 0.25
    return y - y.mean(axis=0)


def pixel_layout(pixels: DataFrame, vector: str, key: str, landmarks: int = LANDMARKS, near: int = 10, perplexity: float = 30.0, stages: tuple = ((500, 1.2), (100, 2.5))) -> DataFrame:
    """pixels with layout_x and layout_y.  About `landmarks` pixels, drawn by the hash of their key, are embedded; a pixel stands
    at the mean of its `near` nearest landmarks, weighed at half their number as perplexity (a landmark at its own place).

    Null vectors get null.  An empty table gives an empty one.  One landmark or none: all pixels are at the origin.
    """
    total = pixels.where(F.col(vector).isNotNull()).count()
    place = F.xxhash64(F.lit("landmark"), key).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    drawn = pixels.where(F.col(vector).isNotNull() & (place < min(1.0, landmarks / max(total, 1)))).select(F.col(key).alias("key"), F.col(vector).alias("v")).toPandas().sort_values("key")
    marks = np.unique(matrix_of(drawn["v"].tolist()), axis=0)
    spots = tsne(marks, perplexity, stages) if len(marks) > 1 else np.zeros((len(marks), 2))

    @F.pandas_udf("struct<layout_x: double, layout_y: double>")
    def placed(v: pd.Series) -> pd.DataFrame:
        known = v.notna().to_numpy()
        out = np.full((len(v), 2), np.nan)
        x = matrix_of(v[known].tolist())
        if len(x) and len(marks):
            d = squared_distances(x, marks)
            k = min(near, len(marks))
            best = np.argpartition(d, k - 1, axis=1)[:, :k]
            close = np.take_along_axis(d, best, axis=1)
            w = affinities(close, max(1.0, k / 2)) if k > 1 else np.ones((len(x), 1))
            own = close <= 1e-12 * (1 + (x * x).sum(axis=1))[:, None]
            w = np.where(own.any(axis=1)[:, None], own / np.maximum(own.sum(axis=1), 1)[:, None], w)
            out[known] = (w[:, :, None] * spots[best]).sum(axis=1)
        elif len(x):
            out[known] = 0
        frame = pd.DataFrame(out, columns=["layout_x", "layout_y"]).astype(object)
        return frame.where(frame.notna(), None)

    return pixels.withColumn("_at", placed(vector)).select(*pixels.columns, "_at.layout_x", "_at.layout_y")


def view_factors(pixels: DataFrame, vector: str, views: list[int], factors: int = 10, rounds: int = 200, least: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors of several views of the same pixels: mean, loadings (features x factors) and noise variances.

    `views` names the view of each feature of the vector.  Each factor has a precision of its own in each view, so it can be
    shared or belong to one view; factors that explain less than `least` of every view are dropped.  The rounds need the
    Gram matrix only, which is one pass over the pixels.
    """
    n, s, g = gram(pixels, vector)
    mean = s / max(n, 1)
    cov = g / max(n, 1) - np.outer(mean, mean)
    view = np.asarray(views)
    if not n:
        return mean, np.zeros((len(view), 0)), np.zeros(len(view))
    values, vectors = np.linalg.eigh(cov)
    w = vectors[:, ::-1][:, :factors] * np.sqrt(np.clip(values[::-1][:factors], 1e-12, None))
    k = w.shape[1]
    noise = np.maximum(np.diag(cov) * 0.5, 1e-9)
    names = np.unique(view)
    for _ in range(rounds):
        precision = np.stack([(view == v).sum() / np.maximum((w[view == v] ** 2).sum(axis=0), 1e-9) for v in names])
        scaled = w / noise[:, None]
        inverse = np.linalg.inv(np.eye(k) + w.T @ scaled)
        to_factors = inverse @ scaled.T
        cross = cov @ to_factors.T
        second = inverse + to_factors @ cross
        for at, v in enumerate(names):
            for j in np.flatnonzero(view == v):
                w[j] = np.linalg.solve(second + np.diag(precision[at]) * noise[j] / n, cross[j])
        noise = np.maximum(np.diag(cov) - 2 * (w * cross).sum(axis=1) + ((w @ second) * w).sum(axis=1), 1e-9)
    share = explained(w, cov, view)
    keep = share.max(axis=0) >= least
    order = np.argsort(-share.sum(axis=0)[keep], kind="stable")
    w = w[:, keep][:, order]
    return mean, w * np.where(w.sum(axis=0) < 0, -1, 1), noise


def explained(loadings: np.ndarray, cov: np.ndarray, views: np.ndarray) -> np.ndarray:
    """views x factors: the share of a view's variance that a factor explains."""
    return np.stack([(loadings[views == v] ** 2).sum(axis=0) / max(np.diag(cov)[views == v].sum(), 1e-12) for v in np.unique(views)])


def factor_scores(pixels: DataFrame, vector: str, mean: np.ndarray, loadings: np.ndarray, noise: np.ndarray) -> DataFrame:
    """pixels with the expected factors of each (an array), JVM-side."""
    scaled = loadings / noise[:, None]
    to_factors = np.linalg.inv(np.eye(loadings.shape[1]) + loadings.T @ scaled) @ scaled.T
    one = [F.aggregate(F.zip_with(vector, F.array(*map(F.lit, t.tolist())), lambda x, b: x * b), F.lit(0.0), lambda s, x: s + x) - float(t @ mean) for t in to_factors]
    return pixels.withColumn("factors", F.array(*one) if one else F.array().cast("array<double>"))
