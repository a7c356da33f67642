"""Layouts, communities and factors: invariants and planted structure."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.operators import graph as G
from pixelmill.operators import layout as Y


def blobs(rng, count, size, width=8):
    centres = 10 * rng.normal(size=(count, width))
    return np.concatenate([c + rng.normal(size=(size, width)) for c in centres]), np.repeat(np.arange(count), size)


def same_neighbour(at, label):
    d = Y.squared_distances(at, at)
    np.fill_diagonal(d, np.inf)
    return (label[d.argmin(axis=1)] == label).mean()


def test_affinities_have_the_perplexity():
    x = np.random.default_rng(0).normal(size=(50, 3))
    d = Y.squared_distances(x, x)
    np.fill_diagonal(d, np.inf)
    p = Y.affinities(d, 12.0)
    assert p.sum(axis=1) == pytest.approx(1) and np.diag(p) == pytest.approx(0)
    assert np.exp(-(p * np.log(np.where(p > 0, p, 1))).sum(axis=1)) == pytest.approx(12.0, rel=1e-3)


def test_layouts_keep_groups_apart():
    x, label = blobs(np.random.default_rng(1), 4, 25)
    for layout in (Y.tsne, Y.umap):
        at = layout(x)
        assert at.shape == (100, 2) and np.isfinite(at).all() and same_neighbour(at, label) > 0.95
        assert np.array_equal(at, layout(x))
        for n in (0, 1, 2, 3):
            assert layout(x[:n]).shape == (n, 2)
        assert np.isfinite(layout(np.zeros((6, 4)))).all()
    graph = Y.fuzzy_graph(np.sqrt(np.where(np.eye(100) > 0, np.inf, Y.squared_distances(x, x))), 10)
    assert np.array_equal(graph, graph.T) and graph.min() >= 0 and graph.max() <= 1 + 1e-12


def test_pixels_are_placed_among_landmarks(spark):
    x, label = blobs(np.random.default_rng(2), 3, 60)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(500, None, "x"), (501, x[0].tolist(), "x")]
    df = spark.createDataFrame(rows, "id long, v array<double>, layout string")
    got = {r["id"]: (r["layout_x"], r["layout_y"]) for r in Y.pixel_layout(df, "v", "id", landmarks=80, stages=((200, 1.2),)).collect()}
    assert got[500] == (None, None) and got[501] == pytest.approx(got[0])
    assert same_neighbour(np.array([got[i] for i in range(180)]), label) > 0.95
    assert Y.pixel_layout(df.limit(0), "v", "id").count() == 0


def test_communities_are_connected_and_no_worse():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n = 30
        group = rng.integers(0, 4, n)
        w = rng.random((n, n)) * (rng.random((n, n)) < np.where(group[:, None] == group, 0.5, 0.05))
        w = np.triu(w, 1) + np.triu(w, 1).T
        labels = G.leiden(w)
        assert G.partition_quality(w, labels) >= G.partition_quality(w, G.louvain(w)) - 0.03
        for c in np.unique(labels):
            inside = np.flatnonzero(labels == c)
            reach = np.linalg.matrix_power((w[np.ix_(inside, inside)] > 0) + np.eye(len(inside)), len(inside))
            assert (reach > 0).all()
    assert G.leiden(np.zeros((3, 3))).tolist() == [0, 1, 2] and len(G.leiden(np.zeros((0, 0)))) == 0


def test_factors_of_two_views(spark):
    """One shared factor and one of each view: the shares say which is which, and scores follow the planted ones."""
    rng = np.random.default_rng(4)
    z = rng.normal(size=(2000, 3))
    w = np.zeros((16, 3))
    w[:, 0], w[:8, 1], w[8:, 2] = rng.normal(size=16) * 2, rng.normal(size=8), rng.normal(size=8)
    x = z @ w.T + 0.1 * rng.normal(size=(2000, 16)) + 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    views = [0] * 8 + [1] * 8
    mean, loadings, noise = Y.view_factors(df, "v", views, factors=6)
    assert mean == pytest.approx(x.mean(axis=0))
    assert np.abs(loadings @ loadings.T + np.diag(noise) - np.cov(x.T, bias=True)).max() < 0.3
    share = Y.explained(loadings, np.cov(x.T, bias=True), np.array(views))
    assert (share.sum(axis=1) > 0.9).all()
    got = np.array([r["factors"] for r in Y.factor_scores(df, "v", mean, loadings, noise).orderBy("id").collect()])
    for f in range(3):
        fit = np.linalg.lstsq(got, z[:, f], rcond=None)[0]
        assert np.corrcoef(got @ fit, z[:, f])[0, 1] > 0.98
    assert Y.view_factors(df.limit(0), "v", [])[1].shape == (0, 0)
    assert Y.factor_scores(df.limit(1), "v", np.zeros(16), np.zeros((16, 0)), np.ones(16)).select(F.size("factors")).first()[0] == 0
