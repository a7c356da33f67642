"""Surfaces of a sphere and a torus: closed, of the right Euler number, area and volume; block borders do not show."""

import numpy as np
import pytest

from pixelmill.operators import surface as S


def voxels(spark, f, low, high):
    grid = np.stack(np.meshgrid(*[np.arange(low, high)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    v = f(grid.astype(float))
    return spark.createDataFrame([(*map(int, p), float(x)) for p, x in zip(grid, v) if x > -4], "i int, j int, k int, value double")


def mesh(triangles):
    rows = triangles.collect()
    key = lambda v: tuple(v)[:4]
    return [[key(r[c]) for c in "abc"] for r in rows]


def euler(faces):
    """Vertices - edges + faces; each edge must belong to two triangles that run along it in opposite directions."""
    sides = [(t[i], t[(i + 1) % 3]) for t in faces for i in range(3)]
    assert len(set(sides)) == len(sides) and {(b, a) for a, b in sides} == set(sides)
    return len({v for t in faces for v in t}) - len(sides) // 2 + len(faces)


@pytest.mark.parametrize("edge", [7, 32])
def test_sphere(spark, edge):
    df = voxels(spark, lambda p: 9.3 - np.sqrt(((p - 0.2) ** 2).sum(axis=1)), -13, 14)
    triangles = S.surface(df, 0.0, outside=-4.0, edge=edge)
    faces = mesh(triangles)
    assert euler(faces) == 2
    r = S.measures(triangles).first()
    assert r["triangles"] == len(faces)
    assert r["area"] == pytest.approx(4 * np.pi * 9.3**2, rel=0.03) and r["volume"] == pytest.approx(4 / 3 * np.pi * 9.3**3, rel=0.03)
    points = S.vertices(triangles).collect()
    assert len(points) == len({v for t in faces for v in t})
    assert all(abs(np.sqrt(((np.array([p["x"], p["y"], p["z"]]) - 0.2) ** 2).sum()) - 9.3) < 0.1 for p in points)


def test_torus(spark):
    f = lambda p: 3.4 - np.sqrt((np.sqrt(p[:, 0] ** 2 + p[:, 1] ** 2) - 8.1) ** 2 + p[:, 2] ** 2)
    triangles = S.surface(voxels(spark, f, -14, 15), 0.0, outside=-4.0, edge=8)
    assert euler(mesh(triangles)) == 0
    assert S.measures(triangles).first()["area"] == pytest.approx(4 * np.pi**2 * 8.1 * 3.4, rel=0.03)


def test_every_pattern_closes():
    """Random voxels: surfaces stay closed whatever the pattern, and nothing inside gives nothing."""
    rng = np.random.default_rng(0)
    for _ in range(20):
        cells = np.pad(rng.random((4, 4, 4)), 1)
        key, place = S.march(cells, 0.5)
        euler([[tuple(v) for v in t] for t in key.tolist()])
    assert len(S.march(np.zeros((3, 3, 3)), 0.5)[0]) == 0


def test_odd_volumes(spark):
    one = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 0, 0.2), (5, 5, 5, None), (-40, 3, 3, 1.0)], "i int, j int, k int, value double")
    triangles = S.surface(one, 0.5)
    assert euler(mesh(triangles)) == 4  # two spheres
    assert S.surface(one.limit(0), 0.5).count() == 0 and tuple(S.measures(S.surface(one.limit(0), 0.5)).first()) == (0, 0.0, 0.0)
    with pytest.raises(ValueError):
        S.surface(one, 0.5, outside=1.0)
