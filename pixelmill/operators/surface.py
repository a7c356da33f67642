"""Surfaces of volumes by marching tetrahedra: triangles and the vertices that they share.

Each cell of eight voxels is cut into six tetrahedra around its main diagonal, alike everywhere, so that faces of
neighbouring cells meet.  A vertex lies on an edge between a voxel inside and one outside; its key is the edge's lower voxel
and direction, so cells agree on it without looking at each other."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edge of the blocks that are arrays in one task.
EDGE = 32
#: Directions of edges by number - 1: bits of i, j, k from 1 to 7.
STEPS = np.array([[d >> 2 & 1, d >> 1 & 1, d & 1] for d in range(8)])


def _tetrahedra() -> np.ndarray:
    """Corners (0 to 7) of the six tetrahedra, each a way along the axes from corner 0 to corner 7."""
    return np.array([[0, 1 << a, (1 << a) | (1 << b), 7] for a, b, _ in permutations(range(3))])


def _triangles(inside: np.ndarray) -> list[list[tuple[int, int]]]:
    """Triangles of a tetrahedron as triples of edges (two of its corners), by which corners are inside."""
    within, beyond = np.flatnonzero(inside).tolist(), np.flatnonzero(~inside).tolist()
    if len(within) in (0, 4):
        return []
    if len(within) == 2:
        (a, b), (c, d) = within, beyond
        return [[(a, c), (a, d), (b, d)], [(a, c), (b, d), (b, c)]]
    one, rest = (within[0], beyond) if len(within) == 1 else (beyond[0], within)
    return [[(one, r) for r in rest]]


def march(values: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
    """Of an array of voxels: keys (triangle, 3, lower voxel and direction) and places (triangle, 3, 3), with normals that
    point outwards."""
    keys, places = [], []
    n = np.array(values.shape) - 1
    corner = np.stack([values[i:i + n[0], j:j + n[1], k:k + n[2]] for i, j, k in STEPS], axis=-1)
    inside = corner > level
    cells = np.argwhere(inside.any(axis=-1) & ~inside.all(axis=-1))
    corner, inside = corner[tuple(cells.T)], inside[tuple(cells.T)]
    for tetrahedron in _tetrahedra():
        mine = inside[:, tetrahedron]
        case = mine @ (1 << np.arange(4))
        for number in range(1, 15):
            at = np.flatnonzero(case == number)
            bits = np.array([number >> b & 1 for b in range(4)], bool)
            for triangle in _triangles(bits) if len(at) else []:
                key, place = [], []
                for a, b in triangle:
                    low, high = sorted((int(tetrahedron[a]), int(tetrahedron[b])))  # along a way, the lower corner is the lower number
                    base, step = cells[at] + STEPS[low], STEPS[high] - STEPS[low]
                    t = (level - corner[at, low]) / (corner[at, high] - corner[at, low])
                    key.append(np.concatenate((base, np.full((len(at), 1), step @ [4, 2, 1])), axis=1))
                    place.append(base + t[:, None] * step)
                key, place = np.stack(key, axis=1), np.stack(place, axis=1)
                normal = np.cross(place[:, 1] - place[:, 0], place[:, 2] - place[:, 0])
                outwards = STEPS[tetrahedron[~bits]].mean(axis=0) - STEPS[tetrahedron[bits]].mean(axis=0)
                turned = normal @ outwards < 0
                key[turned], place[turned] = key[turned][:, ::-1], place[turned][:, ::-1]
                keys.append(key)
                places.append(place)
    if not keys:
        return np.zeros((0, 3, 4), int), np.zeros((0, 3, 3))
    return np.concatenate(keys), np.concatenate(places)


def surface(volume: DataFrame, level: float, value: str = "value", outside: float = 0.0, edge: int = EDGE) -> DataFrame:
    """One row a triangle of the surface where value passes `level`: a, b, c, each struct(i, j, k, step, x, y, z) of a vertex.

    volume: i, j, k, value; voxels that are missing or null count as `outside` (not above the level), so surfaces are closed.
    Voxels are shuffled to their block, those at its lower faces to the neighbours too; a block is one array.  Of voxels
    that are there twice the largest value counts."""
    if outside > level:
        raise ValueError("outside must not be above the level")
    sent = volume.where(F.col(value).isNotNull()).select(*(F.col(c).cast("long").alias(c) for c in "ijk"), F.col(value).cast("double").alias("_v"))
    for c in "ijk":
        own, before = F.floor(F.col(c) / edge), F.floor((F.col(c) - 1) / edge)
        sent = sent.withColumn(f"_{c}", F.explode(F.array_distinct(F.array(own, before))))
    vertex = pa.struct([("i", pa.int64()), ("j", pa.int64()), ("k", pa.int64()), ("step", pa.int32()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        start = np.array([table.column(f"_{c}")[0].as_py() for c in "ijk"]) * edge
        cells = np.full((edge + 1,) * 3, outside)
        at = tuple(table.column(c).to_numpy() - s for c, s in zip("ijk", start))
        order = np.argsort(table.column("_v").to_numpy(), kind="stable")
        cells[tuple(a[order] for a in at)] = table.column("_v").to_numpy()[order]
        key, place = march(cells, level)
        out = {}
        for n, name in enumerate("abc"):
            columns = [*(pa.array(key[:, n, d] + start[d], pa.int64()) for d in range(3)), pa.array(key[:, n, 3], pa.int32()), *(pa.array(place[:, n, d] + start[d]) for d in range(3))]
            out[name] = pa.StructArray.from_arrays(columns, fields=list(vertex))
        return pa.table(out)

    kind = "struct<i: bigint, j: bigint, k: bigint, step: int, x: double, y: double, z: double>"
    return sent.groupBy("_i", "_j", "_k").applyInArrow(run, f"a {kind}, b {kind}, c {kind}")


def vertices(triangles: DataFrame) -> DataFrame:
    """i, j, k, step, x, y, z: each vertex once."""
    return triangles.select(F.explode(F.array("a", "b", "c")).alias("v")).groupBy("v.i", "v.j", "v.k", "v.step").agg(*(F.min(f"v.{c}").alias(c) for c in "xyz"))


def measures(triangles: DataFrame) -> DataFrame:
    """One row: triangles, area and enclosed volume of the surface."""
    def cross(p: str, q: str, d: int):
        e, f = ("xyz"[(d + 1) % 3], "xyz"[(d + 2) % 3])
        return (F.col(f"{p}.{e}") - F.col(f"a.{e}")) * (F.col(f"{q}.{f}") - F.col(f"a.{f}")) - (F.col(f"{p}.{f}") - F.col(f"a.{f}")) * (F.col(f"{q}.{e}") - F.col(f"a.{e}"))

    normal = [cross("b", "c", d) for d in range(3)]
    size = F.sqrt(sum((n * n for n in normal), F.lit(0.0))) / 2
    held = sum((F.col(f"a.{c}") * n for c, n in zip("xyz", normal)), F.lit(0.0)) / 6
    return triangles.agg(F.count("*").alias("triangles"), F.coalesce(F.sum(size), F.lit(0.0)).alias("area"), F.coalesce(F.sum(held), F.lit(0.0)).alias("volume"))
