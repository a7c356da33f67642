"""Spatial operators on pixel grids and volumes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import ratio, spool, unsent
from .graph import connected_components
from .joins import FOUR, HALF, neighbours
from .quantiles import exact_quantiles


def moran(long: DataFrame, feature: str = "feature_id", section: str = "section_id", x: str = "x", y: str = "y", value: str = "value") -> DataFrame:
    """Moran's I per (feature, section) on the 4-neighbourhood with row-normalised weights; null counts as 0.

    One grouped mean and one equi-join on (feature, section, x, y): both sides are partitioned by the same key.
    """
    keys = [feature, section]
    means = long.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    z = long.join(means, keys).select(*keys, x, y, (F.col(value) - F.col("_mean")).alias("_z"))
    steps = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in FOUR)))
    sent = z.select(*keys, x, y, "_z", steps.alias("_s"))
    sent = sent.select(*keys, (F.col(x) + F.col("_s.dx")).alias(x), (F.col(y) + F.col("_s.dy")).alias(y), F.col("_z").alias("_nb"))
    lag = sent.groupBy(*keys, x, y).agg(F.avg("_nb").alias("_lag"))
    joined = z.join(unsent(lag), [*keys, x, y], "left")
    i = ratio(F.count("*"), F.count("_lag")) * ratio(F.sum(F.col("_z") * F.col("_lag")), F.sum(F.col("_z") * F.col("_z")))
    return joined.groupBy(*keys).agg(F.coalesce(i, F.lit(0.0)).alias("moran_i"))


def neighbourhood(pixels: DataFrame, section: str = "section_id", x: str = "x", y: str = "y", label: str = "label") -> DataFrame:
    """Per label, the share of each label among its 8-neighbours.  Pixels meet on half of the offsets, counts are turned."""
    other = f"nb_{label}"
    once = neighbours(pixels, HALF, section, x, y, label).groupBy(label, other).agg(F.count("*").alias("n"))
    ways = F.explode(F.array(F.struct(F.col(label).alias("a"), F.col(other).alias("b")), F.struct(F.col(other).alias("a"), F.col(label).alias("b"))))
    counts = once.select(ways.alias("_w"), "n").groupBy(F.col("_w.a").alias(label), F.col("_w.b").alias(other)).agg(F.sum("n").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(label)))


def neighbourhood_map(pixels: DataFrame, section: str = "section_id", x: str = "x", y: str = "y", label: str = "label") -> DataFrame:
    """The same as a map per label."""
    shares = neighbourhood(pixels, section, x, y, label)
    return shares.groupBy(label).agg(F.map_from_entries(F.collect_list(F.struct(f"nb_{label}", "share"))).alias("proportions"))


def nearest_distance(pixels: DataFrame, section: str = "section_id", x: str = "x", y: str = "y", reach: int | None = None) -> DataFrame:
    """Distance of each pixel to the nearest other one of its section; pixels without one are left out.

    Pixels meet in tiles of `reach` (else twice the spacing that their number lets expect); what has no neighbour within reach is searched again with tiles twice as wide, until
    all are found or one tile holds a section.  A distance is final only if it is at most the tile's width.
    """
    *spans, count, sections = pixels.agg(F.max(x) - F.min(x), F.max(y) - F.min(y), F.count("*"), F.approx_count_distinct(section)).first()
    widest = max(int(s or 0) for s in spans) + 1
    area = (int(spans[0] or 0) + 1) * (int(spans[1] or 0) + 1) * max(sections, 1)
    todo, done, width = pixels.select(section, x, y), None, reach or min(widest, max(2, round(2 * (area / max(count, 1)) ** 0.5)))
    everything = pixels.select(section, F.col(x).alias("_x"), F.col(y).alias("_y"))
    while True:
        tiles = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
        left = todo.select(section, x, y, tiles.alias("_t")).select(section, x, y, (F.floor(F.col(x) / width) + F.col("_t.i")).alias("_i"), (F.floor(F.col(y) / width) + F.col("_t.j")).alias("_j"))
        right = everything.withColumn("_i", F.floor(F.col("_x") / width)).withColumn("_j", F.floor(F.col("_y") / width))
        near = left.join(unsent(right), [section, "_i", "_j"]).where((F.col(x) != F.col("_x")) | (F.col(y) != F.col("_y")))
        apart = F.min(F.pow(F.col(x) - F.col("_x"), 2) + F.pow(F.col(y) - F.col("_y"), 2))
        found = near.groupBy(section, x, y).agg(F.sqrt(apart).alias("distance"))
        last = width >= widest
        found = spool(found if last else found.where(F.col("distance") <= width))
        done = found if done is None else done.unionByName(found)
        if last:
            return done
        todo = spool(todo.join(unsent(found), [section, x, y], "left_anti"))
        if todo.isEmpty():
            return done
        width *= 2


def thin(pixels: DataFrame, seed: int = 42, section: str = "section_id", x: str = "x", y: str = "y", apart: int = 3) -> DataFrame:
    """A random maximal subset whose members are at least `apart` from each other (Chebyshev) within a section.

    Rounds on DataFrames: a pixel whose hash is the least among the remaining ones near it is kept and those near it go.
    """
    left = spool(pixels.select(section, x, y).distinct().withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), section, x, y).cast("binary"))))
    steps = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(1 - apart, apart) for dy in range(1 - apart, apart))))
    kept = None
    while not left.isEmpty():
        sent = left.select(section, x, y, F.struct("_h", x, y).alias("_me"), steps.alias("_s"))
        sent = sent.select(section, (F.col(x) + F.col("_s.dx")).alias(x), (F.col(y) + F.col("_s.dy")).alias(y), "_me")
        least = sent.groupBy(section, x, y).agg(F.min("_me").alias("_least"))
        now = spool(left.join(unsent(least), [section, x, y]).where(F.struct("_h", x, y) == F.col("_least")).select(section, x, y))
        kept = now if kept is None else kept.unionByName(now)
        near = now.select(section, x, y, steps.alias("_s")).select(section, (F.col(x) + F.col("_s.dx")).alias(x), (F.col(y) + F.col("_s.dy")).alias(y)).distinct()
        left = spool(left.join(unsent(near), [section, x, y], "left_anti"))
    return pixels.select(section, x, y).limit(0) if kept is None else kept


def train_test(pixels: DataFrame, seed: int = 42, section: str = "section_id", x: str = "x", y: str = "y") -> tuple[DataFrame, DataFrame]:
    """A thinned set, and a thinned set of what it leaves."""
    train = thin(pixels, seed, section, x, y)
    return train, thin(pixels.join(unsent(train), [section, x, y], "left_anti"), seed, section, x, y)


def voxels(points: DataFrame, i: Column, j: Column, k: Column, shape: tuple[int, int, int]) -> DataFrame:
    """Distinct occupied voxels within a grid."""
    cells = points.select(i.cast("int").alias("i"), j.cast("int").alias("j"), k.cast("int").alias("k"))
    inside = cells.where(F.col("i").between(0, shape[0] - 1) & F.col("j").between(0, shape[1] - 1) & F.col("k").between(0, shape[2] - 1))
    return inside.distinct()


def raster(points: DataFrame, section: str, x: str, y: str, value: str, order: str) -> DataFrame:
    """One value per cell and section; of several the last in order wins."""
    cells = points.groupBy(section, F.col(x).cast("int").alias("col"), F.col(y).cast("int").alias("row"))
    return cells.agg(F.max_by(value, order).alias(value))


def border(cells: DataFrame, section: str, x: str, y: str, label: str) -> DataFrame:
    """Cells that erosion removes: those of which a 4-neighbour is missing or has another label."""
    same = neighbours(cells, FOUR, section, x, y, label).where(F.col(label) == F.col(f"nb_{label}"))
    whole = same.groupBy(section, x, y).agg(F.count("*").alias("_n")).where(F.col("_n") == 4)
    return cells.join(unsent(whole), [section, x, y], "left_anti")


def to_255(values: DataFrame, value: str) -> DataFrame:
    """value scaled to 0..255; at or below the lowest decile it becomes 0."""
    ends = values.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")).join(F.broadcast(exact_quantiles(values, [], value, [0.1])), how="left").withColumn("_q", F.get("_q", F.lit(0)))
    scaled = F.coalesce(ratio((F.col(value) - F.col("_lo")) * 255, F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return values.crossJoin(F.broadcast(ends)).withColumn("scaled", F.when(F.col(value) <= F.col("_q"), 0.0).otherwise(scaled)).drop("_lo", "_hi", "_q")


#: Edge of the cubes whose voxels are filled against the same known ones, and numbers of one matrix of distances.
CUBE, PAIRS = 8, 1 << 20


def _filled(t: np.ndarray, p: np.ndarray, v: np.ndarray, radius: float) -> np.ndarray:
    """Means of known values v at p around voxels t, by e^-distance within the radius; NaN where there are none.

    Cube by cube.  Known voxels so much farther than the nearest one that all of them together change no digit are
    skipped."""
    out = np.full(len(t), np.nan)
    if not len(t) or not len(p):
        return out
    cube = t // CUBE
    order = np.lexsort(cube.T)
    starts = np.flatnonzero(np.concatenate(([True], (cube[order][1:] != cube[order][:-1]).any(axis=1))))
    for rows in np.split(order, starts[1:]):
        mine = t[rows]
        low, high = mine.min(axis=0), mine.max(axis=0)
        apart = np.sqrt(((p - (low + high) / 2) ** 2).sum(axis=1))
        half = np.sqrt(((high - low) ** 2).sum()) / 2
        reach = min(radius, apart.min() + half + 40 + np.log(len(p)))
        near = np.flatnonzero(apart - half <= reach)
        whole, value = np.zeros(len(mine)), np.zeros(len(mine))
        step = max(1, PAIRS // len(mine))
        for at in range(0, len(near), step):
            some = near[at:at + step]
            d = np.sqrt(((mine[:, None] - p[some][None]) ** 2).sum(axis=2))
            w = np.where(d <= radius, np.exp(-d), 0.0)
            whole += w.sum(axis=1)
            value += w @ v[some]
        out[rows] = np.divide(value, whole, out=np.full(len(mine), np.nan), where=whole > 0)
    return out


def interpolate(volume: DataFrame, known: DataFrame, radius: int, value: str = "value", region: str = "region", first: int = 8, edge: int = 64) -> DataFrame:
    """Values of the voxels of `volume` (i, j, k, region) as the mean of known voxels (i, j, k, region, value >= 0) of the same
    region within `radius`, weighed by e^-distance; known values are kept, voxels with i < first are left out.

    The volume is cut into blocks of `edge`; a block and the known voxels of its halo are arrays in one task.  Known voxels
    are shuffled once for each block that they can reach (on average ((edge + 2 radius) / edge)^3 of them), voxels once,
    and no pair of voxels is ever a row.  Defined cases: voxels without a region are not filled; known voxels carry the
    region of their place; of several values of one voxel the largest is kept, all of them count for others."""
    def block(c: Column) -> Column:
        return F.floor(c / edge)

    cells = volume.select(F.col(region).alias("_region"), *(F.col(c).cast("long").alias(c) for c in "ijk"), *(block(F.col(c)).alias(f"_{c}") for c in "ijk"), F.lit(None).cast("double").alias("_v"))
    reached = [F.sequence(block(F.col(c) - radius), block(F.col(c) + radius)) for c in "ijk"]
    sent = known.where(F.col(value) >= 0).select(F.col(region).alias("_region"), *(F.col(c).cast("long").alias(c) for c in "ijk"), F.col(value).cast("double").alias("_v"))
    for c, span in zip("ijk", reached):
        sent = sent.withColumn(f"_{c}", F.explode(span))
    kind = dict(volume.dtypes)[region]

    def fill(table: pa.Table) -> pa.Table:
        where = table.column("_region")[0].as_py()
        place = np.stack([table.column(c).to_numpy() for c in "ijk"], axis=1)
        v = table.column("_v").to_numpy(zero_copy_only=False).astype(float)
        target = np.isnan(v)
        t, p, v = place[target], place[~target], v[~target]
        out = np.full(len(t), np.nan)
        order = np.argsort(v, kind="stable")
        own = dict(zip(map(tuple, p[order].tolist()), v[order].tolist()))
        out = np.array([own.get(x, np.nan) for x in map(tuple, t.tolist())], dtype=float)
        if where is not None:
            empty = np.flatnonzero(np.isnan(out) & (t[:, 0] >= first))
            out[empty] = _filled(t[empty], p, v, radius)
        return pa.table({**{c: t[:, n] for n, c in enumerate("ijk")}, region: pa.array([where] * len(t), table.schema.field("_region").type), value: pa.array(out, from_pandas=True)})

    blocks = cells.unionByName(sent).groupBy("_region", "_i", "_j", "_k")
    return blocks.applyInArrow(fill, f"i long, j long, k long, `{region}` {kind}, `{value}` double")


def box_fill(volume: DataFrame, size: int = 10, value: str = "value") -> DataFrame:
    """Missing values of (i, j, k, value) become the mean of the known ones in a box of `size`; separable sums along each axis."""
    low, high = size // 2, size - size // 2
    reach = F.explode(F.sequence(F.lit(1 - high), F.lit(low)))
    sums = volume.where(F.col(value).isNotNull()).select("i", "j", "k", F.col(value).alias("_s"), F.lit(1).cast("long").alias("_n"))
    for axis in ("i", "j", "k"):
        sums = sums.withColumn("_o", reach).withColumn(axis, F.col(axis) + F.col("_o")).groupBy("i", "j", "k").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    return volume.join(sums, ["i", "j", "k"], "left").select(*(c for c in volume.columns if c != value), F.coalesce(F.col(value), F.col("_s") / F.col("_n")).alias(value))


def volume_of_feature(pixels: DataFrame, atlas: DataFrame, value: str, radius: int, threshold: float = 50.0) -> DataFrame:
    """The whole way of one feature from pixels (i, j, k, value) to a filled volume over the atlas (i, j, k, region):
    mean log per voxel, 0..255, what is under the threshold is empty, interpolation by region, box filling."""
    means = pixels.groupBy("i", "j", "k").agg(F.avg(F.when(F.col(value) > 0, F.ln(value))).alias("value"))
    scaled = to_255(means.where("value IS NOT NULL"), "value").where(F.col("scaled") >= threshold).select("i", "j", "k", F.col("scaled").alias("value"))
    known = scaled.join(atlas, ["i", "j", "k"])
    return box_fill(interpolate(atlas, known, radius))


#: Edge of the blocks whose voxels are labelled by one task, and half of the 26 offsets.
BLOCK = 64
HALF_26 = tuple((a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0))


def _block_labels(table: pa.Table) -> pa.Table:
    """i, j, k of distinct voxels of a block with their component's least voxel (ci, cj, ck) inside the block."""
    p = np.stack([table.column(c).to_numpy() for c in "ijk"], axis=1)
    p = p[np.lexsort(p.T[::-1])]
    low = p.min(axis=0)
    shape = p.max(axis=0) - low + 3
    at = np.ravel_multi_index((p - low + 1).T, shape)
    grid = np.full(shape.prod(), -1)
    grid[at] = np.arange(len(p))
    met = [(np.flatnonzero(to >= 0), to[to >= 0]) for a, b, c in HALF_26 for to in [grid[at + (a * shape[1] + b) * shape[2] + c]]]
    u, v = np.concatenate([x for x, _ in met]), np.concatenate([x for _, x in met])
    label = np.arange(len(p))
    while len(u):  # roots are hooked to smaller ones, then all point to their root
        np.minimum.at(label, np.maximum(label[u], label[v]), np.minimum(label[u], label[v]))
        while (label[label] != label).any():
            label = label[label]
        apart = label[u] != label[v]
        u, v = u[apart], v[apart]
    return pa.table({c: x for names, q in ((("i", "j", "k"), p), (("ci", "cj", "ck"), p[label])) for c, x in zip(names, q.T)})


def components_3d(mask: DataFrame, rounds: int = 200, edge: int = BLOCK) -> DataFrame:
    """Connected components (26-neighbourhood) of voxels (i, j, k): i, j, k, component (its least voxel).

    Each block of edge^3 voxels is labelled by one task; only pairs of labels that meet at the faces of blocks go through
    rounds, so a voxel is shuffled twice, whatever the number of rounds."""
    kind = dict(mask.dtypes)
    block = lambda c: F.floor(F.col(c) / edge)
    cells = mask.select(*(F.col(c).cast("long").alias(c) for c in "ijk")).dropna().distinct()
    parts = spool(cells.groupBy(*(block(c).alias(f"_{c}") for c in "ijk")).applyInArrow(_block_labels, "i long, j long, k long, ci long, cj long, ck long"))
    parts = parts.select("i", "j", "k", F.struct(*(F.col(f"c{c}").alias(c) for c in "ijk")).alias("_part"))
    faces = parts.where(" OR ".join(f"pmod({c}, {edge}) IN (0, {edge - 1})" for c in "ijk"))
    steps = F.explode(F.array(*(F.struct(*(F.lit(d).alias(c) for c, d in zip("ijk", o))) for o in HALF_26)))
    sent = faces.select("i", "j", "k", F.col("_part").alias("u"), steps.alias("_s")).where(" OR ".join(f"floor(({c} + _s.{c}) / {edge}) <> floor({c} / {edge})" for c in "ijk"))
    sent = sent.select(*((F.col(c) + F.col(f"_s.{c}")).alias(c) for c in "ijk"), "u")
    links = sent.join(unsent(faces), ["i", "j", "k"]).select("u", F.col("_part").alias("v")).distinct()
    whole = connected_components(links, "u", "v", rounds).select(F.col("node").alias("_part"), "component")
    labelled = parts.join(unsent(whole), "_part", "left").withColumn("_c", F.coalesce("component", "_part"))
    return labelled.select(*(F.col(c).cast(kind[c]).alias(c) for c in "ijk"), F.struct(*(F.col(f"_c.{c}").cast(kind[c]).alias(c) for c in "ijk")).alias("component"))


def largest_components(mask: DataFrame, k: int = 4) -> DataFrame:
    """The voxels of the k largest components."""
    labelled = components_3d(mask)
    best = labelled.groupBy("component").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "component").limit(k).select("component")
    return labelled.join(F.broadcast(best), "component", "left_semi").select("i", "j", "k")


def symmetrise(mask: DataFrame, width: int, axis: str = "k") -> DataFrame:
    """The mask and its mirror image along an axis of `width` voxels."""
    return mask.unionByName(mask.withColumn(axis, F.lit(width - 1) - F.col(axis))).distinct()


def close(mask: DataFrame, reach: int = 1) -> DataFrame:
    """Morphological closing with a cube: dilation, then erosion."""
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) for c in range(-reach, reach + 1))))

    def sent(df: DataFrame) -> DataFrame:
        return df.select("i", "j", "k", steps.alias("_s")).select((F.col("i") + F.col("_s.a")).alias("i"), (F.col("j") + F.col("_s.b")).alias("j"), (F.col("k") + F.col("_s.c")).alias("k"))

    grown = sent(mask).distinct()
    return sent(grown).groupBy("i", "j", "k").agg(F.count("*").alias("_n")).where(F.col("_n") == (2 * reach + 1) ** 3).select("i", "j", "k")


def gaussian_3d(mask: DataFrame, sigma: float = 2.5) -> DataFrame:
    """Separable Gaussian smoothing of a mask: i, j, k, density."""
    radius = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    kernel = F.explode(F.array(*(F.struct(F.lit(d - radius).alias("d"), F.lit(float(v)).alias("w")) for d, v in enumerate(w / w.sum()))))
    out = mask.select("i", "j", "k", F.lit(1.0).alias("density"))
    for axis in ("i", "j", "k"):
        out = out.withColumn("_k", kernel).withColumn(axis, F.col(axis) + F.col("_k.d")).withColumn("density", F.col("density") * F.col("_k.w")).groupBy("i", "j", "k").agg(F.sum("density").alias("density"))
    return out
