"""Restoring unreliable features from an embedding, and assembling the final feature matrix.

All features are boosted together: a level of the trees of all features is one pass over the pixels, in which each task adds
up residuals by (feature, node, bin of a dimension); the best splits are found where a feature's sums meet, so the
driver gets a row a feature and node.  The number of passes depends on trees and depth, not on features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import ratio, spool
from .windows import top_above

#: Bins of a dimension, bytes of sums that a task holds, and trees after which residuals are written anew.
BINS, HELD, REWRITE = 32, 64 << 20, 5


def usage(moran: DataFrame, feature: str = "feature_id", section: str = "section_id", value: str = "moran_i", threshold: float = 0.4, top: int = 3, least_sections: int = 3, least_sum: int = 2) -> DataFrame:
    """Per feature that more than least_sections sections and more than least_sum chosen ones pass: section, role.  Of the chosen
    sections in order the 1st and 3rd train, the 2nd validates."""
    wide = moran.where(F.col(value) > threshold).groupBy(feature).count().where(F.col("count") > least_sections).select(feature)
    chosen = top_above(moran.join(wide, feature, "left_semi"), feature, value, section, top, threshold)
    own = Window.partitionBy(feature)
    placed = chosen.withColumn("_i", F.row_number().over(own.orderBy(section)) - 1).withColumn("_n", F.count("*").over(own)).where(F.col("_n") > least_sum)
    return placed.select(feature, section, F.when(F.col("_i") == 1, "val").otherwise("train").alias("role"))


@dataclass
class Forest:
    """Trees of all features, as complete trees of one depth; a node that does not split sends all to the left."""
    features: list
    edges: list[np.ndarray]  # of the bins of each dimension
    first: np.ndarray  # the mean of each feature
    dims: np.ndarray  # tree, feature, node
    bins: np.ndarray
    leaves: np.ndarray  # tree, feature, leaf

    def leaf(self, tree: int, codes: np.ndarray, row: np.ndarray, feature: np.ndarray, levels: int) -> np.ndarray:
        """The node at a level (0 the root) that each (row, feature) reaches, numbered within the level."""
        node = np.zeros(len(row), np.int64)
        for level in range(levels):
            at = (1 << level) - 1 + node
            node = 2 * node + (codes[row, self.dims[tree, feature, at]] > self.bins[tree, feature, at])
        return node

    def added(self, trees: range, codes: np.ndarray, row: np.ndarray, feature: np.ndarray) -> np.ndarray:
        depth = int(self.leaves.shape[2]).bit_length() - 1
        return sum((self.leaves[t, feature, self.leaf(t, codes, row, feature, depth)] for t in trees), np.zeros(len(row)))

    def predict(self, codes: np.ndarray, row: np.ndarray, feature: np.ndarray) -> np.ndarray:
        return self.first[feature] + self.added(range(len(self.leaves)), codes, row, feature)


def _codes(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of each row, a byte a dimension."""
    return np.stack([np.searchsorted(e, x[:, d]) for d, e in enumerate(edges)], axis=1).astype(np.uint8)


def _matrix(codes: pa.Array, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), dimensions)


def _binned(pixels: DataFrame, embedding: str, edges: list[np.ndarray], keep: list[str]) -> DataFrame:
    @F.pandas_udf("binary")
    def code(v):
        import pandas as pd
        return pd.Series([c.tobytes() for c in _codes(np.array(v.tolist(), dtype=float).reshape(len(v), -1), edges)])
    return pixels.select(*keep, code(embedding).alias("codes"))


def _edges(pixels: DataFrame, embedding: str) -> list[np.ndarray]:
    """Quantiles that cut each dimension into BINS bins."""
    shares = [i / BINS for i in range(1, BINS)]
    n = len(pixels.select(embedding).first()[0])
    found = pixels.select(*(F.get(embedding, F.lit(i)).alias(f"c{i}") for i in range(n))).agg(*(F.percentile_approx(f"c{i}", shares, 10_000) for i in range(n))).first()
    return [np.unique(np.array(e, dtype=float)) for e in found]


def _level_splits(rows: DataFrame, forest: Forest, done: range, tree: int, level: int) -> DataFrame:
    """feature, node, dim, bin, and the sums and counts left and right of the best split of each node of a level."""
    dimensions, nodes = len(forest.edges), 1 << level
    size = nodes * dimensions * BINS * 2

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.ravel() for v in held.values()], pa.list_(pa.float64()))], names=["feature", "v"])
            held.clear()
            return batch

        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                codes, lists = _matrix(part.column(0), dimensions), part.column(1)
                row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                feature, y = lists.flatten().to_numpy(), part.column(2).flatten().to_numpy()
                y = y - forest.added(done, codes, row, feature)
                node = forest.leaf(tree, codes, row, feature, level)
                there, local = np.unique(feature, return_inverse=True)
                base = (local * nodes + node) * BINS
                for d in range(dimensions):
                    at = base + codes[row, d]
                    total, count = (np.bincount(at, w, minlength=len(there) * nodes * BINS).reshape(len(there), nodes, BINS) for w in (y, None))
                    for i, f in enumerate(there.tolist()):
                        mine = held.setdefault(f, np.zeros((nodes, dimensions, BINS, 2)))
                        mine[:, d, :, 0] += total[i]
                        mine[:, d, :, 1] += count[i]
                if len(held) * size * 8 > HELD:
                    yield out()
        if held:
            yield out()

    def best(table: pa.Table) -> pa.Table:
        whole = np.array(table.column("v").combine_chunks().flatten()).reshape(table.num_rows, nodes, dimensions, BINS, 2).sum(axis=0)
        left = whole.cumsum(axis=2)[:, :, :-1]
        total = whole.sum(axis=2)[:, :, None]
        right = total - left
        with np.errstate(invalid="ignore", divide="ignore"):
            gain = left[..., 0] ** 2 / left[..., 1] + right[..., 0] ** 2 / right[..., 1] - total[..., 0] ** 2 / total[..., 1]
        gain = np.where((left[..., 1] > 0) & (right[..., 1] > 0), gain, -np.inf).reshape(nodes, -1)
        at = gain.argmax(axis=1)
        node, splits = np.arange(nodes), gain.max(axis=1) > 1e-12
        dim, cut = np.where(splits, at // (BINS - 1), 0), np.where(splits, at % (BINS - 1), 255)
        l = np.where(splits[:, None], left[node, dim, np.minimum(cut, BINS - 2)], total[node, 0, 0])
        r = np.where(splits[:, None], right[node, dim, np.minimum(cut, BINS - 2)], 0.0)
        return pa.table({"feature": pa.array([table.column("feature")[0].as_py()] * nodes, pa.int32()), "node": pa.array(node, pa.int32()), "dim": pa.array(dim, pa.int32()), "bin": pa.array(cut, pa.int32()), "left": l[:, 0], "n_left": l[:, 1], "right": r[:, 0], "n_right": r[:, 1]})

    return rows.mapInArrow(sums, "feature int, v array<double>").groupBy("feature").applyInArrow(best, "feature int, node int, dim int, bin int, left double, n_left double, right double, n_right double")


def _residuals(rows: DataFrame, forest: Forest, done: range) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, lists = _matrix(batch.column(0), len(forest.edges)), batch.column(1)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            y = batch.column(2).flatten().to_numpy() - forest.added(done, codes, row, lists.flatten().to_numpy())
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.ListArray.from_arrays(pa.array(ends), pa.array(y))], names=["codes", "feature", "y"])
    return rows.mapInArrow(run, "codes binary, feature array<int>, y array<double>")


def boosted(rows: DataFrame, features: list, edges: list[np.ndarray], trees: int = 20, depth: int = 4, rate: float = 0.2) -> Forest:
    """rows: codes (bins of a pixel), feature (array of places in features), y (array of their values).

    Squared error; the first tree counts in full, the others by `rate`.  Passes: depth + 1 for each tree, and one for the
    means."""
    flat = rows.select(F.explode(F.arrays_zip("feature", "y")).alias("x")).groupBy("x.feature").agg(F.avg("x.y").alias("mean")).collect()
    count = len(features)
    forest = Forest(features, edges, np.zeros(count), np.zeros((0, count, (1 << depth) - 1), np.int32), np.zeros((0, count, (1 << depth) - 1), np.int32), np.zeros((0, count, 1 << depth)))
    for r in flat:
        forest.first[r["feature"]] = r["mean"]
    means = F.array(*map(F.lit, forest.first.tolist()))
    rows = spool(rows.select("codes", "feature", F.zip_with("y", "feature", lambda y, f: y - F.element_at(means, f + 1)).alias("y")))
    written = 0
    for tree in range(trees):
        forest.dims = np.concatenate((forest.dims, np.zeros((1, count, (1 << depth) - 1), np.int32)))
        forest.bins = np.concatenate((forest.bins, np.full((1, count, (1 << depth) - 1), 255, np.int32)))
        forest.leaves = np.concatenate((forest.leaves, np.zeros((1, count, 1 << depth))))
        for level in range(depth):
            for r in _level_splits(rows, forest, range(written, tree), tree, level).collect():
                at = (1 << level) - 1 + r["node"]
                forest.dims[tree, r["feature"], at], forest.bins[tree, r["feature"], at] = r["dim"], r["bin"]
                if level == depth - 1:
                    scale = 1.0 if tree == 0 else rate
                    forest.leaves[tree, r["feature"], 2 * r["node"]] = scale * r["left"] / max(r["n_left"], 1)
                    forest.leaves[tree, r["feature"], 2 * r["node"] + 1] = scale * r["right"] / max(r["n_right"], 1)
        if (tree + 1) % REWRITE == 0 and tree + 1 < trees:
            rows, written = spool(_residuals(rows, forest, range(written, tree + 1))), tree + 1
    return forest


def predicted(pixels: DataFrame, forest: Forest, places: list[int], embedding: str = "embedding", pixel: str = "pixel_id", feature: str = "feature_id", value: str = "value", kind: str = "bigint") -> DataFrame:
    """Long predictions of the features at `places` for all pixels."""
    dimensions, wanted = len(forest.edges), np.array(places, np.int64)
    names = [forest.features[p] for p in places]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                codes, n = _matrix(part.column(1), dimensions), part.num_rows
                row, of = np.repeat(np.arange(n), len(wanted)), np.tile(wanted, n)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(np.tile(np.arange(len(wanted), dtype=np.int32), n)), pa.array(forest.predict(codes, row, of))], names=[pixel, "_place", value])

    binned = _binned(pixels, embedding, forest.edges, [pixel])
    found = binned.mapInArrow(run, f"`{pixel}` {dict(pixels.dtypes)[pixel]}, _place int, `{value}` double")
    named = F.element_at(F.array(*(F.lit(x) for x in names)).cast(f"array<{kind}>"), F.col("_place") + 1)
    return found.select(pixel, named.alias(feature), value)


def restore(pixels: DataFrame, long: DataFrame, roles: DataFrame, embedding: str = "embedding", pixel: str = "pixel_id", section: str = "section_id", feature: str = "feature_id", value: str = "value", least_r: float = 0.4, trees: int = 20, depth: int = 4) -> tuple[DataFrame, DataFrame]:
    """For all features of roles boosted trees from the embedding, judged by Pearson r on their validation sections.

    Returns the restored long matrix of the features that pass (for all pixels) and the metrics.  Features are fitted
    together in shared passes; a feature's pixels are never gathered in one task.  Null values and pixels without an
    embedding do not count; a feature without training rows is not kept."""
    spark = pixels.sparkSession
    features = [r[0] for r in roles.select(feature).distinct().orderBy(feature).collect()]  # features are few
    kind = dict(roles.dtypes)[feature]
    known = pixels.where(F.col(embedding).isNotNull())
    if not features or known.isEmpty():
        return long.select(pixel, feature, F.col(value).cast("double").alias(value)).limit(0), roles.select(feature).distinct().select(feature, *(F.lit(None).cast("double").alias(c) for c in ("r", "rmse")), F.lit(False).alias("kept"))
    index = spark.createDataFrame([(f, i) for i, f in enumerate(features)], f"`{feature}` {kind}, _i int")
    edges = _edges(known, embedding)
    binned = spool(_binned(known, embedding, edges, [pixel]))
    placed = F.broadcast(roles.join(F.broadcast(index), feature).select(feature, section, "role", "_i"))
    targets = long.where(F.col(value).isNotNull()).join(placed, [feature, section]).select(pixel, "role", "_i", F.col(value).cast("double").alias("y"))
    gathered = targets.groupBy(pixel, "role").agg(F.collect_list(F.struct("_i", "y")).alias("t")).join(binned, pixel)
    rows = spool(gathered.select("role", "codes", F.col("t._i").alias("feature"), F.col("t.y").alias("y")))
    forest = boosted(rows.where("role = 'train'").drop("role"), features, edges, trees, depth)
    dimensions = len(edges)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(features)))
        for batch in batches:
            codes, lists = _matrix(batch.column(0), dimensions), batch.column(1)
            row, of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
            y, p = batch.column(2).flatten().to_numpy(), forest.predict(codes, row, of)
            total += [np.bincount(of, w, minlength=len(features)) for w in (np.ones(len(y)), y, p, y * y, p * p, y * p)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(features)), pa.int32()), *map(pa.array, total)], names=["i", *"nypabc"])

    sums = rows.where("role = 'val'").select("codes", "feature", "y").mapInArrow(judge, "i int, n double, y double, p double, a double, b double, c double")
    sums = {r["i"]: r for r in sums.groupBy("i").agg(*(F.sum(c).alias(c) for c in "nypabc")).collect()}
    trained = {r[0] for r in rows.where("role = 'train'").select(F.explode("feature")).distinct().collect()}
    metrics = []
    for i, f in enumerate(features):
        n, y, p, a, b, c = (sums[i][k] for k in "nypabc") if i in sums else [0.0] * 6
        r = error = None
        if n and i in trained:
            spread = (a / n - (y / n) ** 2) * (b / n - (p / n) ** 2)
            r = (c / n - y * p / n**2) / spread**0.5 if spread > 1e-24 else None
            error = max(0.0, (a - 2 * c + b) / n) ** 0.5
        metrics.append((f, r, error, r is not None and r > least_r))
    table = spark.createDataFrame(metrics, f"`{feature}` {kind}, r double, rmse double, kept boolean")
    kept = [i for i, m in enumerate(metrics) if m[3]]
    empty = long.select(pixel, feature, F.col(value).cast("double").alias(value)).limit(0)
    return predicted(known, forest, kept, embedding, pixel, feature, value, kind) if kept else empty, table


def final_matrix(native: DataFrame, restored: DataFrame, table: DataFrame, least_score: float = 4.0, feature: str = "name") -> DataFrame:
    """native rows and those restored ones whose annotation is known, not "_db", scores enough and is not native yet."""
    good = table.where(F.col("annotation").isNotNull() & (F.col("annotation") != "_db") & (F.col("score") >= least_score)).select("mz_key", F.col("annotation").alias(feature))
    added = restored.join(F.broadcast(good), "mz_key").join(native.select(feature).distinct(), feature, "left_anti")
    return native.unionByName(added.select(native.columns))


def select_features(moran: DataFrame, scores: DataFrame, dropout: DataFrame, feature: str = "feature_id", threshold: float = 0.25, wanted: list | None = None) -> DataFrame:
    """Features by spatial structure (mean Moran's I over sections above the threshold), few dropouts and a positive score; an
    explicit list comes before all."""
    if wanted is not None:
        return scores.where(F.col(feature).isin(wanted)).select(feature)
    mean = moran.groupBy(feature).agg(F.avg("moran_i").alias("moran")).where(F.col("moran") > threshold)
    return mean.join(dropout.where("kept").select(feature), feature).join(scores.where("score > 0").select(feature), feature).select(feature)
