"""Boosting of all features in shared passes against plain splits and against single fits."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from pixelmill.operators import restore as R


def tables(spark, rng, pixels=360, features=5):
    """Pixels of three sections with four dimensions, and features that depend on them less and less."""
    e = rng.normal(size=(pixels, 4))
    values = np.stack([np.sin(2 * e[:, f % 4]) + e[:, (f + 1) % 4] * e[:, f % 4] + rng.normal(0, 0.2 + 0.5 * f, pixels) for f in range(features)], axis=1)
    px = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(e)], "pixel_id long, section_id long, embedding array<double>")
    long = spark.createDataFrame([(i, i % 3, 10 * f, float(values[i, f])) for i in range(pixels) for f in range(features)], "pixel_id long, section_id long, feature_id long, value double")
    roles = spark.createDataFrame([(10 * f, s, r) for f in range(features) for s, r in enumerate(("train", "val", "train"))], "feature_id long, section_id long, role string")
    return px, long, roles, e, values


def test_splits_against_brute_force(spark, monkeypatch):
    """The best split of each node, from sums that tasks hand on in several parts."""
    monkeypatch.setattr(R, "HELD", 1)
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 8, (200, 3)).astype(np.uint8)
    y = rng.normal(size=(200, 2)) + (codes[:, 1] > 4)[:, None] + 2 * (codes[:, [0]] > 2) * (codes[:, [1]] > 4)
    rows = spark.createDataFrame([(codes[i].tobytes(), [0, 1], y[i].tolist()) for i in range(200)], "codes binary, feature array<int>, y array<double>").repartition(3)
    forest = R.Forest([0, 1], [np.arange(7.0)] * 3, np.zeros(2), np.zeros((1, 2, 3), int), np.full((1, 2, 3), 255), np.zeros((1, 2, 4)))
    forest.dims[0, :, 0], forest.bins[0, :, 0] = 1, 4
    for level in (0, 1):
        got = {(r["feature"], r["node"]): r for r in R._level_splits(rows, forest, range(0), 0, level).collect()}
        for f in (0, 1):
            for node in range(1 << level):
                mine = np.ones(200, bool) if level == 0 else (codes[:, 1] > 4) == bool(node)
                gain = {}
                for d in range(3):
                    for b in range(31):
                        left = mine & (codes[:, d] <= b)
                        right = mine & (codes[:, d] > b)
                        if left.any() and right.any():
                            gain[d, b] = y[left, f].sum() ** 2 / left.sum() + y[right, f].sum() ** 2 / right.sum()
                r = got[f, node]
                assert gain[r["dim"], r["bin"]] == pytest.approx(max(gain.values()))
                left = mine & (codes[:, r["dim"]] <= r["bin"])
                assert (r["n_left"], r["left"]) == pytest.approx((left.sum(), y[left, f].sum()))


def test_as_good_as_single_fits(spark, monkeypatch):
    """r of three features within 0.02 of boosted trees fitted one by one; passes do not depend on the number of features."""
    px, long, roles, _, _ = tables(spark, np.random.default_rng(1), 900)
    passes = []
    splits = R._level_splits
    monkeypatch.setattr(R, "_level_splits", lambda *a: passes.append(a[3:]) or splits(*a))
    _, metrics = R.restore(px, long, roles, trees=12, depth=3)
    shared = {r["feature_id"]: r["r"] for r in metrics.collect()}
    assert len(passes) == 12 * 3
    for f in (0, 10, 20):
        rows = long.where(F.col("feature_id") == f).join(px.select("pixel_id", array_to_vector("embedding").alias("features")), "pixel_id").withColumnRenamed("value", "label")
        model = GBTRegressor(maxIter=12, maxDepth=3, seed=1).fit(rows.where("section_id <> 1"))
        single = model.transform(rows.where("section_id = 1")).select(F.corr("label", "prediction")).first()[0]
        assert shared[f] == pytest.approx(single, abs=0.02) or shared[f] > single


def test_predictions_and_metrics(spark):
    """What is restored for a pixel is what judged it: metrics from the long result equal those returned."""
    px, long, roles, _, _ = tables(spark, np.random.default_rng(2))
    out, metrics = R.restore(px, long, roles, least_r=-1.0, trees=7, depth=3)
    table = {r["feature_id"]: r for r in metrics.collect()}
    assert out.count() == 360 * len(table)
    both = out.withColumnRenamed("value", "p").join(long.where("section_id = 1"), ["pixel_id", "feature_id"])
    for r in both.groupBy("feature_id").agg(F.corr("p", "value").alias("r"), F.sqrt(F.avg(F.pow(F.col("p") - F.col("value"), 2))).alias("rmse")).collect():
        assert (r["r"], r["rmse"]) == pytest.approx((table[r["feature_id"]]["r"], table[r["feature_id"]]["rmse"]))


def test_odd_rows(spark):
    px, long, roles, _, _ = tables(spark, np.random.default_rng(3), 90, 2)
    more = long.unionByName(spark.createDataFrame([(0, 0, 10, None), (999, 0, 10, 5.0)], long.schema)).unionByName(long.where("section_id = 1").withColumn("feature_id", F.lit(77).cast("long")))
    wide = px.unionByName(spark.createDataFrame([(500, 0, None)], px.schema))
    wanted = roles.unionByName(spark.createDataFrame([(77, 1, "val"), (78, 0, "train")], roles.schema))
    out, metrics = R.restore(wide, more, wanted, trees=2, depth=2, least_r=-1.0)
    got = {r["feature_id"]: r["kept"] for r in metrics.collect()}
    assert got == {0: True, 10: True, 77: False, 78: False} and out.count() == 180
    none, empty = R.restore(px.limit(0), long, roles)
    assert none.count() == 0 and {r["kept"] for r in empty.collect()} == {False}
