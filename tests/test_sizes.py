"""What larger tables showed: nodes one after the other, tables of pixels through the driver, numbers as C prints them."""

import hashlib
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.operators import cluster as C
from pixelmill.operators import graph as G
from pixelmill.operators import spatial as S
from pixelmill.operators import windows as W
from pixelmill.operators.base import spool
from pixelmill.plans import QUERIES


def test_nodes_of_a_tree_are_walked_at_once(spark):
    """Both children wait for each other, so one after the other would never end."""
    pixels, met = spark.range(4).withColumnRenamed("id", "pixel_id"), threading.Barrier(2, timeout=60)

    def step(node, mine, n):
        if not node.path:
            return node, None, [(C.Node((side,)), mine.where(F.col("pixel_id") % 2 == side - 1), 2) for side in (1, 2)]
        met.wait()
        return node, mine, []

    assert {r["pixel_id"]: r["path"] for r in C._walked(C.Node(()), pixels, 4, step).collect()} == {0: [1], 1: [2], 2: [1], 3: [2]}


def test_few_pixels_are_searched_by_one_task(spark):
    """The same centres and sides as by passes over many partitions."""
    rng = np.random.default_rng(5)
    group = np.arange(300) % 2
    space = np.stack((2.0 * group - 1 + rng.normal(0, 0.1, 300), rng.normal(0, 1, 300), rng.normal(0, 1, 300)), axis=1)
    features = rng.normal(5, 0.5, (300, 6)) + 2.0 * group[:, None] * (np.arange(6) < 3)
    rows = [(i, i % 6, space[i].tolist(), features[i].tolist()) for i in range(300)]
    frame = spool(spark.createDataFrame(rows, "pixel_id int, section_id int, _space array<double>, features array<double>").repartition(4))
    config, kept, sections = C.TreeConfig(clusters=8), [np.array([0, 1, 2]), np.array([0, 2])], list(range(6))
    centres = C._clustered(frame, space, kept, config)
    sides = C._sides(frame, "features", sections, "section_id", kept, centres)
    got, found = C._searched(frame.coalesce(1), "features", sections, "section_id", space, kept, config)
    assert all(a == pytest.approx(b) for a, b in zip(centres, got))
    assert [f and f[0] for f in found] == [f and f[0] for f in sides] and any(sides)
    assert all((a is None) == (b is None) and (a is None or (a[1] == b[1]).all()) for a, b in zip(found, sides))


def _grid(spark):
    return spool(spark.range(4000).select(F.lit(0).alias("section_id"), (F.col("id") % 50).alias("x"), F.floor(F.col("id") / 50).alias("y"), (F.col("id") % 3).cast("string").alias("label")))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_distances_send_no_pixels_through_the_driver(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(S, "spool", lambda df: plans.append(_plan(df)) or spool(df))
    points = _grid(spark).where("x % 7 = 0 OR y > 70")
    got = {(r["x"], r["y"]): r["distance"] for r in S.nearest_distance(points, reach=1).collect()}
    assert len(got) == points.count() and set(got.values()) == {1.0}
    assert plans and not any("Broadcast" in p for p in plans)


def test_mass_keys_are_printed_as_c_does(spark, tmp_path):
    values = [-0.0, 0.5e-6, 1.5, 1.5, None, float("nan"), float("inf")]
    spark.createDataFrame([(v,) for v in values], "c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r["mz_key"]: r["checksum"] for r in QUERIES["mz_keys"](spark, str(tmp_path)).collect()}
    assert got == {k: k and hashlib.md5(k.encode()).hexdigest() for k in ("-0.000000", "0.000000", "1.500000", None, "nan", "inf")}


def test_components_send_no_voxels_through_the_driver(spark, monkeypatch):
    """Components that wind through many blocks, against plain labels; no table of voxels or links is broadcast."""
    plans = []
    for module in (S, G):
        monkeypatch.setattr(module, "spool", lambda df: plans.append(_plan(df)) or spool(df))
    rng = np.random.default_rng(3)
    voxels = {tuple(map(int, v)) for v in rng.integers(-6, 7, (700, 3))} | {(i, 0, 9) for i in range(-20, 20)}
    least = {v: v for v in voxels}
    moved = True
    while moved:
        moved = False
        for i, j, k in voxels:
            best = min(least[w] for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (w := (i + a, j + b, k + c)) in voxels)
            if best < least[i, j, k]:
                least[i, j, k], moved = best, True
    mask = spark.createDataFrame([*voxels, (0, 0, 9)], "i int, j int, k long")
    found = S.components_3d(mask, edge=4)
    assert {(r["i"], r["j"], r["k"]): tuple(r["component"]) for r in found.collect()} == least and found.count() == len(voxels)
    assert dict(found.dtypes)["component"] == "struct<i:int,j:int,k:bigint>" and S.components_3d(mask.limit(0)).count() == 0
    assert len(plans) > 3 and not any("Broadcast" in p for p in [*plans, _plan(found)])


def test_neighbourhoods_meet_without_a_broadcast(spark):
    found = S.neighbourhood(_grid(spark))
    assert "Broadcast" not in _plan(found)
    cells = {(i % 50, i // 50): str(i % 3) for i in range(4000)}
    want = {}
    for (x, y), a in cells.items():
        for d in ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)):
            if b := cells.get((x + d[0], y + d[1])):
                want[a, b] = want.get((a, b), 0) + 1
    assert {(r["label"], r["nb_label"]): r["n"] for r in found.collect()} == want
    assert sum(r["share"] for r in found.collect()) == pytest.approx(3)


def test_nodes_of_a_level_share_their_jobs(spark, monkeypatch):
    """Small nodes are learned together, level by level, as they are by jobs of their own; tables are written by level."""
    rng = np.random.default_rng(7)
    n = 480
    kind = np.arange(n) // 2 % 4
    centre = np.array([[6, 1, 1, 1], [5, 6, 1, 1], [1, 1, 6, 1], [1, 1, 5, 6]])[kind]
    x = np.repeat(centre, 3, axis=1) * rng.gamma(20, 0.05, (n, 12))
    rows = [(i, i // 8 % 6 or None, x[i].tolist(), (centre[i] + rng.normal(0, 0.1, 4)).tolist()) for i in range(n)]
    pixels = spark.createDataFrame(rows, "pixel_id int, section_id int, features array<double>, embedding array<double>")
    config, written = C.TreeConfig(clusters=8, least_pixels=60, sweep=2, trees=2, depth=2, least_per_section=5, candidates=20), []
    monkeypatch.setattr(C, "spool", lambda df, *by: written.append(1) or spool(df, *by))
    root, learned = C.learn_tree(pixels, config=config)
    together = {r["pixel_id"]: r["path"] for r in learned.collect()}
    assert len(together) == n and {len(p) for p in together.values()} == {2} and len(written) <= 12
    written.clear()
    assert {r["pixel_id"]: r["path"] for r in C.apply_tree(root, pixels, config=config).collect()} == together
    assert len(written) <= 4
    monkeypatch.setattr(C, "GROUP", 0)
    assert {r["pixel_id"]: r["path"] for r in C.learn_tree(pixels, config=config)[1].collect()} == together


def test_splits_are_judged_by_a_task_as_by_tables(spark):
    rng = np.random.default_rng(8)
    values, first = np.clip(np.round(rng.normal(0.5, 0.3, (90, 6)), 1), 0, 1), rng.random(90) < 0.3
    values[:, 1] = 0.4
    values[first, 2], values[~first, 3] = 0.9, values[~first, 3] / 3
    long = spark.createDataFrame([(j, 1 if first[i] else 2, float(values[i, j])) for i in range(90) for j in range(6)], "feature int, side int, value double")
    for change, threshold in ((0.2, 0.05), (0.05, 0.6), (2.0, 0.05)):
        config = C.TreeConfig(least_change=change, threshold=threshold)
        assert C._altered(values, *C._midranks(values), first, config) == C.differential(long, "feature", "side", "value", 1, 2, change, threshold).where("passes").count()
    sections, config = [None, *range(2, 30, 3), 31, 32], C.TreeConfig(least_per_section=4)
    counts = [rng.integers(0, 9, len(sections)) * (rng.random(len(sections)) < share) for share in (0.2, 0.5, 0.9) for _ in range(8)]
    counts += [np.array([0, 9, 9, 0, 0, 0, 9, 9, 0, 0, 9, 9]), np.array([0, 9, 9, 9, 9, 0, 0, 0, 0, 0, 0, 0]), np.array([9, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0])]
    table = spark.createDataFrame([(g, s, int(k)) for g, c in enumerate(counts) for s, k in zip(sections, c) if k], "g int, s int, n int")
    runs = W.consecutive_sections(table, "g", "s", "n", 4, 3)
    tops = W.peaks(W.smoothed(table, "g", "s", "n"), "g", "s")
    want = {r["g"] for r in runs.join(tops, "g", "left").where(~F.col("continuous") | ((F.coalesce("peaks", F.lit(0)) >= 3) & (F.col("peak_ratio") <= 1.4))).collect()}
    got = {g for g, c in enumerate(counts) if c.any() and C._broken(sections, c, config)}
    assert got == want and 0 < len(got) < len(counts)
