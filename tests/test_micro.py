"""Hand-computed cases."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pixelmill.functions import colors
from pixelmill.functions import names as N
from pixelmill.operators import aggregates as A
from pixelmill.operators import bicluster as B
from pixelmill.operators import filters as X
from pixelmill.operators import graph as G
from pixelmill.operators import inference as I
from pixelmill.operators import joins as J
from pixelmill.operators import linear as L
from pixelmill.operators import restore as R
from pixelmill.operators import spatial as S
from pixelmill.operators import windows as W
from pixelmill.operators.base import ordered_index
from pixelmill.sources import tables as T


def pixels(spark, grid, section=0):
    rows = [(section, "f", x, y, float(v)) for y, line in enumerate(grid) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "section_id int, feature_id string, x int, y int, value double")


def test_moran(spark):
    board = [[1 if (x + y) % 2 else -1 for x in range(4)] for y in range(4)]
    assert S.moran(pixels(spark, board)).first()["moran_i"] == pytest.approx(-1)
    assert S.moran(pixels(spark, [[3, 3], [3, 3]])).first()["moran_i"] == 0


def test_variance_of_variances(spark):
    df = spark.createDataFrame([(0, 1, 0.0), (0, 1, 2.0), (0, 2, 0.0), (0, 2, 4.0)], "feature_id int, section_id int, value double")
    r = A.variance_of_variances(df).first()
    assert (r["mean_of_variances"], r["variance_of_variances"], r["score"]) == (2.5, 2.25, 1.375)


@pytest.mark.parametrize(("counts", "expected"), [
    ({"ax": 8, "ay": 2, "bx": 2, "by": 8}, {"ax": 2.56, "ay": 0.16, "bx": 0.16, "by": 2.56}),
    ({"ax": 4, "by": 4}, {"ax": 4.0, "ay": 0.0, "bx": 0.0, "by": 4.0}),
])
def test_enrichment(spark, counts, expected):
    df = spark.createDataFrame([(k[0], k[1]) for k, n in counts.items() for _ in range(n)], "a string, b string")
    got = {r["a"] + r["b"]: r["enrichment"] for r in A.enrichment(A.crosstab(df, "a", "b"), "a", "b").collect()}
    assert got == pytest.approx(expected)


def test_icc(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 2.0), ("B", 3.0), ("B", 4.0), ("B", None)], "s string, v double")
    r = A.icc(df, "s", "v").first()
    assert (r["msb"], r["msw"]) == (4, 0.5) and r["icc"] == pytest.approx(0.777778, abs=1e-6)
    assert A.icc(df.where("s = 'A'"), "s", "v").first()["icc"] is None


def test_top_above(spark):
    df = spark.createDataFrame([("a", 1, .9), ("a", 2, .5), ("a", 3, .45), ("a", 4, .41), ("b", 1, .5), ("b", 2, .3), ("b", 3, .45)], "f string, s int, v double")
    got = sorted((r["f"], r["s"]) for r in W.top_above(df, "f", "v", "s").collect())
    assert got == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 3)]


def test_running_q_and_bh(spark):
    q = W.running_q(spark.createDataFrame([(1, .01), (2, .03), (3, .2)], "i int, p double"), "p", "i")
    assert [round(r["q"], 6) for r in q.orderBy("i").collect()] == [.01, .02, .08]
    b = W.benjamini_hochberg(spark.createDataFrame([(1, .01), (2, .02), (3, .03), (4, .5), (5, None)], "i int, p double"), "p", "i")
    assert [r["adjusted"] and round(r["adjusted"], 6) for r in b.orderBy("i").collect()] == [.04, .04, .04, .5, None]


def test_rank_sums(spark):
    df = spark.createDataFrame([(0, "A", float(v)) for v in (1, 2, 3)] + [(0, "B", float(v)) for v in (2, 4)], "f int, g string, v double")
    r = W.rank_sums(df, "f", "g", "v", "A", "B").first()
    assert (r["rank_sum"], r["u"]) == (7.5, 1.5)
    d = I.differential(df, "f", "g", "v", "A", "B").first()
    assert 0 < d["p"] <= 1 and d["log2fc"] == pytest.approx(math.log2(3 / 2))


def test_repeated_names(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "i int, n string")
    assert [r["unique_name"] for r in W.number_repeats(df, "n", "i").orderBy("i").collect()] == ["a_1", "b", "a_2"]
    df = spark.createDataFrame([(0, "a"), (1, "a"), (2, "a")], "i int, n string")
    assert [r["unique_name"] for r in W.number_later_repeats(df, "n", "i").orderBy("i").collect()] == ["a", "a_1", "a_2"]


def test_nearest(spark):
    peaks = spark.createDataFrame([(760.5850,), (761.0,)], "mz double")
    refs = spark.createDataFrame([(1, "A", 760.5851), (2, "B", 760.5880)], "at int, name string, mass double")
    got = {r["mz"]: (r["name"], r["ppm_error"]) for r in J.nearest(peaks, refs, "mz", "mass", "at").collect()}
    assert got[760.585][0] == "A" and got[760.585][1] == pytest.approx(0.1315, abs=1e-4) and got[761.0] == (None, None)


def test_names(spark):
    df = spark.createDataFrame([("PC O-36:4",), ("SM 34:1;O2",), ("734.5",), ("PC 34:1_uncertain",)], "name string")
    colours = spark.createDataFrame([("SM", "#112233")], "class string, color string")
    got = {r["name"]: (r["class"], r["carbons"], r["unsaturation"], r["color"]) for r in N.molecule_properties(df, "name", colours).collect()}
    assert got["PC O-36:4"] == ("PC O-", 36, 4, "gray") and got["SM 34:1;O2"] == ("SM", 34, 1, "#112233")
    assert got["734.5"] == ("734", None, None, "gray") and got["PC 34:1_uncertain"] == (None, None, None, "gray")
    parts = spark.createDataFrame([("PC 34:1; SM 34:1;O2",)], "s string").select(N.protected_split(F.col("s"))).first()[0]
    assert parts == ["PC 34:1", "SM 34:1;O2"]


def test_union_support(spark):
    rows = [(z, f, v) for z, vs in enumerate([(0., 0.), (0., 0.), (1., 0.), (1., 1.)]) for f, v in enumerate(vs)]
    d = {(r["a"], r["b"]): r["union_cosine"] for r in L.centroid_distances(spark.createDataFrame(rows, "z int, f int, mean double"), "z", "f", "mean").collect()}
    assert d[0, 1] == 0 and d[0, 2] == 1 and d[2, 3] == pytest.approx(0.292893, abs=1e-6)


def test_comodulation(spark):
    df = spark.createDataFrame([(.5, .5, True, True), (.5, .5, False, True)], "s double, b double, e boolean, h boolean")
    assert [r["log2fc"] for r in I.comodulation(df, "s", "b", "e", "h").collect()] == [1, 0]


def test_neighbourhood(spark):
    df = spark.createDataFrame([(0, 0, 0, "A"), (0, 1, 0, "A"), (0, 0, 1, "B"), (0, 1, 1, "B")], "section_id int, x int, y int, label string")
    got = {(r["label"], r["nb_label"]): r["share"] for r in S.neighbourhood(df).collect()}
    assert got["A", "A"] == pytest.approx(1 / 3) and got["A", "B"] == pytest.approx(2 / 3)
    assert S.neighbourhood_map(df).where("label = 'A'").first()["proportions"]["B"] == pytest.approx(2 / 3)


def test_filters(spark):
    df = spark.createDataFrame([("v",), ("w",), (None,)], "c string")
    assert [r[0] for r in X.filter_by_spec(df, "c", "!=v").collect()] == ["w"]
    assert X.filter_by_spec(df, "c", "==zz").count() == 0 and X.filter_by_spec(df, "c", "==zz", "all").count() == 3
    with pytest.raises(ValueError):
        X.filter_by_spec(df, "d", "==v")
    images = spark.createDataFrame([(1, [[1.0, float("nan")], [None, 4.0]])], "section_id int, image array<array<double>>")
    assert sorted(map(tuple, X.flatten_images(images).collect())) == [(1, 1, 1, 1.0), (1, 2, 2, 4.0)]
    code = spark.createDataFrame([("section3_pixel4_5",), ("x",)], "b string").select(X.parse_barcode(F.col("b"))).collect()
    assert tuple(code[0][0]) == (3, 4, 5) and code[1][0] is None


def test_order_without_one_task(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = ordered_index(df, ["k"]).orderBy("k").collect()
    assert [r["index"] for r in got] == list(range(1000))
    assert sorted(r["k"] for r in X.every_kth(df, 10, ["k"]).collect()) == list(range(0, 1000, 10))


def reference_thin(points: pd.DataFrame, seed: int = 42) -> pd.DataFrame:
    """One section, one after the other in a seeded order: the plain form of `thin`, for comparison."""
    order = np.random.default_rng(seed).permutation(len(points))
    taken, keep = set(), []
    for r in order:
        px, py = int(points["x"].iloc[r]), int(points["y"].iloc[r])
        if not any((px + a, py + b) in taken for a in (-2, -1, 0, 1, 2) for b in (-2, -1, 0, 1, 2)):
            taken.add((px, py))
            keep.append(r)
    return points.iloc[sorted(keep)]


def test_thinning(spark):
    df = spark.createDataFrame([(s, x, y) for s in range(2) for x in range(12) for y in range(9)], "section_id int, x int, y int")
    train, test = S.train_test(df)
    for part in (train, test):
        for _, g in part.toPandas().groupby("section_id"):
            p = g[["x", "y"]].to_numpy()
            d = np.abs(p[:, None] - p[None, :]).max(axis=2)
            assert (d[~np.eye(len(p), dtype=bool)] >= 3).all()
    kept = {tuple(r) for r in train.collect()}
    assert all(any(abs(x - a) <= 2 and abs(y - b) <= 2 for s2, a, b in kept if s2 == s) for s, x, y in map(tuple, df.collect()))
    assert len(reference_thin(df.where("section_id = 0").toPandas())) > 0


def test_nearest_distance(spark):
    rng = np.random.default_rng(1)
    p = rng.choice(4000, 60, replace=False)
    df = spark.createDataFrame([(0, int(v % 80), int(v // 80)) for v in p] + [(1, 5, 5)], "section_id int, x int, y int")
    got = {(r["x"], r["y"]): r["distance"] for r in S.nearest_distance(df, reach=2).collect()}
    xy = np.array([(v % 80, v // 80) for v in p])
    d = np.hypot(*(xy[:, None] - xy[None, :]).transpose(2, 0, 1)) + np.eye(len(p)) * 1e9
    assert len(got) == len(p) and all(got[tuple(map(int, xy[i]))] == pytest.approx(d[i].min()) for i in range(len(p)))


def test_volumes(spark):
    line = spark.createDataFrame([(i, 0, 0) for i in (0, 1, 2, 5, 6)], "i int, j int, k int")
    assert sorted(r["n"] for r in S.components_3d(line).groupBy("component").agg(F.count("*").alias("n")).collect()) == [2, 3]
    assert S.largest_components(line, 1).count() == 3
    assert S.close(spark.createDataFrame([(0, 0, 0), (2, 0, 0)], "i int, j int, k int")).where("i = 1").count() == 1
    assert S.symmetrise(line, 4, "j").count() == 10
    assert S.gaussian_3d(line.limit(1), 0.5).agg(F.sum("density")).first()[0] == pytest.approx(1)
    volume = spark.createDataFrame([(i, 0, 0, "a") for i in range(4)], "i int, j int, k int, region string")
    known = spark.createDataFrame([(0, 0, 0, "a", 1.0), (3, 0, 0, "b", 9.0)], "i int, j int, k int, region string, value double")
    out = {r["i"]: r["value"] for r in S.interpolate(volume, known, 2, first=0).collect()}
    assert out[0] == 1 and out[1] == pytest.approx(1) and out[2] == pytest.approx(1)
    filled = S.box_fill(spark.createDataFrame([(0, 0, 0, 2.0), (1, 0, 0, None)], "i int, j int, k int, value double"))
    assert {r["i"]: r["value"] for r in filled.collect()} == {0: 2.0, 1: 2.0}


def test_joins_and_splits(spark):
    px = spark.createDataFrame([("p", 1), ("p", 2)], "path string, x int")
    meta = spark.createDataFrame([("p", 1, "old", 1), ("p", 1, "new", 2)], "path string, x int, tag string, at int")
    assert [tuple(r) for r in J.attach_metadata(px, meta, ["path", "x"], ["at"]).select("path", "x", "tag").collect()] == [("p", 1, "new")]
    with pytest.raises(ValueError):
        J.attach_programs(px, meta, ["path", "x"], ["at"])
    sections = spark.createDataFrame([(i,) for i in range(10)], "s int")
    parts = {r["s"]: r["part"] for r in W.section_split(sections, "s").collect()}
    assert [s for s, p in sorted(parts.items()) if p == "val"] == [2, 7] and [s for s, p in sorted(parts.items()) if p == "test"] == [1, 6]


def test_reactions(spark):
    m = spark.createDataFrame([("PC 34:1", "PC", 34, 1), ("LPC 18:0", "LPC", 18, 0), ("LPC 20:0", "LPC", 20, 0), ("PA 34:1", "PA", 34, 1), ("PC O-34:1", "PC O-", 34, 1), ("x", None, None, None)], "name string, class string, carbons int, unsaturation int")
    e = spark.createDataFrame([("PC", "PA", ["PLD"])], "reagent_class string, product_class string, enzyme array<string>")
    got = {(r["reagent"], r["product"]): r["enzyme"] for r in G.reaction_network(m, e).collect()}
    assert got["PC 34:1", "PA 34:1"] == ["PLD"] and got["LPC 18:0", "LPC 20:0"] == ["Unknown"] and ("LPC 18:0", "PC 34:1") in got
    assert ("LPC 18:0", "PC O-34:1") not in got and ("PC O-34:1", "LPC 18:0") not in got


def test_graph():
    w = np.zeros((6, 6))
    for a, b in ((0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)):
        w[a, b] = w[b, a] = 1
    w[2, 3] = w[3, 2] = 0.1
    labels = G.louvain(w)
    assert len(set(labels[:3])) == len(set(labels[3:])) == 1 and labels[0] != labels[3]
    assert G.partition_quality(w, labels) > 0.4
    assert G.nearest_chain([[0.0], [5.0], [1.0]]) == ([0, 2, 1], [0.0, 1.0, 5.0])


def test_linkage_and_seriation():
    d = np.abs(np.subtract.outer([0.0, 1.0, 10.0, 11.5], [0.0, 1.0, 10.0, 11.5]))
    merges = L.linkage(d)
    assert [m[:2] for m in merges] == [(0, 1), (2, 3), (4, 5)] and L.cut(merges, 2).tolist() == [0, 0, 1, 1]
    assert L.leaf_order(merges, d) in ([0, 1, 2, 3], [3, 2, 1, 0])
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(0, .1, (10, 8)) + np.arange(8), rng.normal(0, .1, (10, 8)) - np.arange(8)))
    mixed = rng.permutation(20)
    corr = np.corrcoef(x[mixed])
    order = B.spin(x[mixed], 0.6, columns=False)[0]
    at = B.best_break(corr[np.ix_(order, order)])
    assert at == 10 and len({v < 10 for v in mixed[order[:10]]}) == 1
    assert L.subsets(3, 4) == [(0, 1, 2), (0, 1), (0, 2), (1, 2)]
    rows, columns, labels = L.clean_heatmap(pd.DataFrame([[1., 0], [1., .1], [0, 1]], index=list("abc"), columns=list("xy")), 2, sparse=0.4, least=0)
    assert sorted(rows) == list("abc") and sorted(columns) == list("xy") and len(labels) == 3


def test_factorisation(spark):
    rng = np.random.default_rng(3)
    x = rng.random((120, 3)) @ rng.random((3, 12))
    px = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "pixel_id long, batch int, features array<double>")
    n, s, g = L.gram(px, "features")
    assert n == 120 and np.allclose(s, x.sum(axis=0)) and np.allclose(g, x.T @ x)
    model = L.fit_nmf(px, "features", steps=4, iterations=8)
    assert (model.h >= 0).all() and all(b <= a * (1 + 1e-9) for a, b in zip(model.losses, model.losses[1:]))
    w = np.array([r["loadings"] for r in L.apply_nmf(px, "features", model).collect()])
    assert (w >= 0).all()
    assert L.harmonise(px, "features", "batch", 3, 2).count() == 120


def test_case_control(spark):
    rng = np.random.default_rng(0)
    rows = []
    for s in range(6):
        for k, (base, shift) in {"a": (0.3, 0.4), "b": (0.6, 0.0)}.items():
            for _ in range(60):
                rows.append(("f", s, s % 3, "case" if s >= 3 else "naive", k, float(base + (s >= 3) * shift + rng.normal(0, 0.05))))
    df = spark.createDataFrame(rows, "feature string, section int, sample int, condition string, supertype string, value double")
    fit = {r["supertype"]: r for r in I.fit_case_control(df, "feature", "section", "sample", "condition", "supertype", "value", "case", I.CaseControlConfig(epochs=800)).collect()}
    assert fit["a"]["shift"] - fit["b"]["shift"] == pytest.approx(0.4, abs=0.06)
    calls = I.calls(spark.createDataFrame([("u", 0.0, .01, .4, .01), ("n", 0.0, .01, 0.0, .01)], "k string, loc double, loc_sd double, shift double, shift_sd double"), ["k"]).collect()
    assert {r["k"]: r["shifted"] for r in calls} == {"u": True, "n": False}
    b = I.bootstrap_fraction(spark.createDataFrame([(1, i < 30, True) for i in range(100)], "k int, hit boolean, ok boolean"), ["k"], "hit", "ok", 500).first()
    assert b["low"] < 0.3 < b["high"] and b["mean"] == pytest.approx(0.3, abs=0.02)


def test_restoration(spark):
    rng = np.random.default_rng(2)
    e = rng.normal(size=(300, 3))
    px = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(e)], "pixel_id long, section_id long, embedding array<double>")
    long = spark.createDataFrame([(i, i % 3, f, float(v[0] if f == 0 else rng.normal())) for i, v in enumerate(e) for f in (0, 1)], "pixel_id long, section_id long, feature_id long, value double")
    roles = spark.createDataFrame([(f, s, r) for f in (0, 1) for s, r in enumerate(("train", "val", "train"))], "feature_id long, section_id long, role string")
    out, metrics = R.restore(px, long, roles, trees=10)
    assert {r["feature_id"]: r["kept"] for r in metrics.collect()} == {0: True, 1: False} and out.count() == 300


def test_colours(spark):
    df = spark.createDataFrame([("#ff8000", "#000000")], "a string, b string")
    r = df.select(colors.hex_part(F.col("a"), 1).alias("g"), colors.between(F.col("a"), F.col("b"), F.lit(1.0)).alias("e"), colors.saturated(F.lit("#806060")).alias("s")).first()
    assert r["g"] == 128 and r["e"] == "#000000" and r["s"] != "#806060" and len(set(colors.distinct_colors(7))) == 7


def test_sources(spark, tmp_path):
    (tmp_path / "m.sdf").write_text("x\n> <LM_ID>\nLM1\n\n> <NAME>\nPC\n\n> <EXACT_MASS>\n760.5\n\n$$$$\ny\n> <LM_ID>\nLM2\n\n$$$$\n")
    got = {r["lm_id"]: (r["name"], r["exact_mass"]) for r in T.read_molecules(spark, str(tmp_path / "m.sdf")).collect()}
    assert got == {"LM1": ("PC", "760.5"), "LM2": (None, None)}
    T.save_dataset({"a": spark.range(3)}, str(tmp_path / "d"))
    assert T.load_dataset(spark, str(tmp_path / "d"))["a"].count() == 3


def test_stream(spark, tmp_path):
    from pixelmill.operators.linear import Nmf
    from pixelmill.streaming.frozen import each_batch, loadings_of_stream

    spark.createDataFrame([(0, [1.0, 2.0])], "pixel_id long, features array<double>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pixel_id long, features array<double>").parquet(str(tmp_path / "in"))
    model = Nmf(np.eye(2), 0.0, [0, 1], np.array([0, 1]), [])
    q = each_batch(loadings_of_stream(stream, "features", model), lambda b: b, str(tmp_path / "out"), str(tmp_path / "at"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).first()["loadings"] == pytest.approx([1.0, 2.0])
