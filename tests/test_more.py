"""Orders over all rows, correlations, trees, graphs of pixels, noise models and further sources against plain forms."""

import io

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pixelmill.operators import cluster as C
from pixelmill.operators import communities as M
from pixelmill.operators import graph as G
from pixelmill.operators import inference as I
from pixelmill.operators import joins as J
from pixelmill.operators import linear as L
from pixelmill.operators import spatial as S
from pixelmill.operators import windows as W
from pixelmill.operators.base import spool
from pixelmill.sources import tables as T


def test_orders_over_all_rows(spark):
    rng = np.random.default_rng(0)
    p = np.round(rng.random(700) ** 3, 3)  # with ties
    rows = [(i, float(v)) for i, v in enumerate(p)] + [(1000, None), (1001, None)]
    df = spark.createDataFrame(rows, "i int, p double").repartition(5)
    order = sorted(range(700), key=lambda i: (p[i], i))
    means = np.cumsum(p[order]) / np.arange(1, 701)
    got = {r["i"]: r["q"] for r in W.running_q(df, "p", "i").collect()}
    assert [got[i] for i in order] == pytest.approx(means.tolist()) and got[1000] is None
    raw = p[order] * 700 / np.arange(1, 701)
    want = np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1])
    adjusted = {r["i"]: r["adjusted"] for r in W.benjamini_hochberg(df, "p", "i").collect()}
    assert [adjusted[i] for i in order] == pytest.approx(want.tolist()) and adjusted[1001] is None and len(adjusted) == 702
    ends = W.rank_extremes(df.where("p IS NOT NULL"), "p", "i", 4).collect()
    assert {r["i"] for r in ends if r["end"] == "low"} == set(order[:4]) and sum(r["end"] == "middle" for r in ends) == 4
    assert {r["i"] for r in ends if r["end"] == "high"} == set(sorted(range(700), key=lambda i: (-p[i], i))[:4])
    assert {r["end"] for r in W.rank_extremes(df.where("i < 3"), "p", "i", 4).collect()} == {"low"}
    pairs = J.aligned_pairs(df.where("i < 300"), df.where("i >= 300 AND p IS NOT NULL"), "p").orderBy("rank").collect()
    assert [r["a"] for r in pairs] == sorted(p[:300].tolist()) and [r["b"] for r in pairs] == sorted(p[300:].tolist())[:300]
    assert W.running_q(df.limit(0), "p", "i").count() == 0 and W.benjamini_hochberg(df.limit(0), "p", "i").count() == 0


def test_correlations_of_features(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(100, 1, (90, 5))
    x[:, 3] = 7.0
    there = rng.random((90, 5)) < 0.8
    long = spark.createDataFrame([(i, 10 * j, float(x[i, j])) for i in range(90) for j in range(5) if there[i, j]], "pixel_id int, f int, value double")
    got = {(r["src"], r["dst"]): r["weight"] for r in G.correlation_edges(long, "pixel_id", "f", "value", -2.0).collect()}
    want = {(10 * a, 10 * b): np.corrcoef(x[both, a], x[both, b])[0, 1] for a in range(5) for b in range(a + 1, 5) if 3 not in (a, b) for both in [there[:, a] & there[:, b]]}
    assert got == pytest.approx(want)


def test_tree_is_applied_with_its_own_scalers(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(360):
        side = i % 2
        v = rng.gamma(2.0, 1.0, 8) * np.where(np.arange(8) // 4 == side, 4.0, 0.4)
        rows.append((i, i // 2 % 6, v.tolist(), [float(side) + rng.normal(0, 0.1), float(rng.normal())]))
    pixels = spark.createDataFrame(rows, "pixel_id int, section_id int, features array<double>, embedding array<double>")
    config = C.TreeConfig(clusters=6, least_pixels=40, sweep=2, trees=3, depth=1, least_per_section=5)
    root, learned = C.learn_tree(pixels, config=config)
    assert root.model is not None
    paths = {r["pixel_id"]: r["path"] for r in learned.collect()}
    assert {r["pixel_id"]: r["path"] for r in C.apply_tree(root, pixels, config=config).collect()} == paths
    C.save_tree(root, str(tmp_path / "tree"), spark, config)
    again, same = C.load_tree(str(tmp_path / "tree"), spark)
    assert same == config
    for i in (0, 1, 7):  # a row alone takes the path that it took among others
        assert [r["path"] for r in C.apply_tree(again, pixels.where(F.col("pixel_id") == i), config=same).collect()] == [paths[i]]


def test_a_subset_splits_where_all_factors_fail(spark):
    """One factor tells two groups apart, the other is loud and says nothing: together they do not split, the first alone does."""
    rng = np.random.default_rng(11)
    group = np.arange(480) % 2
    space = np.stack((2.0 * group - 1 + rng.normal(0, 0.1, 480), rng.normal(0, 30, 480), np.zeros(480)), axis=1)
    features = rng.normal(5, 0.5, (480, 10)) + 2.0 * (np.arange(10) < 5) * group[:, None] - 2.0 * (np.arange(10) >= 5) * group[:, None]
    rows = [(i, i // 2 % 6, space[i].tolist(), features[i].tolist()) for i in range(480)]
    frame = spark.createDataFrame(rows, "pixel_id int, section_id int, _space array<double>, features array<double>")
    frame = spool(frame.withColumn("measured", C.normalised(frame, "features")))
    config = C.TreeConfig(clusters=8, least_pixels=100, least_per_section=10)
    assert C._bisected(frame, "features", "section_id", [0, 1], 1, C.TreeConfig(clusters=8, least_pixels=100, candidates=1)) is None
    subset, sides = C._bisected(frame, "features", "section_id", [0, 1], 1, config)
    assert subset == [0]
    found = {r["pixel_id"]: r["_side"] for r in sides.collect()}
    assert len({(group[i], found[i]) for i in range(480)}) == 2
    assert C._bisected(frame, "features", "section_id", [0, 1], 1, C.TreeConfig(clusters=8, least_pixels=100, least_per_section=60)) is None


def test_shared_passes_are_those_of_one_candidate(spark):
    """Centres and counts of several subsets from shared passes equal plain k-means rounds of each."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 4)) + 3 * rng.integers(0, 3, (300, 1))
    frame = spool(spark.createDataFrame([(i, i % 3, v.tolist(), v[:2].tolist()) for i, v in enumerate(x)], "pixel_id int, section_id int, _space array<double>, features array<double>").repartition(4))
    config = C.TreeConfig(clusters=5, passes=4)
    kept = [np.array([0, 1, 3]), np.array([2, 3]), np.array([0, 1, 2, 3])]
    centres = C._clustered(frame, x[:100], kept, config)
    draw = np.random.default_rng(config.seed)
    for columns, got in zip(kept, centres):
        want = C._first_centres(x[:100][:, columns], 5, draw)
        for _ in range(4):
            near = np.linalg.norm(x[:, None, columns] - want[None], axis=2).argmin(axis=1)
            want = np.stack([x[near == k][:, columns].mean(axis=0) if (near == k).any() else want[k] for k in range(5)])
        assert np.allclose(got, want)


def test_neighbours_and_communities_of_pixels(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (30, 4)) for c in (0, 5, 10)])
    pixels = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pixel_id long, features array<double>")
    edges = G.knn_edges(pixels, "features", 6, cells=5, probes=5).collect()
    apart = np.linalg.norm(x[:, None] - x[None], axis=2) + np.eye(90) * 1e9
    for i in range(90):
        mine = sorted((r["distance"], r["dst"]) for r in edges if r["src"] == i)
        assert [j for _, j in mine] == np.argsort(apart[i], kind="stable")[:6].tolist()
    some = {(r["src"], r["dst"]) for r in G.knn_edges(pixels, "features", 6, cells=5, probes=2).collect()}
    assert len(some & {(r["src"], r["dst"]) for r in edges}) >= 0.9 * len(edges)
    labels = {r["node"]: r["community"] for r in M.modularity_communities(spark.createDataFrame(edges)).collect()}
    for part in range(3):  # communities stay within the groups, and are their smallest members
        mine = {labels[i] for i in range(30 * part, 30 * part + 30)}
        assert all(30 * part <= c < 30 * part + 30 and labels[c] == c for c in mine) and len(mine) < 6


def test_neighbours_across_slices(spark, monkeypatch):
    """Members and visitors of a cell in several slices, equal and far-off points, against brute force."""
    monkeypatch.setattr(G, "SLICE", 17)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(1e6, 1, (40, 3)), np.ones((20, 3))])
    pixels = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pixel_id long, features array<double>")
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) + np.where(np.eye(120) > 0, np.inf, 0)
    want = {(i, int(j)) for i in range(120) for j in np.argsort(apart[i], kind="stable")[:5]}
    got = G.knn_edges(pixels, "features", 5, cells=3, probes=3)
    assert {(r["src"], r["dst"]) for r in got.collect()} == want and got.count() == 600


def test_nearest_is_the_same_at_every_size(monkeypatch):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(1e4, 1, (200, 4)), 1)
    ids = np.arange(200)
    whole = G._nearest(ids, x, ids, x, 7)
    monkeypatch.setattr(G, "BLOCK", 300)
    assert all(np.array_equal(a, b) for a, b in zip(whole, G._nearest(ids, x, ids, x, 7)))


def planted(groups, size, inside, between, seed):
    """Weighted edges of a random graph with denser groups, and its matrix."""
    rng = np.random.default_rng(seed)
    of = np.repeat(np.arange(groups), size)
    w = np.where(rng.random((len(of), len(of))) < np.where(of[:, None] == of[None], inside, between), rng.integers(1, 4, (len(of), len(of))), 0)
    w = np.triu(w, 1)
    return [(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w))], (w + w.T).astype(float)


@pytest.mark.parametrize("coarse", [0, 1024])
def test_modularity_communities(spark, coarse):
    """Planted groups come back, connected and named by their smallest node, with the quality of the driver's method."""
    edges, w = planted(5, 24, 0.4, 0.02, 7)
    frame = spark.createDataFrame(edges, "src long, dst long, weight double")
    found = spool(M.modularity_communities(frame, weight="weight", coarse=coarse))
    labels = np.array([r["community"] for r in found.orderBy("node").collect()])
    q = G.modularity(frame, found).first()["q"]
    assert q >= G.partition_quality(w, G.leiden(w)) - 0.02
    assert q == pytest.approx(G.partition_quality(w, labels), abs=1e-9)
    for g in range(5):  # nearly all of a group together
        assert np.bincount(labels[24 * g:24 * g + 24]).max() >= 22
    for c in np.unique(labels):
        inside = np.flatnonzero(labels == c)
        assert inside[0] == c
        reached = np.linalg.matrix_power(w[np.ix_(inside, inside)] + np.eye(len(inside)), len(inside))
        assert (reached[0] > 0).all()


def test_communities_of_odd_graphs(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert M.modularity_communities(none).count() == 0
    odd = [("a", "b", 1.0), ("b", "a", 1.0), ("c", "c", 2.0), ("d", None, 1.0), ("e", "f", 0.0), ("g", "h", 5.0), ("h", "g", None)]
    got = {r["node"]: r["community"] for r in M.modularity_communities(spark.createDataFrame(odd, "src string, dst string, weight double"), weight="weight").collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "g": "g", "h": "g"}


def shuffled_mb(spark):
    """MB that the stages so far have shuffled."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() / 1e6 for i in range(stages.size())}


def test_rounds_of_communities_move_labels_not_links(spark):
    """On tables too large to broadcast, all rounds together shuffle little for each link."""
    rng = np.random.default_rng(8)
    edges = pd.DataFrame({"src": np.repeat(np.arange(3000), 12), "dst": rng.integers(0, 3000, 36000)})
    edges["dst"] = np.where(rng.random(36000) < 0.6, edges["src"] // 100 * 100 + edges["dst"] % 100, edges["dst"])
    frame = spark.createDataFrame(edges)
    before, threshold = shuffled_mb(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = M.modularity_communities(frame, iterations=1).toPandas()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    moved = sum(mb for stage, mb in shuffled_mb(spark).items() if stage not in before)
    assert len(found) == 3000 and (found.groupby(found["node"] // 100)["community"].agg(lambda c: c.value_counts().iloc[0]) > 80).all()
    assert moved < 15


@pytest.mark.parametrize("hub", [30, 10**6])
def test_blocks_propose_as_joins_do(spark, monkeypatch, hub):
    """Moves by blocks of nodes, with hubs apart or without hubs, are those that grouped sums of all links give."""
    monkeypatch.setattr(M, "LINKS", 150)
    monkeypatch.setattr(M, "HUB", hub)
    edges, _ = planted(4, 30, 0.2, 0.03, 9)
    edges += [(0, i, 1.0) for i in range(1, 90)] + [(200, 201, 2.0), (300, 300, 1.0)]
    links = spool(M._symmetric(spark.createDataFrame(edges, "src long, dst long, weight double"), "src", "dst", "weight"))
    total = links.agg(F.sum("w")).first()[0]
    nodes, blocks = M._routed(links)
    assert blocks > 5 and nodes.where("home IS NULL").count() == (1 if hub == 30 else 0)
    label = nodes.withColumn("community", F.when(F.col("node") < 60, F.col("node") - F.col("node") % 3).otherwise(F.col("node")))
    sums = label.groupBy("community").agg(F.sum("degree").alias("strength"), F.count("*").alias("size"), F.min("node").alias("least"))
    labels = spool(label.join(sums, "community"))
    between = links.where("u <> v")
    got = M._blockwise(M._dealt(between, nodes, blocks), labels, blocks, total, 1.0)
    want = M._proposals(between.join(nodes.select(F.col("node").alias("u"), "degree"), "u"), labels, total, 1.0, nodes)
    light = want.join(nodes.where("home IS NOT NULL").select("node", "home", "routes"), "node")
    assert sorted(map(str, got.select(light.columns).collect())) == sorted(map(str, light.collect()))


def test_communities_by_blocks_and_hubs(spark, monkeypatch):
    """A star with a chain, all in small blocks: ids of another type give the same partition, by names in order."""
    monkeypatch.setattr(M, "LINKS", 16)
    monkeypatch.setattr(M, "HUB", 8)
    edges = [(0, i) for i in range(1, 13)] + [(i, i + 1) for i in range(20, 26)]
    for kind in ("int", "string"):
        frame = spark.createDataFrame(edges, "src int, dst int").select(*((F.col(c) if kind == "int" else F.format_string("n%02d", c)).alias(c) for c in ("src", "dst")))
        found = M.modularity_communities(frame, coarse=0)
        assert dict(found.dtypes) == {"node": kind, "community": kind}
        got = {int(str(r["node"]).strip("n")): int(str(r["community"]).strip("n")) for r in found.collect()}
        assert len(got) == 20 and all(got[i] == 0 for i in range(13)) and min(got[i] for i in range(20, 27)) == 20 and all(got[c] == c for c in got.values())


def test_noise_model(spark):
    mean = np.linspace(0.5, 50, 40)
    cv = mean**-0.6 + 0.15
    a, k = L.fit_noise(mean, cv)
    assert a == pytest.approx(-0.6, abs=0.02) and k == pytest.approx(0.15, abs=0.02)
    rng = np.random.default_rng(4)
    rows = [(j, float(v)) for j in range(12) for v in rng.normal(10 + j, (2.0 if j == 5 else 0.5), 300)]
    top = L.noise_selection(spark.createDataFrame(rows, "f int, value double"), "f", "value", 3).collect()
    assert len(top) == 3 and top[0]["f"] == 5
    assert L.noise_selection(spark.createDataFrame(rows, "f int, value double").limit(0), "f", "value", 3).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_support_curve(seed):
    """Bounds and sum of the dual, and a gap to the primal of less than 1e-6."""
    rng = np.random.default_rng(seed)
    x = rng.uniform(-4, 8, 80)
    x[:5] = x[0]
    y = np.sin(x / 2) + rng.normal(0, 0.3, 80) + 3 * (rng.random(80) < 0.05)
    curve = L.fit_support(x, y)
    beta, kernel = curve.beta, np.exp(-0.06 * (x[:, None] - x) ** 2)
    assert abs(beta.sum()) < 1e-9 and np.abs(beta).max() <= 1 + 1e-12
    quadratic = beta @ kernel @ beta / 2
    primal = quadratic + np.maximum(0, np.abs(y - curve.predict(x)) - 0.1).sum()
    dual = -(quadratic - y @ beta + 0.1 * np.abs(beta).sum())
    assert 0 <= primal - dual + 1e-9 < 1e-6
    assert (np.abs(y - curve.predict(x))[np.abs(beta) < 1e-12] <= 0.1 + 1e-6).all()


def test_support_selection(spark):
    rng = np.random.default_rng(6)
    rows = [(j, float(v)) for j in range(15) for v in rng.normal(10 + j, (3.0 if j in (4, 9) else 0.5), 200)]
    frame = spark.createDataFrame(rows, "f int, value double")
    top = L.noise_selection(frame, "f", "value", 2, "support").collect()
    assert {r["f"] for r in top} == {4, 9} and all(r["excess"] > 0 for r in top)
    assert L.noise_selection(frame.limit(0), "f", "value", 2, "support").count() == 0
    curve = L.fit_support([1.0], [3.0])
    assert curve.predict([1.0, 9.0]).tolist() == [3.0, 3.0]


def test_case_control_analysis(spark):
    rng = np.random.default_rng(5)
    rows = [(f, s, s % 2, "case" if s >= 4 else "control", t, float(0.4 + (0.3 if s >= 4 and t == "x" and f == 0 else 0.0) + rng.normal(0, 0.02))) for f in range(2) for s in range(8) for t in "xy" for _ in range(30)]
    df = spark.createDataFrame(rows, "feature int, section int, sample int, condition string, supertype string, value double")
    out = {(r["feature"], r["supertype"]): r for r in I.case_control_analysis(df, None, "feature", "section", "sample", "condition", "supertype", "value", "case", I.CaseControlConfig(epochs=400), draws=200).collect()}
    assert len(out) == 4 and out[0, "x"]["shift"] > out[0, "y"]["shift"] + 0.2 and out[0, "x"]["shifted"] and out[0, "x"]["log2fc"] > 0
    one = I.case_control_analysis(df, [1], "feature", "section", "sample", "condition", "supertype", "value", "case", I.CaseControlConfig(epochs=50), draws=50)
    assert {r["feature"] for r in one.collect()} == {1}


def test_database_by_structure_key(spark):
    m = spark.createDataFrame([(1, "InChIKey=AAA-B"), (2, "aaa-b"), (3, "CCC"), (4, None), (5, "")], "lm int, inchi_key string")
    d = spark.createDataFrame([("H2", "AAA-B", "two"), ("H1", "inchikey=aaa-b ", "one"), ("H9", "", "none"), ("H8", None, "none")], "dbid string, inchikey string, title string")
    got = {r["lm"]: (r["dbid"], r["title"]) for r in J.attach_database(m, d).collect()}
    assert got == {1: ("H1", "one"), 2: ("H1", "one"), 3: (None, None), 4: (None, None), 5: (None, None)}


def test_strict_joins(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "pixel_id int, x string")
    right = spark.createDataFrame([(2, 5.0), (3, 6.0)], "pixel_id int, y double")
    assert {tuple(r) for r in J.aligned_modality(left, right).collect()} == {(1, "a", None), (2, "b", 5.0)}
    with pytest.raises(ValueError):
        J.aligned_modality(left, right, complete=True)
    assert J.aligned_modality(left.where("pixel_id = 2"), right, complete=True).count() == 1
    for other in (right, right.limit(0), left.union(left).withColumnRenamed("x", "y")):
        with pytest.raises(ValueError):
            J.merge_columns(left, other, same_rows=True)
    assert J.merge_columns(left, left.withColumnRenamed("x", "y"), same_rows=True).count() == 2
    assert [tuple(r) for r in J.transpose(left.withColumns({"u": F.col("pixel_id") * 2, "v": F.lit(None).cast("double")}), "pixel_id", ["u", "v"]).orderBy("column").collect()] == [("u", 2.0, 4.0), ("v", None, None)]


def test_stages_of_an_analysis(spark, tmp_path):
    folder, pixels = str(tmp_path), spark.range(3).withColumnRenamed("id", "pixel_id")
    with pytest.raises(FileNotFoundError):
        T.load_stage(spark, folder, "brain")
    vectors = pixels.withColumn("v", F.array(F.col("pixel_id").cast("double"), F.lit(1.0)))
    T.save_stage({"pixels": pixels}, folder, "brain", "preprocessed")
    path = T.save_stage({"pixels": pixels.limit(2)}, folder, "brain", "embedding", {"nmf": (vectors, "pixel_id", "v")})
    assert path.endswith("brain_msi_embedding")
    last = T.load_stage(spark, folder, "brain")
    assert last["pixels"].count() == 2 and {(r["key"], tuple(r["vector"])) for r in last["vectors_nmf"].collect()} == {(i, (float(i), 1.0)) for i in range(3)}
    assert set(T.load_stage(spark, folder, "brain", "preprocessed")) == {"pixels"}
    with pytest.raises(ValueError):
        T.save_stage({}, folder, "brain", "embedding", {"bad": (vectors.withColumn("v", F.when(F.col("pixel_id") == 0, F.array(F.lit(1.0))).otherwise(F.col("v"))), "pixel_id", "v")})
    with pytest.raises(ValueError):
        T.stage_folder(folder, "brain", "plots")


def test_further_files(spark, tmp_path):
    (tmp_path / "colors.csv").write_text("class,classcolors\nPC , #aa0000\nPE,#00aa00\nPC,#bb0000\n")
    colors = {r["class"]: r["color"] for r in T.read_colors(spark, str(tmp_path / "colors.csv")).collect()}
    assert colors == {"PC": "#bb0000", "PE": "#00aa00"}
    x = np.arange(24).reshape(2, 3, 4)
    buffer = io.BytesIO()
    np.save(buffer, x)
    (tmp_path / "a.npy").write_bytes(buffer.getvalue())
    cells = T.read_arrays(spark, str(tmp_path / "*.npy")).collect()
    assert {tuple(r["index"]): r["value"] for r in cells} == {i: float(v) for i, v in np.ndenumerate(x)}
    voxels = spark.createDataFrame([(*r["index"], r["value"]) for r in cells], "i long, j long, k long, value double")
    T.write_voxels(voxels, str(tmp_path / "voxels"), "i", "j", "k")
    assert spark.read.parquet(str(tmp_path / "voxels")).where("i = 1").count() == 12
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.txt").write_text("abc")
    sums = spark.createDataFrame([("a.txt", "900150983CD24FB0D6963F7D28E17F72"), ("a2.txt", "00")], "name string, md5 string")
    assert {r["name"]: r["state"] for r in T.verify_files(spark, str(tmp_path / "files"), sums).collect()} == {"a.txt": "ok", "a2.txt": "missing"}
    assert T.verify_files(spark, str(tmp_path / "files"), sums.withColumn("md5", F.lit("11"))).where("state = 'changed'").count() == 1
    for i in range(2):
        T.log_progress(spark, str(tmp_path / "log"), feature=i, done=True)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "log")).collect()) == ['{"done": true, "feature": 0}', '{"done": true, "feature": 1}']


def test_interpolation_across_blocks(spark):
    """Blocks with halos against all pairs, at radius 40 and with far-off known voxels; own values, regions, the first voxels."""
    rng = np.random.default_rng(21)
    cells = [(int(i), int(j), int(k), "ab"[int(i + j) % 2]) for i, j, k in {tuple(x) for x in rng.integers(-30, 60, (700, 3)).tolist()}]
    at = [cells[n] for n in rng.choice(len(cells), 60, replace=False)]
    known = [(*c, float(rng.random()) if n else -1.0) for n, c in enumerate(at)] + [(300, 300, 300, "a", 9.0)]
    volume = spark.createDataFrame([*cells, (500, 0, 0, None), (500, 0, 1, "a")], "i long, j long, k long, region string")
    frame = spark.createDataFrame(known, "i long, j long, k long, region string, value double")
    for radius, edge in ((40, 16), (40, 64), (7, 16)):
        got = {(r["i"], r["j"], r["k"]): r["value"] for r in S.interpolate(volume, frame, radius, first=-20, edge=edge).collect()}
        assert len(got) == len(cells) + 2 and got[500, 0, 0] is None and got[500, 0, 1] is None
        good = [(np.array(x[:3]), x[3], x[4]) for x in known if x[4] >= 0]
        own = {tuple(p.tolist()): v for p, _, v in good}
        for i, j, k, region in cells:
            d = [(np.linalg.norm(p - (i, j, k)), v) for p, g, v in good if g == region]
            w = [(np.exp(-x), v) for x, v in d if x <= radius]
            want = own.get((i, j, k), sum(a * v for a, v in w) / sum(a for a, _ in w) if w and i >= -20 else None)
            assert got[i, j, k] == (None if want is None else pytest.approx(want, rel=1e-9))


def test_distances_at_any_spacing(spark):
    rng = np.random.default_rng(22)
    points = [(s, int(x), int(y)) for s, scale in ((0, 10), (1, 400)) for x, y in {tuple(p) for p in rng.integers(0, scale, (60, 2)).tolist()}] + [(2, 5, 5), (3, 0, 0), (3, 900, 900)]
    got = {(r[0], r[1], r[2]): r[3] for r in S.nearest_distance(spark.createDataFrame(points, "section_id int, x long, y long")).collect()}
    for s, x, y in points:
        rest = [np.hypot(x - a, y - b) for t, a, b in points if t == s and (a, b) != (x, y)]
        assert got.get((s, x, y)) == (pytest.approx(min(rest)) if rest else None)
