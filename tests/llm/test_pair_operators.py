"""Sharding, decontamination, SimHash and cover tree against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pixelmill.llm import covertree, decontam, sharding, simhash
from pixelmill.llm.components import connected_components, forest

LOWER = {i: i + 32 for i in range(65, 91)}


def components(n, links):
    label = list(range(n))
    while True:
        new = list(label)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


# ---- sharding ------------------------------------------------------------------------------------------------------------

def shard(spark, rows, shards=8):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "size": F.lit("x")})
    return sharding.shard_documents(df, shards).collect()


def test_shards_are_even_and_gapless(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "w%d " % i * int(rng.integers(1, 60))) for i in range(3000)] + [(5000 + i, "the same text " * 5) for i in range(1500)]
    got = shard(spark, rows)
    assert len(got) == len(rows) and all(r["size"] == len(t.encode()) + 1 for r, t in ((r, dict(rows)[r["doc_id"]]) for r in got))
    assert all(r["text_crc32"] == zlib.crc32(dict(rows)[r["doc_id"]].encode()) for r in got)
    total = sum(r["size"] for r in got)
    for s in range(8):
        mine = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        assert sum(r["size"] for r in mine) == pytest.approx(total / 8, rel=0.05)


def test_small_groups_stay_together(spark):
    rows = [(i, f"text {i % 700} " * 3) for i in range(2100)]
    where = {}
    for r in shard(spark, rows):
        where.setdefault(dict(rows)[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_shards_against_a_plain_computation(spark):
    """From the plan's boundaries: ranges by bisection, shards by where a range's middle lies, slots by the order of keys."""
    from bisect import bisect_right

    rng = random.Random(4)
    texts = [None, "", "hot " * 30] + ["x" * rng.randint(0, 400) for _ in range(500)] + ["hot " * 30] * 200
    df = spark.createDataFrame([*enumerate(texts), (None, "a"), (3, texts[3]), (3, texts[3])], "doc_id long, text string")
    records = df.select("doc_id", sharding.size_of(F.col("text")).alias("size"), sharding.key_of(F.col("doc_id"), F.col("text")).alias("key"))
    plan = sharding.plan_shards(records, 4, 16, 4, overfull=1.5)
    rows = [(r["key"], r["size"]) for r in records.collect()]
    assert sorted(r["size"] for r in records.collect()) == sorted(len((t or "").encode()) + 1 for t in [*texts, "a", texts[3], texts[3]])
    ranges = {}
    for key, size in rows:
        ranges.setdefault(bisect_right(plan.boundaries, key), []).append((key, size))
    total, before, shard_of = sum(s for _, s in rows), 0, {}
    for r in sorted(ranges):
        size = sum(s for _, s in ranges[r])
        shard_of[r] = min(3, (2 * before + size) * 4 // (2 * total))
        before += size
        # what is overfull could not be cut: one key
        assert size * 64 <= 1.5 * total or len({k for k, _ in ranges[r]}) == 1
    want, filled = [], [0] * 4
    for r in sorted(ranges):
        for key, size in sorted(ranges[r]):
            want.append((key, size, shard_of[r], filled[shard_of[r]]))
            filled[shard_of[r]] += 1
    got = [(r["key"], r["size"], r["shard"], r["slot"]) for r in sharding.slots(records, plan).collect()]
    assert sorted(got) == sorted(want)


def test_overfull_ranges_are_subdivided(spark):
    """With next to no samples the first ranges are uneven; counting finds that and cuts them again."""
    rows = [(i, "text %d" % i * (1 + i % 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    records = df.select("doc_id", sharding.size_of(F.col("text")).alias("size"), sharding.key_of(F.col("doc_id"), F.col("text")).alias("key"))
    rough = sharding.plan_shards(records, 4, 16, 1, overfull=1.5, rounds=0)
    fine = sharding.plan_shards(records, 4, 16, 1, overfull=1.5, rounds=3)
    assert len(fine.boundaries) > len(rough.boundaries) and max(fine.shard_bytes) - min(fine.shard_bytes) <= max(rough.shard_bytes) - min(rough.shard_bytes)
    assert sum(fine.shard_bytes) == sum(r["size"] for r in records.collect())
    got = fine.assign(records, F.col("key")).collect()
    assert all(r["shard"] == sharding.shard_of_key(fine, r["key"]) for r in got)


def test_shards_of_odd_tables(spark):
    assert shard(spark, []) == []
    got = shard(spark, [(None, None), (1, ""), (1, ""), (2, "é" * 5), (3, "x" * 200_000)])
    assert sorted(r["size"] for r in got) == [1, 1, 1, 11, 200_001] and len({(r["shard"], r["slot"]) for r in got}) == 5
    assert {r["text_crc32"] for r in got if r["size"] == 1} == {0}


# ---- decontamination -------------------------------------------------------------------------------------------------------

def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_hits(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        k = min(13, len(b))
        for i in range(len(b) - k + 1 if b else 0):
            for j in range(len(w) - k + 1):
                if w[j:j + k] == b[i:i + k]:
                    hit |= set(range(j, j + k))
                    found.add(item)
    ids = ",".join(sorted(str(i) for i in found if i is not None))
    return len(w), len(hit), ids, bool(hit) and 20 * len(hit) >= len(w)


def decontamination_case():
    rng = np.random.default_rng(5)
    vocabulary = ["tok%d" % i for i in range(30)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, text(int(n))) for i, n in enumerate((20, 13, 14, 5, 1, 40))] + [(6, ""), (7, None), (8, "Straße ÄÖ 12 x")]
    docs = [(i, text(int(rng.integers(0, 80)))) for i in range(30)]
    docs += [(100, f"{text(10)}, {items[0][1].upper()}! {text(300)}"), (101, items[5][1] + " " + items[5][1]), (102, None), (103, ""), (104, "straße ÄÖ 12 X"), (104, "straße ÄÖ 12 X"), (105, "Start: " + items[1][1].replace(" ", " -- ") + " tail " * 5), (106, (text(50) + " ") * 200)]
    return docs, items


def test_decontamination(spark):
    docs, items = decontamination_case()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"words": F.lit(0), "_row": F.lit("r"), "k": F.lit(2)})
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["id"], r["n_words"], r["n_hit"], ",".join(r["item_ids"])) for r in decontam.find_hits(d, b).collect())
    assert got == sorted((i, *brute_hits(t, items)[:3]) for i, t in docs)
    kept = decontam.decontaminate(d, b)
    assert kept.columns == d.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted((i, t or "") for i, t in docs if not brute_hits(t, items)[3])
    cut = decontam.decontaminate(d, b, "spans").collect()
    assert len(cut) == len(docs) and all(not brute_hits(r["text"], items)[3] or brute_hits(r["text"], items)[1] < 13 for r in cut)
    assert [r["text"] for r in cut if r["doc_id"] == 105] == ["Start: tail  tail  tail  tail  tail "]
    assert decontam.find_hits(d.limit(0), b).count() == 0 and decontam.decontaminate(d, b.limit(0)).count() == len(docs)


def test_decontamination_beyond_the_bounds(spark, monkeypatch):
    docs, items = decontamination_case()
    monkeypatch.setattr(decontam, "MAX_BROADCAST", 0)
    monkeypatch.setattr(decontam, "MAX_BITS", 64)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["id"], r["n_words"], r["n_hit"], ",".join(r["item_ids"])) for r in decontam.find_hits(d, b).collect())
    assert got == sorted((i, *brute_hits(t, items)[:3]) for i, t in docs)


def test_large_benchmarks_leave_few_candidates(spark):
    """More windows than a plain constant would take: only windows whose ends the benchmark has become candidates."""
    items = spark.range(20_000).select(F.col("id").alias("item_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: F.concat(F.lit("w"), F.col("id"), F.lit("x"), i.cast("string")))).alias("text"))
    windows = decontam.benchmark_windows(items)
    assert windows.count() == 13 * 20_000
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.concat(F.lit("y"), F.col("id"), F.lit("x"), i.cast("string")))).alias("text"))
    some = docs.select("doc_id", F.concat("text", F.lit(" "), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: F.concat(F.lit("w"), F.col("doc_id"), F.lit("x"), i.cast("string"))))).alias("text"))
    bitmap = decontam._bitmap(windows, 13 * 20_000)
    candidates = docs.select(F.size(decontam._candidates(decontam.words_of(F.col("text")), 13, bitmap)).alias("n")).agg(F.sum("n")).first()[0]
    assert candidates < 0.1 * 50 * 988
    assert [r["n_hit"] for r in decontam.find_hits(some, items).collect()] == [25] * 50


# ---- SimHash -----------------------------------------------------------------------------------------------------------------

def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, monkeypatch):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["A", "b", "Cé", "dd", "e f", "g"], int(n))) for n in rng.integers(0, 40, 60)]
    texts += [None, "", " \t\n", "one", "One", "two words", texts[5], texts[5] + " z", "long " * 70_000, "x\x0by\x1cz w v"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"fp": F.lit(1), "_row": F.lit(2)})
    prints = [brute_fingerprint(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    label = components(len(texts), links)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).withColumn("hex", simhash.as_hex(F.col("fp"))).collect()}
    assert [int(got[i]["hex"], 16) for i in range(len(texts))] == prints
    assert [got[i]["component_id"] for i in range(len(texts))] == label
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    twice = docs.union(docs)
    assert simhash.near_duplicates(twice).count() == 2 * len(texts) and simhash.keep_one(twice).count() == len(set(label))


@pytest.mark.parametrize("rows", [30, 200, 5000])
def test_vantage_cells_lose_no_pair(spark, monkeypatch, rows):
    rng = np.random.default_rng(rows)
    seeds = rng.integers(0, 2**63, 120, dtype=np.uint64)
    fps = np.unique(np.concatenate([seeds] + [seeds ^ np.uint64(1 << int(b)) for b in rng.integers(0, 64, 4)] + [seeds ^ np.uint64((1 << int(a)) ^ (1 << int(b))) for a, b in rng.integers(0, 64, (5, 2))]))
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
    want = components(len(fps), [(i, j) for i, j in zip(*np.nonzero(apart <= 2)) if i != j])
    monkeypatch.setattr(simhash, "CELL_ROWS", rows)
    placed = simhash.cells(spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")).toPandas()
    found = []
    for _, mine in placed.groupby("cell"):
        every = mine["fp"].to_numpy().view(np.uint64)
        a, b = simhash.tree_links(every[mine["home"].to_numpy(bool)], every, leaf=8)
        found += [(int(np.searchsorted(fps, x)), int(np.searchsorted(fps, y))) for x, y in zip(a, b)]
    assert components(len(fps), found) == want
    assert sorted(placed[placed["home"]]["fp"]) == sorted(fps.view(np.int64).tolist())
    assert (placed["cell"].nunique() > 1) == (rows < len(fps))


def test_only_overfull_cells_are_cut(spark, monkeypatch):
    """A dense cluster is cut for itself: the other fingerprints keep few copies."""
    rng = np.random.default_rng(3)
    loose = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    dense = np.unique(np.uint64(0x123456789ABCDEF) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (6000, 6)).astype(np.uint64), axis=1))
    monkeypatch.setattr(simhash, "CELL_ROWS", 500)
    rows = [(int(v), False) for v in loose.view(np.int64)] + [(int(v), True) for v in dense.view(np.int64)]
    frame = spark.createDataFrame(rows, "fp long, dense boolean")
    copies = {r["dense"]: r["n"] for r in simhash.cells(frame.select("fp")).join(frame, "fp").groupBy("dense").agg((F.count("*") / F.countDistinct("fp")).alias("n")).collect()}
    assert copies[False] < 6


def test_links_with_many_cells(spark, monkeypatch):
    rng = np.random.default_rng(9)
    seeds = rng.integers(0, 2**63, 200, dtype=np.uint64)
    fps = np.unique(np.concatenate((seeds, seeds ^ np.uint64(5), seeds ^ np.uint64(1 << 63))))
    monkeypatch.setattr(simhash, "CELL_ROWS", 60)
    frame = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")
    pairs = [(r["a"], r["b"]) for r in simhash.links(frame).collect()]
    at = {int(v): i for i, v in enumerate(fps.view(np.int64))}
    want = components(len(fps), [(i, j) for i, j in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)) if i != j])
    assert components(len(fps), [(at[a], at[b]) for a, b in pairs]) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 301)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160)) and got[301] == 300
    a, b = forest(np.array([3, 5, 9]), np.array([5, 9, 11]))
    assert set(b.tolist()) == {3} and sorted(a.tolist()) == [5, 9, 11]


# ---- cover tree -----------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("block", [8192, 40])
def test_cover_tree(spark, block):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(25, 6))
    x = np.concatenate([c + rng.normal(0, s, (6, 6)) for c, s in zip(centres, np.linspace(0.01, 0.4, 25))]).astype(np.float32)
    x = np.concatenate((x, x[:5], 3 * x[5:8], np.zeros((1, 6), np.float32), np.repeat(x[10:11], 40, axis=0)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [float("nan")] * 6), (904, [float("inf")] * 6), (905, [1.0, 2.0]), (906, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({"class": F.lit(1), "label": F.lit(0), "h": F.lit(0)})
    got = {r["vec_id"]: r for r in covertree.near_duplicates(df, block_rows=block).collect()}
    d = x.astype(np.float64)
    norm = np.linalg.norm(d, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        cosine = d @ d.T / np.outer(norm, norm)
    hit = np.nan_to_num(cosine, nan=-1) >= 0.95
    np.fill_diagonal(hit, False)
    label = components(len(x), [(i, j) for i, j in zip(*np.nonzero(hit))])
    assert [got[i]["n_links"] for i in range(len(x))] == hit.sum(axis=1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == label
    assert all(got[i]["kept"] == (i == label[i]) for i in range(len(x)))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(900, 905))
    assert got[905]["n_links"] == got[906]["n_links"] == 1 and got[906]["component_id"] == 905
    assert covertree.near_duplicates(df.limit(0)).count() == 0


def test_dense_blocks_need_bounded_memory():
    """Two dense blocks have some four million links around the threshold; counts are exact and pairs are never all held."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(0)
    x = (np.full((4000, 64), 0.125) + rng.normal(0, 0.024, (4000, 64))).astype(np.float32)
    blocks = [covertree.nets(covertree.unit(part)) for part in (x[:2000], x[2000:])]
    table = pa.table({
        "first": pa.array(np.arange(4000) < 2000), "class": pa.array(np.arange(4000)), "weight": pa.array(1 + np.arange(4000) % 3),
        "place": pa.array(np.tile(np.arange(2000, dtype=np.int32), 2)), "vector": pa.array(list(x)), "nets": pa.array(list(np.concatenate(blocks).astype(np.int32))),
    })
    order = pa.array(rng.permutation(4000))  # rows reach a task in any order
    tracemalloc.start()
    got = covertree.block_pair(table.take(order), 0.95).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    unit = covertree.unit(x)
    hit, weight = unit[:2000] @ unit[2000:].T >= 0.95, 1 + np.arange(4000) % 3
    want = np.concatenate((hit @ weight[2000:], weight[:2000] @ hit))
    assert hit.sum() > 2_000_000 and peak < 150e6
    assert {r["a"]: r["n"] for r in got if r["b"] is None} == {i: n for i, n in enumerate(want.tolist()) if n}
    assert components(4000, [(r["a"], r["b"]) for r in got if r["n"] is None]) == components(4000, [(0, 2000 + int(j)) for j in np.flatnonzero(hit[0])] + [(int(i), 2000 + int(np.flatnonzero(hit[i])[0])) for i in range(2000) if hit[i].any()] + [(int(np.flatnonzero(hit[:, j])[0]), 2000 + int(j)) for j in range(2000) if hit[:, j].any()])
