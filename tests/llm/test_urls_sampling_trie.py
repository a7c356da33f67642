"""URL filters, importance resampling and prefix tries against plain forms."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.llm import importance, trie, urls
from pixelmill.operators.base import lookup

LOWER = {i: i + 32 for i in range(65, 91)}


# ---- url filters ------------------------------------------------------------------------------------------------------------

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("bad.org", "", "block"), ("bad.org", "/o", "allow"), ("É.org", None, "block")]
URLS = [
    None, "", "no scheme", "http://", "://example.com/en/", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/EN/", "http://example.com", "http://example.com/en", "http://notexample.com/en/a",
    "http://a.b.example.com/en/", "http://x.net/es/1", "http://x.net/fr/1", "http://bad.org", "http://bad.org?q", "http://sub.bad.org/ok", "http://sub.bad.org/no", "http://É.org/a", "http://é.org/a", "http://x.É.org#f",
    "http://a://b.com/", "http://com", "http://com/", "http://.com/", "http://example.com./en/", "http://u@example.com:80/en/", "http://x.com\n/en/a\nb?c", "http://" + "a." * 3000 + "com/" + "p" * 50_000, "same://x.com/", "same://x.com/",
]


def judged(url, rules):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    host = host.translate(LOWER)
    fits = [(len(h + (p or "")), len(h), h + (p or ""), v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("max_bytes", [urls.MAX_BYTES, 0])
def test_urls_against_brute_force(spark, max_bytes):
    """Shipped as a file and joined, with kept columns of odd names."""
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumns({"a.b": F.lit(1), "key": F.lit(2)})
    known = urls.build(spark.createDataFrame(RULES, "host string, path string, verdict string"), max_bytes=max_bytes)
    assert (known.name is None) == (max_bytes == 0)
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, known, ["page_id", "a.b", "key"]).collect()}
    assert found == {i: judged(u, RULES) for i, u in enumerate(URLS)}
    kept = urls.allowed(pages, known)
    assert kept.columns == pages.columns
    assert {r["page_id"] for r in kept.collect()} == {i for i, u in enumerate(URLS) if judged(u, RULES)[3] == "allow"}


@pytest.mark.parametrize("max_bytes", [urls.MAX_BYTES, 0])
def test_many_rules(spark, max_bytes):
    rng = random.Random(1)
    name = lambda: ".".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
    rules = list({(h, p): (h, p, v) for h, p, v in ((name(), "".join("/" + rng.choice("xy") for _ in range(rng.randint(0, 3))), rng.choice(["allow", "block"])) for _ in range(80))}.values())
    pages = [f"http://{name()}.{name()}{''.join('/' + rng.choice('xyz') for _ in range(rng.randint(0, 4)))}" for _ in range(300)]
    known = urls.build(spark.createDataFrame(rules, "host string, path string, verdict string"), max_bytes=max_bytes)
    found = urls.judge(spark.createDataFrame(list(enumerate(pages)), "page_id long, url string"), known, ["page_id"]).collect()
    for r in found:
        host, path, rule, verdict = judged(pages[r["page_id"]], rules)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_equal_digests_are_told_apart(tmp_path):
    """Three strings of one digest: each is found, and another string of that digest is not."""
    keys = [b"a.com/", b"b.com/", b"c.com/", b"d.com/"]
    path = tmp_path / "list"
    path.write_bytes(urls._file(np.array([-5, 7, 7, 7]), np.array([0, 1, 0, 1]), keys))
    held = urls.Mapped(str(path))
    met, place = held.probe(np.array([7, 6, -5, 8]))
    assert met.tolist() == [0, 2] and place.tolist() == [1, 0]
    assert [held.confirmed(1, 7, k) for k in (b"b.com/", b"c.com/", b"d.com/", b"a.com/", b"x")] == [1, 2, 3, -1, -1]


def test_url_lists_that_are_odd(spark):
    pages = spark.createDataFrame([(1, "http://x.com/a")], "page_id long, url string")
    none = urls.build(spark.createDataFrame([], "host string, path string, verdict string"))
    assert [tuple(r) for r in urls.judge(pages, none, ["page_id"], default="block").collect()] == [(1, "x.com", "/a", None, "block")]
    twice = urls.build(spark.createDataFrame([("x.com", "/", "block"), ("X.com", "/", "allow")], "host string, path string, verdict string"))
    assert twice.count == 1 and urls.judge(pages, twice, ["page_id"]).first()["verdict"] == "block"
    assert urls.judge(pages.limit(0), twice, ["page_id"]).count() == 0
    for rule in [(None, "/", "block"), ("", "/", "block"), ("x", "a", "block"), ("x", "/", "maybe")]:
        with pytest.raises(ValueError):
            urls.build(spark.createDataFrame([rule], "host string, path string, verdict string"))
    with pytest.raises(ValueError):
        urls.judge(pages.withColumn("rule", F.lit(1)), twice, ["rule"])


def test_common_keys_are_looked_up_apart(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.col("id")).when(F.col("id") % 3 == 1, F.lit(-1)).alias("k"), "id")
    table = spark.range(-1, 6000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = sorted((r["k"], r["id"], r["v"]) for r in lookup(rows, "k", table).collect())
    assert got == sorted([(i, i, 2 * i) for i in range(0, 6000, 3)] + [(-1, i, -2) for i in range(1, 9000, 3)])


# ---- importance resampling ---------------------------------------------------------------------------------------------------

def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[i:i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def resampled(rows, items, share):
    known = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in known for b in f), Counter(b for x in items for b in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    out = []
    for i, n, f in known:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    order = sorted((x for x in out if x[2] >= 20), key=lambda x: (-x[4], x[0] is not None, x[0]))
    for k, x in enumerate(order[:int(share * len(order) // 100)]):
        x[5] = k + 1
    return out


def sample_rows(n):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "ß", "naïve", "A1", "🙂"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [*enumerate(texts), (n, None), (n + 1, ""), (n + 2, "w1 w2. W3!\nw1"), (None, texts[0] + " w1" * 30), (5, texts[5]), (5, texts[5]), (n + 3, "w7 w8 w9 " * 40_000)]


@pytest.mark.parametrize("share", [5, 40, 100])
def test_resampling_against_brute_force(spark, share):
    rows, items = sample_rows(150), ["w1 w2 w3 w4", None, "w5 É", ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("words", "buckets", "score", "a.b")})
    target = spark.createDataFrame([(x,) for x in items], "text string")
    got = [tuple(r) for r in importance.resample(docs, target, share).collect()]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(got, key=key) == sorted(map(tuple, resampled(rows, items, share)), key=key)
    drawn = {r[0] for r in got if r[5]}
    assert {r["doc_id"] for r in importance.selected(docs, target, share).collect()} == drawn


def test_resampling_of_nothing(spark):
    docs, target = spark.createDataFrame(sample_rows(30), "doc_id long, text string"), spark.createDataFrame([("w1",)], "text string")
    assert importance.resample(docs.limit(0), target).count() == 0
    whole = importance.resample(docs, target.limit(0), 50).collect()
    assert len(whole) == docs.count() and max(r["rank"] or 0 for r in whole) > 0
    assert all(r["rank"] is None for r in importance.resample(docs, target, 0).collect())


def test_resampling_prefers_the_target(spark):
    """A corpus of two kinds, a target of one: what is drawn is of that kind."""
    rng = random.Random(8)
    kind = lambda c: " ".join(f"{c}{rng.randint(0, 30)}" for _ in range(60))
    docs = spark.createDataFrame([(i, kind("a" if i % 10 == 0 else "b")) for i in range(400)], "doc_id long, text string")
    target = spark.createDataFrame([(kind("a"),) for _ in range(20)], "text string")
    drawn = importance.selected(docs, target, 8).select("doc_id").collect()
    assert len(drawn) == 32 and all(r[0] % 10 == 0 for r in drawn)


# ---- prefix trie -------------------------------------------------------------------------------------------------------------

def ordered(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest(), role, text))
    return {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}


def rebuild(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    return out


def nodes_of(conversations):
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, who in members.items():
        below = [k for k in members if k[:len(key)] == key]
        children = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if not any(len(m) == len(k) + 1 and m[:len(k)] == k for m in below)]
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        ends = ",".join(str(c) for c in sorted(who) if len(conversations[c]) == len(key))
        out.append((min(who), len(key), min(members[key[:-1]]) if key else None, len(who), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(60):
        for turn in range(rng.choice([0, 1, 2, 3, 8, 12])):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "é", "long 🙂 text"]) if turn < 3 else f"own {c % 7}"))
    rows += [(77, t, "user", "again") for t in range(40)] + [(78, t, "user", "again") for t in range(33)]  # deep
    rows += [(81, None, None, None), (81, None, "user", None), (81, 0, None, "x"), (81, 0, None, "x"), (82, 3, "u", ""), (82, 3, "u", ""), (None, 0, "user", "lost"), (9007199254740993, 0, "user", "a")]
    rng.shuffle(rows)
    return rows


def key_of(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


@pytest.mark.parametrize("seed", [0, 1])
def test_trie_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "PACK", 4)
    rows = conversations(seed)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("key", "depth", "_part", "a.b")})
    whole = ordered(rows)
    got = [tuple(r) for r in trie.shared_prefixes(frame).collect()]
    assert sorted(got, key=key_of) == sorted(nodes_of(whole), key=key_of)
    got = [tuple(r) for r in trie.shared_prefixes_of_rebuilt(frame).collect()]
    assert sorted(got, key=key_of) == sorted(nodes_of(rebuild(whole)), key=key_of)


def test_trie_of_one_conversation_and_of_many_equal_ones(spark):
    """A conversation that fills several ranges, and 300 equal ones whose ends fill several packs."""
    long = spark.range(700).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), (F.col("id") % 3).cast("string").alias("text"))
    got = {r["depth"]: r for r in trie.shared_prefixes(long).collect()}
    assert sorted(got) == list(range(701)) and all(r["n_convs"] == r["n_leaves"] == 1 and r["saved_tokens"] == 0 for r in got.values())
    equal = spark.range(3000).select((F.col("id") % 1000).alias("conv_id"), F.floor(F.col("id") / 1000).alias("turn"), F.lit("user").alias("role"), F.lit("abc").alias("text"))
    got = {r["depth"]: r for r in trie.shared_prefixes(equal).collect()}
    assert sorted(got) == [0, 1, 2, 3] and [got[d]["saved_tokens"] for d in range(4)] == [3 * 3 * 999, 3 * 3 * 999, 2 * 3 * 999, 3 * 999]
    assert got[3]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(1000))).encode()).hexdigest()


def test_trie_of_nothing(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.shared_prefixes_of_rebuilt(frame).count() == 0
    lost = spark.createDataFrame([(None, 0, "user", "x")], frame.schema)
    assert trie.shared_prefixes(lost).count() == 0
