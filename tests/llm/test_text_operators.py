"""Licenses, quality, tokens, language model, personal data, chats and the pipeline against plain forms."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from pixelmill.llm import bpe, chat, licenses, lm, pii, quality

PATH = P.path("byte_bpe_multi_50k.tiktoken")
LOWER = {i: i + 32 for i in range(65, 91)}
ODD = [None, "", " \n\t ", "x", "É中🙂 \x1c\x85", "long word " * 20_000, "same", "same"]


def frame(spark, texts):
    """Documents with columns whose names clash with what operators could call their own."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_row", "_score", "words", "row", "kind")})


# ---- licenses ---------------------------------------------------------------------------------------------------------------

def test_alignment():
    assert licenses.longest_increasing([(0, 5), (1, 1), (2, 2), (3, 9), (4, 3)]) == [(1, 1), (2, 2), (4, 3)]
    a, b = "x a b c d e y".split(), "a b z d e".split()
    assert licenses.align(a, b) == [(1, 0), (2, 1), (4, 3), (5, 4)]
    assert licenses.align([], b) == [] and licenses.align(b, b) == [(i, i) for i in range(5)]
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (rng.choice(list("abcdefgh"), 20).tolist() for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def common_length(a, b):
    """Length of a longest common subsequence, by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        row, old = [0], row
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(old[j + 1], row[-1]))
    return row[-1]


def test_alignment_against_brute_force():
    """Never longer than a longest common subsequence, and as long where each word is unique."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = (rng.permutation(30)[:int(rng.integers(0, 30))].tolist() for _ in range(2))
        assert len(licenses.align(a, b)) == common_length(a, b)
        a, b = (rng.integers(0, 9, 25).tolist() for _ in range(2))
        assert len(licenses.align(a, b)) <= common_length(a, b)


def test_all_copies_against_brute_force():
    """Copies with words left out and put in, among other words: each is found at its place with its coverage, and the best
    coverage is that of the best window."""
    rng = np.random.default_rng(6)
    templates = {name: " ".join(f"{name}{i}" for i in range(n)) for name, n in (("a", 5), ("b", 20), ("c", 60))}
    scanner = licenses.Scanner(templates)
    for _ in range(25):
        words, want = [], []
        for _ in range(int(rng.integers(0, 7))):
            words += [f"x{i}" for i in rng.integers(0, 50, int(rng.integers(0, 30)))]
            name = str(rng.choice(list(templates)))
            whole = templates[name].split()
            out = set(rng.choice(len(whole), int(rng.integers(0, len(whole) // 5 + 1)), replace=False).tolist())
            copy = [w for i, w in enumerate(whole) if i not in out]
            at = len(copy) // 2
            copy[at:at] = ["y"] * int(rng.integers(0, 3))
            want.append((name, len(whole) - len(out), len(words), len(words) + len(copy)))
            words += copy + ["z"]
        got = [(n, round(c * len(templates[n].split())), f, e) for n, c, f, e in scanner.copies(" ".join(words))]
        assert got == sorted(want, key=lambda c: (c[0], c[2]))
        best, _ = scanner.scan(" ".join(words))
        for name, coverage, _, _ in best:
            t = templates[name].split()
            windows = (words[i:i + len(t) + 2] for i in range(len(words)))
            assert coverage == pytest.approx(max(common_length(w, t) for w in windows) / len(t))


def test_templates_from_a_table(spark):
    words = [" ".join(f"t{n}w{i}" for i in range(30)) for n in range(3)]
    table = spark.createDataFrame([(f"lic{n}", w) for n, w in enumerate(words)] + [("empty", " "), ("none", None)], "license string, text string")
    templates = licenses.load_templates(table)
    assert templates == {f"lic{n}": w for n, w in enumerate(words)}
    docs = frame(spark, ["head " + words[1] + " tail " + words[2], words[0].replace("t0w3 ", ""), "nothing"])
    found = {r["doc_id"]: (r["license"], sorted(r["licenses"])) for r in licenses.scan(docs, ["doc_id"], templates).collect()}
    assert found == {0: ("lic1", ["lic1", "lic2"]), 1: ("lic0", ["lic0"]), 2: (None, [])}
    assert licenses.load_templates(table.limit(0)) == {}
    for bad in (table.union(table.limit(1)), table.withColumn("license", F.lit(None).cast("string"))):
        with pytest.raises(ValueError):
            licenses.load_templates(bad)
    with pytest.raises(ValueError):
        licenses.load_templates(table, max_bytes=10)


def test_license_scan(spark):
    rng = np.random.default_rng(1)
    filler = " ".join(rng.choice(["lorem", "ipsum", "the", "license", "of"], 300))
    texts = ODD + [f"{filler} {licenses.TEMPLATES['MIT-text']} {filler}", f"Licensed under CC BY-NC 4.0.\n{filler}\nLicensed under CC BY-NC 4.0.", filler]
    words = licenses.TEMPLATES["ISC-text"].split()
    texts.append(" ".join(w for i, w in enumerate(words) if i % 12))
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, texts), ["doc_id"]).collect()}
    n = len(ODD)
    assert all(got[i]["license"] is None and got[i]["coverage"] == 0 for i in range(n))
    assert (got[n]["license"], got[n]["coverage"]) == ("MIT-text", 1.0) and got[n]["first_word"] == 300
    assert (got[n + 1]["license"], got[n + 1]["coverage"]) == ("CC-BY-NC-4.0", 1.0)
    assert [(c["license"], c["first_word"]) for c in got[n + 1]["copies"]] == [("CC-BY-NC-4.0", 0), ("CC-BY-NC-4.0", 305)]
    with pytest.raises(ValueError):
        licenses.scan(frame(spark, texts).withColumnRenamed("kind", "License"), ["License"])
    assert got[n + 2]["license"] is None and got[n + 3]["license"] == "ISC-text" and 0.85 < got[n + 3]["coverage"] < 1
    assert licenses.scan(frame(spark, texts).limit(0), ["doc_id"]).count() == 0


# ---- quality -----------------------------------------------------------------------------------------------------------------

def test_chunks_cover_everything():
    for n in (0, 1, 255, 256, 257, 496, 497, 1000, 5000):
        text = np.random.default_rng(n).integers(1, 256, n).astype(np.uint8).tobytes()
        chunks = quality.chunks_of(text)
        assert chunks.shape[1] == quality.CHUNK
        place, seen = 0, b""
        for chunk in map(bytes, chunks):  # each chunk stands in the text, and none leaves a hole behind it
            place = text.index(chunk, place) if n >= quality.CHUNK else 0
            assert place <= len(seen)
            seen = text[:place + quality.CHUNK]
        assert seen == text


def plain_logit(net, text):
    """The mean over chunks of the linear layer over rectified maxima, filter by filter and place by place."""
    total = []
    for chunk in quality.chunks_of(text):
        hidden = []
        for f in range(quality.FILTERS):
            places = range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)
            best = max(sum(float(net.table[j, chunk[p + j], f]) for j in range(quality.WIDTH)) for p in places)
            hidden.append(max(0.0, best + float(net.bias[f])))
        total.append(sum(h * float(w) for h, w in zip(hidden, net.weight)) + float(net.base[0]))
    return sum(total) / len(total)


def test_scores_are_those_of_a_plain_network():
    rng = np.random.default_rng(0)
    net = quality.Net.new(rng)
    texts = [b"", b"a", b"some words here " * 9, rng.integers(1, 256, 700).astype(np.uint8).tobytes()]
    want = [1 / (1 + math.exp(-plain_logit(net, t))) for t in texts]
    assert net.scores(texts) == pytest.approx(want, rel=1e-4)


def test_learning_lowers_the_loss():
    """One step of learning on a batch moves the loss down, as a step along its gradient must."""
    rng = np.random.default_rng(1)
    texts = [bytes(rng.choice(list(b"abcd"), 60).tolist()) if i % 2 else bytes(rng.choice(list(b"cdef"), 60).tolist()) for i in range(80)]
    labels = np.array([float(i % 2) for i in range(80)])
    net = quality.train(texts, labels)
    p = net.scores(texts)
    assert -np.mean(np.log(np.where(labels == 1, p, 1 - p))) < 0.2


def test_quality(spark):
    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "gamma", "delta", "and", "of"]
    make = lambda good: " ".join(w if good else w.upper() + "###" for w in rng.choice(words, int(rng.integers(5, 120))))
    y = [i % 3 != 0 for i in range(300)]
    texts = [make(v) for v in y]
    docs = frame(spark, texts + ODD)
    labels = spark.createDataFrame([(i, int(v), 0) for i, v in enumerate(y)] + [(9999, None, 0)], "doc_id long, quality int, toxic int")
    net = quality.fit(docs, labels)
    name = "quality_score"
    got = {r["doc_id"]: r[name] for r in quality.score(docs, net, name=name).collect()}
    held = [r[0] for r in labels.where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 and quality is not null").select("doc_id").collect()]
    assert len(held) > 20 and np.mean([(got[i] >= 0.7) == y[i] for i in held]) > 0.95
    assert all(0 <= v <= 1 for v in got.values()) and got[300] == got[301]
    kept = quality.keep_good(docs, net)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, v in got.items() if v >= 0.7}
    assert quality.score(docs.limit(0), net).count() == 0
    with pytest.raises(ValueError):
        quality.score(docs, net, name="Words")
    long = spark.createDataFrame([(i, "x" * 40_000) for i in range(8)], "doc_id long, text string")
    drawn, _ = quality.training_rows(long, labels)
    assert drawn and all(len(t) == quality.CHUNK * quality.TRAIN_SPANS for t in drawn)
    flat = quality.fit(docs, labels.where("quality = 1"))
    assert flat.scores([b"x", b""]) == pytest.approx([1.0, 1.0], abs=1e-3)
    none = quality.fit(docs, labels.limit(0))
    assert none.scores([b"x"]) == pytest.approx([0.5], abs=1e-3)


def test_held_out_labels_are_not_learned(spark):
    docs = frame(spark, ["a"] * 40)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    texts, _ = quality.training_rows(docs, labels)
    free = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2").count()
    assert len(texts) == free < 40


# ---- tokens -------------------------------------------------------------------------------------------------------------------

def test_tokens_as_the_library(spark):
    ranks = bpe.load_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    find = bpe.finder(P.PATTERN)
    rng = np.random.default_rng(1)
    alphabet = list("aab'sre tll \n\t  \x85\x1c\x1fé中1２²Ⅷ!?_-$'d🙂𝟗")
    texts = ["".join(rng.choice(alphabet, int(n))) for n in rng.integers(0, 250, 300)] + ["a" * 500 + " " * 300 + "b", "'ll" * 50, " '" * 90]
    base = bpe.Codec(ranks, find)
    for chunk, overlap in ((1 << 16, 1 << 10), (16, 8), (9, 4), (40, 5)):
        codec = bpe.Codec(ranks, find, chunk, overlap)
        codec.ids_of = base.ids_of
        for t in texts:
            ids = codec.encode(t)
            assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
            assert codec.decode(ids) == t.encode()
            starts = range(0, max(1, len(t) - overlap), chunk)
            parts = [(t[s:] if s == starts[-1] else t[s:s + chunk], *codec.chunk_of(t[s:s + chunk + overlap], s == starts[-1])) for s in starts]
            assert codec.stitched(parts) == ids
    docs = frame(spark, ODD)
    got = {r["doc_id"]: r for r in bpe.digests(docs, PATH, P.PATTERN, ["doc_id", "words"]).collect()}
    for i, t in enumerate(ODD):
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs, PATH, P.PATTERN, ["doc_id"]), PATH, ["doc_id"]).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}
    assert bpe.digests(docs.limit(0), PATH, P.PATTERN, ["doc_id"]).count() == 0


def test_every_code_point_splits_as_in_the_library():
    ranks = bpe.load_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(ranks, bpe.finder(P.PATTERN))
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        text = "".join(f"a{c}a1{c} " for c in points[at:at + 4096])
        assert codec.encode(text) == np.array(library.encode_ordinary(text), "<u4").tobytes(), hex(at)


def test_chunks_of_long_texts_are_rows(spark, monkeypatch):
    """Long texts are cut into rows, encoded apart and stitched; a run without a boundary is gone through in one task."""
    monkeypatch.setattr(bpe, "CHUNK", 40)
    monkeypatch.setattr(bpe, "OVERLAP", 12)
    ranks = bpe.load_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["one", "Straße", "12", "don't", "??", "\n\n", "🙂"], int(n))) for n in rng.integers(0, 90, 60)] + ["x" * 500, "a b " * 40 + "y" * 200 + " c" * 50, None]
    docs = frame(spark, texts)
    got = {r["doc_id"]: r for r in bpe.encode(docs, PATH, P.PATTERN, ["doc_id", "words"]).collect()}
    assert len(got) == len(texts) and all(got[i]["ids"] == library.encode_ordinary(t or "") for i, t in enumerate(texts))
    assert {r["doc_id"] for r in bpe.digests(docs, PATH, P.PATTERN, ["doc_id"]).collect()} == set(range(len(texts)))


# ---- language model --------------------------------------------------------------------------------------------------------------

def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + ["\n"]


def plain_contexts(texts):
    """Next bytes and counts of the contexts that pass the divergence test and of their suffixes, by plain counting."""
    seen = {}
    for x in texts:
        data = b"\n" * lm.DEPTH + " ".join(tokens(x)[:-1]).encode() + b"\n"
        for i in range(lm.DEPTH, len(data)):
            for k in range(lm.DEPTH + 1):
                seen.setdefault(data[i - k:i], Counter())[data[i]] += 1
    kept = {b""}
    for context, following in seen.items():
        n, parent = sum(following.values()), seen[context[1:]]
        bits = sum(c * math.log2(c / n / (parent[s] / sum(parent.values()))) for s, c in following.items())
        if context and n >= lm.LEAST and bits >= lm.GAIN:
            kept |= {context[i:] for i in range(len(context))}
    return {c: dict(seen[c]) for c in kept}


def plain_score(counts, text):
    """Probability by looking for the longest retained suffix at each symbol, smoothed down to the empty context."""
    data = ("\n" * lm.DEPTH + " ".join(tokens(text)[:-1]) + "\n").encode()
    total = sum(counts[b""].values())

    def p(context, s):
        if not context:
            return (counts[b""].get(s, 0) + 1) / (total + 257)
        own = counts[context]
        return (own.get(s, 0) + len(own) * p(context[1:], s)) / (sum(own.values()) + len(own))

    out = 0.0
    for i in range(lm.DEPTH, len(data)):
        context = next(data[j:i] for j in range(i - lm.DEPTH, i + 1) if data[j:i] in counts)
        out += math.log10(p(context, data[i]))
    return out


def test_language_model(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["The", "cat", "sat", "on", "mats", "today", "ünd"], int(n))) for n in rng.integers(0, 60, 80)]
    train, other = texts[:60], texts[60:] + ODD + ["unseen Words here here"]
    model = lm.fit(frame(spark, train))
    got = {r["doc_id"]: r for r in lm.score(frame(spark, other), model, ["doc_id", "words"]).collect()}
    c = Counter(t for x in train for t in tokens(x))
    assert (model.tokens, model.kinds) == (sum(c.values()), len(c))
    counts = plain_contexts(train)
    assert len(counts) > 20 and lm.contexts(lm.corpus_counts(frame(spark, train).repartition(3), F.col("text"))) == counts
    for i, t in enumerate(other):
        w = tokens(t)
        assert got[i]["n_tokens"] == len(w) and got[i]["n_known"] == sum(c[x] > 0 for x in w)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (model.tokens + model.kinds + 1)) for x in w))
        if len(w) < 1000:
            assert got[i]["score"] == pytest.approx(plain_score(counts, t), rel=1e-5)
    flat = lm.Automaton.build({b"": counts[b""]}).scores([lm.words_of(t.encode()) for t in other[:len(texts) - 60]])
    assert sum(got[i]["score"] for i in range(len(texts) - 60)) > 0.6 * flat.sum()  # contexts save much
    tree = model.automaton
    for context in list(counts)[:200]:
        whole = (b"\n" * lm.DEPTH + context)[-lm.DEPTH:][::-1]
        every = np.array([int.from_bytes(whole + bytes([b]), "big") for b in range(256)], np.uint64)
        assert tree.p(every).sum() < 1 + 1e-5


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_contexts_stream(rows):
    """Sorted grams in chunks of any size give the tree of all of them, with what is left for the shorter contexts."""
    rng = np.random.default_rng(rows)
    words = [bytes(rng.choice(list(b"abcde"), 5).tolist()) for _ in range(40)]
    codes, _ = lm.coded([[words[i] for i in rng.integers(0, 40, 300)] for _ in range(6)])
    codes = np.sort(codes)
    chunks = [(codes[i:i + rows], np.ones(len(codes[i:i + rows]), np.int64), np.zeros(len(codes[i:i + rows]), bool)) for i in range(0, len(codes), rows)]
    got = {}
    for length, (c, n, _) in lm.judged(iter(chunks), lm.DEPTH, 1):
        for g, x in zip(c.tolist(), n.tolist()):
            assert (length, g) not in got
            got[length, g] = x
    all_at_once = [(codes, np.ones(len(codes), np.int64), np.zeros(len(codes), bool))]
    want = {(length, g): x for length, (c, n, _) in lm.judged(iter(all_at_once), lm.DEPTH, 1) for g, x in zip(c.tolist(), n.tolist())}
    assert got == want and len(got) > 300


def test_memory_of_grams():
    rng = np.random.default_rng(0)
    memo = lm.Memo(1 << 10)  # far too small
    codes = np.unique(rng.integers(0, 1 << 56, 5000, dtype=np.uint64))
    memo.put(codes, (codes % np.uint64(1000)).astype(np.float32))
    out = np.empty(len(codes), np.float32)
    left = memo.get(codes, out)
    known = np.setdiff1d(np.arange(len(codes)), left)
    assert len(known) > 800 and (out[known] == (codes[known] % np.uint64(1000))).all()


def test_language_model_rare_words(spark, monkeypatch):
    monkeypatch.setattr(lm, "DICTIONARY", 2)
    train = ["a a a b c"] * 5 + ["b d"]
    model = lm.fit(frame(spark, train))
    assert len(model.dictionary) <= 3
    r = lm.score(frame(spark, ["a d d zz"]), model, ["doc_id"]).first()
    c = Counter(t for x in train for t in tokens(x))
    assert r["n_known"] == 4 and r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (model.tokens + model.kinds + 1)) for x in tokens("a d d zz")))
    empty = lm.fit(frame(spark, ["x"]).limit(0))
    assert empty.tokens == 0 and lm.score(frame(spark, ["x"]), empty, ["doc_id"]).first()["n_known"] == 0


def test_language_model_keeps_every_context(spark, monkeypatch):
    """More contexts than any fixed number, and rare ones however large the corpus; parts score like the whole tree."""
    pairs = [(a, b) for a in range(60, 200) for b in range(60, 200)]
    rows = [((b << 48) | (a << 40) | 60 + (a * 31 + b * 17) % 140, 25) for a, b in pairs] + [((1 << 48) | (1 << 40) | 1, 400_000_000)]
    found = lm.contexts(spark.createDataFrame(rows, "gram long, n long").withColumn("word", F.lit(None).cast("binary")))
    assert all(bytes(p) in found for p in pairs)
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["The", "cat", "sat", "on", "mats", "today", "ünd"], int(n))) for n in rng.integers(0, 60, 60)] + ODD[:4]
    whole = lm.fit(frame(spark, texts))
    monkeypatch.setattr(lm, "PART_ROWS", 10)
    cut = lm.fit(frame(spark, texts))
    assert whole.parts == [None] and len(cut.parts) > 2
    a, b = ({r["doc_id"]: r for r in lm.score(frame(spark, texts), m, ["doc_id"]).collect()} for m in (whole, cut))
    for i in range(len(texts)):
        assert a[i]["score"] == pytest.approx(b[i]["score"], rel=1e-9) and a[i][:4] == b[i][:4]


# ---- personal data -----------------------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if good(k, m[0])]


def test_base_spans(spark):
    rng = np.random.default_rng(6)
    bits = ["a@b.c", "x.y@z", "_d@e.f-g.h", "@", ".", " ", "-", "1.2.3.4", "256.1.1.1", "0001.2.3.255.7", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "+1 (555) 010-9999", "+", "(", "é🙂", "\x01", "9", "12", "\n", "+49 30 123456"]
    texts = ["".join(rng.choice(bits, int(n))) for n in rng.integers(0, 14, 400)]
    texts += ODD + ["7" * 50_000, "a" * 60_000, "a." * 30_000 + "@b", "x@" + "a." * 30_000 + "b", "1 " * 30_000, "1.2.3.4 " * 500, "+1" * 9_000]
    got = {r["doc_id"]: r for r in pii.summary(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (t[:80], got[i]["spans"][:200], want[:5])
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]
        assert set(want) <= set(got[i]["spans"].split(",")) | {""}
    assert pii.summary(frame(spark, texts).limit(0)).count() == 0


def test_patterns_find_what_base_ones_miss(spark):
    seeds = [f"call hotline: +1 (555) 010-99{i:02d} now" for i in range(6)]
    texts = seeds + ["call hotline: (555) 010-1234 now", "elsewhere (555) 010-1234 too", "the number 12 34 56 78 90 of", *["the +1 (555) 010-7777"] * 3, *["the end of the day"] * 50]
    docs = frame(spark, texts)
    got = {r["doc_id"]: r for r in pii.summary(docs).collect()}
    assert got[6]["spans"] == "phone:14:28" and got[7]["spans"] == "phone:10:24" and got[6]["n_phone"] == 0 and got[8]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[6] == "call hotline: <PHONE> now" and clean[0] == "call hotline: <PHONE> now" and clean[8] == texts[8]
    assert pii.redact(docs).columns == docs.columns


def test_later_patterns_find_more(spark):
    """Values found behind a first pattern make a second one, those behind it a third and so on, till nothing is added."""
    steps = ["first", "second", "third", "fourth", "fifth", "sixth"]
    loose = [[f"(555) 0{i}0-12{j:02d}" for j in range(3)] for i in range(len(steps))]
    texts = [f"first +1 (555) 910-99{i:02d} now" for i in range(6)]
    for i, word in enumerate(steps):
        texts += [f"{word} {x} now" for x in loose[i]]
        if i:
            texts += [f"{word} {x} now" for x in loose[i - 1]]
    got = {r["doc_id"]: r["spans"] for r in pii.summary(frame(spark, texts)).collect()}
    assert all(got[i].startswith("phone:") for i in range(len(texts))), got


def test_patterns_may_touch(spark):
    """A pattern without a blank before the entity counts where longer words begin with it."""
    texts = [f"x tel:+49 30 1234{i:02d} y" for i in range(6)] + [f"see mail:a{i}@b.c, +49 30 9999{i:02d} too" for i in range(4)]
    texts += ["x tel:(555) 010-1234 y", "see mail:e (at) b.c too", "x of(555) 010-4321 z", *[f"of+49 30 7777{i:02d}" for i in range(3)], *["often offered"] * 9]
    got = {r["doc_id"]: r["spans"] for r in pii.summary(frame(spark, texts)).collect()}
    assert got[10] == "phone:6:20" and got[11] == "email:9:19" and got[12] == ""


def test_what_follows_is_a_pattern_too(spark):
    texts = [f"w{i} +49 30 1234{i:02d} (direct line)" for i in range(5)] + [f"u{i} a{i}@b.cd/home" for i in range(4)]
    texts += ["v (555) 010-1234 (direct line)", "v e (at) b.cd/home", "v (555) 010-4321 elsewhere"]
    docs = frame(spark, texts).withColumnsRenamed({"kind": "base_email", "row": "_base_ip", "words": "_extra"})
    got = {r["doc_id"]: r["spans"] for r in pii.summary(docs).collect()}
    assert [got[i] for i in range(9, 12)] == ["phone:2:16", "email:2:13", ""]
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and {r["doc_id"]: r["text"] for r in clean.collect()}[9] == "v <PHONE> (direct line)"
    assert {r["base_email"] for r in clean.collect()} == {1}


def test_cards_and_addresses_are_discovered(spark):
    """Loose cards and addresses behind a confident pattern are found; without one, or with wrong digits, they are not."""
    cards = ["4111 1111 1111 1111", "5500 0000 0000 0004", "4012 8888 8888 1881", "4222 2222 2222 2222"]
    texts = [f"paid with {c} today" for c in cards[:3]] + [f"server 10.0.0.{i} is up" for i in range(3)]
    texts += ["paid with 4111  1111  1111  1111 today", "paid with 4012.8888.8888.1881 today", "paid with 4012.8888.8888.1882 today"]
    texts += ["server 2001:db8::ff00:42:8329 is up", "server 10 . 0 . 0 . 77 is up", "server 10[.]0[.]0[.]78 is up", "server 1:2:3:4:5:6:7:8 is up", "server 12:30:45 is up", "at fe80::1 or 4222/2222/2222/2222"]
    got = {r["doc_id"]: r["spans"] for r in pii.summary(frame(spark, texts + ["1  " * 30_000, "1:" * 30_000, "1 . " * 2_000, *(f"server 10.0.1.{i} is up" for i in range(4))])).collect()}
    assert got[6] == "card:10:32" and got[7] == "card:10:29" and "card" not in got[8]
    assert [got[i] for i in range(9, 13)] == ["ip:7:29", "ip:7:22", "ip:7:22", "ip:7:22"]
    assert "ip" not in got[13] and got[14] == ""


def test_redaction_merges_overlaps(spark):
    texts = [None, "", "mail a@b.cd or 1.2.3.4, card 4111 1111 1111 1111.", "é +1 555 010 9999 é"]
    got = [r["text"] for r in pii.redact(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == [None, "", "mail <EMAIL> or <IP>, card <CARD>.", "é <PHONE> é"]


# ---- chats -------------------------------------------------------------------------------------------------------------------------

def test_chat_round_trip(spark):
    rng = np.random.default_rng(2)
    bits = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<|", "|>", "<|/|>", "\\", "<", "[", "/", "a", "é", "\n", "s>", "INST]"]
    text = lambda: "".join(rng.choice(bits, int(rng.integers(0, 9))))
    rows = [(c, t, r, text()) for c in range(40) for t, r in enumerate(rng.choice(["user", "assistant", "system", "tool", "/", "a|>b"], int(rng.integers(1, 7))))]
    rows += [(100, 0, "user", "q"), (100, 1, "assistant", "r"), (101, 0, None, None), (102, 1, "user", "b"), (102, 1, "assistant", "a"), (None, 0, "user", "x"), (103, 0, "user", "z" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"position": F.lit(1), "ok": F.lit(2)})
    parts = chat.segments(df)
    got = {r["conv_id"]: r for r in chat.read_back(parts).collect()}
    want = {}
    for c, t, r, x in sorted(rows, key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2] or "", v[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[100]["ordered"] and not got[101]["ordered"] and not got[103]["ordered"]
    assert sum(len(r["text"]) for r in parts.where("conv_id = 100").collect()) == got[100]["formatted_chars"]
    assert chat.read_back(chat.segments(df.limit(0))).count() == 0


def test_escaping_is_reversible():
    w = chat.Writer(chat.Template())
    rng = np.random.default_rng(0)
    bits = w.t.controls() + ["\\", "<", "[", "/", "s", ">", "I"]
    for _ in range(3000):
        t = "".join(rng.choice(bits, int(rng.integers(0, 8))))
        e = w.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in w.t.controls())


# ---- row numbers -----------------------------------------------------------------------------------------------------------------

def test_row_numbers_outlive_another_split(spark, tmp_path, monkeypatch):
    """Decisions by row number hold when later scans of the same files are split in another way."""
    from pixelmill.llm import common, decontam, simhash

    rng = np.random.default_rng(4)
    words = lambda: " ".join("".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(30))
    item = words()
    texts = [words() for _ in range(24)]
    texts += [texts[3], texts[11], item, *(f"call hotline: +1 (555) 010-99{i:02d} now" for i in range(6)), "call hotline: (555) 010-1234 now"]
    frame(spark, texts).repartition(8, "doc_id").write.parquet(str(tmp_path / "docs"))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")

    def spool(df):
        out = common.spool(df)
        spark.conf.set(key, "1g")  # from now on all files make few partitions
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        return out

    def run(step):
        spark.conf.set(key, "1k")
        return {r["doc_id"]: r["text"] for r in step(spark.read.parquet(str(tmp_path / "docs"))).collect()}

    for module in (simhash, decontam, pii):
        monkeypatch.setattr(module, "spool", spool)
    try:
        kept = run(simhash.keep_one)
        assert set(range(len(texts))) - set(kept) >= {24, 25} and set(range(24)) <= set(kept)
        assert set(run(lambda d: decontam.decontaminate(d, items))) == set(range(len(texts))) - {26}
        clean = run(pii.redact)
        assert clean[len(texts) - 1] == "call hotline: <PHONE> now" and all(clean[i] == texts[i] for i in range(27))
    finally:
        spark.conf.set(key, before)
        spark.conf.unset("spark.sql.files.minPartitionNum")


# ---- pipeline ------------------------------------------------------------------------------------------------------------------------

def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from pixelmill.llm import decontam, simhash

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, kept = docs.columns, docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = kept
        stage(spark, before, data).write.parquet(str(tmp_path / str(i)))
        kept = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert kept.columns == columns, name
        if name == "quality classifier":
            assert 0.5 * before.count() < kept.count() <= before.count()
        if name == "SimHash near-dedup":
            found = simhash.near_duplicates(before)
            assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in found.select("component_id").distinct().collect()}
        if name == "benchmark decontamination":
            hits = decontam.find_hits(before, spark.read.parquet(f"{data}/benchmark.parquet")).where("not (n_hit > 0 and 20 * n_hit >= n_words)")
            assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in hits.select("id").collect()}
        if name == "PII":
            assert kept.count() == before.count() and not any(base_spans(r["text"]) for r in kept.collect())
    final = corpus_pipeline.run(spark, data)
    assert sorted(map(tuple, final.collect())) == sorted(map(tuple, kept.collect()))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "3")).collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in final.collect())
