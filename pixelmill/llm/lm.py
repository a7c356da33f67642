"""Language-model scoring with a probabilistic suffix tree.

Symbols are the bytes of the lower-cased words, one space between words and one end; that string and the sequence of
tokens determine each other, so the score is the log10 probability of the token sequence.

A gram is DEPTH bytes of context, the latest one first, and the byte behind them.  Grams and words are counted in place
and shuffled once.  In that order all contexts that end alike are neighbours, so the tree is climbed as sorted grams
stream by: a context of LEAST occurrences is retained if its next-symbol distribution diverges from that of its longest
proper suffix by GAIN bits over its occurrences, and so are the suffixes of retained contexts.  No step holds more than
a block of grams and those of one shorter context.  The tree grows with the corpus; nothing caps it.

Distributions are smoothed towards the suffix's one (Witten-Bell), down to an add-one distribution over bytes.  The tree
goes to executors as a file of sorted arrays, which their workers map and share; beyond PART_ROWS rows it is cut by the last two bytes of contexts, which all contexts of a
symbol share, and texts are read once for each part and the sums added.  What grams cost is remembered in a table of
MEMO places; what it has no place for is looked up again.

The base score needs the count of each token.  The words of most counts (at most DICTIONARY of them, broadcast) are
looked up in place, all others by a join, summed per document first.

Defined cases: a null or empty text is one end; rows are scored each for itself, repeated or not; with no training row
N and V are 0 and each byte has probability 1/257; empty tables give empty results; extra columns do not matter, and
a name in `keep` that the result needs raises ValueError.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_BYTES, extended, mapped, require_free, shelved, ship_arrays, spool

#: Most bytes of a context: grams of one more fit into a long.
DEPTH = 6
#: Bits that a context must save over its training occurrences, and how often it must occur.
GAIN, LEAST = 16.0, 8
#: Contexts of more bytes than this are judged where their last SPLIT bytes are together.
SPLIT = 3
#: Rows (next symbols of contexts) of the tree in one file, 12 bytes each.
PART_ROWS = 8_000_000
#: How length, gram and n are packed.
PACKED = ("u1", "u8", "u8")
DICTIONARY = 100_000
#: Bytes of text that are turned into arrays at once, and entries that a task holds before it hands them on.
SLICE, HELD = 1 << 20, 600_000
#: Places (a power of two) for remembered grams, 12 bytes each, and how far from its own place a gram is looked for.
MEMO, PROBES = 1 << 22, 6
END = b"\n"
TOP = np.uint64(8 * DEPTH + 8)
BYTE = np.uint64(8)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER_BYTES).split()


def _slices(texts: Iterator[bytes | None]) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for text in texts:
        held.append(words_of(text))
        size += len(text or b"")
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def coded(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The gram of each symbol of docs, and where each document's begin (DEPTH ends stand before it, one behind it)."""
    parts = [END * DEPTH + b" ".join(words) + END for words in docs]
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(sizes) - sizes
    code = data[DEPTH:].astype(np.uint64)
    for j in range(1, DEPTH + 1):
        code |= data[DEPTH - j:len(data) - j].astype(np.uint64) << (TOP - BYTE * np.uint64(j))
    real = np.ones(len(code), dtype=bool)
    for j in range(DEPTH):  # the ends before later documents are no symbols
        real[starts[1:] + j - DEPTH] = False
    return code[real], starts - DEPTH * np.arange(len(docs))


def _merged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal neighbours added up."""
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.add.reduceat(counts, first)


def _sorted(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    order = np.argsort(codes, kind="stable")
    return _merged(codes[order], counts[order])


def corpus_counts(docs: DataFrame, text: Column) -> DataFrame:
    """word (null for grams), gram (null for words), n: what each task has counted, not yet summed over tasks."""
    names = ["word", "gram", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def emit_words() -> Iterator[pa.RecordBatch]:
            keys = list(words)
            for at in range(0, len(keys), 100_000):
                part = keys[at:at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.nulls(len(part), pa.int64()), pa.array([words[w] for w in part], pa.int64())], names=names)
            words.clear()

        def emit_grams() -> Iterator[pa.RecordBatch]:
            if held:
                codes, counts = _sorted(held)
                held.clear()
                for at in range(0, len(codes), 100_000):
                    part = codes[at:at + 100_000].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.binary()), pa.array(part), pa.array(counts[at:at + 100_000], pa.int64())], names=names)

        for batch in batches:
            for part in _slices(t.as_py() for t in batch.column(0)):
                for w in part:
                    words.update(w)
                words[END] += len(part)
                held.append(np.unique(coded(part)[0], return_counts=True))
                if len(words) > HELD:
                    yield from emit_words()
                if sum(len(c) for c, _ in held) > 4 * HELD:
                    held[:] = [_sorted(held)]
                    if len(held[0][0]) > 3 * HELD:
                        yield from emit_grams()
        yield from emit_words()
        yield from emit_grams()

    return docs.select(text.cast("string").cast("binary").alias("text")).mapInArrow(run, "word binary, gram long, n long")


Grams = tuple[np.ndarray, np.ndarray, np.ndarray]  # codes, counts, and whether a longer context has been retained


def climb(codes: np.ndarray, counts: np.ndarray, needed: np.ndarray) -> tuple[Grams, Grams]:
    """From the sorted grams of contexts of one length, all of a shorter context's together: those of the retained
    contexts, and the grams of the contexts that are one byte shorter."""
    context, following = codes >> BYTE, codes & np.uint64(255)
    first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
    runs = np.diff(np.append(first, len(codes)))
    total = np.add.reduceat(counts, first)
    above, place = np.unique((context >> BYTE << BYTE) | following, return_inverse=True)
    above_n = np.bincount(place, counts).astype(np.int64)
    parents = np.flatnonzero(np.concatenate(([True], above[1:] >> BYTE != above[:-1] >> BYTE)))
    kinds = np.diff(np.append(parents, len(above)))
    above_total = np.repeat(np.add.reduceat(above_n, parents), kinds)
    bits = counts * np.log2(counts / np.repeat(total, runs) * (above_total / above_n)[place])
    keep = (total >= LEAST) & (np.add.reduceat(bits, first) >= GAIN) | np.logical_or.reduceat(needed, first)
    kept = np.repeat(keep, runs)
    wanted = np.zeros(len(above), dtype=bool)
    wanted[place[kept]] = True
    wanted = np.repeat(np.logical_or.reduceat(wanted, parents), kinds)
    return (codes[kept], counts[kept], needed[kept]), (above, above_n, wanted)


def _summed(chunks: Iterator[Grams]) -> Iterator[Grams]:
    """Equal grams of sorted chunks added up."""
    held: Grams | None = None
    for chunk in chunks:
        codes, counts, needed = chunk if held is None else tuple(map(np.concatenate, zip(held, chunk)))
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        codes, counts, needed = codes[first], np.add.reduceat(counts, first), np.logical_or.reduceat(needed, first)
        held = codes[-1:], counts[-1:], needed[-1:]
        if len(codes) > 1:
            yield codes[:-1], counts[:-1], needed[:-1]
    if held is not None:
        yield held


def _level(length: int, chunks: Iterator[Grams], out: list[tuple[int, Grams]]) -> Iterator[Grams]:
    """Judges the contexts of a length in sorted chunks, puts the retained ones into out and yields the next shorter ones."""
    held: Grams | None = None
    for chunk in chunks:
        whole = chunk if held is None else tuple(map(np.concatenate, zip(held, chunk)))
        parent = whole[0] >> np.uint64(16)
        cut = int(np.searchsorted(parent, parent[-1]))  # more of the last shorter context may follow
        held = tuple(x[cut:] for x in whole)
        if cut:
            kept, above = climb(*(x[:cut] for x in whole))
            out.append((length, kept))
            yield above
    if held is not None:
        kept, above = climb(*held)
        out.append((length, kept))
        yield above


def judged(chunks: Iterator[Grams], longest: int, shortest: int) -> Iterator[tuple[int, Grams]]:
    """length and grams of retained contexts, from sorted grams of contexts of `longest` bytes; length 0 for the grams
    of contexts one byte shorter than `shortest`, which are not judged."""
    out: list[tuple[int, Grams]] = []
    chunks = _summed(chunks)
    for length in range(longest, shortest - 1, -1):
        chunks = _level(length, chunks, out)
    for left in chunks:
        yield from out
        out.clear()
        yield 0, left
    yield from out


NAMES = ["length", "word", "gram", "n", "needed"]
KINDS = "length int, word binary, gram long, n long, needed boolean"


def _out(length: int, grams: Grams) -> Iterator[pa.RecordBatch]:
    codes, counts, needed = grams
    for at in range(0, len(codes), 100_000):
        part = codes[at:at + 100_000].astype(np.int64)
        columns = [pa.array(np.full(len(part), length, np.int32)), pa.nulls(len(part), pa.binary()), pa.array(part), pa.array(counts[at:at + 100_000], pa.int64()), pa.array(needed[at:at + 100_000])]
        yield pa.RecordBatch.from_arrays(columns, names=NAMES)


def _gathered(batches: Iterator[tuple[np.ndarray, ...]], rows: int = 300_000) -> Iterator[Grams]:
    held, size = [], 0
    for batch in batches:
        if len(batch[0]):
            held.append(batch)
            size += len(batch[0])
        if size >= rows:
            yield tuple(map(np.concatenate, zip(*held)))
            held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _climbed(longest: int, shortest: int):
    """Sums words and judges contexts of sorted rows (word, gram, n, needed); words come first and get length -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[bytes, int] = {}  # those of the latest hash
        ready: list[pa.RecordBatch] = []
        hashed = None

        def done() -> pa.RecordBatch:
            keys = list(words)
            return pa.RecordBatch.from_arrays([pa.array([-1] * len(keys), pa.int32()), pa.array(keys, pa.binary()), pa.nulls(len(keys), pa.int64()), pa.array([words[k] for k in keys], pa.int64()), pa.nulls(len(keys), pa.bool_())], names=NAMES)

        def grams() -> Iterator[Grams]:
            nonlocal hashed
            for batch in batches:
                key = batch.column(0).to_numpy()
                at = int(np.searchsorted(key, 0))
                if at:
                    for h, w, n in zip(key[:at].tolist(), batch.column(1)[:at].to_pylist(), batch.column(2)[:at].to_pylist()):
                        if h != hashed and len(words) > 10_000:
                            ready.append(done())
                            words.clear()
                        hashed = h
                        words[w] = words.get(w, 0) + n
                if at < len(key):
                    needed = batch.column(3).to_numpy(zero_copy_only=False)[at:].astype(bool)
                    yield key[at:].astype(np.uint64), batch.column(2).to_numpy()[at:], needed
                else:
                    yield np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)

        def steps() -> Iterator[pa.RecordBatch]:
            for length, found in judged(_gathered(grams()), longest, shortest):
                yield from ready
                ready.clear()
                yield from _out(length, found)

        yield from steps()
        yield from ready
        if words:
            yield done()
    return run


def tree(counted: DataFrame) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    """counted: word, gram, n, in any number of rows each.  Returns word, n of all words; length, gram, n of each retained
    context, a gram being the context (latest byte first) and the next byte; and the counts of bytes (the empty context)."""
    spark = counted.sparkSession
    word = -1 - F.xxhash64("word").bitwiseAND(F.lit((1 << 62) - 1))
    keyed = counted.select(F.coalesce("gram", word).alias("key"), "word", "n", F.lit(False).alias("needed"))
    below = F.shiftright("key", 8 * (DEPTH + 1 - SPLIT))
    dealt = keyed.repartition(F.when(F.col("key") < 0, F.col("key")).otherwise(below)).sortWithinPartitions("key", "word")
    found = spool(dealt.mapInArrow(_climbed(DEPTH, SPLIT + 1), KINDS))
    short = found.where("length = 0").select(F.col("gram").alias("key"), "word", "n", "needed")
    short = short.repartition(F.shiftright("key", 8 * SPLIT)).sortWithinPartitions("key")
    less = spool(short.mapInArrow(_climbed(SPLIT, 2), KINDS))
    # contexts of one byte: at most 65,536 grams
    bytes_of = less.where("length = 0").groupBy("gram").agg(F.sum("n").alias("n"), F.max("needed").alias("needed")).orderBy("gram").collect()
    rows, root = found.unionByName(less).where("length > 0").select("length", "gram", "n"), {}
    if bytes_of:
        grams = np.array([r["gram"] for r in bytes_of], np.uint64), np.array([r["n"] for r in bytes_of], np.int64), np.array([r["needed"] for r in bytes_of], bool)
        kept, above = climb(*grams)
        root = dict(zip(above[0].tolist(), above[1].tolist()))
        if len(kept[0]):
            ones = spark.createDataFrame([(1, int(g), int(n)) for g, n in zip(*kept[:2])], "length int, gram long, n long")
            rows = rows.unionByName(ones)
    return found.where("length = -1").select("word", "n"), rows, root


def contexts(counted: DataFrame) -> dict[bytes, dict[int, int]]:
    """Next bytes and their counts of the retained contexts (in the order of the text) and of the empty one, on the driver."""
    _, rows, root = tree(counted)
    out = {b"": root}
    for r in rows.collect():
        context = (r["gram"] >> 8).to_bytes(r["length"], "big")[::-1]
        out.setdefault(context, {})[r["gram"] & 255] = r["n"]
    return out


def _find(table: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where codes stand in the sorted table, and whether they do."""
    at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
    return at, table[at] == codes


class Memo:
    """Remembers numbers by code in a bounded table of open addressing."""

    def __init__(self, places: int):
        self.shift = np.uint64(65 - places.bit_length())
        self.codes = np.full(places + PROBES, np.uint64((1 << 64) - 1))
        self.values = np.zeros(places + PROBES, np.float32)

    def _place(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, codes: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Fills out where codes are known; returns where they are not."""
        place = self._place(codes)
        left = np.flatnonzero(self.codes[place] != codes)
        np.take(self.values, place, out=out)
        for probe in range(1, PROBES):
            if not len(left):
                break
            at = place[left] + probe
            hit = self.codes[at] == codes[left]
            out[left[hit]] = self.values[at[hit]]
            left = left[~hit]
        return left

    def put(self, codes: np.ndarray, values: np.ndarray) -> None:
        place = self._place(codes)
        for probe in range(PROBES):
            at = place + probe
            free = np.flatnonzero(self.codes[at] == np.uint64((1 << 64) - 1))
            self.codes[at[free]] = codes[free]
            mine = self.codes[at] == codes
            self.values[at[mine]] = values[mine]
            codes, values, place = codes[~mine], values[~mine], place[~mine]


@dataclass
class Automaton:
    root: np.ndarray  # byte -> probability behind the empty context
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # by length from 1: contexts, share of the suffix, place of the context and next byte, own share
    tails: np.ndarray | None = None  # of a part: which last two bytes are its own
    memo: Memo | None = field(default=None, repr=False)

    @classmethod
    def of(cls, root: dict[int, int], length: np.ndarray, gram: np.ndarray, n: np.ndarray, tails: np.ndarray | None = None) -> Automaton:
        total = sum(root.values())
        p = np.full(256, 1 / (total + 257))
        for byte, times in root.items():
            p[byte] = (times + 1) / (total + 257)
        levels = []
        for k in range(1, DEPTH + 1):
            mine = length == k
            code, times = gram[mine].astype(np.uint64), n[mine].astype(np.float64)
            order = np.argsort(code)
            code, times = code[order], times[order]
            own, first, kinds = np.unique(code >> BYTE, return_index=True, return_counts=True)
            sums = np.add.reduceat(times, first) + kinds if len(own) else np.zeros(0)
            place = (np.repeat(np.arange(len(own), dtype=np.uint64), kinds) << BYTE) | (code & np.uint64(255))
            levels.append((own, (kinds / sums).astype(np.float32), place, (times / np.repeat(sums, kinds)).astype(np.float32)))
        return cls(p, levels, tails)

    @classmethod
    def build(cls, counts: dict[bytes, dict[int, int]]) -> Automaton:
        rows = [(len(c), int.from_bytes(c[::-1] + bytes([b]), "big"), t) for c, following in counts.items() if c for b, t in following.items()]
        return cls.of(counts[b""], *np.array(rows, np.int64).reshape(-1, 3).T)

    def p(self, codes: np.ndarray) -> np.ndarray:
        """Probability of the last byte of each of sorted grams behind the others.  A context's suffixes are in the tree
        if it is, so what one length lacks is not looked for in the next."""
        following = codes & np.uint64(255)
        out, alive = self.root[following.astype(np.intp)], np.arange(len(codes))
        for k, (own, back, place, share) in enumerate(self.levels, 1):
            if not len(alive) or not len(own):
                break
            context = codes[alive] >> (TOP - BYTE * np.uint64(k))
            first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
            runs = np.diff(np.append(first, len(context)))
            at, there = _find(own, context[first])
            alive, at = alive[np.repeat(there, runs)], np.repeat(at[there], runs[there])
            gram, known = _find(place, (at.astype(np.uint64) << BYTE) | following[alive])
            out[alive] = out[alive] * back[at] + np.where(known, share[gram], 0)
        return out

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram, rounded alike whether it is remembered or not."""
        if self.memo is None:
            self.memo = Memo(MEMO)
        out = np.empty(len(codes), np.float32)
        left = self.memo.get(codes, out)
        if len(left):
            fresh, place = np.unique(codes[left], return_inverse=True)
            values = np.log10(self.p(fresh)).astype(np.float32)
            out[left] = values[place]
            self.memo.put(fresh, values)
        return out

    def scores(self, docs: list[list[bytes]]) -> np.ndarray:
        """log10 probability of each document, or of what is this part's own."""
        codes, starts = coded(docs)
        if self.tails is None:
            return np.add.reduceat(self.log10(codes).astype(np.float64), starts)
        mine = self.tails[(codes >> (TOP - np.uint64(16))).astype(np.intp)]
        owner = np.repeat(np.arange(len(docs)), np.diff(np.append(starts, len(codes))))[mine]
        return np.bincount(owner, self.log10(codes[mine]), minlength=len(docs))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": None}


def _tail() -> Column:
    """The last two bytes of a context of at least two."""
    return F.expr("shiftright(gram, 8 * length - 8)")


def parts_of(rows: DataFrame) -> list[np.ndarray | None]:
    """The last two bytes of each part, as a mask; contexts of one byte are in every part."""
    tails = rows.where("length > 1").groupBy(_tail().alias("tail")).agg(F.count("*").alias("n")).collect()  # at most 65,536
    number = -(-sum(r["n"] for r in tails) // PART_ROWS)
    if number < 2:
        return [None]
    sizes, part = [0] * number, np.arange(65536) % number
    for r in sorted(tails, key=lambda r: (-r["n"], r["tail"])):
        part[r["tail"]] = sizes.index(min(sizes))
        sizes[part[r["tail"]]] += r["n"]
    return [part == i for i in range(number)]


def load(rows: DataFrame, root: dict[int, int], tails: np.ndarray | None) -> Automaton:
    if tails is not None:
        wanted = rows.sparkSession.createDataFrame([(int(t),) for t in np.flatnonzero(tails)], "tail long")
        longer = rows.where("length > 1").join(F.broadcast(wanted), _tail() == F.col("tail"), "left_semi")
        rows = rows.where("length = 1").unionByName(longer)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(c.to_numpy().astype(t).tobytes(), 1)], pa.binary()) for c, t in zip(batch.columns, PACKED)], names=["length", "gram", "n"])

    # arrays are packed in the tasks: the driver holds few bytes a row
    found = rows.select("length", "gram", "n").mapInArrow(pack, "length binary, gram binary, n binary").collect()
    return Automaton.of(root, *(np.frombuffer(b"".join(zlib.decompress(r[i]) for r in found), t) for i, t in enumerate(PACKED)), tails)


@dataclass
class Model:
    rows: DataFrame  # length, gram, n
    root: dict[int, int]
    parts: list[np.ndarray | None]
    words: DataFrame  # word, n
    dictionary: dict[bytes, float]  # log10 of the count and one
    tokens: int  # N
    kinds: int  # V
    least: int  # words of at least this count are in the dictionary

    @property
    def automaton(self) -> Automaton:
        """The whole tree, on the driver."""
        return load(self.rows, self.root, None)


def fit(training: DataFrame, text_col: str = "text") -> Model:
    words, rows, root = tree(corpus_counts(training, F.col(text_col)))
    tokens, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # the smallest count that no more than DICTIONARY words reach
    common = words.where(F.col("n") >= max(1, tokens // (50 * DICTIONARY)))
    levels = sorted(((r[0], r[1]) for r in common.groupBy("n").count().collect()), reverse=True)
    least, number = (levels[0][0] + 1 if levels else 1), 0
    for n, how_many in levels:
        number += how_many
        if number > DICTIONARY:
            break
        least = n
    frame = words.where((F.col("n") >= least) | (F.col("word") == F.lit(END))).toPandas()  # the end of texts is always looked up
    dictionary = dict(zip(map(bytes, frame["word"]), np.log10(frame["n"].to_numpy() + 1.0).tolist()))
    return Model(rows, root, parts_of(rows), words, dictionary, tokens, kinds, least)


def _shipped(spark: SparkSession, automaton: Automaton) -> list:
    """What is broadcast of a part of the tree: where its arrays are in a file that executors map.  Executors know nothing of
    this package, so nothing but names and arrays travels."""
    tails = [] if automaton.tails is None else [automaton.tails]
    return [*ship_arrays(spark, [automaton.root, *(a for level in automaton.levels for a in level), *tails])]


def _built(place: list) -> Automaton:
    """The automaton over the mapped arrays, made once a worker and kept behind their place with what it remembers."""
    if len(place) < 3:
        root, *arrays = mapped(*place)
        place.append(Automaton(np.array(root), [tuple(arrays[4 * k:4 * k + 4]) for k in range(DEPTH)], arrays[4 * DEPTH] if len(arrays) > 4 * DEPTH else None))
    return place[2]


def _partial(shared):
    """_row, _key (joins with nothing) and the part's own sum of each row of (_row, _text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _built(shared.value)
        for batch in batches:
            scores = [x for part in _slices(t.as_py() for t in batch.column(1)) for x in automaton.scores(part)]
            rows = batch.column(0)
            yield pa.RecordBatch.from_arrays([rows, pa.array([b" %d" % r for r in rows.to_pylist()], pa.binary()), pa.array(scores, pa.float64())], names=["_row", "_key", "_score"])
    return run


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of docs, n_tokens, n_known, base_score and score of each row."""
    spark = docs.sparkSession
    require_free(keep, ["n_tokens", "n_known", "base_score", "score"])
    keep, put, back = shelved(keep)
    shared = spark.sparkContext.broadcast((_shipped(spark, load(model.rows, model.root, model.parts[0])), model.dictionary))
    kept = docs.select(*put)
    names = [*keep, "_row", "_key", "_times", "_tokens", "_known", "_sum", "_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, dictionary = shared.value
        automaton = _built(arrays)
        get, end = dictionary.get, dictionary.get(END)
        for batch in batches:
            done = 0
            rows = batch.column(len(keep))
            for part in _slices(t.as_py() for t in batch.column(len(keep) + 1)):
                scores = automaton.scores(part)
                index, row, key, times, tokens, known, sums, total = [], [], [], [], [], [], [], []
                for i, words in enumerate(part):
                    n_row = rows[done + i].as_py()
                    found = list(map(get, words))
                    rare = Counter(w for w, n in zip(words, found) if n is None) if None in found else {}
                    if rare:
                        found = [n for n in found if n is not None]
                    index.append(done + i)
                    row.append(n_row)
                    key.append(b" %d" % n_row)  # no word has a space: joins with nothing
                    times.append(0)
                    tokens.append(len(words) + 1)
                    known.append(len(found) + (end is not None))
                    sums.append(sum(found) + (end or 0.0))
                    total.append(float(scores[i]))
                    for w, n in rare.items():
                        index.append(done + i)
                        row.append(n_row)
                        key.append(w)
                        times.append(n)
                        tokens.append(None)
                        known.append(None)
                        sums.append(None)
                        total.append(None)
                done += len(part)
                picked = batch.select(range(len(keep))).take(pa.array(index)) if keep else None
                own = [pa.array(row, pa.int64()), pa.array(key, pa.binary()), pa.array(times, pa.int64()), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64()), pa.array(total, pa.float64())]
                yield pa.RecordBatch.from_arrays([*(picked.columns if keep else []), *own], names=names)

    numbered = docs.select(*put, F.monotonically_increasing_id().alias("_row"), F.col(text_col).cast("string").cast("binary").alias("_text"))
    if len(model.parts) > 1:
        numbered = spool(numbered)  # read once for each part
    flat = numbered.mapInArrow(run, extended(kept, "_row long, _key binary, _times long, _tokens long, _known long, _sum double, _score double"))
    rest = model.words.where((F.col("n") < model.least) & (F.col("word") != F.lit(END))).select(F.col("word").alias("_key"), "n")
    for tails in model.parts[1:]:
        more = numbered.select("_row", "_text").mapInArrow(_partial(spark.sparkContext.broadcast(_shipped(spark, load(model.rows, model.root, tails)))), "_row long, _key binary, _score double")
        flat = flat.unionByName(more, allowMissingColumns=True)
    joined = flat.join(rest, "_key", "left")
    n = F.coalesce("n", F.lit(0))
    sums = joined.groupBy("_row").agg(
        *(F.first(c, ignorenulls=True).alias(c) for c in keep),
        F.max("_tokens").alias("n_tokens"),
        (F.max("_known") + F.sum(F.when(n > 0, F.col("_times")).otherwise(0))).alias("n_known"),
        (F.max("_sum") + F.sum(F.col("_times") * F.log10(n + 1))).alias("_sum"),
        F.sum("_score").alias("score"),
    )
    base = F.col("_sum") - F.col("n_tokens") * F.log10(F.lit(float(model.tokens + model.kinds + 1)))
    return sums.select(*back, "n_tokens", "n_known", base.alias("base_score"), "score")
