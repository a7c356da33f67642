"""SimHash near-duplicates by vantage-point trees over 64-bit fingerprints.

Documents become fingerprints (one pass, no shuffle of texts); equal fingerprints collapse to one.  The upper levels of
a vantage-point tree are built by DataFrame rounds: only a cell of too many rows is cut, by the distance from a vantage
point of its own, at the quartiles.  The triangle bound says which parts a fingerprint's partners can be in; it visits
those of them that come before its own, so each pair of parts meets once.  A cell that a vantage point does not divide
stays whole, which takes longer but loses nothing.  Inside a cell a vantage-point tree is traversed by all its queries at
once, pruned by the same bound; leaves are compared exactly.  A cell returns a spanning forest of its links, never all
pairs; components are then found by DataFrame rounds.

Defined cases: a null or empty text has fingerprint 0 and links like any other; repeated rows share a component; an
empty table gives an empty result; null ids are kept as rows and never name a component that has another id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, cols, fresh, spool
from .components import connected_components, forest

SHINGLE, SEED, BITS = 3, 42, 2
#: Rows of a cell (8 bytes each) from which it is cut, and the share of them that a part may keep to be cut again.  Cells
#: are as large as a task's tree takes in seconds: each cut adds about half as many visitors as there are rows.
CELL_ROWS, STUCK = 1 << 17, 0.8
#: Rows of a tree's leaf.
LEAF = 256
#: Most rows to drop whose numbers are broadcast; beyond it they are joined by a shuffle.
MAX_BROADCAST = 2_000_000
#: Shingles whose bits are counted at once, to bound memory on very long texts.
BLOCK = 1 << 15


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set if it is set in over half of the shingles' hashes, repeats included."""
    words = (text or b"").translate(LOWER_BYTES).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-shingle])).tolist()
    ends = (ends[shingle - 1:] - 1).tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), BLOCK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at:at + BLOCK], ends[at:at + BLOCK])], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(1).cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[id_col, "fp"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"{id_col} {kind}, fp long")


def distances(a: np.ndarray, point: int) -> np.ndarray:
    return np.bitwise_count(a ^ np.uint64(point)).astype(np.int16)


def tree_links(points: np.ndarray, queries: np.ndarray, bits: int = BITS, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between points and queries (points are among the queries), by a vantage-point tree that is
    built and traversed at once: a query goes to the inner or outer side only if the triangle bound lets it."""
    found_a, found_b, held = [], [], 0

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal held
        found_a.append(a)
        found_b.append(b)
        held += len(a)
        if held > 2_000_000:
            a, b = forest(np.concatenate(found_a), np.concatenate(found_b))
            found_a[:], found_b[:], held = [a], [b], len(a)

    stack = [(points, queries)]
    while stack:
        p, q = stack.pop()
        if not len(p) or not len(q):
            continue
        if len(p) > leaf:
            v = p[len(p) // 2]
            dp = distances(p, v)
            middle = int(np.median(dp))
            inner = dp <= middle
            if not inner.all():
                dq = distances(q, v)
                stack += [(p[inner], q[dq <= middle + bits]), (p[~inner], q[dq > middle - bits])]
                continue
            inner = dp < middle
            if inner.any():
                dq = distances(q, v)
                stack += [(p[inner], q[dq < middle + bits]), (p[~inner], q[dq >= middle - bits])]
                continue
        step = max(1, (1 << 21) // len(p))
        for at in range(0, len(q), step):
            i, j = np.nonzero(np.bitwise_count(q[at:at + step, None] ^ p[None, :]) <= bits)
            a, b = q[at + i], p[j]
            different = a != b
            if different.any():
                keep(a[different], b[different])
    if not found_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return forest(np.concatenate(found_a), np.concatenate(found_b))


def _cut(placed: DataFrame, large: DataFrame, bits: int) -> DataFrame:
    """The rows of large cells (cell, vantage, n) in the parts that they belong to (home) or must visit."""
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage")))
    far = placed.join(F.broadcast(large), "cell").withColumn("apart", apart)  # a cell for each CELL_ROWS rows, at most
    spread = far.groupBy("cell", "apart").agg(F.count("*").alias("rows"))
    edges = spread.groupBy("cell").agg(F.array_distinct(F.expr("percentile(apart, array(0.25, 0.5, 0.75), rows)")).alias("edges"))

    def part(distance: Column) -> Column:
        return F.size(F.filter("edges", lambda e: e < distance))

    # what is at home here meets the parts before its own, a visitor all that are within reach
    last = part(F.col("apart") + F.when(F.col("home"), F.lit(0)).otherwise(F.lit(bits)))
    parts = far.join(F.broadcast(edges), "cell").withColumns({"own": part(F.col("apart")), "part": F.explode(F.sequence(part(F.col("apart") - bits), last))})
    return parts.select(F.xxhash64("cell", "part").alias("cell"), "fp", (F.col("home") & (F.col("part") == F.col("own"))).alias("home"), F.col("n").alias("above"))


def cells(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """cell, fp, home: each fingerprint in its own cell, and as a visitor in those that the triangle bound leaves."""
    placed = distinct.select(F.lit(0).cast("long").alias("cell"), "fp", F.lit(True).alias("home"), F.lit(None).cast("long").alias("above"))
    done = None
    while True:
        first = F.min(F.struct(F.xxhash64("cell", "fp").alias("h"), "fp"))
        sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("above").alias("above"), first.getField("fp").alias("vantage"))
        large = spool(sizes.where((F.col("n") > CELL_ROWS) & (F.col("above").isNull() | (F.col("n") <= STUCK * F.col("above")))).select("cell", "vantage", "n"))
        if not large.count():
            return placed.drop("above") if done is None else done.unionByName(placed.drop("above"))
        rest = placed.join(F.broadcast(large.select("cell")), "cell", "left_anti").select("cell", "fp", "home")
        done = rest if done is None else done.unionByName(rest)
        placed = spool(_cut(placed, large, bits))


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """distinct: fp long, each once.  a, b: links that connect exactly what all pairs within `bits` connect."""
    def within(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy()
        a, b = tree_links(fps[home], fps, bits)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return cells(distinct, bits).groupBy("cell").applyInArrow(within, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """id, fp, component_id (smallest id reachable by links) of each row of docs."""
    prints = spool(fingerprints(docs, id_col, text_col))
    classes = spool(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    pairs = links(classes.select("fp"), bits)
    nodes = connected_components(pairs)
    named = nodes.join(classes, nodes.node == classes.fp).groupBy("component").agg(F.min("least").alias("component_id"))
    linked = nodes.join(named, "component").select(F.col("node").alias("fp"), "component_id")
    whole = classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    # a fingerprint that a third of all documents share is one row of `whole`; that join splits its other side
    return prints.join(whole, "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """docs with one row of each component: the first row of its smallest id."""
    row = fresh(docs, "_row")
    # written once: a second scan may be split otherwise and would number other rows
    numbered = spool(docs.withColumn(row, F.monotonically_increasing_id()))
    ids = numbered.select(F.col(row), F.col(text_col))
    found = near_duplicates(ids, row, text_col, bits).select(row, "component_id")
    order = numbered.select(F.col(row), F.col(id_col).alias("_id")).join(found, row)
    first = order.groupBy("component_id").agg(F.min(F.struct("_id", row)).alias("least")).select(F.col(f"least.{row}").alias(row))
    gone = spool(order.select(row).join(first, row, "left_anti"))
    small = gone.count() <= MAX_BROADCAST
    return numbered.join(F.broadcast(gone) if small else gone, row, "left_anti").select(cols(docs.columns))


def as_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
