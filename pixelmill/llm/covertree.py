"""Embedding near-duplicates: cover trees and their dual traversal give exactly the pairs at or above a cosine.

Equal vectors collapse to one class.  Pivots (a bounded sample) are the upper net: they cut the unit sphere into blocks
of bounded size; pairs of blocks that the covering radii keep apart are dropped before any row is shuffled, the others
meet in a task each.  Each block gets its cover tree once: nested nets of halving radii, kept as the centres of each
row.  Two trees are traversed together: a pair of nodes is dropped if its centres are further apart than both covering
radii and the threshold, counted whole if even its furthest members are within the threshold, and opened otherwise.
Bounds and leaves are computed in single precision with an error bound; whatever that leaves open is decided in double
precision.  Links are counted in place and merged into labels at once; a task returns counts and a spanning forest and
never holds more than a slice of the pairs.

Defined cases: a vector that is null, empty, zero or has null or non-finite components links with nothing; vectors of
different lengths do not link; repeated rows are copies that link with each other; an empty table gives an empty result;
rows without an id get component null and kept = false unless linked with others; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spool
from .components import connected_components, forest

COSINE = 0.95
#: Vectors of a block, and most pivots that are drawn.
BLOCK_ROWS, MAX_PIVOTS = 8192, 4096
#: Radii of the nets, from the root's children down.
RADII = (1.0, 0.5, 0.25, 0.125, 0.0625)
#: Rounding slack on covering radii (computed in double precision).
SLACK = 1e-6
#: Pairs of vectors that are compared without opening their nodes, and at once.
SMALL, AT_ONCE = 1 << 12, 1 << 21
#: Pairs of blocks whose list is broadcast; beyond it the list is joined by a shuffle.
MAX_BROADCAST = 1_000_000


def unit(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def error_of(width: int) -> float:
    """Bounds the error of a single-precision dot product of unit vectors."""
    return 1.2e-7 * (width + 8)


def _net(x: np.ndarray, rows: np.ndarray, radius: float) -> np.ndarray:
    """For each of rows, the row of its centre: greedy, in order, each centre covers what is within radius."""
    centre = np.full(len(rows), -1)
    least = 1 - radius * radius / 2
    left = np.arange(len(rows))
    while len(left):
        batch = left[:256]
        close = x[rows[batch]] @ x[rows[left]].T >= least
        owner = np.full(len(left), -1)
        for i in range(len(batch)):
            if owner[i] < 0:
                owner[(owner < 0) & close[i]] = i
                owner[i] = i
        done = owner >= 0
        centre[left[done]] = rows[batch[owner[done]]]
        left = left[~done]
    return centre


def nets(x: np.ndarray) -> np.ndarray:
    """The centre of each row of x in each net, nested: rows with one centre share those of all coarser nets."""
    x = x.astype(np.float32)
    out = np.repeat(np.arange(len(x))[:, None], len(RADII), axis=1)
    groups = [np.arange(len(x))] if len(x) else []
    for level, radius in enumerate(RADII):
        finer = []
        for rows in groups:
            centre = _net(x, rows, radius)
            out[rows, level] = centre
            order = np.argsort(centre, kind="stable")
            cuts = np.flatnonzero(np.diff(centre[order])) + 1
            finer += [rows[g] for g in np.split(order, cuts) if len(g) > 1]
        groups = finer
    return out


class Nodes:
    """Nodes of one net: centres, covering radii, and their rows one node after the other."""

    def __init__(self, level: int, centres: np.ndarray, reaches: np.ndarray, rows: np.ndarray, starts: np.ndarray):
        self.level, self.centres, self.reaches, self.rows, self.starts = level, centres, reaches, rows, starts
        self.sizes = np.diff(np.append(starts, len(rows)))

    def rows_of(self, i: int) -> np.ndarray:
        return self.rows[self.starts[i]:self.starts[i] + self.sizes[i]]

    def only(self, i: int) -> Nodes:
        return Nodes(self.level, self.centres[i:i + 1], self.reaches[i:i + 1], self.rows_of(i), np.zeros(1, np.int64))


class CoverTree:
    def __init__(self, x: np.ndarray, centres: np.ndarray | None = None):
        self.x, self.x32 = x, x.astype(np.float32)
        self.nets = nets(x) if centres is None else centres
        self.below: dict[tuple[int, int], Nodes] = {}
        self.root = self._nodes(0, np.arange(len(x)), np.zeros(len(x), np.int64))

    def _nodes(self, level: int, rows: np.ndarray, centre: np.ndarray) -> Nodes:
        order = np.argsort(centre, kind="stable")
        rows, centre = rows[order], centre[order]
        starts = np.flatnonzero(np.concatenate(([True], np.diff(centre) != 0)))
        dots = np.einsum("nd,nd->n", self.x[rows], self.x[centre])
        reach = np.sqrt(np.maximum(0, 2 - 2 * np.minimum.reduceat(dots, starts))) + SLACK
        reach[np.diff(np.append(starts, len(rows))) == 1] = 0
        return Nodes(level, centre[starts], reach, rows, starts)

    def children(self, node: Nodes) -> Nodes | None:
        """The nodes of the next net below a single node; none below the finest."""
        if node.level == len(RADII) or len(node.rows) < 2:
            return None
        key = node.level, int(node.rows[0])
        if key not in self.below:
            self.below[key] = self._nodes(node.level + 1, node.rows, self.nets[node.rows, node.level])
        return self.below[key]


class Links:
    """Counts of links (weighed by the copies of the other side), and a label of each row that linked rows share."""

    def __init__(self, a_weights: np.ndarray, b_weights: np.ndarray, same: bool):
        self.wa, self.wb, self.same = a_weights, b_weights, same
        self.na = np.zeros(len(a_weights), np.int64)
        self.nb = self.na if same else np.zeros(len(b_weights), np.int64)
        self.shift = 0 if same else len(a_weights)
        self.label = np.arange(self.shift + len(b_weights))

    def _join(self, i: np.ndarray, j: np.ndarray) -> None:
        u, v = self.label[i], self.label[self.shift + j]
        apart = u != v
        if apart.any():
            nodes, roots = forest(u[apart], v[apart])
            moved = np.arange(len(self.label))
            moved[nodes] = roots
            self.label = moved[self.label]

    def pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        self.na += np.bincount(i, self.wb[j], len(self.na)).astype(np.int64)
        self.nb += np.bincount(j, self.wa[i], len(self.nb)).astype(np.int64)
        self._join(i, j)

    def whole(self, p: np.ndarray, q: np.ndarray) -> None:
        """Each of p with each of q (no row in both)."""
        self.na[p] += self.wb[q].sum()
        self.nb[q] += self.wa[p].sum()
        self._join(np.concatenate((np.full(len(q), p[0]), p)), np.concatenate((q, np.full(len(p), q[0]))))

    def inside(self, p: np.ndarray) -> None:
        """Each of p with each other one of p, in a tree with itself."""
        self.na[p] += self.wa[p].sum() - self.wa[p]
        self._join(np.full(len(p), p[0]), p)

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows (those of b behind those of a) and the row whose label they share."""
        moved = np.flatnonzero(self.label != np.arange(len(self.label)))
        return moved, self.label[moved]


def dual(a: CoverTree, b: CoverTree, cosine: float, out: Links) -> None:
    """All pairs (row of a, row of b) at or above the cosine; of a tree with itself each pair once."""
    same, reach = a is b, float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    error = error_of(a.x.shape[1])

    def decided(left: np.ndarray, right: np.ndarray, dots: np.ndarray) -> None:
        """Links those of the pairs, whose single-precision products are not clearly too small, that are links."""
        open_ = np.flatnonzero(dots <= cosine + error)
        if len(open_):
            keep = np.ones(len(dots), dtype=bool)
            for at in range(0, len(open_), 1 << 16):
                some = open_[at:at + (1 << 16)]
                keep[some] = np.einsum("nd,nd->n", a.x[left[some]], b.x[right[some]]) >= cosine
            left, right = left[keep], right[keep]
        if len(left):
            out.pairs(left, right)

    def compare(p: np.ndarray, q: np.ndarray, triangle: bool) -> None:
        step = max(1, AT_ONCE // len(q))
        for at in range(0, len(p), step):
            begin = at if triangle else 0  # pairs before were met from the other side
            others = q[begin:]
            dots = a.x32[p[at:at + step]] @ b.x32[others].T
            if dots.max() < cosine - error:
                continue
            i, j = np.nonzero(dots >= cosine - error)
            if triangle:
                once = i < j
                i, j = i[once], j[once]
            decided(p[at + i], others[j], dots[i, j])

    def spread(ps: Nodes, i: np.ndarray, qs: Nodes, j: np.ndarray) -> None:
        """Every vector of node i[t] with every one of node j[t], for small nodes."""
        for at in range(0, len(i), 4_000):
            n, m = i[at:at + 4_000], j[at:at + 4_000]
            work = ps.sizes[n] * qs.sizes[m]
            pair = np.repeat(np.arange(len(n)), work)
            place = np.arange(len(pair)) - np.repeat(np.cumsum(work) - work, work)
            x, y = place // qs.sizes[m][pair], place % qs.sizes[m][pair]
            left, right = ps.rows[ps.starts[n][pair] + x], qs.rows[qs.starts[m][pair] + y]
            dots = np.einsum("nd,nd->n", a.x32[left], b.x32[right])
            hit = dots >= cosine - error
            if hit.any():
                decided(left[hit], right[hit], dots[hit])

    stack = [(a.root, b.root)]
    while stack:
        p, q = stack.pop()
        self_pair = same and p is q
        if self_pair and 2 * p.reaches[0] <= reach - SLACK:
            if len(p.rows) > 1:
                out.inside(p.rows)
            continue
        if len(p.rows) * len(q.rows) <= SMALL:
            compare(p.rows, q.rows, self_pair)
            continue
        # the node of the coarser net is opened, both if they are of the same
        ps = a.children(p) if p.level <= q.level else p
        qs = ps if self_pair else b.children(q) if q.level <= p.level else q
        if ps is None or qs is None:
            compare(p.rows, q.rows, self_pair)
            continue
        # nodes of one vector are leaves: among each other they are compared at once
        p_one, q_one = ps.reaches == 0, qs.reaches == 0
        p_wide, q_wide = np.flatnonzero(~p_one), np.flatnonzero(~q_one)
        p_one, q_one = np.flatnonzero(p_one), np.flatnonzero(q_one)
        if len(p_one) and len(q_one):
            compare(ps.centres[p_one], qs.centres[q_one], self_pair)
        everything = np.arange(len(qs.centres))
        for left, right in ((p_wide, everything), (p_one, q_wide)):
            if self_pair and left is p_one:
                continue  # met from the other side
            step = max(1, (AT_ONCE >> 1) // max(1, len(right)))
            for at in range(0, len(left) if len(right) else 0, step):
                some = left[at:at + step]
                gap = 2 - 2 * (a.x32[ps.centres[some]] @ b.x32[qs.centres[right]].T)
                both = (ps.reaches[some, None] + qs.reaches[None, right]).astype(np.float32)
                near = np.sqrt(np.maximum(0, gap - 2 * error)) <= both + (reach + SLACK)
                if self_pair:  # a pair of wide nodes once, a wide one with each single one
                    near &= (some[:, None] <= right[None, :]) | (qs.reaches[right] == 0)[None, :]
                i, j = np.nonzero(near)
                whole = np.sqrt(np.maximum(0, gap[i, j] + 2 * error)) + both[i, j] <= reach - SLACK
                i, j = some[i], right[j]
                own = (i == j) if self_pair else np.zeros(len(i), dtype=bool)
                whole &= ~own
                small = ~whole & ~own & (ps.sizes[i] * qs.sizes[j] <= 64)
                for n, m in zip(i[whole].tolist(), j[whole].tolist()):
                    out.whole(ps.rows_of(n), qs.rows_of(m))
                spread(ps, i[small], qs, j[small])
                rest = ~whole & ~small
                for n, m in zip(i[rest].tolist(), j[rest].tolist()):
                    child = ps.only(n)
                    stack.append((child, child if self_pair and n == m else qs.only(m)))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def block_pair(table: pa.Table, cosine: float) -> pa.Table:
    """Counts (b null) and links (n null) between the two blocks of a pair, or within one."""
    first = np.asarray(table.column("first").to_numpy(zero_copy_only=False), dtype=bool)
    ids, weights, place = (table.column(c).to_numpy() for c in ("class", "weight", "place"))
    x, centres = unit(_matrix(table.column("vector"))), _matrix(table.column("nets")).astype(np.int64)
    parts = [p[np.argsort(place[p])] for p in (np.flatnonzero(first), np.flatnonzero(~first)) if len(p)]  # nets name rows by their places
    trees = [CoverTree(x[p], centres[p]) for p in parts]
    same = len(trees) == 1
    a, b = parts[0], parts[-1]
    out = Links(weights[a], weights[b], same)
    dual(trees[0], trees[-1], cosine, out)
    every = ids[a] if same else np.concatenate((ids[a], ids[b]))
    n = out.na if same else np.concatenate((out.na, out.nb))
    left, right = out.forest()
    linked = n > 0
    return pa.table({
        "a": pa.array(np.concatenate((every[linked], every[left]))),
        "b": pa.concat_arrays([pa.nulls(int(linked.sum()), pa.int64()), pa.array(every[right])]),
        "n": pa.concat_arrays([pa.array(n[linked]), pa.nulls(len(left), pa.int64())]),
    })


def _blocks(classes: DataFrame, rows: int) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """classes with their block and cover tree (place in the block, nets), and centre, radius and length of vectors of each block."""
    spark = classes.sparkSession
    n = classes.count()
    wanted = min(MAX_PIVOTS, -(-n // rows))
    drawn = []
    if wanted > 1:
        place = F.xxhash64(F.lit("pivot"), "class").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
        # about 2 * wanted rows, of which the first ones in hash order are taken
        found = classes.where(place < min(1.0, (2 * wanted + 20) / n)).select("class", "vector", place.alias("place")).collect()
        drawn = [r["vector"] for r in sorted(found, key=lambda r: (r["place"], r["class"]))]
    lengths = sorted(r[0] for r in classes.select(F.size("vector")).distinct().collect())
    pivots = {d: unit(np.array([v for v in drawn if len(v) == d][:wanted] or [[1.0] * d])) for d in lengths}
    offsets, total = {}, 0
    for d in lengths:
        offsets[d] = total
        total += len(pivots[d])

    def place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            size = np.array([len(v) for v in column])
            cell, apart = np.zeros(len(size), np.int64), np.zeros(len(size))
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                dots = unit(_matrix(pa.chunked_array([column.take(pa.array(at))]))) @ pivots[d].T
                best = dots.argmax(axis=1)
                cell[at] = best + offsets[d]
                apart[at] = np.sqrt(np.maximum(0, 2 - 2 * dots[np.arange(len(at)), best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell), pa.array(apart)], names=["class", "cell", "apart"])

    cells = spool(classes.select("class", "vector").mapInArrow(place_rows, "class long, cell long, apart double"))
    counts = {r[0]: r[1] for r in cells.groupBy("cell").count().collect()}  # at most MAX_PIVOTS a length
    first, starts = 0, []
    for cell in range(total):  # an overfull cell is cut into blocks of equal size
        parts = max(1, -(-counts.get(cell, 0) // rows))
        starts.append((cell, first, parts))
        first += parts
    cut = spark.createDataFrame(starts, "cell long, first long, parts long")
    blocks = cells.join(F.broadcast(cut), "cell").select("class", "apart", (F.col("first") + F.pmod(F.xxhash64("class"), F.col("parts"))).alias("block"))

    def build(table: pa.Table) -> pa.Table:
        centres = nets(unit(_matrix(table.column("vector"))))
        return table.append_column("place", pa.array(np.arange(len(centres), dtype=np.int32))).append_column("nets", pa.array(list(centres.astype(np.int32)), pa.list_(pa.int32())))

    kind = classes.schema["vector"].dataType.simpleString()
    placed = classes.join(blocks, "class").select("block", "apart", "class", "weight", "vector")
    placed = spool(placed.groupBy("block").applyInArrow(build, f"block long, apart double, class long, weight long, vector {kind}, place int, nets array<int>"))
    reach = {r[0]: r[1] for r in placed.groupBy("block").agg(F.max("apart")).collect()}
    length_of = {c: d for d in lengths for c in range(offsets[d], offsets[d] + len(pivots[d]))}
    widest = max(lengths, default=1)
    centre, radius, length = np.zeros((first, widest)), np.full(first, -1.0), np.zeros(first, np.int64)
    for cell, begin, parts in starts:
        d = length_of[cell]
        for block in range(begin, begin + parts):
            centre[block, :d] = pivots[d][cell - offsets[d]]
            radius[block] = reach.get(block, -1.0)
            length[block] = d
    return placed, centre, radius, length


def links(classes: DataFrame, cosine: float = COSINE, rows: int = BLOCK_ROWS) -> DataFrame:
    """classes: class long, vector, weight long.  Returns a, b, n: counts (b null) and links that connect (n null)."""
    spark = classes.sparkSession
    placed, centre, radius, length = _blocks(classes, rows)
    reach, blocks = float(np.sqrt(max(0.0, 2 - 2 * cosine))), len(radius)
    upper = spark.sparkContext.broadcast((centre, radius, length))  # one row for `rows` vectors, or for a pivot

    def meets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, radius, length = upper.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                apart = np.sqrt(np.maximum(0, 2 - 2 * centre[i:] @ centre[i]))
                near = (apart <= radius[i] + radius[i:] + reach + SLACK) & (length[i:] == length[i]) & (radius[i] >= 0) & (radius[i:] >= 0)
                j = np.flatnonzero(near) + i
                other = j[j != i]
                pair = np.concatenate((i * blocks + j, i * blocks + other))
                block = np.concatenate((np.full(len(j), i), other))
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(block), pa.array(np.arange(len(pair)) < len(j))], names=["pair", "block", "first"])

    pairs = spool(spark.range(blocks).mapInArrow(meets, "pair long, block long, first boolean"))
    small = pairs.count() <= MAX_BROADCAST
    dealt = placed.join(F.broadcast(pairs) if small else pairs, "block").select("pair", "first", "class", "weight", "vector", "place", "nets")

    def run(table: pa.Table) -> pa.Table:
        return block_pair(table, cosine)

    return dealt.groupBy("pair").applyInArrow(run, "a long, b long, n long")


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """id, n_links, component_id, kept of each row."""
    v = F.col(vector_col)
    usable = v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    numbered = spool(rows.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.when(F.coalesce(usable, F.lit(False)), v).alias("vector")))
    good = numbered.where("vector IS NOT NULL").withColumn("h", F.xxhash64("vector"))
    classes = spool(good.groupBy("h", "vector").agg(F.min("row").alias("class"), F.min("id").alias("least"), F.count("*").alias("weight")))
    found = spool(links(classes.select("class", "vector", "weight"), cosine, block_rows))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    nodes = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    named = nodes.join(classes.select("class", "least"), nodes.node == F.col("class"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = named.join(least, "component").select("class", "component_id")
    whole = classes.join(counts, "class", "left").join(linked, "class", "left")
    whole = whole.select("h", "vector", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    own = good.join(whole, ["h", "vector"]).select("id", "n_links", "component_id")
    alone = numbered.where("vector IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return own.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
