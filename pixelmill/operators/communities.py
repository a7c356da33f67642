"""Communities of graphs of any size by modularity: local moves, connected parts, contraction, all as DataFrame rounds."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import lookup, ordered_index, spool, spooled_buckets
from .graph import connected_components, leiden

#: A window of rounds must raise Q by this much to be followed by another one.
LEAST_GAIN = 1e-4
#: Nodes move in one of SHARES[i] rounds; a round that lowers Q is undone and repeated with the next, smaller share.
SHARES = (2, 4, 8)
#: A contracted graph of no more nodes than this is finished on the driver.
COARSE = 1024
#: Links of one block of nodes.  A node of more than HUB links is in no block, its links meet labels by joins.
LINKS, HUB = 1 << 19, 1 << 17
#: What a block hears of a node: itself, its community with the sums of that, and its degree if the block is its home.
HEARD = {"node": "long", "community": "long", "strength": "double", "size": "long", "least": "long", "degree": "double"}
#: A row of proposals.
PROPOSED = "node long, degree double, home int, routes array<int>, own long, strength double, inside double, best long, gain double, loner long"


def _symmetric(edges: DataFrame, src: str, dst: str, weight: str | None) -> DataFrame:
    """u, v, w in both directions, parallel edges added up; loops once, with both of their ends."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    flat = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("u"), F.col(dst).alias("v"), w.alias("w")).where("w > 0")
    turned = flat.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")
    return flat.unionByName(turned).groupBy("u", "v").agg(F.sum("w").alias("w"))


def _proposals(links: DataFrame, labels: DataFrame, total: float, resolution: float, hubs: DataFrame) -> DataFrame:
    """node, degree, own, strength (of its own community), inside (weight into it), best, gain over staying, loner (the
    node of `best` where both sides are alone).  links: u, v, w, degree (of u), without loops; labels: node, degree,
    community, strength, size, least (its smallest node).

    A node's links to a community are grouped sums.  This is the way for hubs: all of `links` is shuffled."""
    known_of = ["strength", "size", "least"]
    at = labels.select(F.col("node").alias("v"), "community", *known_of)
    votes = links.join(at, "v").select("u", "community", "w", "degree", *known_of, F.lit(False).alias("mine"))
    stay = labels.join(F.broadcast(hubs.select("node")), "node", "left_semi").select(F.col("node").alias("u"), "community", F.lit(0.0).alias("w"), "degree", *known_of, F.lit(True).alias("mine"))
    known = votes.unionByName(stay).groupBy("u", "community").agg(F.sum("w").alias("w"), *(F.first(c).alias(c) for c in ("degree", *known_of)), F.max("mine").alias("mine"))
    rest = F.col("strength") - F.when(F.col("mine"), F.col("degree")).otherwise(0.0)
    known = known.withColumn("score", F.col("w") - F.lit(resolution) * F.col("degree") * rest / total)
    mine = F.max(F.when(F.col("mine"), F.struct("community", "strength", "w", "score", "size")))
    # ties to the smallest community
    best = F.min_by(F.struct("community", "score", "size", "least"), F.struct(-F.col("score"), "community"))
    found = known.groupBy(F.col("u").alias("node")).agg(F.first("degree").alias("degree"), mine.alias("mine"), best.alias("to"))
    return found.select(
        "node", "degree", F.col("mine.community").alias("own"), F.col("mine.strength").alias("strength"), F.col("mine.w").alias("inside"),
        F.col("to.community").alias("best"), (F.col("to.score") - F.col("mine.score")).alias("gain"), F.when((F.col("mine.size") == 1) & (F.col("to.size") == 1), F.col("to.least")).alias("loner"),
    )


def _home(node: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(blocks)).cast("int")


def _routed(links: DataFrame) -> tuple[DataFrame, int]:
    """node, degree, home (its block; null for hubs), routes (blocks that hold links to it, and its home), and the number of blocks."""
    blocks = max(1, -(-links.count() // LINKS))
    to = F.collect_set(_home(F.col("v"), blocks))
    found = links.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("degree"), F.count("*").alias("links"), to.alias("routes"))
    found = found.withColumn("home", F.when(F.col("links") <= HUB, _home(F.col("node"), blocks)))
    return spool(found.select("node", "degree", "home", F.array_compact(F.array_union("routes", F.array("home"))).alias("routes"))), blocks


def _packed(block: np.ndarray, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """A row a block with lists of what `columns` hold of it."""
    order = np.argsort(block, kind="stable")
    names, starts = np.unique(block[order], return_index=True)
    offsets = pa.array(np.append(starts, len(block)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, c.take(pa.array(order))) for c in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), *lists], names=["block", *columns])


def _dealt(between: DataFrame, nodes: DataFrame, blocks: int) -> DataFrame:
    """block, u, v, w, node, routes as lists: links (without those of hubs) and nodes by the blocks that are their homes,
    written once, so that no round moves them."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _packed(b.column(0).to_numpy(), dict(zip(b.schema.names[1:], b.columns[1:])))

    hubs = F.broadcast(nodes.where("home IS NULL").select(F.col("node").alias("u")))  # of more than HUB links each: few
    links = between.join(hubs, "u", "left_anti").select(_home(F.col("u"), blocks).alias("block"), "u", "v", "w").repartition(blocks, "block")
    links = links.mapInArrow(pack, "block int, u array<long>, v array<long>, w array<double>")
    at_home = nodes.where("home IS NOT NULL").select(F.col("home").alias("block"), "node", "routes").repartition(blocks, "block")
    at_home = at_home.mapInArrow(pack, "block int, node array<long>, routes array<array<int>>")
    return spooled_buckets(links.unionByName(at_home, allowMissingColumns=True), "block", blocks)


def _blockwise(dealt: DataFrame, labels: DataFrame, blocks: int, total: float, resolution: float) -> DataFrame:
    """The same as _proposals, of all nodes but hubs, with home and routes: a label goes once to each block that has links
    to its node, in lists; links stay where they are."""
    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            # ordered by community: what its nodes have in common compresses
            b = b.take(pa.array(np.argsort(b.column("community").to_numpy(), kind="stable")))
            routes, home = b.column("routes"), b.column("home").fill_null(-1).to_numpy()
            row = np.repeat(np.arange(b.num_rows), routes.value_lengths().to_numpy())
            block = routes.flatten().to_numpy()
            columns = {c: b.column(c).take(pa.array(row)) for c in HEARD}
            columns["degree"] = pa.array(np.where(block == home[row], columns["degree"].to_numpy(), 0.0))
            yield _packed(block, columns)

    def choose(held: pa.Table, heard: pa.Table) -> pa.Table:
        u, v, w = (held.column(c).combine_chunks().flatten().to_numpy() for c in ("u", "v", "w"))
        ids, community, strength, size, least, degree = (heard.column(c).combine_chunks().flatten().to_numpy() for c in HEARD)
        if not (degree > 0).any():  # the home of hubs alone
            return pa.schema(fields).empty_table()
        order = np.argsort(ids)
        ids, community, strength, size, least, degree = (x[order] for x in (ids, community, strength, size, least, degree))
        names, one, code = np.unique(community, return_index=True, return_inverse=True)
        strength, size, least, here = strength[one], size[one], least[one], degree > 0
        node, degree, own = ids[here], degree[here], code[here]
        # a node's links to a community, and none to its own; by node, then community
        key = np.concatenate([np.searchsorted(node, u) * len(names) + code[np.searchsorted(ids, v)], np.arange(len(node)) * len(names) + own])
        order = np.argsort(key, kind="stable")
        key, first = np.unique(key[order], return_index=True)
        w = np.add.reduceat(np.append(w, np.zeros(len(node)))[order], first)
        u, c = np.divmod(key, len(names))
        mine = c == own[u]
        score = w - resolution * degree[u] * (strength[c] - np.where(mine, degree[u], 0.0)) / total
        stay = np.flatnonzero(mine)
        # ties to the smallest community
        best = np.lexsort((c, -score, u))[np.searchsorted(u, np.arange(len(node)))]
        to = c[best]
        alone = (size[own] == 1) & (size[to] == 1)
        place, routes = held.column("node").combine_chunks().flatten().to_numpy(), held.column("routes").combine_chunks().flatten()
        return pa.table({
            "node": node, "degree": degree, "home": pa.array(np.full(len(node), held.column("block")[0].as_py()), pa.int32()), "routes": routes.take(pa.array(np.argsort(place))),
            "own": names[own], "strength": strength[own], "inside": w[stay], "best": names[to], "gain": score[best] - score[stay], "loner": pa.array(least[to], mask=~alone),
        })

    fields = [(c, pa.int32() if c == "home" else pa.list_(pa.int32()) if c == "routes" else pa.float64() if c in ("degree", "strength", "inside", "gain") else pa.int64()) for c in (x.split()[0] for x in PROPOSED.split(", "))]
    lists = ", ".join(f"{c} array<{kind}>" for c, kind in HEARD.items())
    heard = labels.select("home", "routes", *HEARD).mapInArrow(tell, f"block int, {lists}").repartition(blocks, "block")
    return dealt.groupBy("block").cogroup(heard.groupBy("block")).applyInArrow(choose, PROPOSED)


def _local_moves(links: DataFrame, nodes: DataFrame, blocks: int, start: DataFrame | None, count: int, loops: float, total: float, resolution: float, seed: int, kind: str) -> tuple[DataFrame, float, float]:
    """node, community after rounds of moves from `start` (else each node alone), and Q before and after.  links: u, v, w without
    loops; nodes and blocks: of _routed.  Two nodes that are alone do not change places: where
    both may move, the greater one joins the smaller.  Ends when no node wants to move or a window of rounds, one for each share of the
    nodes, gains little; Q is bounded, so it ends."""
    dealt = _dealt(links, nodes, blocks)
    hubs = spool(nodes.where("home IS NULL"))
    of_hubs = None if hubs.isEmpty() else spool(links.join(F.broadcast(hubs.select(F.col("node").alias("u"), "degree")), "u"))
    wants = (F.col("best") != F.col("own")) & (F.col("gain") > 1e-9 * total)

    def proposed(labels: DataFrame) -> DataFrame:
        new = _blockwise(dealt, labels, blocks, total, resolution)
        if of_hubs is None:
            return new
        ways = F.broadcast(hubs.select("node", "home", "routes"))
        return new.unionByName(_proposals(of_hubs, labels, total, resolution, hubs).join(ways, "node"))

    def measured(moved: DataFrame) -> DataFrame:
        strength = moved.groupBy("community").agg(F.sum("degree").alias("strength"), F.count("*").alias("size"), F.min("node").alias("least"))
        return lookup(moved, "community", strength, total=count)

    alone = nodes.withColumns({"community": F.col("node"), "strength": F.col("degree"), "size": F.lit(1).cast("long"), "least": F.col("node")})
    labels = alone if start is None else measured(spool(nodes.join(start, "node")))
    found = None
    best_q = first_q = opened_q = -np.inf
    share = at = rounds = 0

    def done() -> tuple[DataFrame, float, float]:
        return found.select("node", F.col("own").alias("community")), first_q, best_q

    while True:
        new = spool(proposed(labels))
        # the squares of all communities' strengths, summed over their nodes
        inside, wanting, squares = new.agg(F.sum("inside"), F.sum(wants.cast("long")), F.sum(F.col("degree") * F.col("strength"))).first()
        q = (inside + loops) / total - resolution * squares / total**2
        if found is None:
            first_q = opened_q = q
        if q > best_q:
            found, best_q = new, q
            if not wanting:
                return done()
        else:  # too many moved at once
            share += 1
            rounds, opened_q = 0, best_q
            if share == len(SHARES):
                return done()
        if rounds == SHARES[share]:
            if best_q - opened_q < LEAST_GAIN:
                return done()
            rounds, opened_q = 0, best_q
        number, round_ = SHARES[share], at

        def turn(node: Column) -> Column:
            return F.pmod(F.xxhash64(node.cast(kind), F.lit(seed), F.lit(round_ // number)), F.lit(number)) == round_ % number

        free = F.col("loner").isNull() | (F.col("loner") < F.col("node")) | ~turn(F.col("loner"))
        moved = found.select("node", "degree", "home", "routes", F.when(turn(F.col("node")) & wants & free, F.col("best")).otherwise(F.col("own")).alias("community"))
        labels = measured(moved)
        at, rounds = at + 1, rounds + 1


def _connected_parts(links: DataFrame, labels: DataFrame) -> DataFrame:
    """node, part: the connected parts of each community, named by their smallest node."""
    at = labels.select("node", "community")
    inside = links.where("u < v").join(at.withColumnsRenamed({"node": "u", "community": "cu"}), "u").join(at.withColumnsRenamed({"node": "v", "community": "cv"}), "v").where("cu = cv").select("u", "v")
    parts = connected_components(inside, "u", "v")
    return labels.select("node").join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("part"))


def _levels(links: DataFrame, start: DataFrame | None, total: float, resolution: float, seed: int, coarse: int, kind: str) -> tuple[DataFrame, float]:
    """node, community and Q: moves from `start`, connected parts, contraction, and again from parts alone."""
    nodes, blocks = _routed(links)
    member, all_, best = nodes.select("node", F.col("node").alias("community")), nodes.count(), -np.inf
    while True:
        count = nodes.count()
        if count < all_ and count <= coarse:
            top, best = _finished(links, nodes, resolution, seed)
            return spool(member.join(top, member.community == top.part).select(member.node, top.community)), best
        loops = links.where("u = v").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
        between = links.where("u <> v")
        labels, before, after = _local_moves(between, nodes, blocks, start, count, loops, total, resolution, seed, kind)
        if start is None and after - before < LEAST_GAIN / 10:
            return spool(member), before
        start = None
        parts = spool(_connected_parts(links, labels))
        member = spool(member.join(parts.withColumnsRenamed({"node": "community", "part": "_part"}), "community").select("node", F.col("_part").alias("community")))
        left, right = parts.withColumnsRenamed({"node": "u", "part": "pu"}), parts.withColumnsRenamed({"node": "v", "part": "pv"})
        links = spool(links.join(left, "u").join(right, "v").groupBy(F.col("pu").alias("u"), F.col("pv").alias("v")).agg(F.sum("w").alias("w")))
        nodes, blocks = _routed(links)


def modularity_communities(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None, resolution: float = 1.0, seed: int = 0, coarse: int = COARSE, iterations: int = 2) -> DataFrame:
    """node, community (its smallest node) of an undirected graph, each pair of nodes in any direction; parallel edges add up.

    Each level starts with every node alone, moves nodes to the neighbouring community of most gain, cuts communities
    into connected parts (never worse) and contracts the parts; levels end when Q no longer rises.  A further iteration
    starts with the single nodes in the communities found before.  Links are dealt to blocks once a level; a round moves
    labels, at most one a link in lists, and writes a row a node; nothing but sums reaches the driver, and a contracted graph of at most `coarse` nodes, which is
    finished there.

    Defined cases: edges with a null end or a weight that is not positive are left out (so are nodes without others);
    loops count for their node; ids must be of one orderable type; a graph without edges has no rows; the result depends on
    the seed only.
    """
    links = spool(_symmetric(edges, src, dst, weight))
    total = links.agg(F.sum("w")).first()[0]
    if not total:
        return links.select(F.col("u").alias("node"), F.col("v").alias("community"))
    kind, ids = dict(links.dtypes)["u"], None
    if kind in ("tinyint", "smallint", "int"):
        links = links.withColumns({"u": F.col("u").cast("long"), "v": F.col("v").cast("long")})
    elif kind != "bigint":  # by their places in the order of all
        ids, kind = spool(ordered_index(links.select(F.col("u").alias("id")).distinct(), ["id"])), "bigint"
        for c in ("u", "v"):
            links = links.join(ids.withColumnsRenamed({"id": c, "index": f"_{c}"}), c)
        links = spool(links.select(F.col("_u").cast("long").alias("u"), F.col("_v").cast("long").alias("v"), "w"))
    member, best = None, -np.inf
    for _ in range(iterations):
        found, q = _levels(links, member, total, resolution, seed, coarse, kind)
        if q - best < LEAST_GAIN:
            break
        member, best = found, q
    least = member.groupBy("community").agg(F.min("node").alias("_least"))
    found = lookup(member, "community", least).select("node", F.col("_least").alias("community"))
    if ids is None:
        return found.select(F.col("node").cast(kind).alias("node"), F.col("community").cast(kind).alias("community"))
    for c in ("node", "community"):
        found = lookup(spool(found), c, ids.withColumnsRenamed({"id": f"_{c}", "index": c})).drop(c)
    return found.select(F.col("_node").alias("node"), F.col("_community").alias("community"))


def _finished(links: DataFrame, nodes: DataFrame, resolution: float, seed: int) -> tuple[DataFrame, float]:
    """part, community of a small contracted graph, by `leiden` with its loops, and their Q."""
    names = [r[0] for r in nodes.select("node").orderBy("node").collect()]
    place = {n: i for i, n in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for r in links.collect():
        w[place[r["u"]], place[r["v"]]] = r["w"]
    found = leiden(w, resolution, seed, loops=True)
    kind = dict(nodes.dtypes)["node"]
    degree, same = w.sum(axis=1), found[:, None] == found[None]
    q = float((w * same).sum() / w.sum() - resolution * (np.outer(degree, degree) * same).sum() / w.sum() ** 2)
    rows = [(n, names[int(np.flatnonzero(found == c)[0])]) for n, c in zip(names, found)]
    return nodes.sparkSession.createDataFrame(rows, f"part {kind}, community {kind}"), q
