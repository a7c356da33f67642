"""Conversation prefix trie: what conversations share from their start, rolled up by pointer jumping.

A node is a distinct sequence of first turns.  Its key is a digest of that sequence: each turn's sha256 of (depth, role,
text) gives LANES numbers of 32 bits, and the sums of these over the first d turns are what the key of depth d is made
of.  Sums run over ranges of all turns, so a conversation of any length is dealt over tasks; texts are not shuffled,
digests are.  The key of a node's parent comes from the same row (the sums without its own turn).

Pointer jumping: each node points to its ancestor 2^k above; in round k it hands what it has gathered to that ancestor
and takes over the ancestor's pointer.  After as many rounds as the greatest depth has binary digits each node has
the sums of its whole subtree; no round follows the trie level by level.  Common ancestors are looked up apart.

Defined cases: turns are ordered by turn (null first), turns that tie by the digest of role and text; null roles and texts
are empty; rows without a conversation id belong to no conversation and are left out; repeated rows are turns of their
own; a conversation without turns ends in the root; an empty table gives no nodes; extra columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelmill.operators.base import lookup, ranged

from .common import spool

LANES = 4
ROOT = "root"
#: Ids that are packed into one row on their way to the digest of a node's ends.
PACK = 512


def _sums_before(parts: DataFrame, group: str, sums: dict[str, Column]) -> DataFrame:
    """_part, group and the sums over the same group in earlier ranges; only groups that cross into a range have a row,
    and at most one does in each range."""
    totals = parts.groupBy("_part", group).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_part", group, *(F.sum(n).over(before).alias(f"{n}_before") for n in sums)).where(F.col(f"{next(iter(sums))}_before").isNotNull())


def running(parts: DataFrame, group: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """parts (of `ranged` by group and order) with the sums over each group up to each row, added across ranges."""
    within = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = parts.select("*", *(F.sum(c).over(within).alias(n) for n, c in sums.items()))
    joined = added.join(F.broadcast(_sums_before(parts, group, sums)), ["_part", group], "left")
    return joined.withColumns({n: F.col(n) + F.coalesce(f"{n}_before", F.lit(0)) for n in sums}).drop(*(f"{n}_before" for n in sums))


def marked_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 1), mark (digest of role and text), bytes (of the text) of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    mark = F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text).cast("binary"), 256)
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), mark.alias("mark"), F.octet_length(text).cast("long").alias("bytes"))
    order = ["turn", "mark", "_row"]
    parts = ranged(rows.withColumn("_row", F.monotonically_increasing_id()), ["conv_id", *order])
    return running(parts, "conv_id", order, {"pos": F.lit(1)}).select("conv_id", "pos", "mark", "bytes")


def rebuilt(turns: DataFrame, ids: DataFrame, base: Column, heads: Column, most: int) -> DataFrame:
    """conv_id, place, mark, bytes: the first `heads` turns (`most` at most) of conversation `base`, then a conversation's
    own turns after its first `heads`; base and heads are expressions over conv_id."""
    whose = ids.select("conv_id", base.alias("_base"), heads.alias("_heads"))
    first = turns.where(F.col("pos") <= most).select(F.col("conv_id").alias("_base"), "pos", "mark", "bytes")
    borrowed = first.join(whose, "_base").where(F.col("pos") <= F.col("_heads"))
    # places of own turns come after all borrowed ones
    own = turns.where(F.col("pos") > heads).withColumn("pos", F.col("pos") + most)
    return borrowed.select("conv_id", F.col("pos").alias("place"), "mark", "bytes").unionByName(own.select("conv_id", F.col("pos").alias("place"), "mark", "bytes"))


def _key(lanes: list[Column], depth: Column) -> Column:
    digest = F.sha2(F.concat_ws(",", depth.cast("string"), *(c.cast("string") for c in lanes)).cast("binary"), 256)
    return F.when(depth == 0, F.lit(ROOT)).otherwise(F.substring(digest, 1, 32))


def prefixes(turns: DataFrame) -> DataFrame:
    """turns: conv_id, place, mark, bytes.  conv_id, depth, key, parent, bytes of each prefix of each conversation."""
    parts = ranged(turns, ["conv_id", "place"])
    counted = running(parts, "conv_id", ["place"], {"depth": F.lit(1)})
    digest = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), "mark").cast("binary"), 256)
    own = {f"own{i}": F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(LANES)}
    # written: the window and the totals of the ranges both read it
    counted = spool(counted.withColumns(own).drop("mark"))
    summed = running(counted, "conv_id", ["place"], {f"sum{i}": F.col(f"own{i}") for i in range(LANES)})
    sums = [F.col(f"sum{i}") for i in range(LANES)]
    above = [F.col(f"sum{i}") - F.col(f"own{i}") for i in range(LANES)]
    return summed.select("conv_id", "depth", _key(sums, F.col("depth")).alias("key"), _key(above, F.col("depth") - 1).alias("parent"), "bytes")


def ends_digests(ends: DataFrame) -> DataFrame:
    """ends: key, conv_id.  key, ends_sha256 (of the ids in decimal, ascending, comma-joined).

    Ids are sorted in ranges and packed PACK to a row; a node's packs are streamed in order through one digest, which
    holds no more than a batch of packs however many conversations end there.
    """
    parts = ranged(ends, ["key", "conv_id"])
    number = F.row_number().over(Window.partitionBy("_part", "key").orderBy("conv_id"))
    packs = parts.withColumn("pack", F.floor((number - 1) / PACK)).groupBy("key", "_part", "pack").agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None
        for batch in batches:
            keys, found = [], []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key == current:
                    digest.update(b",")
                else:
                    if current is not None:
                        keys.append(current)
                        found.append(digest.hexdigest())
                    current, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())], names=["key", "ends_sha256"])
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

    streamed = packs.repartition("key").sortWithinPartitions("key", "_part", "pack").select("key", "ids")
    return streamed.mapInArrow(run, "key string, ends_sha256 string")


def roll_up(nodes: DataFrame, values: list[str]) -> DataFrame:
    """nodes: key, parent (null for roots) and values, written.  key and the values summed over each subtree, its top included."""
    sums = nodes.select("key", *values)
    up = nodes.where("parent IS NOT NULL").select("key", F.col("parent").alias("ptr"))
    while up.limit(1).count():
        handed = up.join(sums, "key").groupBy("ptr").agg(*(F.sum(v).alias(f"_{v}") for v in values)).withColumnRenamed("ptr", "key")
        sums = spool(sums.join(handed, "key", "left").select("key", *((F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values)))
        # the pointer of what one points to; those that reach a root are done
        jumped = lookup(up.withColumnRenamed("key", "_from"), "ptr", up.select(F.col("key").alias("ptr"), F.col("ptr").alias("_next")))
        up = spool(jumped.select(F.col("_from").alias("key"), F.col("_next").alias("ptr")))
    return sums


def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """turns: conv_id, place, mark, bytes; ids: conv_id of all conversations, also of those without turns.  One row a node:
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ids = spool(ids)
    all_, least = ids.agg(F.count("*"), F.min("conv_id")).first()
    steps = spool(prefixes(turns))
    last = steps.groupBy("conv_id").agg(F.max(F.struct("depth", "key")).getField("key").alias("key"))
    ends = ends_digests(ids.join(last, "conv_id", "left").select(F.coalesce("key", F.lit(ROOT)).alias("key"), "conv_id"))
    below = steps.groupBy("key").agg(F.min("parent").alias("parent"), F.min("depth").cast("long").alias("depth"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("bytes").alias("bytes"))
    top = ids.limit(1).select(F.lit(ROOT).alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(all_).cast("long").alias("n_convs"), F.lit(least).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("bytes"))
    nodes = spool(below.unionByName(top))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    whole = spool(nodes.join(children, "key", "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)), "n_leaves": F.col("n_children").isNull().cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")}))
    summed = roll_up(whole, ["n_leaves", "saved_tokens"])
    above = lookup(whole.select(F.col("key").alias("_key"), "parent"), "parent", nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    above = above.select(F.col("_key").alias("key"), "parent_conv_id")
    found = whole.drop("n_leaves", "saved_tokens").join(summed, "key").join(above, "key", "left").join(ends, "key", "left")
    none = hashlib.sha256().hexdigest()
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def shared_prefixes(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are."""
    turns = marked_turns(conversations)
    return trie(turns.withColumnRenamed("pos", "place"), turns.select("conv_id").distinct())


def shared_prefixes_of_rebuilt(conversations: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """The trie of rebuilt conversations: conversation c starts with the first h turns of c - c mod family (none if there is
    no such conversation) and goes on with its own after the first h; h = crc32(c in decimal) mod heads."""
    turns = spool(marked_turns(conversations))
    ids = spool(turns.select("conv_id").distinct())
    c = F.col("conv_id")
    h = F.crc32(c.cast("string").cast("binary")) % heads
    return trie(rebuilt(turns, ids, c - F.pmod(c, F.lit(family)), h, heads - 1), ids)
