"""Sampled splitters: size-weighted key samples give quantile boundaries; records are range-partitioned by them.

The key of a record is (hash of its text, its id), so equal texts are neighbours.  A boundary is moved to the start
of its group of equal texts, unless the group fills more than SPLIT ranges: such an overfull group is subdivided by id.
Ranges that are still overfull after exact counting are sampled again and subdivided.  The exact sizes of the ranges
(a few thousand numbers, bounded by parameters) then decide which run of ranges makes which shard.

All work on records is DataFrame expressions.  Texts are read but never shuffled: `assign` needs no shuffle at all.

Defined cases: a null text has size 1 and checksum 0; repeated rows stay together and get slots of their own; an empty
table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import literal_array, spool

#: A group of equal texts is subdivided if it fills more ranges than this (a thirtieth of a shard with the defaults).
SPLIT = 4
#: Sorts after every key that begins with the same hash.
AFTER = "~"


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def key_of(record_id: Column, text: Column) -> Column:
    return F.concat(F.lpad(F.hex(F.xxhash64(text)), 16, "0"), F.lpad(F.hex(F.xxhash64(record_id)), 16, "0"), F.lit("."), F.coalesce(record_id.cast("string"), F.lit("")))


def range_of(key: Column, boundaries: list[str]) -> Column:
    """How many boundaries are at or below key, by binary search in an array constant."""
    top = 1
    while top <= len(boundaries):
        top *= 2
    padded = literal_array(boundaries + ["\x7f"] * (top - 1 - len(boundaries)), "string")
    steps = [1 << i for i in reversed(range(top.bit_length() - 1))]
    if not steps:
        return F.lit(0)
    return F.aggregate(literal_array(steps, "int"), F.lit(0), lambda low, step: F.when(F.element_at(padded, low + step) <= key, low + step).otherwise(low))


@dataclass
class ShardPlan:
    boundaries: list[str]
    shard_of_range: list[int]
    slot_of_range: list[int]
    shard_bytes: list[int]

    def assign(self, df: DataFrame, key: Column, name: str = "shard") -> DataFrame:
        """df with the shard of each record; no shuffle."""
        return df.withColumn(name, F.element_at(literal_array(self.shard_of_range, "int"), range_of(key, self.boundaries) + 1))


def _boundaries(records: DataFrame, ranges: int, samples: int) -> list[str]:
    """Boundaries that cut records (key, size) into about `ranges` parts of equal size; about `samples` sampled rows reach the driver."""
    total = records.agg(F.sum("size")).first()[0] or 0
    if total == 0 or ranges < 2:
        return []
    at = (F.xxhash64(F.lit("sample"), "key").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52)))
    points = F.floor(F.col("size") * F.lit(samples / total) + at)
    drawn = sorted((r[0], r[1]) for r in records.select("key", points.alias("points")).where("points > 0").collect())
    weight, cut, cuts = sum(w for _, w in drawn), 1, []
    so_far = 0
    for key, points in drawn:
        so_far += points
        while cut < ranges and so_far * ranges >= cut * weight:
            cuts.append(key)
            cut += 1
    groups = {}
    for key in cuts:
        groups.setdefault(key[:16], []).append(key)
    out = set()
    for group, keys in groups.items():
        out.add(group)
        if len(keys) > 1:  # a group of equal texts that fills a range is one of its own
            out.add(group + AFTER)
        if len(keys) > SPLIT:  # one that fills several is subdivided
            out.update(keys)
    return sorted(out)


def plan_shards(records: DataFrame, shards: int = 8, ranges_per_shard: int = 128, samples_per_range: int = 24, overfull: float = 8.0, rounds: int | None = None) -> ShardPlan:
    """records: key string, size long.  Overfull ranges are subdivided until none is left or none can be cut (or for `rounds`).  At most ranges_per_shard * shards * samples_per_range sampled keys reach the driver in a round."""
    ranges = shards * ranges_per_shard
    boundaries = _boundaries(records, ranges, ranges * samples_per_range)

    def sizes() -> dict[int, tuple[int, int]]:
        rows = records.groupBy(range_of(F.col("key"), boundaries).alias("range")).agg(F.sum("size"), F.count("*")).collect()
        return {r[0]: (r[1], r[2]) for r in rows}

    found = sizes()
    total = sum(b for b, _ in found.values())
    done = 0
    while rounds is None or done < rounds:
        done += 1
        large = [r for r, (b, n) in found.items() if b * ranges > overfull * total and n > 1]
        if not large:
            break
        inside = records.where(range_of(F.col("key"), boundaries).isin(large))
        share = sum(found[r][0] for r in large) * ranges // total + 1
        more = [b for b in _boundaries(inside, 4 * share, 4 * share * samples_per_range)]
        # a group of equal texts inside an overfull range may be cut by id as well
        merged = sorted({*boundaries, *more})
        if merged == boundaries:
            break
        boundaries = merged
        found = sizes()
    shard_of_range, slot_of_range, shard_bytes, rows_in, so_far = [], [], [0] * shards, [0] * shards, 0
    for r in range(len(boundaries) + 1):
        b, n = found.get(r, (0, 0))
        shard = min(shards - 1, (2 * so_far + b) * shards // (2 * total)) if total else 0
        shard_of_range.append(shard)
        slot_of_range.append(rows_in[shard])
        shard_bytes[shard] += b
        rows_in[shard] += n
        so_far += b
    return ShardPlan(boundaries, shard_of_range, slot_of_range, shard_bytes)


def shard_of_key(plan: ShardPlan, key: str) -> int:
    """The shard of one key, on the driver (a new record goes where its neighbours are)."""
    return plan.shard_of_range[bisect_right(plan.boundaries, key)]


def slots(records: DataFrame, plan: ShardPlan) -> DataFrame:
    """records with shard and slot, gapless from 0 in each shard; sorts each range apart from the others."""
    order = Window.partitionBy("range").orderBy("key")
    ranged = records.withColumn("range", range_of(F.col("key"), plan.boundaries))
    return ranged.select(
        "*",
        F.element_at(literal_array(plan.shard_of_range, "int"), F.col("range") + 1).alias("shard"),
        (F.element_at(literal_array(plan.slot_of_range, "long"), F.col("range") + 1) + F.row_number().over(order) - 1).alias("slot"),
    )


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard, slot of each row of docs; shards are near equal in bytes."""
    text = F.col(text_col)
    records = spool(docs.select(
        F.col(id_col), size_of(text).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        key_of(F.col(id_col), text).alias("key"),
    ))
    plan = plan_shards(records, shards)
    return slots(records, plan).select(id_col, "size", "text_crc32", "shard", "slot")
