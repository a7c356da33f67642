"""Exact quantiles of groups of any size, by selection.

`percentile` holds the distinct values of a group in one task; that is right for small groups.  Of a group with more rows
than HELD the values at the wanted ranks are selected: each pass counts the rows of BINS bins between the bounds so far
and keeps, for each rank, the bin that it falls into, with that bin's least and greatest value as the new bounds, until
few rows are left between them.  Rows are never shuffled or sorted, only counts are; groups of more than HELD rows are
fewer than rows / HELD, so what is known of them is broadcast."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import spool

HELD, BINS = 1 << 22, 256


def _marked(rows: DataFrame, keys: Sequence[str], state: DataFrame) -> DataFrame:
    """The rows between the bounds of each rank of their group, with what is known of it."""
    named = state.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), "_rank", "_lo", "_hi", "_before")
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    between = (F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi"))
    return rows.join(F.broadcast(named), reduce(lambda a, b: a & b, same, between)).drop(*(f"_key{i}" for i in range(len(keys))))


def _selected(rows: DataFrame, keys: Sequence[str], large: DataFrame, shares: Sequence[float], held: int) -> DataFrame:
    """keys, _rank, _value: the values at the ranks (from 0) that the shares of each large group need."""
    needed = [x for s in shares for at in [F.lit(s) * (F.col("_n") - 1)] for x in (F.floor(at), F.ceil(at))]
    state = spool(large.select(*keys, F.explode(F.array_distinct(F.array(*needed))).alias("_rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_before"), "_n"))
    own = Window.partitionBy(*keys, "_rank")
    wide = (F.col("_n") > held) & (F.col("_lo") < F.col("_hi"))
    while True:
        todo = state.where(wide)
        if todo.isEmpty():
            break
        place = F.when(F.col("_x") == F.col("_hi"), BINS - 1).otherwise(F.least(F.lit(BINS - 1), F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS)))
        bins = _marked(rows, keys, todo).groupBy(*keys, "_rank", "_before", place.alias("_bin")).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        so_far = F.col("_before") + F.sum("_n").over(own.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
        within = bins.withColumn("_end", so_far).where((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_n")))
        narrowed = within.select(*keys, "_rank", "_lo", "_hi", (F.col("_end") - F.col("_n")).alias("_before"), "_n")
        state = spool(narrowed.unionByName(state.where(~wide)))
    counts = _marked(rows, keys, state).groupBy(*keys, "_rank", "_before", "_x").agg(F.count("*").alias("_n"))
    so_far = F.col("_before") + F.sum("_n").over(own.orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("_end", so_far).where((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_n"))).select(*keys, "_rank", F.col("_x").alias("_value"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], name: str = "_q", held: int | None = None) -> DataFrame:
    """keys and an array of the quantiles at the shares (0 to 1), interpolated between neighbours.

    Nulls and values that are not numbers do not count; a group without others has no row; null keys are a group."""
    held = held or HELD
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x)).select(*keys, x.alias("_x"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    if not keys:
        sizes = sizes.where("_n > 0")
    large = spool(sizes.where(F.col("_n") > held))
    points = F.array(*(F.lit(float(s)) for s in shares))
    if large.isEmpty():
        return rows.groupBy(*keys).agg(F.percentile("_x", points).alias(name)).where(F.col(name).isNotNull())
    groups = F.broadcast(large.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.lit(1).alias("_one")))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)), F.col("_one") == 1)
    small = rows.join(groups, same, "left_anti").groupBy(*keys).agg(F.percentile("_x", points).alias(name)).where(F.col(name).isNotNull())
    found = _selected(rows, keys, large, shares, held).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_values"))
    named = large.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), "_n")
    whole = found.join(F.broadcast(named), reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)), F.lit(True)))

    def at(share: float) -> Column:
        place = F.lit(share) * (F.col("_n") - 1)
        low, high = F.element_at("_values", F.floor(place)), F.element_at("_values", F.ceil(place))
        return F.when(F.floor(place) == F.ceil(place), low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return small.unionByName(whole.select(*keys, F.array(*(at(float(s)) for s in shares)).alias(name)))
