"""Order-dependent computations.  Windows without a partition run over summaries (features, zones, sections) only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import earlier, later, ranged, ratio
from .quantiles import exact_quantiles


def top_above(df: DataFrame, group: str, value: str, order: str, n: int = 3, threshold: float = 0.4) -> DataFrame:
    """Per group, rows at or above the threshold; if there are more than n, the n largest."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), order))
    return df.where(F.col(value) >= threshold).withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def running_q(df: DataFrame, pep: str, order: str) -> DataFrame:
    """q = running mean of the sorted error probabilities; nulls come first and do not count."""
    parts = ranged(df, [pep, order])
    sums = parts.groupBy("_part").agg(F.count(pep).alias("_n"), F.sum(pep).alias("_s"))
    offsets = sums.select("_part", F.coalesce(F.sum("_n").over(earlier()), F.lit(0)).alias("_n"), F.coalesce(F.sum("_s").over(earlier()), F.lit(0.0)).alias("_s"))
    so_far = Window.partitionBy("_part").orderBy(pep, order).rowsBetween(Window.unboundedPreceding, 0)
    q = ratio(F.col("_s") + F.coalesce(F.sum(pep).over(so_far), F.lit(0.0)), F.col("_n") + F.count(pep).over(so_far))
    return parts.join(F.broadcast(offsets), "_part").withColumn("q", q).drop("_part", "_n", "_s")


def benjamini_hochberg(df: DataFrame, p: str, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adjusted p values; nulls stay null and do not count."""
    if not keys:
        return _adjusted_over_all(df, p, order)
    own = Window.partitionBy(*keys, F.col(p).isNull())
    rank = F.row_number().over(own.orderBy(p, order))
    raw = df.withColumn("_raw", F.col(p) * F.count(p).over(own) / rank).withColumn("_rank", rank)
    back = Window.partitionBy(*keys, F.col(p).isNull()).orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("adjusted", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_raw").over(back)))).drop("_raw", "_rank")


def _adjusted_over_all(df: DataFrame, p: str, order: str) -> DataFrame:
    parts = ranged(df.where(F.col(p).isNotNull()), [p, order])
    offsets = parts.groupBy("_part").agg(F.count("*").alias("_rows")).select("_part", F.coalesce(F.sum("_rows").over(earlier()), F.lit(0)).alias("_offset"), F.sum("_rows").over(Window.partitionBy()).alias("_all"))
    rank = F.col("_offset") + F.row_number().over(Window.partitionBy("_part").orderBy(p, order))
    raw = parts.join(F.broadcast(offsets), "_part").withColumn("_rank", rank).withColumn("_raw", F.col(p) * F.col("_all") / F.col("_rank"))
    least = raw.groupBy("_part").agg(F.min("_raw").alias("_least")).select("_part", F.min("_least").over(later()).alias("_later"))
    back = Window.partitionBy("_part").orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = F.least(F.lit(1.0), F.min("_raw").over(back), F.coalesce("_later", F.lit(1.0)))
    known = raw.join(F.broadcast(least), "_part").withColumn("adjusted", adjusted).select(*df.columns, "adjusted")
    return known.unionByName(df.where(F.col(p).isNull()).withColumn("adjusted", F.lit(None).cast("double")))


def rank_sums(df: DataFrame, feature: str, group: str, value: str, a, b) -> DataFrame:
    """Per feature: sizes, rank sum and U of group a against b, with mean ranks for ties, and the tie term sum(t^3 - t).

    Values are counted first, so a window sorts distinct values, not rows: ties as hot as a third of all rows are one row.
    """
    rows = df.where(F.col(group).isin([a, b]) & F.col(value).isNotNull())
    counts = rows.groupBy(feature, value).agg(F.count_if(F.col(group) == a).alias("_a"), F.count_if(F.col(group) == b).alias("_b"))
    t = F.col("_a") + F.col("_b")
    below = F.coalesce(F.sum(t).over(Window.partitionBy(feature).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("_rank", below + (t + 1) / 2)
    out = ranked.groupBy(feature).agg(
        F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"), F.sum(F.col("_a") * F.col("_rank")).alias("rank_sum"),
        F.sum(F.pow(t.cast("double"), 3) - t).alias("ties"),
    )
    return out.withColumn("u", F.col("rank_sum") - F.col("n_a") * (F.col("n_a") + 1) / 2)


def cumulative_share(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Share of the sum of absolute values up to each row, largest first, and the place."""
    falling = Window.partitionBy(group).orderBy(F.desc(F.abs(value)), order)
    share = ratio(F.sum(F.abs(value)).over(falling.rowsBetween(Window.unboundedPreceding, 0)), F.sum(F.abs(value)).over(Window.partitionBy(group)))
    return df.withColumn("place", F.row_number().over(falling)).withColumn("share", share)


def knee(shares: DataFrame, group: str) -> DataFrame:
    """Per group, the place whose share is furthest above the chord from the first to the last point."""
    every = Window.partitionBy(group)
    n, first, last = F.max("place").over(every), F.min("share").over(every), F.max("share").over(every)
    chord = first + (last - first) * ratio((F.col("place") - 1).cast("double"), n - 1)
    return shares.withColumn("_rise", F.col("share") - F.coalesce(chord, first)).groupBy(group).agg(F.min_by("place", F.struct(-F.round("_rise", 9), "place")).alias("knee"))


def number_repeats(df: DataFrame, name: str, order: str) -> DataFrame:
    """Names that occur more than once get _1, _2, ... in order."""
    own = Window.partitionBy(name)
    k = F.row_number().over(own.orderBy(order))
    return df.withColumn("unique_name", F.when(F.count("*").over(own) > 1, F.concat(name, F.lit("_"), k.cast("string"))).otherwise(F.col(name)))


def number_later_repeats(df: DataFrame, name: str, order: str) -> DataFrame:
    """The first keeps its name, later ones get _1, _2, ..."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return df.withColumn("unique_name", F.when(k > 0, F.concat(name, F.lit("_"), k.cast("string"))).otherwise(F.col(name)))


def adjacent_axis(df: DataFrame, order: str, *values: str) -> DataFrame:
    """Cumulative distance from row to row in order, scaled to 0..1."""
    by = Window.orderBy(order)
    step = F.sqrt(sum((F.pow(F.col(v) - F.lag(v).over(by), 2) for v in values), F.lit(0.0)))
    out = df.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn("_sum", F.sum("_step").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("axis", F.coalesce(ratio(F.col("_sum"), F.max("_sum").over(Window.partitionBy())), F.lit(0.0))).drop("_step", "_sum")


def consecutive_sections(counts: DataFrame, group: str, section: str, n: str, least: int = 10, least_sections: int = 3) -> DataFrame:
    """Per group: sections with at least `least` pixels, whether two observed sections in a row are among them, and continuous."""
    by = Window.partitionBy(group).orderBy(section)
    marked = counts.withColumn("_on", F.col(n) >= least).withColumn("_next", F.lead("_on").over(by))
    out = marked.groupBy(group).agg(F.count_if("_on").alias("sections"), F.coalesce(F.bool_or(F.col("_on") & F.col("_next")), F.lit(False)).alias("consecutive"))
    return out.withColumn("continuous", (F.col("sections") > least_sections) & F.col("consecutive"))


def kernel(sigma: float = 1.8) -> list[tuple[int, float]]:
    """Offsets and weights of Gaussian smoothing, cut at 4 sigma."""
    radius = int(4 * sigma + 0.5)
    weights = [(d, 2.718281828459045 ** (-d * d / (2 * sigma * sigma))) for d in range(-radius, radius + 1)]
    total = sum(w for _, w in weights)
    return [(d, w / total) for d, w in weights]


def smoothed(counts: DataFrame, group: str, section: str, n: str, sigma: float = 1.8) -> DataFrame:
    """Gaussian smoothing over whole-numbered sections, zeros outside, kernel cut at 4 sigma; sections between the first and
    the last of a group are filled with 0."""
    grid = counts.groupBy(group).agg(F.explode(F.sequence(F.min(section), F.max(section))).alias(section))
    spread = counts.withColumn("_k", F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in kernel(sigma)))))
    spread = spread.select(group, (F.col(section) + F.col("_k.d")).alias(section), (F.col(n) * F.col("_k.w")).alias("_v"))
    return grid.join(spread, [group, section], "left").groupBy(group, section).agg(F.coalesce(F.sum("_v"), F.lit(0.0)).alias("smooth"))


def peaks(smooth: DataFrame, group: str, section: str) -> DataFrame:
    """Per group: number of local maxima of `smooth` and the height of the largest over the second (10 for one peak)."""
    by = Window.partitionBy(group).orderBy(section)
    up = F.col("smooth") > F.coalesce(F.lag("smooth").over(by), F.lit(0.0))
    down = F.col("smooth") > F.coalesce(F.lead("smooth").over(by), F.lit(0.0))
    tops = smooth.withColumn("_top", up & down).where("_top")
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("smooth"), section))
    tops = tops.withColumn("_place", place)
    out = tops.groupBy(group).agg(F.count("*").alias("peaks"), F.max(F.when(F.col("_place") == 1, F.col("smooth"))).alias("_1"), F.max(F.when(F.col("_place") == 2, F.col("smooth"))).alias("_2"))
    return out.select(group, "peaks", F.coalesce(ratio(F.col("_1"), F.col("_2")), F.lit(10.0)).alias("peak_ratio"))


def row_order_by_peak(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Rows by the column of their largest value (first on ties): the order that makes a heat-map diagonal."""
    best = df.groupBy(row).agg(F.min_by(column, F.struct(-F.col(value), F.col(column))).alias("peak"))
    return best.withColumn("place", F.row_number().over(Window.orderBy("peak", row)))


def argmax_channel(long: DataFrame, pixel: str, channel: str, value: str, section: str) -> DataFrame:
    """Each pixel with its largest channel, scaled by the 5 % and 95 % quantile of the winners of its section and channel."""
    won = long.groupBy(pixel, section).agg(F.min_by(F.struct(channel, value), F.struct(-F.col(value), F.col(channel))).alias("_w")).select(pixel, section, f"_w.{channel}", f"_w.{value}")
    ends = exact_quantiles(won, [section, channel], value, [0.05, 0.95])
    low, high = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    scaled = ratio(F.greatest(low, F.least(high, F.col(value))) - low, high - low)
    return won.join(ends, [section, channel]).withColumn("scaled", F.coalesce(scaled, F.lit(0.0))).drop("_q")


def section_split(sections: DataFrame, section: str, keys: Sequence[str] = ()) -> DataFrame:
    """train / val / test per section (of each of the keys): from five sections on, the 2nd of each five is test, the 3rd val (a val at the end stays in
    train); with three or four the 1st is val and the 2nd test; below that all is train (rows are then split by hash)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(section)) - 1
    n = F.count("*").over(Window.partitionBy(*keys))
    ranked = sections.select(*keys, section).distinct().withColumn("_i", place).withColumn("_n", n)
    i, many = F.col("_i"), F.col("_n") >= 5
    name = (
        F.when(many & (i % 5 == 2) & (i < F.col("_n") - 1), "val").when(many & (i % 5 == 1), "test")
        .when(~many & (F.col("_n") >= 3) & (i == 0), "val").when(~many & (F.col("_n") >= 3) & (i == 1), "test").otherwise("train")
    )
    return ranked.select(*keys, section, name.alias("part"))


def rank_extremes(df: DataFrame, value: str, order: str, n: int = 5) -> DataFrame:
    """The n smallest, the n largest and n of the others in the order of a hash; order names each row.  Each is a top-n."""
    low = df.orderBy(value, order).limit(n)
    high = df.orderBy(F.desc(value), order).limit(n).join(F.broadcast(low.select(order)), order, "left_anti")
    ends = low.withColumn("end", F.lit("low")).unionByName(high.withColumn("end", F.lit("high")))
    middle = df.join(F.broadcast(ends.select(order)), order, "left_anti").orderBy(F.xxhash64(order), order).limit(n)
    return ends.unionByName(middle.withColumn("end", F.lit("middle")))


def balanced_undersample(df: DataFrame, label: str, order: Sequence, keys: Sequence[str] = ()) -> DataFrame:
    """As many rows of each label as the rarest (of the same keys) has, in the order given."""
    place = F.row_number().over(Window.partitionBy(*keys, label).orderBy(*order))
    least = F.broadcast(df.groupBy(*keys, label).agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.min("_n").alias("_least")))
    placed = df.withColumn("_place", place)
    return (placed.join(least, list(keys)) if keys else placed.crossJoin(least)).where(F.col("_place") <= F.col("_least")).drop("_place", "_least")


def dense_codes(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """df with the 0-based place of its value among the sorted distinct values."""
    codes = df.select(column).distinct().where(F.col(column).isNotNull()).withColumn(name, F.row_number().over(Window.orderBy(column)) - 1)
    return df.join(codes, column, "left")
