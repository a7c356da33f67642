"""Grouped statistics: signals, variances of variances, crosstabs and enrichment, intraclass correlation, quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import ratio
from .quantiles import exact_quantiles


def total_signal(long: DataFrame, feature: str, section: str, value: str, inside: str) -> DataFrame:
    """Per feature, the sum over sections of the mean delogged signal x 1e6; pixels outside the mask count as 0."""
    signal = F.when(F.col(inside), F.exp(value)).otherwise(0.0) * 1e6
    return long.groupBy(feature, section).agg(F.avg(signal).alias("_mean")).groupBy(feature).agg(F.sum("_mean").alias("signal"))


def best_by(df: DataFrame, group: str, item: str, value: str, order: str) -> DataFrame:
    """Per group, the item of the largest value; ties go to the first in order."""
    return df.groupBy(group).agg(F.max_by(F.col(item), F.struct(F.col(value), -F.col(order))).alias(item))


def variance_of_variances(long: DataFrame, feature: str = "feature_id", section: str = "section_id", value: str = "value") -> DataFrame:
    """Per feature: mean and (population) variance over sections of the (population) variance within; score = mean - variance / 2."""
    inner = long.groupBy(feature, section).agg(F.var_pop(value).alias("_v"))
    outer = inner.groupBy(feature).agg(F.avg("_v").alias("mean_of_variances"), F.var_pop("_v").alias("variance_of_variances"))
    return outer.withColumn("score", F.col("mean_of_variances") - F.col("variance_of_variances") / 2)


def normalised_variance_rank(long: DataFrame, feature: str = "feature_id", section: str = "section_id", value: str = "value") -> DataFrame:
    """As variance_of_variances, both terms divided by their mean over features; with the rank by falling score."""
    v = variance_of_variances(long, feature, section, value)
    every = Window.partitionBy()  # as many rows as features
    score = ratio(F.col("mean_of_variances"), F.avg("mean_of_variances").over(every)) - ratio(F.col("variance_of_variances"), F.avg("variance_of_variances").over(every))
    return v.select(feature, score.alias("score")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), feature)))


def section_dropout(long: DataFrame, feature: str, section: str, value: str, floor: float = 0.00015, most: int = 4) -> DataFrame:
    """Per feature, in how many sections the mean is below floor; kept = fewer than `most`."""
    means = long.groupBy(feature, section).agg(F.avg(value).alias("_mean"))
    out = means.groupBy(feature).agg(F.count_if(F.col("_mean") < floor).alias("missing"))
    return out.withColumn("kept", F.col("missing") < most)


def cluster_gate(features: DataFrame, cluster: str, score: str, moran: str) -> DataFrame:
    """Per cluster sqrt(mean(score)^2 + 2 mean(moran)^2), kept if at or above the median."""
    gate = F.sqrt(F.pow(F.avg(score), 2) + 2 * F.pow(F.avg(moran), 2))
    out = features.groupBy(cluster).agg(gate.alias("gate"))
    return out.withColumn("kept", F.col("gate") >= F.percentile("gate", F.lit(0.5)).over(Window.partitionBy()))


def crosstab(df: DataFrame, a: str, b: str, least_a: int = 0, least_b: int = 0) -> DataFrame:
    """a, b, n over the whole grid of categories (zeros included); categories seen at most least_* times are left out."""
    counts = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    for c, least in ((a, least_a), (b, least_b)):
        if least:
            counts = counts.join(counts.groupBy(c).agg(F.sum("n").alias("_all")).where(F.col("_all") > least).select(c), c, "left_semi")
    grid = counts.select(a).distinct().crossJoin(F.broadcast(counts.select(b).distinct()))  # categories only
    return grid.join(counts, [a, b], "left").select(a, b, F.coalesce("n", F.lit(0)).alias("n"))


def fractions(table: DataFrame, a: str, b: str, n: str = "n") -> DataFrame:
    """p(a given b): each column of the crosstab divided by its sum."""
    return table.withColumn("fraction", ratio(F.col(n), F.sum(n).over(Window.partitionBy(b))))


def enrichment(table: DataFrame, a: str, b: str, n: str = "n") -> DataFrame:
    """Two-way enrichment of a crosstab: product of p(a|b) over its mean by a and p(b|a) over its mean by b."""
    by_a, by_b = Window.partitionBy(a), Window.partitionBy(b)
    out = table.withColumn("_p", ratio(F.col(n), F.sum(n).over(by_b))).withColumn("_q", ratio(F.col(n), F.sum(n).over(by_a)))
    return out.withColumn("enrichment", ratio(F.col("_p"), F.avg("_p").over(by_a)) * ratio(F.col("_q"), F.avg("_q").over(by_b))).drop("_p", "_q")


def enriched_names(table: DataFrame, a: str, b: str, threshold: float = 300.0, none: str = "Broad") -> DataFrame:
    """Per b: the names a whose enrichment exceeds the threshold, in order, joined by hyphens; else `none`."""
    hit = F.when(F.col("enrichment") > threshold, F.col(a))
    return table.groupBy(b).agg(F.array_join(F.array_sort(F.collect_list(hit)), "-").alias("_name")).select(b, F.when(F.col("_name") == "", none).otherwise(F.col("_name")).alias("name"))


def compare_parcellations(df: DataFrame, a: str, b: str, least_cell: int = 20, least_sum: float = 200) -> DataFrame:
    """Enrichment between two labellings; cells under least_cell count as 0, rows and columns must sum to more than least_sum."""
    table = enrichment(crosstab(df, a, b), a, b)
    table = table.withColumn("enrichment", F.when(F.col("n") < least_cell, 0.0).otherwise(F.col("enrichment")))
    table = table.withColumn("_a", F.sum("n").over(Window.partitionBy(a))).withColumn("_b", F.sum("n").over(Window.partitionBy(b)))
    return table.where((F.col("_a") > least_sum) & (F.col("_b") > least_sum)).drop("_a", "_b")


def centroids(long: DataFrame, zone: str, feature: str = "feature_id", value: str = "value") -> DataFrame:
    return long.groupBy(zone, feature).agg(F.avg(value).alias("mean"))


def modal(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value per group; ties go to the smallest."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))


def first_value(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(value))


def icc(df: DataFrame, subject: str, value: str, strata: Sequence[str] = ()) -> DataFrame:
    """ICC(1) by one-way ANOVA, per stratum if given; null for fewer than two subjects or a zero denominator.

    Both levels are plain grouped sums: nothing but (stratum, subject) statistics is shuffled twice.
    """
    keys = list(strata)
    x = F.col(value).cast("double")
    by = df.where(x.isNotNull()).groupBy(*keys, subject).agg(F.count("*").alias("_n"), F.avg(x).alias("_m"), F.var_pop(x).alias("_v"))
    total = _anova(by, keys)
    between = ratio(F.col("ssb"), F.col("subjects") - 1)
    within = ratio(F.col("ssw"), F.col("rows") - F.col("subjects"))
    out = total.withColumn("msb", between).withColumn("msw", within).withColumn("var_between", (F.col("msb") - F.col("msw")) / F.col("size"))
    return out.withColumn("icc", F.when(F.col("subjects") >= 2, ratio(F.col("var_between"), F.col("var_between") + F.col("msw")))).select(*keys, "subjects", "rows", "msb", "msw", "icc")


def _anova(by: DataFrame, keys: list[str]) -> DataFrame:
    """subjects, rows, mean size, sums of squares between and within of groups (_n, _m, _v); a weighted variance gives SSB."""
    grand = by.groupBy(*keys).agg((F.sum(F.col("_n") * F.col("_m")) / F.sum("_n")).alias("_grand"))
    joined = by.join(grand, keys) if keys else by.crossJoin(F.broadcast(grand))  # one row
    return joined.groupBy(*keys).agg(
        F.count("*").alias("subjects"), F.sum("_n").alias("rows"), F.avg("_n").alias("size"),
        F.sum(F.col("_n") * F.pow(F.col("_m") - F.col("_grand"), 2)).alias("ssb"), F.sum(F.col("_n") * F.col("_v")).alias("ssw"),
    )


def prevalence(long: DataFrame, zone: str, feature: str = "feature_id", value: str = "value", share: float = 0.8, least: float = 0.0001) -> DataFrame:
    """Per zone, how many features exceed `least` in more than `share` of its pixels."""
    fraction = long.groupBy(zone, feature).agg(F.avg((F.col(value) > least).cast("double")).alias("_f"))
    return fraction.groupBy(zone).agg(F.count_if(F.col("_f") > share).alias("features"))


def label_proportions(pairs: DataFrame, label: str, neighbour: str) -> DataFrame:
    """Share of each neighbour label among the neighbours of each label."""
    counts = pairs.groupBy(label, neighbour).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(label)))


def quantiles(long: DataFrame, keys: Sequence[str], value: str, points: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, q0.. in the order of points."""
    q = exact_quantiles(long, keys, value, points)
    return q.select(*keys, *(F.get("_q", F.lit(i)).alias(f"q{i}") for i in range(len(points))))


def section_quantile_medians(long: DataFrame, feature: str, section: str, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Per feature, the medians over sections of the low and high quantile within sections."""
    q = quantiles(long, [feature, section], value, [low, high])
    return q.groupBy(feature).agg(F.percentile("q0", F.lit(0.5)).alias("low"), F.percentile("q1", F.lit(0.5)).alias("high"))


def clip_scale(long: DataFrame, feature: str, value: str, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """value clipped to its feature's quantiles and scaled to 0..1 (null for a constant feature)."""
    q = quantiles(long, [feature], value, [low, high])
    clipped = F.greatest(F.col("q0"), F.least(F.col("q1"), F.col(value)))
    scaled = F.when(F.col(value).isNotNull(), ratio(clipped - F.col("q0"), F.col("q1") - F.col("q0")))
    return long.join(F.broadcast(q), feature).withColumn("scaled", scaled).drop("q0", "q1")  # one row per feature


def treemap(df: DataFrame, path: Sequence[str]) -> DataFrame:
    """Counts for each prefix of the path."""
    return df.rollup(*path).agg(F.count("*").alias("n"))


def histogram_2d(df: DataFrame, value: str, category: str, bins: int) -> DataFrame:
    """Counts by equal-width bin (left-closed; the last one closed) and category."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    place = F.least(F.lit(bins - 1), F.floor(ratio((F.col(value) - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo"))))
    return df.crossJoin(F.broadcast(ends)).select(F.coalesce(place, F.lit(0)).cast("long").alias("bin"), category).groupBy("bin", category).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts by width_bucket: 0 below low, bins + 1 from high."""
    return df.where(F.col(value).isNotNull()).groupBy(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).alias("bucket")).agg(F.count("*").alias("n"))


def min_max_zone_mean(long: DataFrame, zone: str, feature: str, value: str) -> DataFrame:
    """Zone means of values scaled to 0..1 by feature (0 for a constant feature)."""
    ends = long.groupBy(feature).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return long.join(F.broadcast(ends), feature).groupBy(zone, feature).agg(F.avg(scaled).alias("mean"))


def extents(df: DataFrame, keys: Sequence[str], *columns: str) -> DataFrame:
    return df.groupBy(*keys).agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))))


def unique_mapping(df: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct (key, value); raises if a key has several values."""
    if not df.groupBy(key).agg(F.count_distinct(value).alias("_n")).where("_n > 1").isEmpty():
        raise ValueError(f"{value} is not unique within {key}")
    return df.select(key, value).distinct()


def standardise_columns(long: DataFrame, feature: str, value: str) -> DataFrame:
    """z by feature with the population deviation; a constant feature is divided by 1."""
    s = long.groupBy(feature).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = (F.col(value) - F.col("_m")) / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))
    return long.join(F.broadcast(s), feature).withColumn("z", z).drop("_m", "_s")


def standardise_rows(long: DataFrame, pixel: str, value: str, slack: float = 1e-8) -> DataFrame:
    s = long.groupBy(pixel).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return long.join(s, pixel).withColumn("z", (F.col(value) - F.col("_m")) / (F.col("_s") + slack)).drop("_m", "_s")


def voxel_mean(points: DataFrame, i: Column, j: Column, k: Column, value: Column) -> DataFrame:
    """Mean log value by whole voxel; values that are not positive have no log and are left out."""
    cells = points.select(i.cast("int").alias("i"), j.cast("int").alias("j"), k.cast("int").alias("k"), F.when(value > 0, F.ln(value)).alias("_v"))
    return cells.groupBy("i", "j", "k").agg(F.avg("_v").alias("mean"))


def draw_summary(draws: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    p = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    out = draws.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), p.alias("_p"))
    return out.select(*keys, "mean", "sd", F.get("_p", F.lit(0)).alias("low"), F.get("_p", F.lit(1)).alias("high"))


def nonzero(long: DataFrame, key: str, value: str) -> DataFrame:
    return long.groupBy(key).agg(F.count_if(F.col(value) != 0).alias("nonzero"), F.avg((F.col(value) != 0).cast("double")).alias("fraction"))


def cell_means(df: DataFrame, section: str, supertype: str, value: str) -> DataFrame:
    """n, mean and sums of value and its square per (section, supertype): sufficient for a Gaussian model."""
    x = F.col(value)
    return df.groupBy(section, supertype).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.sum(x).alias("sum"), F.sum(x * x).alias("sum_squares"))
