"""Lookups, semi-joins, nearest and range joins, grid joins, and the union of columns.

No operator here is a theta join: nearest and range joins meet in bins, grid neighbours by exploded offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import ordered_index, unsent

FOUR = ((1, 0), (-1, 0), (0, 1), (0, -1))
EIGHT = tuple((dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy)
#: Half of them: with their opposites they are all eight.
HALF = EIGHT[4:]
#: Masses of the adducts Na, K, H, NH4 (fixed values).
ADDUCTS = (22.989769, 38.963707, 1.007825, 18.033823)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last one in the order given."""
    others = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_last"))
    return picked.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in others))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    others = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_first"))
    return picked.select(*keys, *(F.col(f"_first.{c}").alias(c) for c in others))


def attach_section_metadata(pixels: DataFrame, sections: DataFrame, key: str = "section_id") -> DataFrame:
    return pixels.join(sections, key, "left")


def attach_metadata(pixels: DataFrame, metadata: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Pixels that metadata knows, with the columns they lack; of rows with one key the last in order wins."""
    new = [c for c in metadata.columns if c not in pixels.columns]
    known = last_per_key(metadata.select(*dict.fromkeys([*keys, *new, *order])), list(keys), list(order))
    return pixels.join(known.select(*keys, *new), list(keys))


def attach_programs(pixels: DataFrame, programs: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "programs", check_unique: bool = True) -> DataFrame:
    """Pixels with a program vector; rows without one go.  Raises if a key of programs is not unique."""
    if check_unique and not programs.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("keys of the program table are not unique")
    vectors = programs.select(*keys, F.array(*(F.col(c).cast("double") for c in columns)).alias(name))
    return pixels.join(vectors, list(keys))


def attach_modality(pixels: DataFrame, modality: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "modality") -> DataFrame:
    """All pixels with a vector; a pixel without one gets a vector of nulls."""
    vectors = modality.select(*keys, F.array(*(F.col(c).cast("double") for c in columns)).alias(name))
    empty = F.array_repeat(F.lit(None).cast("double"), len(columns))
    return pixels.join(vectors, list(keys), "left").withColumn(name, F.coalesce(name, empty))


def aligned_modality(pixels: DataFrame, modality: DataFrame, key: str = "pixel_id", complete: bool = False) -> DataFrame:
    """Pixels with the columns of another omic layer; unmatched ones get nulls, or raise ValueError if it must be complete."""
    if complete and not pixels.join(modality.select(key), key, "left_anti").isEmpty():
        raise ValueError(f"the layer lacks values of {key}")
    return pixels.join(modality.select(key, *(c for c in modality.columns if c not in pixels.columns)), key, "left")


def merge_columns(left: DataFrame, right: DataFrame, key: str = "pixel_id", same_rows: bool = False) -> DataFrame:
    """left with the columns that only right has.  With same_rows both must hold the same keys, each once; ValueError if not."""
    if same_rows:
        sides = left.groupBy(key).agg(F.count("*").alias("_l")).join(right.groupBy(key).agg(F.count("*").alias("_r")), key, "full")
        if not sides.where("_l IS NULL OR _r IS NULL OR _l > 1 OR _r > 1").isEmpty():
            raise ValueError(f"the tables do not hold the same rows by {key}")
    return left.join(right.select(key, *(c for c in right.columns if c not in left.columns)), key, "left")


def transpose(wide: DataFrame, key: str, columns: Sequence[str], name: str = "column") -> DataFrame:
    """A row for each of the columns, a column for each key (in order; keys are few): small summaries only."""
    keys = [r[0] for r in wide.select(key).distinct().orderBy(key).collect()]
    long = wide.select(key, *(F.col(c).cast("double") for c in columns)).unpivot(key, list(columns), name, "_value")
    return long.groupBy(name).pivot(key, keys).agg(F.first("_value"))


def transfer_labels(df: DataFrame, labels: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """df with the columns of the first complete row of labels for its key."""
    complete = labels.dropna()
    return df.join(first_per_key(complete, [key], list(order)), key, "left")


def members(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys, list(on), "left_semi")


def complement(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys, list(on), "left_anti")


def lookup(df: DataFrame, table: DataFrame, on: Sequence[str], column: str, default) -> DataFrame:
    """df with a column of table, the default where there is none."""
    return df.join(table.select(*on, column), list(on), "left").withColumn(column, F.coalesce(column, F.lit(default)))


def nearest(peaks: DataFrame, reference: DataFrame, peak: str, mass: str, order: str, ppm: float = 5.0, at_mass: float = 800.0) -> DataFrame:
    """Each peak with its nearest reference within the constant window at_mass * ppm / 1e6; ties go to the first in order.

    Both sides meet in bins as wide as the window: an equi-join, and a residual predicate.  Adds ppm_error, relative to the
    reference mass; peaks without a match keep nulls.
    """
    width = at_mass * ppm / 1e6
    bins = F.explode(F.array(*(F.floor(F.col(peak) / width) + d for d in (-1, 0, 1))))
    left = peaks.withColumn("_bin", bins)
    right = reference.withColumn("_bin", F.floor(F.col(mass) / width))
    close = left.join(right, "_bin").withColumn("_off", F.abs(F.col(peak) - F.col(mass))).where(F.col("_off") <= width)
    own = [c for c in reference.columns]
    best = close.groupBy(peak).agg(F.min_by(F.struct(*own), F.struct("_off", order)).alias("_best"))
    picked = best.select(peak, *(F.col(f"_best.{c}").alias(c) for c in own))
    error = 1e6 * F.abs(F.col(peak) - F.col(mass)) / F.col(mass)
    return peaks.join(picked, peak, "left").withColumn("ppm_error", error)


def within_ppm(peaks: DataFrame, reference: DataFrame, peak: str, mass: str, ppm: float = 5.0, largest: float = 2000.0) -> DataFrame:
    """All pairs with |mass - peak| <= peak * ppm / 1e6.  largest bounds peak and so the width of a bin; each peak looks in
    every bin that its window touches, so wider peaks are found as well."""
    width = largest * ppm / 1e6
    low, high = F.col(peak) - F.col(peak) * ppm / 1e6, F.col(peak) + F.col(peak) * ppm / 1e6
    left = peaks.withColumn("_bin", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    right = reference.withColumn("_bin", F.floor(F.col(mass) / width))
    return left.join(right, "_bin").where(F.col(mass).between(low, high)).drop("_bin")


def adduct_masses(mz: Column) -> Column:
    return F.array(*(mz - a for a in ADDUCTS))


def neighbours(pixels: DataFrame, offsets=FOUR, section: str = "section_id", x: str = "x", y: str = "y", label: str = "label") -> DataFrame:
    """section, x, y, label of each pixel and nb_label of each of its neighbours on the grid."""
    steps = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets)))
    left = pixels.select(section, x, y, label, steps.alias("_step"))
    left = left.select(section, x, y, label, (F.col(x) + F.col("_step.dx")).alias("_x"), (F.col(y) + F.col("_step.dy")).alias("_y"))
    right = pixels.select(section, F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(label).alias(f"nb_{label}"))
    return left.join(unsent(right), [section, "_x", "_y"]).drop("_x", "_y")


def first_abundant(annotated: DataFrame, fractions: DataFrame, key: str, names: str, name: str, fraction: str, threshold: float = 0.8) -> DataFrame:
    """annotated with `chosen`: of its names (array) that the table of fractions knows, the first whose fraction exceeds the
    threshold; else all names joined by commas."""
    flat = annotated.select(key, F.posexplode(names).alias("_pos", name)).join(fractions.select(name, fraction), name)
    picked = flat.where(F.col(fraction) > threshold).groupBy(key).agg(F.min_by(name, "_pos").alias("chosen"))
    out = annotated.join(picked, key, "left")
    return out.withColumn("chosen", F.coalesce("chosen", F.array_join(names, ",")))


def inverted_index(annotated: DataFrame, key: str, names: str, name: str) -> DataFrame:
    """name, keys: the sorted keys that carry each name."""
    return annotated.select(key, F.explode(names).alias(name)).groupBy(name).agg(F.array_sort(F.collect_set(key)).alias("keys"))


def aligned_pairs(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Q-Q pairs: the sorted values of both sides by rank; each side is numbered in ranges."""
    def ranked(df: DataFrame, name: str) -> DataFrame:
        return ordered_index(df.select(F.col(value).alias(name)), [name], "_index").select((F.col("_index") + 1).alias("rank"), name)
    return ranked(a, "a").join(ranked(b, "b"), "rank")


def attach_database(molecules: DataFrame, database: DataFrame, key: str = "inchi_key", other: str = "inchikey", identifier: str = "dbid") -> DataFrame:
    """All molecules with the columns of a second molecule database by structure key.  Keys meet without the prefix
    "InChIKey=" and without regard to case; of several entries with one key the first identifier counts; a molecule
    without a key gets nulls."""
    def plain(name: str) -> Column:
        return F.nullif(F.upper(F.regexp_replace(F.trim(name), "(?i)^InChIKey=", "")), F.lit(""))

    named = database.select(plain(other).alias("_key"), *(F.col(c) for c in database.columns if c != other)).where("_key IS NOT NULL")
    return molecules.withColumn("_key", plain(key)).join(first_per_key(named, ["_key"], [identifier]), "_key", "left").drop("_key")
