"""Projections, filters and predicates over pixels and features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import nan_to_null, ordered_index, require_columns

#: Mean intensity at or below which a pixel is empty.
EMPTY = 0.00011


def flatten_images(images: DataFrame, image: str = "image") -> DataFrame:
    """Rows of images (array of arrays) as (other columns, x, y, value): one row per cell, coordinates from 1, missing cells dropped."""
    others = [c for c in images.columns if c != image]
    rows = images.select(*others, F.posexplode(image).alias("_row", "_cells"))
    cells = rows.select(*others, (F.col("_row") + 1).alias("x"), F.posexplode("_cells").alias("_col", "value"))
    return cells.select(*others, "x", (F.col("_col") + 1).alias("y"), nan_to_null(F.col("value")).alias("value")).where("value IS NOT NULL")


def delog(df: DataFrame, value: str = "value") -> DataFrame:
    return df.withColumn(value, F.exp(value))


def drop_empty_pixels(long: DataFrame, pixel: str = "pixel_id", value: str = "value", floor: float = EMPTY) -> DataFrame:
    """Keeps the pixels whose mean over features exceeds floor."""
    alive = long.groupBy(pixel).agg(F.avg(value).alias("_mean")).where(F.col("_mean") > floor).select(pixel)
    return long.join(alive, pixel, "left_semi")


def barcode(section: Column, x: Column, y: Column) -> Column:
    return F.format_string("section%d_pixel%d_%d", section, x, y)


def add_barcodes(pixels: DataFrame, section: str = "section_id", x: str = "x", y: str = "y") -> DataFrame:
    require_columns(pixels, section, x, y)
    return pixels.withColumn("barcode", barcode(F.col(section), F.col(x), F.col(y)))


def parse_barcode(code: Column) -> Column:
    """(section, x, y) of a barcode; null where it is none."""
    part = [F.regexp_extract(code, r"^section(\d+)_pixel(\d+)_(\d+)$", i).try_cast("int") for i in (1, 2, 3)]
    return F.when(part[0].isNotNull(), F.struct(part[0].alias("section"), part[1].alias("x"), part[2].alias("y")))


def filter_by_spec(df: DataFrame, column: str, operation: str, on_empty: str = "empty") -> DataFrame:
    """operation: "!=v" or "==v" compare as strings and drop nulls; anything else is an SQL condition on the column.

    on_empty: "empty" returns what is left; "all" returns df if nothing is left.
    """
    require_columns(df, column)
    text, op = F.col(column).cast("string"), operation.strip()
    if op.startswith("!="):
        condition = F.col(column).isNotNull() & (text != F.lit(op[2:].strip().strip("'\"")))
    elif op.startswith("=="):
        condition = F.col(column).isNotNull() & (text == F.lit(op[2:].strip().strip("'\"")))
    else:
        condition = F.expr(f"`{column}` {op}")
    kept = df.where(condition)
    return df if on_empty == "all" and kept.isEmpty() else kept


def normalise_keys(df: DataFrame, text: Sequence[str], whole: Sequence[str]) -> DataFrame:
    """Trims text keys and makes the others whole numbers (null where they are none)."""
    return df.withColumns({c: F.trim(F.col(c).cast("string")) for c in text} | {c: F.col(c).try_cast("int") for c in whole})


def crop(df: DataFrame, members: Mapping[str, Sequence] = {}, ranges: Mapping[str, tuple] = {}) -> DataFrame:
    """Rows whose columns are among the given members and within the given closed ranges."""
    for column, values in members.items():
        df = df.where(F.col(column).isin(list(values)))
    for column, (low, high) in ranges.items():
        df = df.where(F.col(column).between(low, high))
    return df


def ends_with_any(df: DataFrame, column: str, suffixes: Sequence[str]) -> DataFrame:
    condition = F.lit(False)
    for s in suffixes:
        condition |= F.col(column).endswith(s)
    return df.where(condition)


def without_substring(df: DataFrame, column: str, part: str = "_db") -> DataFrame:
    return df.where(~F.col(column).contains(part))


def every_kth(df: DataFrame, k: int, keys: Sequence[str]) -> DataFrame:
    """The 1st, (k+1)th, ... row in the order of keys."""
    return ordered_index(df, keys, "_index").where(F.col("_index") % k == 0).drop("_index")


def subset_features(features: DataFrame, wanted: DataFrame, key: str = "name", order: str = "feature_id") -> DataFrame:
    """Features among wanted, numbered anew from 0 in their old order."""
    kept = features.join(wanted.select(key).distinct(), key, "left_semi")
    return kept.withColumn("new_feature_id", F.row_number().over(Window.orderBy(order)) - 1)  # as many rows as features


def drop_low_variance(long: DataFrame, feature: str = "feature_id", value: str = "value", least: float = 1e-4) -> DataFrame:
    kept = long.groupBy(feature).agg(F.var_samp(value).alias("_var")).where(F.col("_var") >= least).select(feature)
    return long.join(kept, feature, "left_semi")


def half_section(pixels: DataFrame, section: str = "section_id", y: str = "y") -> DataFrame:
    """Pixels with y below the mean of their section."""
    means = pixels.groupBy(section).agg(F.avg(y).alias("_mean"))
    return pixels.join(means, section).where(F.col(y) < F.col("_mean")).drop("_mean")


def winsor_floor(value: Column, top: float = 1.0, floor: float = 1e-4) -> Column:
    """Values above top become the floor."""
    return F.when(value > top, floor).otherwise(value)
