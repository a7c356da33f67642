"""Molecule names: classes, chains, protected splitting, numeric keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASS, CARBONS, UNSATURATION = r"^([A-Za-z0-9]+ O-|[A-Za-z0-9]+)", r"(\d+):", r":(\d+)"


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def certain(name: Column) -> Column:
    """The name, or null if it is marked as uncertain."""
    return F.when(~name.endswith("_uncertain"), name)


def lipid_class(name: Column) -> Column:
    return _found(certain(name), CLASS)


def carbons(name: Column) -> Column:
    return _found(certain(name), CARBONS).try_cast("int")


def unsaturation(name: Column) -> Column:
    return _found(certain(name), UNSATURATION).try_cast("int")


def molecule_properties(df: DataFrame, name: str, colors: DataFrame | None = None) -> DataFrame:
    """df with class, carbons, unsaturation, their ratio and a colour (gray where the class has none)."""
    n = F.col(name)
    out = df.withColumns({"class": lipid_class(n), "carbons": carbons(n), "unsaturation": unsaturation(n)})
    out = out.withColumn("unsaturation_share", F.col("unsaturation") / F.nullif(F.col("carbons"), F.lit(0)))
    if colors is None:
        return out
    return out.join(F.broadcast(colors.select("class", "color")), "class", "left").withColumn("color", F.coalesce("color", F.lit("gray")))


def short_class(name: Column) -> Column:
    """The other class extractor: first word with an ether mark, else the first token."""
    found = _found(name, r"^([A-Za-z0-9]+(?:\s?O)?)[\s-]")
    return F.coalesce(found, F.get(F.split(name, " "), F.lit(0)))


def head_group(cls: Column) -> Column:
    """C, S, E, G, I or A of (lyso-)phospholipid classes, ether ones included."""
    return F.coalesce(_found(cls, r"^LP([CSEGIA])(?: O-)?$"), _found(cls, r"^P([CSEGIA])(?: O-)?$"))


def protected_split(text: Column) -> Column:
    """Parts between semicolons, trimmed; the ; of ";O2" does not split."""
    return F.transform(F.split(text, ";(?!O2)"), lambda p: F.trim(p))


def mz_key(mz: Column, digits: int = 6) -> Column:
    """The number as C prints it: rounded by its exact binary value, with the sign of -0; nan and inf; null of null."""
    @F.pandas_udf("string")
    def printed(x: pd.Series) -> pd.Series:
        return pd.Series([f"%.{digits}f" % v for v in x.tolist()], dtype=object)

    return F.when(mz.isNotNull(), printed(mz.cast("double")))


def safe_file_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")


def checksum(text: Column) -> Column:
    return F.md5(text.cast("binary"))
