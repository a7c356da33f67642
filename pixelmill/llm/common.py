"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Bytes that are written to a shipped file at once.
PIECE = 4 << 20
#: bytes.translate table for lower-casing A-Z only.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (tests) one of our own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="pixelmill-"))
    return context.getCheckpointDir()


def spool(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spool-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession, content: Iterable[bytes | memoryview]) -> str:
    """Writes a file of the shared folder that Spark fetches once an executor (also for new ones); its name, by which
    SparkFiles finds it in a task.  The caller checks its size."""
    name = f"shipped-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(at)
    for part in content:
        view = memoryview(part).cast("B")
        for i in range(0, len(view), PIECE):
            out.write(bytearray(view[i:i + PIECE]))
    out.close()
    files.deleteOnExit(at)
    spark.sparkContext.addFile(files.makeQualified(at).toString())
    return name


def ship_arrays(spark: SparkSession, arrays: Sequence[np.ndarray]) -> tuple[str, list[tuple[str, int, int]]]:
    """Arrays of one dimension as such a file; its name, and dtype, length and place of each for `mapped`."""
    layout, at, content = [], 0, []
    for a in arrays:
        layout.append((a.dtype.str, len(a), at))
        content += [np.ascontiguousarray(a).data, bytes(-a.nbytes % 8)] if len(a) else []
        at += a.nbytes + -a.nbytes % 8
    return ship(spark, content), layout


def mapped(name: str, layout: Sequence[tuple[str, int, int]]) -> list[np.ndarray]:
    """In a task: the arrays, mapped from the executor's one copy of the file; workers share its pages."""
    path = SparkFiles.get(name)
    return [np.memmap(path, dtype, "r", at, (n,)) if n else np.zeros(0, dtype) for dtype, n, at in layout]


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def literal_array(values: list, kind: str) -> Column:
    """An array constant, made in one call and folded by the optimizer; values hold no comma."""
    if not values:
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def col(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def cols(names: Sequence[str]) -> list[Column]:
    return [col(n) for n in names]


def shelved(keep: Sequence[str]) -> tuple[list[str], list[Column], list[Column]]:
    """Plain names for kept columns of any name, the columns under them, and the columns back under their own names:
    functions over Arrow batches look columns up by unquoted names."""
    plain = [f"_kept{i}" for i in range(len(keep))]
    return plain, [col(k).alias(p) for k, p in zip(keep, plain)], [F.col(p).alias(k) for k, p in zip(keep, plain)]


def extended(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of df, whatever its names and types, and the columns of ddl behind it."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def require_free(keep: Sequence[str], own: Sequence[str]) -> None:
    """Raises ValueError where kept columns clash with each other or with an operator's own."""
    names = [n.lower() for n in (*keep, *own)]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"columns clash: {', '.join(twice)}")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not use."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus = 2; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == 2
