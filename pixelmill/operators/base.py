"""What the operators share: guards, deterministic global order, and cutting lineage through the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def spool(df: DataFrame, *by: str) -> DataFrame:
    """Write df into the folder that driver and executors share and read it back; by: columns whose values get folders of
    their own, so that a filter on them reads no other rows."""
    spark: SparkSession = df.sparkSession
    path = _shared_path(spark)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spooled_buckets(df: DataFrame, key: str, count: int) -> DataFrame:
    """df, dealt by key to `count` partitions, in as many buckets: read back, it meets other rows so dealt without moving again."""
    spark: SparkSession = df.sparkSession
    path = _shared_path(spark)
    name = f"pixelmill_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(count, key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved while the name is there; the files stay without it
    spark.sql(f"DROP TABLE {name}")
    return out


def _shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted at exit."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="pixelmill-"))
    path = f"{context.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def unsent(df: DataFrame) -> DataFrame:
    """df, as a side of a join that grows with the input: it is sorted and merged.  Files of coordinates are so small against
    their rows that Spark would broadcast a table of any size through the driver."""
    return df.hint("merge")


def earlier():
    """The window over the summaries of all ranges before one's own; they are as many rows as there are partitions."""
    return Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def later():
    return Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)


def ranged(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df in ranges of keys, written once, with the range of each row (_part): what depends on the order of all rows then
    takes a window within each range and one summary row of each."""
    return spool(df.repartitionByRange(*[F.col(k) for k in keys]).withColumn("_part", F.spark_partition_id()))


def ordered_index(df: DataFrame, keys: Sequence[str], name: str = "index") -> DataFrame:
    """df with its 0-based place in the order of keys, without a window over all rows in one task.

    Rows are range-partitioned once and numbered within partitions; the offsets are one number per partition.
    """
    parts = ranged(df, keys)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_rows"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier()), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return parts.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + within - 1).drop("_part", "_offset")


def lookup(rows: DataFrame, key: str, unique: DataFrame, parts: int = 1000, total: int | None = None) -> DataFrame:
    """rows joined (inner) with unique, which holds each key once; rows must be cheap to read again.

    Keys that more than one row in `parts` holds are fewer than `parts`: what unique says of them is broadcast.  The rest
    meets by a shuffle in which no key is common.  total: how many rows there are, where that is known.
    """
    least = max((rows.count() if total is None else total) // parts, 1000)
    common = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > least).select(key).collect()
    if not common:
        return rows.join(unique, key)
    hot = F.broadcast(rows.sparkSession.createDataFrame(common, rows.select(key).schema))
    known = F.broadcast(unique.join(hot, key, "left_semi"))
    return rows.join(known, key).unionByName(rows.join(hot, key, "left_anti").join(unique, key))


def nan_to_null(value: Column) -> Column:
    return F.when(F.isnan(value), None).otherwise(value)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0))
