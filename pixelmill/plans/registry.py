"""Registration of queries, and the relations that they share, in DataFrame and in SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name; sql gives the same rows in DuckDB."""
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixel_id, section_id, zone, feature_id, value from embeddings."""
    e = table(spark, sf_dir, "embeddings")
    flat = e.select(F.col("vec_id").alias("pixel_id"), (F.col("vec_id") % 5).alias("section_id"), F.col("label").cast("long").alias("zone"), F.posexplode("embedding").alias("feature_id", "value"))
    return flat.select("pixel_id", "section_id", "zone", F.col("feature_id").cast("long").alias("feature_id"), F.col("value").cast("double").alias("value"))


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """section_id, x, y, label, price, size, part_id from part: a grid 50 wide."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select(F.lit(0).alias("section_id"), (k % 50).alias("x"), F.floor(k / 50).alias("y"), F.col("p_type").alias("label"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"), k.alias("part_id"))


EMB = "emb AS (SELECT vec_id AS pixel_id, vec_id % 5 AS section_id, CAST(label AS BIGINT) AS zone, unnest(range(0, CAST(len(embedding) AS BIGINT))) AS feature_id, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"
LAT = "lat AS (SELECT 0 AS section_id, p_partkey % 50 AS x, p_partkey // 50 AS y, p_type AS label, p_retailprice AS price, p_size AS size, p_partkey AS part_id FROM part)"
OFF4 = "off4(dx, dy) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1))"
OFF8 = "off8(dx, dy) AS (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))"


def r(column: str, digits: int = 6):
    """A rounded double, under its own name."""
    return F.round(F.col(column).cast("double"), digits).alias(column)


def n(column: str):
    return F.col(column).cast("long").alias(column)
