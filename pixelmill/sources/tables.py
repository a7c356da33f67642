"""Reading and writing: section images, metadata, molecule files, whole datasets."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Properties that are read from a molecule file (fixed names).
MOLECULE_TAGS = ("LM_ID", "NAME", "SYSTEMATIC_NAME", "CATEGORY", "MAIN_CLASS", "EXACT_MASS", "ABBREVIATION", "INCHI_KEY")
IMAGES = T.StructType([T.StructField("mz_key", T.StringType()), T.StructField("section_id", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField("log_value", T.DoubleType())])


def read_images(spark: SparkSession, path: str, features: int | None = None) -> DataFrame:
    """Long intensity table; the first `features` keys in string order if given."""
    images = spark.read.schema(IMAGES).parquet(path)
    if features is None:
        return images
    keys = images.select("mz_key").distinct().orderBy("mz_key").limit(features)
    return images.join(F.broadcast(keys), "mz_key", "left_semi")


def within_mask(images: DataFrame, mask: DataFrame) -> DataFrame:
    """Cells that the mask table (section_id, x, y, inside) marks as inside."""
    return images.join(mask.where("inside").select("section_id", "x", "y"), ["section_id", "x", "y"], "left_semi")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def read_molecules(spark: SparkSession, path: str) -> DataFrame:
    """Records of an SD file (separated by $$$$) with MOLECULE_TAGS as columns; a missing tag is null."""
    records = spark.read.text(path, lineSep="$$$$").where(F.trim("value") != "")
    def tag(name: str):
        return F.nullif(F.trim(F.regexp_extract("value", rf">\s*<{name}>[^\n]*\n([^\n]*)", 1)), F.lit("")).alias(name.lower())
    return records.select(*map(tag, MOLECULE_TAGS)).where("lm_id IS NOT NULL")


def save_dataset(tables: dict[str, DataFrame], path: str, partition: dict[str, list[str]] | None = None) -> None:
    """Tables as Parquet in one folder with a manifest, written last: a folder without it is not complete."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        keys = (partition or {}).get(name)
        (writer.partitionBy(*keys) if keys else writer).parquet(f"{path}/{name}")
    manifest = json.dumps({"tables": sorted(tables)})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_manifest.d")


#: Folders of the stages of an analysis, behind its name (fixed names).
STAGES = {"preprocessed": "msi_preprocessed", "embedding": "msi_embedding", "clustering": "msi_clustering", "postprocessing": "msi_postprocessing"}


def stage_folder(folder: str, analysis: str, stage: str) -> str:
    if stage not in STAGES:
        raise ValueError(f"a stage is one of {', '.join(STAGES)}")
    return f"{folder}/{analysis}_{STAGES[stage]}"


def save_stage(tables: dict[str, DataFrame], folder: str, analysis: str, stage: str, vectors: dict[str, tuple[DataFrame, str, str]] | None = None) -> str:
    """A stage's dataset under its default name; vectors: name -> (table, key, column of arrays), saved as tables of their
    own with the length that all of them must have.  Returns the folder."""
    path = stage_folder(folder, analysis, stage)
    whole = dict(tables)
    for name, (df, key, column) in (vectors or {}).items():
        sizes = [r[0] for r in df.where(F.col(column).isNotNull()).select(F.size(column)).distinct().limit(2).collect()]
        if len(sizes) > 1:
            raise ValueError(f"vectors of {name} differ in length")
        whole[f"vectors_{name}"] = df.select(F.col(key).alias("key"), F.col(column).alias("vector"))
    save_dataset(whole, path)
    return path


def load_stage(spark: SparkSession, folder: str, analysis: str, stage: str | None = None) -> dict[str, DataFrame]:
    """The dataset of a stage, else of the last stage that has been saved."""
    for name in [stage] if stage else reversed(STAGES):
        path = stage_folder(folder, analysis, name)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest.d/_SUCCESS")
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return load_dataset(spark, path)
    raise FileNotFoundError(f"no complete stage of {analysis} in {folder}")


def load_dataset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    manifest = json.loads("".join(r[0] for r in spark.read.text(f"{path}/_manifest.d").collect()))
    return {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}


def read_colors(spark: SparkSession, path: str, key: str = "class", color: str = "classcolors") -> DataFrame:
    """class, color of a colour table (Parquet, or CSV by its name); names are trimmed, the last one of a class counts."""
    table = spark.read.csv(path, header=True) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)
    trimmed = table.select(F.trim(key).alias("class"), F.trim(color).alias("color"), F.monotonically_increasing_id().alias("_at"))
    return trimmed.groupBy("class").agg(F.max_by("color", "_at").alias("color"))


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """path, index, value of each element of the array files (.npy) that path matches; index has one number an axis."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.load(io.BytesIO(content), allow_pickle=False)
                for at in range(0, x.size, 100_000):
                    some = np.arange(at, min(x.size, at + 100_000))
                    index = np.stack(np.unravel_index(some, x.shape), axis=1).astype(np.int64) if x.ndim else np.zeros((1, 0), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(list(index), pa.list_(pa.int64())), pa.array(x.ravel()[some].astype(float))], names=["path", "index", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, index array<long>, value double")


def write_voxels(voxels: DataFrame, path: str, *axes: str) -> None:
    """A voxel table as Parquet in ranges of its first axis, so that slabs are read without the rest."""
    voxels.repartitionByRange(F.col(axes[0])).sortWithinPartitions(*axes).write.mode("overwrite").parquet(path)


def verify_files(spark: SparkSession, path: str, checksums: DataFrame) -> DataFrame:
    """name, state of each file of checksums (name, md5): "ok", "changed" or "missing" below path.  Files are read in
    tasks; nothing is downloaded."""
    name = F.element_at(F.split("path", "/"), -1)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(name.alias("name"), F.md5("content").alias("_md5"))
    state = F.when(F.max(F.col("_md5") == F.lower("md5")), "ok").when(F.max("_md5").isNotNull(), "changed").otherwise("missing")
    return checksums.join(found, "name", "left").groupBy("name").agg(state.alias("state"))


def log_progress(spark: SparkSession, path: str, **entry) -> None:
    """Appends an entry to a progress log (JSON lines)."""
    spark.createDataFrame([(json.dumps(entry, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("append").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_parameters(parameters: DataFrame, path: str, feature: str = "feature") -> None:
    """Model parameters, one folder per feature, so that one feature's are read without the others'."""
    parameters.write.mode("overwrite").partitionBy(feature).parquet(path)


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
