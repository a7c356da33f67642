"""Reader of chunked image stores: a folder a feature, in it an array a section, cut into chunk files.

The layout is that of Zarr version 2: `<feature>/<section>/.zarray` describes an array (shape, chunks, dtype, order,
compressor, fill_value, dimension_separator), beside it stand its chunks (`0.0`, `0.1`, ...).  Filters on the feature and
the section keep folders from being listed and chunks from being opened.  Paths may be of any file system that Arrow
knows; without a scheme they are local and must be shared."""

from __future__ import annotations

import gzip
import json
import math
import zlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "mz_key string, section_id int, x int, y int, log_value double"
#: Bytes of cells that one partition reads (a larger chunk is a partition of its own), and threads that read descriptions.
PARTITION, THREADS = 32 << 20, 16


def _zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


DECODERS = {None: lambda data: data, "zlib": zlib.decompress, "gzip": gzip.decompress, "zstd": _zstd}


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Chunk:
    feature: str
    section: int
    folder: str
    about: dict
    at: tuple[int, int]

    def name(self) -> str:
        return self.folder + "/" + self.about.get("dimension_separator", ".").join(map(str, self.at))

    def cells(self, files: fs.FileSystem) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """x, y (from 1) and values of the cells that are not missing; a chunk without a file holds the fill value."""
        shape, size, fill = self.about["shape"], self.about["chunks"], self.about.get("fill_value")
        fill = math.nan if fill is None else {"NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}.get(fill, fill)
        if files.get_file_info(self.name()).type == fs.FileType.NotFound:
            whole = np.full(size, fill, dtype=float)
        else:
            with files.open_input_stream(self.name()) as f:
                data = DECODERS[(self.about.get("compressor") or {}).get("id")](f.read())
            whole = np.frombuffer(data, np.dtype(self.about["dtype"])).reshape(size, order=self.about.get("order", "C")).astype(float)
        start = [a * s for a, s in zip(self.at, size)]
        whole = whole[tuple(slice(0, min(s, n - b)) for s, n, b in zip(size, shape, start))]  # chunks at the edge reach over it
        i, j = np.nonzero(~np.isnan(whole))
        return start[0] + i + 1, start[1] + j + 1, whole[i, j]


@dataclass
class Chunks(InputPartition):
    chunks: list[Chunk]


class StoreReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.features = set(json.loads(options["features"])) if "features" in options else None
        self.sections = set(json.loads(options["sections"])) if "sections" in options else None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equalities and lists of the feature and the section prune; all else is left to Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("mz_key",):
                self.features = values if self.features is None else self.features & values
            elif values is not None and f.attribute == ("section_id",):
                self.sections = values if self.sections is None else self.sections & values
            else:
                yield f

    def _folders(self, files: fs.FileSystem, path: str) -> list[str]:
        return sorted(i.base_name for i in files.get_file_info(fs.FileSelector(path)) if i.type == fs.FileType.Directory)

    def partitions(self) -> list[Chunks]:
        files, path = _filesystem(self.path)
        features = [f for f in self._folders(files, path) if self.features is None or f in self.features]

        def described(feature: str) -> list[tuple[str, int, str, dict]]:
            out = []
            for section in self._folders(files, f"{path}/{feature}"):
                folder = f"{path}/{feature}/{section}"
                if section.isdigit() and (self.sections is None or int(section) in self.sections) and files.get_file_info(f"{folder}/.zarray").type == fs.FileType.File:
                    with files.open_input_stream(f"{folder}/.zarray") as f:
                        out.append((feature, int(section), folder, json.loads(f.read())))
            return out

        out, held, size = [], [], 0
        with ThreadPoolExecutor(THREADS) as pool:
            for feature, section, folder, about in (a for arrays in pool.map(described, features) for a in arrays):
                kind = (about.get("compressor") or {}).get("id")
                if len(about["shape"]) != 2 or kind not in DECODERS or about.get("filters"):
                    raise ValueError(f"{folder}: an image of two dimensions without filters is needed, compressed by one of {sorted(map(str, DECODERS))}")
                each = math.prod(about["chunks"]) * np.dtype(about["dtype"]).itemsize
                for at in product(*(range(-(-n // c)) for n, c in zip(about["shape"], about["chunks"]))):
                    if held and size + each > PARTITION:
                        out.append(Chunks(held))
                        held, size = [], 0
                    held.append(Chunk(feature, section, folder, about, at))
                    size += each
        return [*out, Chunks(held)]

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        files, _ = _filesystem(self.path)
        for chunk in partition.chunks:
            x, y, value = chunk.cells(files)
            for at in range(0, len(x), 1 << 16):
                n = len(x[at:at + (1 << 16)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk.feature] * n, pa.string()), pa.array(np.full(n, chunk.section, np.int32)), *(pa.array(c[at:at + n].astype(np.int32)) for c in (x, y)), pa.array(value[at:at + n])],
                    names=["mz_key", "section_id", "x", "y", "log_value"])


class ChunkedImages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunked_images"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StoreReader:
        return StoreReader(dict(self.options))


def read_store(spark: SparkSession, path: str, features: list[str] | None = None, sections: list[int] | None = None) -> DataFrame:
    """Long intensity table (mz_key, section_id, x, y, log_value) of a store; cells that are not a number are left out.

    Features and sections may be named here, or filtered behind: both keep other chunks closed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChunkedImages)
    reader = spark.read.format("chunked_images").option("path", path)
    if features is not None:
        reader = reader.option("features", json.dumps(list(features)))
    if sections is not None:
        reader = reader.option("sections", json.dumps(list(sections)))
    return reader.load()
