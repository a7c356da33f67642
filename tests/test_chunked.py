"""Chunked image stores, written here, are read with the right values; filters keep other chunks closed."""

import json
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.sources import chunked


def write(folder, image, chunks, compressor=None, dtype="<f8", order="C", separator=".", fill="NaN", skip=()):
    folder.mkdir(parents=True)
    about = {"zarr_format": 2, "shape": list(image.shape), "chunks": list(chunks), "dtype": dtype, "order": order, "fill_value": fill, "filters": None, "compressor": {"id": compressor} if compressor else None, "dimension_separator": separator}
    (folder / ".zarray").write_text(json.dumps(about))
    for i in range(-(-image.shape[0] // chunks[0])):
        for j in range(-(-image.shape[1] // chunks[1])):
            if (i, j) in skip:
                continue
            part = np.zeros(chunks, dtype)
            piece = image[i * chunks[0]:(i + 1) * chunks[0], j * chunks[1]:(j + 1) * chunks[1]]
            part[:piece.shape[0], :piece.shape[1]] = piece
            data = part.tobytes(order)
            path = folder / separator.join((str(i), str(j)))
            path.parent.mkdir(exist_ok=True)
            path.write_bytes(zlib.compress(data) if compressor else data)


@pytest.fixture
def store(tmp_path):
    rng = np.random.default_rng(0)
    images = {("100.5", 3): rng.normal(size=(7, 10)), ("100.5", 4): rng.normal(size=(5, 5)), ("200.25", 3): rng.normal(size=(9, 4)), ("300", 12): rng.normal(size=(6, 6)).astype("<f4")}
    images["100.5", 3][2, 3] = math.nan
    write(tmp_path / "100.5" / "3", images["100.5", 3], (3, 4))
    write(tmp_path / "100.5" / "4", images["100.5", 4], (5, 5), compressor="zlib", order="F")
    write(tmp_path / "200.25" / "3", images["200.25", 3], (4, 4), compressor="zlib", separator="/")
    write(tmp_path / "300" / "12", images["300", 12], (4, 4), dtype="<f4", fill=-1.5, skip=[(1, 1)])
    images["300", 12][4:, 4:] = -1.5
    (tmp_path / ".zgroup").write_text("{}")
    (tmp_path / "100.5" / "notes").mkdir()
    return str(tmp_path), images


def cells(images):
    return {(f, s, i + 1, j + 1): v for (f, s), image in images.items() for (i, j), v in np.ndenumerate(image.astype(float)) if not math.isnan(v)}


def rows(df):
    return {(r["mz_key"], r["section_id"], r["x"], r["y"]): r["log_value"] for r in df.collect()}


def test_values(spark, store, monkeypatch):
    path, images = store
    found = chunked.read_store(spark, path)
    assert found.schema.simpleString() == "struct<mz_key:string,section_id:int,x:int,y:int,log_value:double>"
    assert rows(found) == cells(images) and found.count() == len(cells(images))
    assert rows(chunked.read_store(spark, "file://" + path)) == cells(images)


def test_a_filter_opens_only_its_chunks(spark, store, tmp_path):
    """All chunks but those of one feature and section are broken."""
    path, images = store
    for chunk in tmp_path.rglob("*"):
        if chunk.is_file() and chunk.name[0] != "." and tmp_path / "200.25" not in chunk.parents:
            chunk.write_bytes(b"x")
    (tmp_path / "300" / "12" / ".zarray").write_text("{")
    want = cells({k: v for k, v in images.items() if k[0] == "200.25"})
    assert rows(chunked.read_store(spark, path).where("mz_key = '200.25'")) == want
    assert rows(chunked.read_store(spark, path).where(F.col("mz_key").isin("200.25", "nothing") & (F.col("x") > 2))) == {k: v for k, v in want.items() if k[2] > 2}
    assert rows(chunked.read_store(spark, path, features=["200.25"])) == want
    assert rows(chunked.read_store(spark, path, features=["100.5"]).where("section_id = 9")) == {}
    with pytest.raises(Exception):
        chunked.read_store(spark, path).count()


def test_partitions(store, monkeypatch):
    path, _ = store
    reader = chunked.StoreReader({"path": path})
    assert [len(p.chunks) for p in reader.partitions()] == [9 + 1 + 3 + 4]
    monkeypatch.setattr(chunked, "PARTITION", 1)
    assert [len(p.chunks) for p in reader.partitions()] == [1] * 17
    assert [len(p.chunks) for p in chunked.StoreReader({"path": path, "features": "[]"}).partitions()] == [0]


def test_what_cannot_be_read_is_said(spark, tmp_path):
    write(tmp_path / "1" / "1", np.zeros((2, 2)), (2, 2), compressor="zlib")
    about = json.loads((tmp_path / "1" / "1" / ".zarray").read_text())
    (tmp_path / "1" / "1" / ".zarray").write_text(json.dumps(about | {"compressor": {"id": "blosc"}}))
    with pytest.raises(Exception, match="compressed by one of"):
        chunked.read_store(spark, str(tmp_path)).count()
