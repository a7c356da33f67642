"""Transforms with frozen models depend on single rows, so they run on a stream as they do on a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.linear import Nmf, apply_nmf


def loadings_of_stream(stream: DataFrame, vector: str, model: Nmf, name: str = "loadings") -> DataFrame:
    return apply_nmf(stream, vector, model, name)


def each_batch(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Applies a batch transform (a learned tree, say) to each micro-batch; a batch that is repeated after a failure overwrites
    its own folder, so nothing is doubled."""
    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
