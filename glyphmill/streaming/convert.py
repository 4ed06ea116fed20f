"""Conversion of streamed inputs (an extension: no streaming is asked of the engine)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators import lattice


def converted(stream: DataFrame, dictionary: DataFrame, connection: DataFrame, path: str, on: str = "input", **options) -> DataStreamWriter:
    """A writer that converts each micro-batch like a batch and writes it under its number, so that a batch run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        lattice.convert(batch, dictionary, connection, on=on, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.select(on).writeStream.foreachBatch(write)
