"""Following a growing array: one writer adds chunks, readers see each new part once.

The writer appends Parquet files of cells to a folder; a reader is a file stream over it. ``drain`` processes what has come
so far and stops, remembering in its checkpoint what it has seen. A rewritten chunk comes again as a whole, so the reader
keeps the last value of every cell (``latest``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry


def cell_schema(ndim: int, spark_type: str) -> str:
    return ", ".join([*(f"{d} long" for d in geometry.dims(ndim)), f"value {spark_type}", "version long"])


def write_version(cells: DataFrame, path: str, version: int) -> None:
    """The writer's step: one batch of cells, whole files only (they appear by rename)."""
    cells.withColumn("version", F.lit(version).cast("long")).write.mode("append").parquet(path)


def follow(spark: SparkSession, path: str, ndim: int, spark_type: str, files_per_batch: int = 1000) -> DataFrame:
    """The stream of new cells, with the version that wrote them."""
    return spark.readStream.schema(cell_schema(ndim, spark_type)).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drain(stream: DataFrame, output: str, checkpoint: str) -> None:
    """Append everything that has come since the last call to ``output``; exactly once for each checkpoint."""
    query = stream.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def drain_with(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Call ``step`` with each new batch of cells."""
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest(cells: DataFrame, ndim: int, shape: Sequence[int] | None = None) -> DataFrame:
    """The last version of every cell; with a shape, only cells inside it."""
    dims = geometry.dims(ndim)
    for d, n in zip(dims, shape or [], strict=False):
        cells = cells.where(F.col(d) < n)
    newest = cells.groupBy(*dims).agg(F.max_by("value", "version").alias("value"), F.max("version").alias("version"))
    return newest


def changes(cells: DataFrame, ndim: int) -> DataFrame:
    """Every change of a cell, with the value before it."""
    w = Window.partitionBy(*geometry.dims(ndim)).orderBy("version")
    return cells.withColumn("before", F.lag("value").over(w))
