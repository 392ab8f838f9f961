"""The driver's tables as arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..array import ChunkedArray
from ..operators import filters
from ..spec import ArraySpec

EVENT_CHUNK, EVENT_BLOCK = 1000, 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> ChunkedArray:
    """A matrix, one row a vector; chunks and blocks do not divide it."""
    df = table(spark, sf_dir, "embeddings")
    shape = df.agg((F.max("vec_id") + 1).alias("n"), F.max(F.size("embedding")).alias("w")).first()
    return ChunkedArray.from_rows(df, ArraySpec((shape["n"], shape["w"]), (20, 25), (7, 9), "f4"), F.col("vec_id"), F.col("embedding"))


def events(spark: SparkSession, sf_dir: str, value: str = "value", dtype: str = "f8") -> ChunkedArray:
    """A vector by event_id."""
    df = table(spark, sf_dir, "events")
    n = df.agg(F.max("event_id") + 1).first()[0]
    return ChunkedArray.of(df, ArraySpec((n,), (EVENT_CHUNK,), (EVENT_BLOCK,), dtype), [F.col("event_id")], F.expr(value))


def event_chunks(spark: SparkSession, sf_dir: str, value: str = "user_id") -> DataFrame:
    """The same as a chunk table: nchunk, nblock, i, value."""
    return filters.chunk_table(table(spark, sf_dir, "events"), F.col("event_id"), F.expr(value), EVENT_CHUNK, EVENT_BLOCK)
