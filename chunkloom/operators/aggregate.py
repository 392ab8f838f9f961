"""Aggregates by chunk and over whole arrays. Partial sums by chunk are combined by Spark's own partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunk_sums(table: DataFrame, value: Column) -> DataFrame:
    """(nchunk, n, total)."""
    return table.groupBy("nchunk").agg(F.count(value).alias("n"), F.sum(value).alias("total"))


def chunk_stats(table: DataFrame, value: Column) -> DataFrame:
    """(nchunk, n, least, most, is_run, special): a chunk of one value is a run; zero and NaN runs are named."""
    least, most = F.min(value), F.max(value)
    special = F.when(least != most, "none").when(most == 0, "zero").when(F.isnan(most.cast("double")), "nan").otherwise("value")
    return table.groupBy("nchunk").agg(F.count(value).alias("n"), least.alias("least"), most.alias("most"), (least == most).alias("is_run"), special.alias("special"))


def chunk_sizes(chunks: DataFrame, raw: Column, stored: Column) -> DataFrame:
    """(nchunk, nbytes, cbytes): bytes before and after encoding."""
    return chunks.groupBy("nchunk").agg(F.sum(raw).cast("long").alias("nbytes"), F.sum(stored).cast("long").alias("cbytes"))


#: Chunks whose last values one task puts in order.
_RUN = 4096


def _last_before(edges: DataFrame) -> DataFrame:
    """(nchunk, _last) from one row (nchunk, last) for each chunk there is: the last value of the chunk before it, however far.
    In runs of ``_RUN`` chunk numbers, and then over the runs, so that no task sees more than a run's chunks or all runs."""
    e = edges.withColumn("_run", F.floor(F.col("nchunk") / _RUN))
    runs = e.groupBy("_run").agg(F.max_by("last", "nchunk").alias("_end"))
    runs = runs.select("_run", F.lag("_end").over(Window.orderBy("_run")).alias("_end"))
    inside = F.lag("last").over(Window.partitionBy("_run").orderBy("nchunk"))
    return e.join(runs, "_run").select("nchunk", F.coalesce(inside, "_end").alias("_last"))


def sign_changes(table: DataFrame, order: str, value: Column) -> DataFrame:
    """Rows after which the sign changes: (nchunk, order, before, value). Chunks are scanned independently; a change between a
    chunk and the one before it, which may be several numbers lower, is found from their border values, one row a chunk."""
    w = Window.partitionBy("nchunk").orderBy(order)
    t = table.select("nchunk", order, value.alias("value"))
    edges = _last_before(t.groupBy("nchunk").agg(F.max_by("value", order).alias("last")))
    t = t.withColumn("before", F.lag("value").over(w)).join(edges, "nchunk", "left")
    t = t.withColumn("before", F.coalesce("before", "_last"))
    return t.where("before * value < 0").select("nchunk", order, "before", "value")
