"""Operators of one-dimensional chunk tables: a frame with a chunk number ``nchunk`` (and any other columns).

Chunks may have any sizes (ragged), so a chunk is what shares a number. All take and return frames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidIndex, InvalidParam

BROADCAST_ROWS = 100_000


def append_chunk(table: DataFrame, chunk: DataFrame, nchunks: int) -> DataFrame:
    """The chunk's rows under the next number."""
    return table.unionByName(chunk.withColumn("nchunk", F.lit(nchunks).cast("long")))


def insert_chunk(table: DataFrame, chunk: DataFrame, at: int, nchunks: int) -> DataFrame:
    """The chunk's rows under number ``at``; chunks from there on move up."""
    if not 0 <= at <= nchunks:
        raise InvalidIndex(f"no chunk {at}")
    n = F.col("nchunk")
    return table.withColumn("nchunk", F.when(n >= at, n + 1).otherwise(n)).unionByName(chunk.withColumn("nchunk", F.lit(at).cast("long")))


def update_chunk(table: DataFrame, chunk: DataFrame, at: int) -> DataFrame:
    """The rows of chunk ``at`` replaced."""
    return table.where(F.col("nchunk") != at).unionByName(chunk.withColumn("nchunk", F.lit(at).cast("long")))


def delete_chunk(table: DataFrame, at: int, nchunks: int) -> DataFrame:
    """Without chunk ``at``; later ones move down."""
    if not 0 <= at < nchunks:
        raise InvalidIndex(f"no chunk {at}")
    n = F.col("nchunk")
    return table.where(n != at).withColumn("nchunk", F.when(n > at, n - 1).otherwise(n))


def reorder_chunks(table: DataFrame, order: Sequence[int] | Column) -> DataFrame:
    """New chunk i is old chunk order[i]. A list must be a permutation; a column gives the new number of each row's chunk itself."""
    if isinstance(order, Column):
        return table.withColumn("nchunk", order.cast("long"))
    if sorted(order) != list(range(len(order))):
        raise InvalidParam("not a permutation of the chunk numbers")
    moves = table.sparkSession.createDataFrame([(int(old), new) for new, old in enumerate(order)], "nchunk long, _new long")
    joined = table.join(F.broadcast(moves) if len(order) <= BROADCAST_ROWS else moves, "nchunk")
    return joined.withColumn("nchunk", F.col("_new")).drop("_new").select(*table.columns)


def vl_blocks(rows: DataFrame, nchunk: Column, order: Column, payload: Column) -> DataFrame:
    """Variable-length blocks: (nchunk, blocks) with the payloads of each chunk in order."""
    picked = rows.select(nchunk.cast("long").alias("nchunk"), F.struct(order.alias("o"), payload.alias("b")).alias("x"))
    return picked.groupBy("nchunk").agg(F.array_sort(F.collect_list("x")).alias("x")).select("nchunk", F.transform("x", lambda x: x["b"]).alias("blocks"))


def vl_block(table: DataFrame, nblock: int) -> DataFrame:
    """(nchunk, block) of each chunk that has so many blocks."""
    return table.where(F.size("blocks") > nblock).select("nchunk", F.element_at("blocks", nblock + 1).alias("block"))


def vl_explode(table: DataFrame) -> DataFrame:
    """(nchunk, nblock, block)."""
    return table.select("nchunk", F.posexplode("blocks").alias("nblock", "block")).withColumn("nblock", F.col("nblock").cast("long"))


def ragged_starts(sizes: DataFrame) -> DataFrame:
    """(nchunk, nitems, start) from (nchunk, nitems): where each chunk of any size begins. One row a chunk, so one window."""
    w = Window.orderBy("nchunk").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("start", F.coalesce(F.sum("nitems").over(w), F.lit(0)).cast("long"))
