"""Queries over the driver's tables, one or more for each operator, and the same in DuckDB SQL.

Regions depend on the tables' sizes: rows [n/4, n - n/4) of the embeddings matrix, n being its length.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..array import ChunkedArray
from ..functions import bits, geometry
from ..operators import aggregate, blocks, callbacks, chunks, filters, mutate, select
from ..sources import codecs, datasource, frames, store
from ..spec import ArraySpec
from ..streaming import growth
from .tables import event_chunks, events, embeddings, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_CELLS = "cells AS (SELECT vec_id AS d0, (i - 1)::BIGINT AS d1, embedding[i]::DOUBLE AS value FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i))"
_SHAPE = "s AS (SELECT max(vec_id) + 1 AS n, max(len(embedding)) AS w FROM embeddings)"
_ADDRESS = """a AS (SELECT d0, d1, value, (d0 // 20) * 3 + d1 // 25 AS nchunk, ((d0 % 20) // 7) * 3 + (d1 % 25) // 9 AS nblock,
 ((d0 % 20) % 7) * 9 + (d1 % 25) % 9 AS "offset" FROM cells)"""
_EVENTS = "e AS (SELECT event_id // 1000 AS nchunk, (event_id % 1000) // 100 AS nblock, event_id % 100 AS i, user_id AS value FROM events)"


def query(sql: str | None = None):
    """Register a query under its function's name; ``sql`` is its oracle."""

    def keep(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return keep


def _doubles(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns or ("value",)})


def _shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; a temporary one in tests."""
    return f"{config.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Creation and addresses


@query(f"WITH {_CELLS} SELECT d0, d1, value FROM cells")
def array_from_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(embeddings(spark, sf_dir).cells())


@query(f'WITH {_CELLS}, {_ADDRESS} SELECT d0, d1, value, d0 * 64 + d1 AS flat_idx, nchunk, nblock, "offset", nchunk * 567 + nblock * 63 + "offset" AS storage_pos FROM a')
def geometry_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(embeddings(spark, sf_dir).addressed())


@query("SELECT event_id AS flat, event_id // 91 AS i0, (event_id // 13) % 7 AS i1, event_id % 13 AS i2, (event_id // 91) * 91 + ((event_id // 13) % 7) * 13 + event_id % 13 AS back FROM events")
def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    n = df.agg(F.max("event_id") + 1).first()[0]
    spec = ArraySpec((-(-n // 91), 7, 13))
    parts = geometry.from_flat(spec, F.col("event_id"))
    out = df.select(F.col("event_id").alias("flat"), *(p.alias(f"i{k}") for k, p in enumerate(parts)))
    return out.withColumn("back", geometry.flat_index(spec, [F.col("i0"), F.col("i1"), F.col("i2")]))


@query("SELECT (i // 30)::BIGINT AS d0, (i % 30)::BIGINT AS d1, 0::BIGINT AS value FROM range(6000) t(i)")
def fill_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ChunkedArray.zeros(spark, ArraySpec((200, 30), (20, 20), (10, 10), "i8")).cells()


@query("SELECT (i // 30)::BIGINT AS d0, (i % 30)::BIGINT AS d1, 2.5::DOUBLE AS value FROM range(6000) t(i)")
def fill_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ChunkedArray.fill(spark, ArraySpec((200, 30), (20, 20), (10, 10)), 2.5).cells()


@query("SELECT (i // 20 // 30)::BIGINT AS nchunk_row, count(*) AS n, count(*) AS nans FROM range(12000) t(i) GROUP BY 1")
def fill_nans(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ChunkedArray.nans(spark, ArraySpec((400, 30), (20, 30), (10, 10), "f4"))
    return a.cells().groupBy(geometry.div(F.col("d0"), 20).alias("nchunk_row")).agg(F.count("*").alias("n"), F.count(F.when(F.isnan("value"), 1)).alias("nans"))


# Selection


@query(f"WITH {_CELLS}, {_SHAPE} SELECT d0 - n // 4 AS d0, d1 - 10 AS d1, value FROM cells, s WHERE d0 >= n // 4 AND d0 < n - n // 4 AND d1 >= 10 AND d1 < 50")
def slice_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = embeddings(spark, sf_dir)
    n = a.spec.shape[0]
    return _doubles(select.get_slice(a, (n // 4, 10), (n - n // 4, 50)).cells())


@query(
    f"""WITH {_CELLS}, {_SHAPE}, x AS (SELECT d0 - n // 4 AS d0, d1 - 10 AS d1, value FROM cells, s WHERE d0 >= n // 4 AND d0 < n - n // 4 AND d1 >= 10 AND d1 < 50)
SELECT d0, d1, value, (d0 // 16) * 4 + d1 // 12 AS nchunk, ((d0 % 16) // 5) * 3 + (d1 % 12) // 4 AS nblock FROM x"""
)
def slice_rechunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = embeddings(spark, sf_dir)
    n = a.spec.shape[0]
    return _doubles(select.get_slice(a, (n // 4, 10), (n - n // 4, 50), (16, 12), (5, 4)).addressed().drop("flat_idx", "offset", "storage_pos"))


@query(f"WITH {_SHAPE} SELECT DISTINCT (r * 3 + c)::BIGINT AS nchunk FROM s, unnest(range((n // 4) // 20, (n - n // 4 + 19) // 20)) t(r), unnest(range(0, 2)) u(c)")
def slice_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = embeddings(spark, sf_dir)
    n = a.spec.shape[0]
    return select.slice_chunks(a, (n // 4, 10), (n - n // 4, 50))


@query("WITH s AS (SELECT max(event_id) + 1 AS n FROM events) SELECT event_id - n // 3 AS d0, value FROM events, s WHERE event_id >= n // 3 AND event_id < n - n // 5")
def slice_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = events(spark, sf_dir)
    n = a.spec.shape[0]
    return select.get_slice(a, (n // 3,), (n - n // 5,)).cells()


@query(f"WITH {_CELLS}, {_SHAPE}, c AS (SELECT event_id AS pos, (event_id * 7919) % (n * w) AS flat_idx FROM events, s) SELECT c.pos, c.flat_idx, cells.value FROM c JOIN cells ON c.flat_idx = cells.d0 * 64 + cells.d1")
def take_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = embeddings(spark, sf_dir)
    coords = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), (F.col("event_id") * 7919 % F.lit(a.spec.nitems)).alias("flat_idx"))
    return _doubles(select.take(a, coords))


@query("WITH s AS (SELECT max(event_id) + 1 AS n FROM events), c AS (SELECT p AS pos, v AS flat_idx FROM s, (SELECT unnest(range(8)) AS p), unnest([n - 1, 0, n // 2, 0, 5, n // 3, 5, n - 2]) WITH ORDINALITY t(v, o) WHERE o = p + 1) SELECT c.pos::BIGINT AS pos, c.flat_idx::BIGINT AS flat_idx, e.value FROM c JOIN events e ON e.event_id = c.flat_idx")
def take_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = events(spark, sf_dir)
    n = a.spec.shape[0]
    return select.gather_1d(a, [n - 1, 0, n // 2, 0, 5, n // 3, 5, n - 2])


_SELECTION = "s0 AS (SELECT (o - 1)::BIGINT AS p0, v AS x0 FROM s, unnest([n - 1, 3, n // 2, 3, 0]) WITH ORDINALITY t(v, o)), s1 AS (SELECT (o - 1)::BIGINT AS p1, v::BIGINT AS x1 FROM unnest([5, 5, 63, 0, 30]) WITH ORDINALITY t(v, o))"


def _selection(n: int) -> list[list[int]]:
    return [[n - 1, 3, n // 2, 3, 0], [5, 5, 63, 0, 30]]


@query(f"WITH {_CELLS}, {_SHAPE}, {_SELECTION} SELECT p0 AS d0, p1 AS d1, value FROM s0, s1, cells WHERE cells.d0 = x0 AND cells.d1 = x1")
def oindex_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = embeddings(spark, sf_dir)
    return _doubles(select.outer_index(a, _selection(a.spec.shape[0])).cells())


@query(
    f"""WITH {_CELLS}, {_SHAPE}, {_SELECTION},
p AS (SELECT x0, x1, max(p0) AS p0, max(p1) AS p1 FROM s0, s1 GROUP BY x0, x1)
SELECT d0, d1, CASE WHEN p.x0 IS NULL THEN value ELSE (1000 + p0 * 5 + p1)::DOUBLE END AS value FROM cells LEFT JOIN p ON d0 = x0 AND d1 = x1"""
)
def oindex_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = mutate.copy_as(embeddings(spark, sf_dir), "f8")
    values = ChunkedArray.from_flat(spark.range(25), ArraySpec((5, 5)), F.col("id"), (F.col("id") + 1000).cast("double"))
    return mutate.outer_set(a, _selection(a.spec.shape[0]), values).cells()


@query(f"WITH {_CELLS}, {_SHAPE} SELECT d0, value FROM cells, s WHERE d1 = 17")
def squeeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = embeddings(spark, sf_dir)
    return _doubles(select.squeeze(select.get_slice(a, (0, 17), (a.spec.shape[0], 18))).cells())


@query(f"WITH {_CELLS} SELECT d0, 0::BIGINT AS d1, d1 AS d2, 0::BIGINT AS d3, value FROM cells")
def expand_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(select.expand_dims(embeddings(spark, sf_dir), (False, True, False, True)).cells())


@query(f"WITH {_CELLS} SELECT d0, d1, value, (d0 // 13) * 5 + d1 // 13 AS nchunk FROM cells")
def copy_rechunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(select.rechunk(embeddings(spark, sf_dir), (13, 13)).addressed().select("d0", "d1", "value", "nchunk"))


@query(f'WITH {_CELLS}, {_ADDRESS} SELECT d0, d1, value, nblock, "offset" FROM a WHERE nchunk = 4')
def chunk_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(select.chunk(embeddings(spark, sf_dir), 4).select("d0", "d1", "value", "nblock", "offset"))


@query(f"WITH {_CELLS}, {_ADDRESS} SELECT d0, d1, nchunk, nblock, value FROM a WHERE nblock NOT IN (0, 4, 8)")
def block_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(select.without_blocks(embeddings(spark, sf_dir), (0, 4, 8)).select("d0", "d1", "nchunk", "nblock", "value"))


@query("SELECT vec_id, i::BIGINT AS i, embedding[i + 3]::DOUBLE AS value FROM embeddings, unnest(range(0, 4)) t(i)")
def array_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = select.get_items(table(spark, sf_dir, "embeddings"), "embedding", 2, 4)
    return rows.select("vec_id", F.posexplode("items").alias("i", "value")).select("vec_id", F.col("i").cast("long").alias("i"), F.col("value").cast("double").alias("value"))


@query(f'WITH {_CELLS}, {_ADDRESS} SELECT nchunk, nblock, count(*) AS n, max("offset") AS last_offset, first(value ORDER BY "offset") AS first_value FROM a GROUP BY nchunk, nblock')
def block_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = embeddings(spark, sf_dir).blocks()
    return b.select("nchunk", "nblock", F.size("values").cast("long").alias("n"), F.element_at("offsets", -1).alias("last_offset"), F.element_at("values", 1).cast("double").alias("first_value"))


# Mutation


@query(f"WITH {_CELLS}, {_SHAPE} SELECT d0, d1, value FROM cells UNION ALL SELECT d0 + n, d1, value * 2 FROM cells, s")
def concatenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = mutate.copy_as(embeddings(spark, sf_dir), "f8")
    return mutate.concatenate(a, a.map_value(F.col("value") * 2), 0).cells()


@query(f"WITH {_CELLS} SELECT d0, d1, value FROM cells UNION ALL SELECT d0, d1 + 64, -value FROM cells")
def concatenate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = mutate.copy_as(embeddings(spark, sf_dir), "f8")
    return mutate.concatenate(a, a.map_value(-F.col("value")), 1).cells()


@query("WITH s AS (SELECT max(event_id) + 1 AS n FROM events) SELECT event_id AS d0, value FROM events UNION ALL SELECT n + i, i::DOUBLE FROM s, unnest(range(0, 500)) t(i)")
def append(spark: SparkSession, sf_dir: str) -> DataFrame:
    slab = ChunkedArray.from_flat(spark.range(500), ArraySpec((500,), (500,)), F.col("id"), F.col("id").cast("double"))
    return mutate.append(events(spark, sf_dir), slab, 0).cells()


@query(f"WITH {_CELLS}, {_SHAPE} SELECT CASE WHEN d0 >= n // 2 THEN d0 + 10 ELSE d0 END AS d0, d1, value FROM cells, s UNION ALL SELECT n // 2 + r, c, (r * 64 + c)::DOUBLE FROM s, unnest(range(0, 10)) t(r), unnest(range(0, 64)) u(c)")
def insert_slab(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = mutate.copy_as(embeddings(spark, sf_dir), "f8")
    slab = ChunkedArray.from_flat(spark.range(640), ArraySpec((10, 64)), F.col("id"), F.col("id").cast("double"))
    return mutate.insert(a, slab, 0, a.spec.shape[0] // 2).cells()


@query(f"WITH {_CELLS} SELECT d0, CASE WHEN d1 >= 30 THEN d1 - 10 ELSE d1 END AS d1, value FROM cells WHERE d1 < 20 OR d1 >= 30")
def delete_slab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(mutate.delete(embeddings(spark, sf_dir), 1, 20, 10).cells())


@query(f"WITH {_CELLS}, {_SHAPE} SELECT r::BIGINT AS d0, c::BIGINT AS d1, coalesce(value, 0) AS value FROM s, unnest(range(0, n + 7)) t(r), unnest(range(0, 70)) u(c) LEFT JOIN cells ON d0 = r AND d1 = c")
def resize_grow(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = embeddings(spark, sf_dir)
    return _doubles(mutate.resize(a, (a.spec.shape[0] + 7, 70)).cells())


@query(f"WITH {_CELLS}, {_SHAPE} SELECT d0, d1, value FROM cells, s WHERE d0 < n - n // 3 AND d1 < 40")
def resize_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = embeddings(spark, sf_dir)
    return _doubles(mutate.resize(a, (a.spec.shape[0] - a.spec.shape[0] // 3, 40)).cells())


@query(f"WITH {_CELLS}, {_SHAPE} SELECT d0, d1, CASE WHEN d0 >= n // 4 AND d0 < n - n // 4 AND d1 >= 10 AND d1 < 50 THEN ((d0 - n // 4) * 40 + d1 - 10)::DOUBLE ELSE value END AS value FROM cells, s")
def set_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = mutate.copy_as(embeddings(spark, sf_dir), "f8")
    n = a.spec.shape[0]
    rows = n - n // 4 - n // 4
    new = ChunkedArray.from_flat(spark.range(rows * 40), ArraySpec((rows, 40)), F.col("id"), F.col("id").cast("double"))
    return mutate.set_slice(a, (n // 4, 10), (n - n // 4, 50), new).cells()


# Chunk tables


@query("SELECT event_id // 1000 AS nchunk, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def chunk_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.chunk_sums(event_chunks(spark, sf_dir, "value"), F.col("value")).withColumn("total", F.round("total", 4))


@query("WITH t AS (SELECT event_id // 1000 AS nchunk, CASE WHEN event_id // 1000 % 3 = 0 THEN 0 WHEN event_id // 1000 % 3 = 1 THEN 7 ELSE user_id END AS v FROM events) SELECT nchunk, count(*) AS n, min(v) AS least, max(v) AS most, min(v) = max(v) AS is_run, CASE WHEN min(v) <> max(v) THEN 'none' WHEN max(v) = 0 THEN 'zero' ELSE 'value' END AS special FROM t GROUP BY nchunk")
def run_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = "CASE WHEN event_id div 1000 % 3 = 0 THEN 0 WHEN event_id div 1000 % 3 = 1 THEN 7 ELSE user_id END"
    return aggregate.chunk_stats(event_chunks(spark, sf_dir, value), F.col("value"))


@query("WITH m AS (SELECT max(event_id // 1000) + 1 AS k FROM events) SELECT k - 1 - event_id // 1000 AS nchunk, event_id, value FROM events, m")
def chunk_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select(F.expr("event_id div 1000").alias("nchunk"), "event_id", "value")
    k = t.agg(F.max("nchunk") + 1).first()[0]
    return chunks.reorder_chunks(t, list(reversed(range(k))))


#: The middle chunk.
_AT = "(SELECT (max(event_id // 1000) + 1) // 2 FROM events)"
_NEW_CHUNK = "SELECT {at}::BIGINT AS nchunk, i::BIGINT AS event_id, (i * 0.5)::DOUBLE AS value FROM unnest(range(0, 1000)) t(i)"


def _event_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    t = table(spark, sf_dir, "events").select(F.expr("event_id div 1000").alias("nchunk"), "event_id", "value")
    new = spark.range(1000).select(F.col("id").alias("event_id"), (F.col("id") * 0.5).alias("value"))
    return t, new, t.agg(F.max("nchunk") + 1).first()[0]


@query(f"SELECT event_id // 1000 + CASE WHEN event_id // 1000 >= {_AT} THEN 1 ELSE 0 END AS nchunk, event_id, value FROM events UNION ALL " + _NEW_CHUNK.format(at=_AT))
def chunk_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, new, k = _event_rows(spark, sf_dir)
    return chunks.insert_chunk(t, new, k // 2, k)


@query(f"SELECT event_id // 1000 - CASE WHEN event_id // 1000 > {_AT} THEN 1 ELSE 0 END AS nchunk, event_id, value FROM events WHERE event_id // 1000 <> {_AT}")
def chunk_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, _, k = _event_rows(spark, sf_dir)
    return chunks.delete_chunk(t, k // 2, k)


@query(f"SELECT event_id // 1000 AS nchunk, event_id, value FROM events WHERE event_id // 1000 <> {_AT} UNION ALL " + _NEW_CHUNK.format(at=_AT))
def chunk_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, new, k = _event_rows(spark, sf_dir)
    return chunks.update_chunk(t, new, k // 2)


@query("SELECT event_id // 1000 AS nchunk, event_id, value FROM events UNION ALL " + _NEW_CHUNK.format(at="(SELECT max(event_id // 1000) + 1 FROM events)"))
def chunk_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, new, k = _event_rows(spark, sf_dir)
    return chunks.append_chunk(t, new, k)


@query("SELECT doc_id // 8 AS nchunk, count(*) AS nblocks, string_agg(md5(text), ',' ORDER BY doc_id) AS digests FROM documents GROUP BY 1")
def vl_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = chunks.vl_blocks(table(spark, sf_dir, "documents"), F.expr("doc_id div 8"), F.col("doc_id"), F.col("text"))
    return t.select("nchunk", F.size("blocks").cast("long").alias("nblocks"), F.array_join(F.transform("blocks", lambda b: F.md5(b.cast("binary"))), ",").alias("digests"))


@query("SELECT doc_id // 8 AS nchunk, text AS block FROM documents WHERE doc_id % 8 = 5")
def vl_block_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block 5 of every chunk."""
    return chunks.vl_block(chunks.vl_blocks(table(spark, sf_dir, "documents"), F.expr("doc_id div 8"), F.col("doc_id"), F.col("text")), 5)


@query("SELECT doc_id // 8 AS nchunk, doc_id % 8 AS nblock, length(block) AS n FROM (SELECT doc_id, text AS block FROM documents)")
def vl_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = chunks.vl_blocks(table(spark, sf_dir, "documents"), F.expr("doc_id div 8"), F.col("doc_id"), F.col("text"))
    return chunks.vl_explode(t).select("nchunk", "nblock", F.length("block").cast("long").alias("n"))


@query("WITH c AS (SELECT ascii(lang) * 256 + ascii(lang[2:]) AS nchunk, count(*) AS nitems FROM documents GROUP BY lang) SELECT nchunk::BIGINT AS nchunk, nitems, coalesce(sum(nitems) OVER (ORDER BY nchunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM c")
def ragged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("nitems"))
    return chunks.ragged_starts(t.select((F.ascii("lang") * 256 + F.ascii(F.substring("lang", 2, 1))).cast("long").alias("nchunk"), "nitems"))


# Filters


_DELTA = """d AS (SELECT nchunk, nblock, i, CASE WHEN nblock = 0 THEN coalesce(xor(value, lag(value) OVER (PARTITION BY nchunk, nblock ORDER BY i)), value)
 ELSE xor(value, max(CASE WHEN nblock = 0 THEN value END) OVER (PARTITION BY nchunk, i)) END AS value FROM e)"""


@query(f"WITH {_EVENTS}, {_DELTA} SELECT nchunk, nblock, i, value FROM d")
def xor_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.xor_delta(event_chunks(spark, sf_dir))


@query(f"WITH {_EVENTS} SELECT nchunk, nblock, i, value FROM e")
def xor_undelta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and decoded: the values that went in."""
    return filters.xor_undelta(filters.xor_delta(event_chunks(spark, sf_dir)))


@query(f"WITH {_EVENTS} SELECT nchunk, nblock, k::BIGINT AS stream, i, (value >> (8 * k)::INT) & 255 AS byte FROM e, unnest(range(0, 8)) t(k)")
def byte_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.byte_shuffle(event_chunks(spark, sf_dir), 8)


_SIGNED = "CASE WHEN event_id % 2 = 0 THEN user_id ELSE -user_id - 1 END"


@query(f"SELECT event_id // 1000 AS nchunk, (event_id % 1000) // 100 AS nblock, event_id % 100 AS i, {_SIGNED} AS value FROM events")
def byte_unshuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.byte_unshuffle(filters.byte_shuffle(event_chunks(spark, sf_dir, _SIGNED), 8), 8)


@query(f"WITH {_EVENTS} SELECT nchunk, nblock, k::BIGINT AS bit, i // 8 AS byte_no, bit_or(((value >> k::INT) & 1) << (i % 8)::INT)::BIGINT AS byte FROM e, unnest(range(0, 64)) t(k) WHERE i < 96 GROUP BY 1, 2, 3, 4 UNION ALL SELECT nchunk, nblock, -1, i, value FROM e WHERE i >= 96")
def bit_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.bit_shuffle(event_chunks(spark, sf_dir), 8)


@query(f"SELECT event_id // 1000 AS nchunk, (event_id % 1000) // 100 AS nblock, event_id % 100 AS i, {_SIGNED} AS value FROM events")
def bit_unshuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.bit_unshuffle(filters.bit_shuffle(event_chunks(spark, sf_dir, _SIGNED), 8), 8)


_BYTES = f"{_EVENTS}, b AS (SELECT nchunk, nblock, k::BIGINT AS stream, i, (value >> (8 * k)::INT) & 255 AS byte FROM e, unnest(range(0, 8)) t(k))"


@query(f"WITH {_BYTES} SELECT nchunk, nblock, stream, i, ((byte - lag(byte, 1, 0) OVER (PARTITION BY nchunk, nblock, stream ORDER BY i) + 256) % 256)::BIGINT AS byte FROM b")
def bytedelta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.byte_delta(filters.byte_shuffle(event_chunks(spark, sf_dir), 8))


@query(f"WITH {_BYTES} SELECT nchunk, nblock, stream, i, byte FROM b")
def bytedelta_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.byte_undelta(filters.byte_delta(filters.byte_shuffle(event_chunks(spark, sf_dir), 8)))


@query(f"WITH {_EVENTS} SELECT nchunk, nblock, i, value FROM e")
def pipeline_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = filters.Pipeline([filters.stage("delta"), filters.stage("shuffle", itemsize=8), filters.stage("bytedelta")])
    return p.backward(p.forward(event_chunks(spark, sf_dir)))


_CUT = "CASE WHEN {x} IS NULL OR {x} = 0 THEN {x} ELSE sign({x}) * floor(abs({x}) / pow(2.0, e - {p})) * pow(2.0, e - {p}) END"
_EXPONENT = "CASE WHEN abs({x}) >= pow(2.0, floor(log2(abs({x}))) + 1) THEN floor(log2(abs({x}))) + 1 WHEN abs({x}) < pow(2.0, floor(log2(abs({x})))) THEN floor(log2(abs({x}))) - 1 ELSE floor(log2(abs({x}))) END"


@query(f"WITH x AS (SELECT event_id, value, CASE WHEN value <> 0 THEN {_EXPONENT.format(x='value')} END AS e FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value ELSE -value END AS value FROM events)) SELECT event_id, {_CUT.format(x='value', p=10)} AS value FROM x")
def trunc_prec_f64(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(-F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", bits.trunc_precision(value, 10).alias("value"))


@query(f"WITH {_CELLS}, x AS (SELECT d0, d1, value, CASE WHEN value <> 0 THEN {_EXPONENT.format(x='value')} END AS e FROM cells) SELECT d0, d1, {_CUT.format(x='value', p=7)} AS value FROM x")
def trunc_prec_f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = embeddings(spark, sf_dir)
    return _doubles(a.map_value(bits.trunc_precision(F.col("value"), -16, "f4")).cells())


@query("SELECT event_id, user_id & ~15 AS kept, (-user_id) & ~15 AS negative FROM events")
def int_trunc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", bits.int_trunc(F.col("user_id"), -4, 64).alias("kept"), bits.int_trunc(-F.col("user_id"), 60, 64).alias("negative"))


@query("SELECT event_id, round(value, 1) AS value FROM events")
def bounded_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", bits.bounded_error(F.col("value"), -1).alias("value"))


_CELL = f"""{_ADDRESS}, k AS (SELECT *, ((d0 % 20) % 7) // 3 AS a0, ((d1 % 25) % 9) // 3 AS a1, ((d0 % 20) % 7) % 3 AS o0, ((d1 % 25) % 9) % 3 AS o1 FROM a),
k2 AS (SELECT *, least(3, 7 - a0 * 3) AS l0, least(3, 9 - a1 * 3) AS l1 FROM k)"""


@query(f'WITH {_CELLS}, {_CELL} SELECT d0, d1, nchunk, nblock, a0 * 3 + a1 AS cell, o0 * l1 + o1 AS in_cell, a0 * 3 * 9 + a1 * 3 * l0 + o0 * l1 + o1 AS "position" FROM k2')
def ndcell_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.cell_order(embeddings(spark, sf_dir), 3).select("d0", "d1", "nchunk", "nblock", "cell", "in_cell", "position")


@query(f"WITH {_CELLS} SELECT d0, d1, value FROM cells")
def ndcell_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = embeddings(spark, sf_dir)
    return _doubles(filters.from_cell_order(a, filters.cell_order(a, 3), 3).cells())


@query(f"WITH {_CELLS}, {_CELL} SELECT nchunk, nblock, a0 * 3 + a1 AS cell, round(sum(value) / count(*), 9) AS mean, count(*) AS n FROM k2 GROUP BY 1, 2, 3")
def ndmean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.cell_mean(embeddings(spark, sf_dir), 3).withColumn("mean", F.round("mean", 9))


@query(f"WITH {_CELLS}, {_CELL} SELECT nchunk, nblock, a0 * 3 + a1 AS cell, round(sum(value) / max(l0 * l1), 9) AS mean, count(*) AS n FROM k2 GROUP BY 1, 2, 3")
def ndmean_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.cell_mean(embeddings(spark, sf_dir), 3, include_padding=True).withColumn("mean", F.round("mean", 9))


@query(f"WITH {_CELLS}, {_CELL} SELECT d0, d1, round(avg(value) OVER (PARTITION BY nchunk, nblock, a0, a1), 9) AS value FROM k2")
def ndmean_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.smooth(embeddings(spark, sf_dir), 3).cells().withColumn("value", F.round("value", 9))


# Callbacks, codecs, stores, growth


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS value FROM lineitem")
def prefilter_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))


@query(f"WITH {_CELLS}, {_ADDRESS} SELECT d0, d1, value * 2 + nchunk AS value FROM a")
def postfilter_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callbacks.map_cells(embeddings(spark, sf_dir), lambda value, nchunk, **_: value.cast("double") * 2 + nchunk, "f8").cells()


@query("SELECT event_id AS d0, value + user_id AS value FROM events")
def prefilter_two_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callbacks.combine([events(spark, sf_dir), events(spark, sf_dir, "user_id")], lambda a, b: a + b).cells()


@query("WITH t AS (SELECT event_id, value - 100 AS v, lag(value - 100) OVER (ORDER BY event_id) AS b FROM events) SELECT event_id // 1000 AS nchunk, event_id, b AS before, v AS value FROM t WHERE b * v < 0")
def sign_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select(F.expr("event_id div 1000").alias("nchunk"), "event_id", "value")
    return aggregate.sign_changes(t, "event_id", F.col("value") - 100)


@query("WITH x AS (SELECT event_id, event_id * 10.0 / (SELECT max(event_id) + 1 FROM events) AS x FROM events) SELECT event_id, round((x - 1.35) * (x - 4.45) * (x - 8.5), 6) AS y FROM x")
def polynomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = events(spark, sf_dir)
    x = F.col("d0") * F.lit(10.0) / F.lit(a.spec.nitems)
    return a.cells().select(F.col("d0").alias("event_id"), F.round((x - 1.35) * (x - 4.45) * (x - 8.5), 6).alias("y"))


@query("SELECT event_id // 1000 AS nchunk, event_id % 1000 AS i, value FROM events")
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = chunks.vl_blocks(table(spark, sf_dir, "events"), F.expr("event_id div 1000"), F.col("event_id"), F.col("value")).withColumnRenamed("blocks", "values")
    back = codecs.decode_chunks(codecs.encode_chunks(t, "f8", "zstd"), "f8", "double")
    return back.select("nchunk", F.posexplode("values").alias("i", "value")).withColumn("i", F.col("i").cast("long"))


@query("SELECT event_id // 1000 AS nchunk, (count(*) * 8)::BIGINT AS nbytes FROM events GROUP BY 1")
def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = chunks.vl_blocks(table(spark, sf_dir, "events"), F.expr("event_id div 1000"), F.col("event_id"), F.col("value")).withColumnRenamed("blocks", "values")
    return codecs.sizes(codecs.encode_chunks(t, "f8", "zlib"), "f8").where("cbytes > 0").select("nchunk", "nbytes")


@query(f"WITH {_CELLS}, {_SHAPE} SELECT d0 - n // 4 AS d0, d1 - 10 AS d1, value FROM cells, s WHERE d0 >= n // 4 AND d0 < n - n // 4 AND d1 >= 10 AND d1 < 50")
def store_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved to a store, opened, and sliced by its chunks."""
    a = embeddings(spark, sf_dir)
    path = _shared_folder(spark, "store")
    store.save(a, path)
    back = store.open_array(spark, path)
    n = back.spec.shape[0]
    return _doubles(select.get_slice(back, (n // 4, 10), (n - n // 4, 50)).cells())


@query(f"WITH {_CELLS}, {_SHAPE} SELECT d0, d1, value FROM cells UNION ALL SELECT d0 + n, d1, value FROM cells, s")
def store_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store grown by another copy of the array; a reader that refreshes sees both."""
    a = embeddings(spark, sf_dir)
    path = _shared_folder(spark, "growing")
    store.save(a, path)
    reader = store.open_array(spark, path)
    store.append_cells(spark, path, a, 0)
    _, reader = store.refresh(spark, path, reader)
    return _doubles(reader.cells())


@query("SELECT event_id AS d0, CASE WHEN event_id // 1000 = 1 THEN value + 1 ELSE value END AS value FROM events")
def growth_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that follows a writer: two batches, then one chunk rewritten; the last version of every cell counts."""
    cells = events(spark, sf_dir).cells()
    base = _shared_folder(spark, "growth")
    half = F.col("d0") % 2000 < 1000
    for version, part in enumerate((cells.where(half), cells.where(~half), cells.where(F.expr("d0 div 1000 = 1")).withColumn("value", F.col("value") + 1))):
        growth.write_version(part, f"{base}/in", version)
        growth.drain(growth.follow(spark, f"{base}/in", 1, "double"), f"{base}/out", f"{base}/checkpoint")
    return growth.latest(spark.read.schema(growth.cell_schema(1, "double")).parquet(f"{base}/out"), 1).select("d0", "value")


@query("SELECT * FROM (VALUES ('author', 'fixed', '616e6e'), ('notes', 'vl', '6c6f6e676572'), ('units', 'fixed', '6d6d')) t(name, kind, content)")
def metalayers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of a stored array after additions, an update and a deletion."""
    path = _shared_folder(spark, "layers")
    store.save(ChunkedArray.zeros(spark, ArraySpec((10,), (5,), (5,), "i4")), path)
    store.set_layer(spark, path, "units", b"cm")
    store.set_layer(spark, path, "author", b"ann")
    store.set_layer(spark, path, "units", b"mm", update=True)
    store.set_layer(spark, path, "notes", b"short", "vl")
    store.set_layer(spark, path, "draft", b"gone", "vl")
    store.delete_layer(spark, path, "draft")
    store.set_layer(spark, path, "notes", b"longer", "vl", update=True)
    newest = store.history(spark, path).orderBy(F.desc("version")).limit(1).select(F.explode("layers").alias("x"))
    return newest.select("x.name", "x.kind", F.lower(F.hex("x.content")).alias("content"))


@query(f"WITH {_CELLS}, {_SHAPE} SELECT d0, d1, value FROM cells, s WHERE d0 < n // 2 AND d1 < 30")
def store_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store shrunk in both dimensions."""
    path = _shared_folder(spark, "shrunk")
    a = embeddings(spark, sf_dir)
    store.save(a, path)
    store.shrink(spark, path, (a.spec.shape[0] // 2, 30))
    return _doubles(store.open_array(spark, path).cells())


@query(f"""WITH {_CELLS}, {_SHAPE}, grown AS (SELECT d0, d1, value FROM cells UNION ALL SELECT d0, d1 + w, value FROM cells, s)
 SELECT d0 - n // 4 AS d0, d1 - 50 AS d1, value FROM grown, s WHERE d0 >= n // 4 AND d0 < n - n // 4 AND d1 >= 50 AND d1 < 90""")
def store_grown_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice over both parts of a store that has grown along its second dimension; each part is pruned by its own chunks."""
    path = _shared_folder(spark, "grown")
    a = embeddings(spark, sf_dir)
    store.save(a, path)
    store.append_cells(spark, path, a, 1)
    n = a.spec.shape[0]
    return _doubles(select.get_slice(store.open_array(spark, path), (n // 4, 50), (n - n // 4, 90)).cells())


@query("SELECT (i + 1)::BIGINT AS d0, (i * i)::BIGINT AS value FROM range(40) t(i)")
def store_second_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another array in the same store, read after the store was renamed."""
    path = _shared_folder(spark, "two")
    store.save(ChunkedArray.zeros(spark, ArraySpec((10,), (5,), (5,), "i4")), path)
    squares = ChunkedArray.from_flat(spark.range(40), ArraySpec((40,), (9,), (4,), "i8"), F.col("id"), F.col("id") * F.col("id"))
    store.save_append(squares, path, "squares")
    store.rename(spark, path, path + "-new")
    return store.open_array(spark, path + "-new", "squares").cells().withColumn("d0", F.col("d0") + 1)


@query("SELECT 'names' AS what, 'b,c' AS value UNION ALL SELECT 'has_a', 'true' UNION ALL SELECT 'has_gone', 'false' UNION ALL SELECT 'a', '7979'")
def layer_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, presence and content of metadata layers."""
    path = _shared_folder(spark, "lookup")
    store.save(ChunkedArray.zeros(spark, ArraySpec((10,), (5,), (5,), "i4")), path)
    for name, kind in (("a", "fixed"), ("b", "vl"), ("c", "vl"), ("gone", "vl")):
        store.set_layer(spark, path, name, b"yy", kind)
    store.delete_layer(spark, path, "gone")
    rows = [("names", ",".join(store.layer_names(spark, path))), ("has_a", str(store.has_layer(spark, path, "a")).lower()), ("has_gone", str(store.has_layer(spark, path, "gone", "vl")).lower()), ("a", store.get_layer(spark, path, "a").hex())]
    return spark.createDataFrame(rows, "what string, value string")


@query(f"WITH {_CELLS} SELECT d0, d1, value FROM cells")
def buffer_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The array as one buffer and back."""
    return _doubles(frames.from_buffer(spark, frames.to_buffer(embeddings(spark, sf_dir))).cells())


def _through_blocks(spark: SparkSession, sf_dir: str, codec: str, *names: str) -> DataFrame:
    a, options = embeddings(spark, sf_dir), config.WriteOptions(codec, filters=names)
    return _doubles(blocks.decode(blocks.encode(a, options), a, options).cells())


@query(f"WITH {_CELLS} SELECT d0, d1, value FROM cells")
def block_shuffle_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks through byte shuffle, byte delta and zstd, and back."""
    return _through_blocks(spark, sf_dir, "zstd", "shuffle", "bytedelta")


@query(f"WITH {_CELLS} SELECT d0, d1, value FROM cells")
def block_bitshuffle_zlib(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through_blocks(spark, sf_dir, "zlib", "bitshuffle")


@query(f"WITH {_CELLS} SELECT d0, d1, value FROM cells")
def block_delta_lz4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through_blocks(spark, sf_dir, "lz4", "delta", "shuffle")


@query(f"WITH {_CELLS}, {_ADDRESS} SELECT d0, d1, value FROM a WHERE nblock NOT IN (0, 4)")
def block_masked_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded blocks read but for masked ones."""
    a, options = embeddings(spark, sf_dir), config.WriteOptions("zstd")
    return _doubles(blocks.decode(blocks.encode(a, options), a, options, config.ReadOptions(masked_blocks=(0, 4))).cells())


def _event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.vl_blocks(table(spark, sf_dir, "events"), F.expr("event_id div 1000"), F.col("event_id"), F.col("value")).withColumnRenamed("blocks", "values")


@query("SELECT event_id // 1000 AS nchunk, 'zlib' AS codec, count(*)::BIGINT AS nitems, (count(*) * 8)::BIGINT AS nbytes, true AS is_valid FROM events GROUP BY 1")
def payload_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the headers of encoded chunks say, without decoding."""
    found = codecs.payload_info(codecs.encode_chunks(_event_values(spark, sf_dir), "f8", "zlib"), "f8")
    return found.select("nchunk", "codec", F.col("nitems").cast("long").alias("nitems"), F.col("nbytes").cast("long").alias("nbytes"), "is_valid")


@query("SELECT event_id // 1000 AS nchunk, event_id % 1000 AS i, value FROM events")
def user_codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks through a codec of the caller's."""
    if 201 not in codecs.registered():
        turned = bytes(255 - i for i in range(256))
        codecs.register(codecs.Codec(201, "turned", lambda raw, level: zlib.compress(raw.translate(turned), level), lambda raw: zlib.decompress(raw).translate(turned)))
    back = codecs.decode_chunks(codecs.encode_chunks(_event_values(spark, sf_dir), "f8", "turned"), "f8", "double")
    return back.select("nchunk", F.posexplode("values").alias("i", "value")).withColumn("i", F.col("i").cast("long"))


class Counting(datasource.Backend):
    """A source that makes its bytes: at byte 8 i of a path stands the whole number i plus the path's number."""

    def size(self, path: str) -> int:
        return 1 << 62

    def read(self, path: str, offset: int, length: int) -> bytes:
        return b"\0" + np.arange(offset // 8, (offset + length) // 8, dtype="<i8").__add__(int(path)).tobytes()


@query("SELECT (i // 100)::BIGINT AS nchunk, (i % 100)::BIGINT AS i, (9007199254740993 + i)::BIGINT AS value FROM range(1000) t(i)")
def user_io_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks read through a backend of the caller's, with whole numbers beyond what doubles can hold."""
    if "counting" not in datasource.backends():
        datasource.register_io("counting", Counting())
    return datasource.read_chunks(spark, "9007199254740993", [(800 * n, 800, 100, "none") for n in range(10)], "i8", "counting")


@query("SELECT event_id AS d0, CASE WHEN event_id BETWEEN 7 AND 9 THEN -(event_id - 6)::DOUBLE ELSE value END AS value FROM events")
def flat_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three items of a vector overwritten from a buffer."""
    return mutate.flat_patch(events(spark, sf_dir), 7, [-1.0, -2.0, -3.0]).cells()


@query("SELECT c_custkey, substr(hex(encode(c_name)), 3, 8) AS bytes FROM customer")
def get_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of payloads, by items of one byte."""
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").cast("binary").alias("payload"))
    return select.get_bytes(df, "payload", 1, 4, 1).select("c_custkey", F.hex("bytes").alias("bytes"))
