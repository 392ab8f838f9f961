"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows are shuffled by a seeded hash within each source and ranked there; a row's fractional rank
``(rank + phase) / rows_of_source`` spreads every source evenly over [0, 1). Sorting all rows by the fractional rank
and cutting the order into equal runs gives shards that each match the mixture and whose row counts differ by one at
most (the law ``rows``).

Scale: neither rank is one window. Within a source, rows go to ``BUCKETS`` hash ranges and the window runs inside a
(source, range); the global order uses ``BUCKETS`` ranges of the fractional rank. Offsets come from counts. So a source
with a third of all rows is spread over ``BUCKETS`` groups, and only (id, source, size, crc) is shuffled, never text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, null_safe_key

SHARDS = 24
SEED = 17
#: Hash ranges of a source, and ranges of the fractional rank. A constant, whatever the size of the input.
BUCKETS = 4096


def interleave(rows: DataFrame, stratum: str, order_by: list[str], n_shards: int, seed: int = SEED) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long) to ``rows``.

    ``order_by``: columns that identify a row; their hash is the seeded shuffle, they themselves break its ties. Rows equal
    in all of them are interchangeable. A null stratum is a stratum of its own. An empty table gives an empty table.
    Columns of ``rows`` whose names start with ``_si_`` are not allowed.
    """
    key, rank, h = "_si_key", "_si_rank", "_si_hash"
    keyed = rows.withColumns({key: null_safe_key(F.col(stratum)), h: F.xxhash64(F.lit(seed), *(F.col(c) for c in order_by))})
    keyed = keyed.withColumn("_si_bucket", F.shiftrightunsigned(F.col(h), 52).cast("int"))
    counts = keyed.groupBy(key, "_si_bucket").agg(F.count("*").alias("_si_n"))
    by_key = Window.partitionBy(key)
    counts = counts.select(
        key,
        "_si_bucket",
        (F.sum("_si_n").over(by_key.orderBy("_si_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_si_n")).alias("_si_before"),
        F.sum("_si_n").over(by_key).alias("_si_total"),
    )
    inside = Window.partitionBy(key, "_si_bucket").orderBy(h, *order_by)
    ranked = keyed.withColumn(rank, F.row_number().over(inside).cast("long")).join(counts, [key, "_si_bucket"])
    ranked = ranked.withColumn(rank, F.col(rank) - 1 + F.col("_si_before"))
    phase = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), F.col(key)), 11).cast("double") / F.lit(float(1 << 53))
    ranked = ranked.withColumn("_si_at", (F.col(rank) + phase) / F.col("_si_total"))
    ranked = ranked.withColumn("_si_range", F.least(F.floor(F.col("_si_at") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    ranges = ranked.groupBy("_si_range").agg(F.count("*").alias("_si_m"))
    # At most BUCKETS rows: the one window here without a partition.
    ranges = ranges.select(
        "_si_range",
        (F.sum("_si_m").over(Window.orderBy("_si_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_si_m")).alias("_si_first"),
        F.sum("_si_m").over(Window.partitionBy()).alias("_si_all"),
    )
    overall = Window.partitionBy("_si_range").orderBy("_si_at", key, rank)
    placed = ranked.withColumn("_si_place", F.row_number().over(overall).cast("long")).join(ranges, "_si_range")
    placed = placed.withColumn("_si_place", F.col("_si_place") - 1 + F.col("_si_first"))
    shard = F.expr(f"cast(_si_place * {n_shards} div _si_all as int)")
    placed = placed.withColumn("shard", shard)
    # The first place of shard s is ceil(s * all / shards).
    slot = F.expr(f"_si_place - ((cast(shard as bigint) * _si_all + {n_shards - 1}) div {n_shards})")
    return placed.withColumn("slot", slot).select(*rows.columns, "shard", "slot")


def shard_documents(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Put every document into a shard; columns as the contract of op6 has them, law ``rows``.

    Null text: size 8, crc32 of no bytes (0). Null doc_id or source: a value like any other. Repeated rows each get a slot
    of their own. Extra columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").alias("_source"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    out = interleave(rows, "_source", ["doc_id", "size", "text_crc32"], n_shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))
