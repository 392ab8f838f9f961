"""Shared plumbing: reading tables, durable materialisation, row-streaming Arrow maps."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import shared_folder

#: Rows decoded at once from an Arrow batch, so that a batch of long texts is never unpacked whole.
SLICE = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster shares; only in local mode (tests) one of our own."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor costs a re-read and not a re-run."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the files of shuffles that no plan refers to; Spark removes them when the driver collects its garbage. What holds
    them is itself let go of by a first collection, so there are two."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as make it differ from all that are taken (in any case of letters)."""
    used = {x.lower() for x in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        out.append(name)
    return out


def null_safe_key(*cols: Column) -> Column:
    """A string key of columns, distinct for null and for every text (no separator can be forged: lengths lead)."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("n")) for c in cols]
    return F.concat(*parts)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, a few hundred at a time in Python."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def batches_of(rows: Iterator[tuple], schema: pa.Schema, most_rows: int = 2048, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows; closed early when their strings and binaries add up."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if len(held) >= most_rows or size >= most_bytes:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string with the types used here."""
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
        "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    }
    return pa.schema([pa.field(name, kinds[kind]) for name, kind in (x.strip().split(" ", 1) for x in ddl.split(","))])


def map_rows(df: DataFrame, make: Callable[[], Callable[[Iterator[tuple]], Iterator[tuple]]], ddl: str) -> DataFrame:
    """``mapInArrow`` with a generator over row tuples. ``make`` runs once in each task and returns the generator function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(make()(rows_of(batches)), arrow_schema(ddl))

    return df.mapInArrow(run, ddl)
