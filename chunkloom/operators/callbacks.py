"""User functions on the values of chunks: before storage (prefilters) and after reading (postfilters).

A function is a column expression wherever one will do; else an Arrow function of whole batches. Both see the chunk and
block numbers of their cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..array import ChunkedArray
from ..errors import InvalidParam
from ..spec import SPARK_TYPES

_NAMED: dict[str, Callable[[ChunkedArray], ChunkedArray]] = {}


def map_cells(array: ChunkedArray, function: Callable[..., Column], dtype: str | None = None) -> ChunkedArray:
    """``function`` of the value column, the coordinates, and the chunk and block numbers (by these names) gives the new value."""
    cells = array.addressed()
    value = function(value=F.col("value"), nchunk=F.col("nchunk"), nblock=F.col("nblock"), **{d: F.col(d) for d in array.dims})
    kind = SPARK_TYPES[dtype] if dtype else dict(array.df.dtypes)["value"]
    out = cells.select(*array.dims, value.cast(kind).alias("value"))
    return array.with_cells(out, replace(array.spec, dtype=dtype or array.spec.dtype), True)


def combine(arrays: list[ChunkedArray], function: Callable[..., Column]) -> ChunkedArray:
    """A new value from the values of several arrays of one shape, cell by cell (joined on the coordinates). A cell that an array
    does not store is null there."""
    first = arrays[0]
    if any(a.spec.shape != first.spec.shape for a in arrays):
        raise InvalidParam("arrays of different shape")
    df = first.cells().withColumnRenamed("value", "v0")
    for k, a in enumerate(arrays[1:], 1):
        df = df.join(a.cells().withColumnRenamed("value", f"v{k}"), first.dims, "full")
    value = function(*(F.col(f"v{k}") for k in range(len(arrays))))
    return first.with_cells(df.select(*first.dims, value.alias("value")), None, True)


def map_batches(array: ChunkedArray, function: Callable[[pa.RecordBatch], pa.Array], dtype: str) -> ChunkedArray:
    """For what no expression can say: an Arrow function of batches of addressed cells, giving their new values."""
    cells = array.addressed().select(*array.dims, "nchunk", "nblock", "value")
    keep = len(array.dims)
    kind = {"byte": pa.int8(), "short": pa.int16(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64()}[SPARK_TYPES[dtype]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value = function(b)
            yield pa.RecordBatch.from_arrays([*b.columns[:keep], value.cast(kind)], names=[*b.schema.names[:keep], "value"])

    out = cells.mapInArrow(run, ", ".join([*(f"{d} long" for d in array.dims), f"value {SPARK_TYPES[dtype]}"]))
    return array.with_cells(out, replace(array.spec, dtype=dtype), True)


def register(name: str, function: Callable[[ChunkedArray], ChunkedArray]) -> None:
    if name in _NAMED:
        raise InvalidParam(f"{name!r} is taken")
    _NAMED[name] = function


def apply(name: str, array: ChunkedArray) -> ChunkedArray:
    if name not in _NAMED:
        raise InvalidParam(f"no function {name!r}")
    return _NAMED[name](array)
