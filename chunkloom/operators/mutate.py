"""Changing arrays: concatenation, append, insert, delete, resize, and writing regions. Each gives a new array."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..array import ChunkedArray
from ..errors import ChunkError, InvalidIndex, InvalidParam
from ..functions import geometry
from ..spec import SPARK_TYPES, ArraySpec
from . import select


def _axis(array: ChunkedArray, axis: int) -> str:
    if not 0 <= axis < array.spec.ndim:
        raise InvalidParam(f"no axis {axis}")
    return f"d{axis}"


def _longer(spec: ArraySpec, axis: int, by: int) -> ArraySpec:
    return spec.with_shape([n + by * (i == axis) for i, n in enumerate(spec.shape)])


def concatenate(a: ChunkedArray, b: ChunkedArray, axis: int) -> ChunkedArray:
    """b after a along the axis; the other lengths and the dtypes must agree. Chunks and metadata are a's."""
    d = _axis(a, axis)
    if a.spec.dtype != b.spec.dtype or a.spec.ndim != b.spec.ndim or any(m != n for i, (m, n) in enumerate(zip(a.spec.shape, b.spec.shape, strict=True)) if i != axis):
        raise InvalidParam("shapes or dtypes that do not fit")
    moved = b.cells().withColumn(d, F.col(d) + F.lit(a.spec.shape[axis]))
    return a.with_cells(a.cells().unionByName(moved), _longer(a.spec, axis, b.spec.shape[axis]), True)


def append(array: ChunkedArray, slab: ChunkedArray, axis: int) -> ChunkedArray:
    return concatenate(array, slab, axis)


def insert(array: ChunkedArray, slab: ChunkedArray, axis: int, at: int, strict: bool = False) -> ChunkedArray:
    """The slab before position ``at``; what is there moves up. ``strict``: inside the array, only whole chunks at chunk borders."""
    d, length = _axis(array, axis), slab.spec.shape[axis]
    n, c = array.spec.shape[axis], array.spec.chunkshape[axis]
    if not 0 <= at <= n:
        raise InvalidIndex(f"no position {at}")
    if any(m != k for i, (m, k) in enumerate(zip(array.spec.shape, slab.spec.shape, strict=True)) if i != axis):
        raise InvalidParam("a slab of another shape")
    if strict and at != n and (at % c or length % c):
        raise ChunkError("inside an array only whole chunks can be inserted")
    moved = array.cells().withColumn(d, F.when(F.col(d) >= at, F.col(d) + length).otherwise(F.col(d)))
    new = slab.cells().withColumn(d, F.col(d) + F.lit(at))
    return array.with_cells(moved.unionByName(new), _longer(array.spec, axis, length), True)


def delete(array: ChunkedArray, axis: int, start: int, length: int, strict: bool = False) -> ChunkedArray:
    """Without positions [start, start + length) of the axis; what follows moves down."""
    d = _axis(array, axis)
    n, c = array.spec.shape[axis], array.spec.chunkshape[axis]
    if start < 0 or length < 0 or start + length > n:
        raise InvalidIndex("a region outside the array")
    if strict and start + length != n and (start % c or length % c):
        raise ChunkError("inside an array only whole chunks can be deleted")
    stay = array.cells().where((F.col(d) < start) | (F.col(d) >= start + length))
    return array.with_cells(stay.withColumn(d, F.when(F.col(d) >= start + length, F.col(d) - length).otherwise(F.col(d))), _longer(array.spec, axis, -length), True)


def resize(array: ChunkedArray, shape: Sequence[int], start: Sequence[int] | None = None, pad: object = 0) -> ChunkedArray:
    """Shrink, then grow, dimension by dimension. ``start``: where to cut or to put the new cells (default: the end).

    New cells hold ``pad`` (0). This differs from stores that show leftover padding of a chunk that was only partly used.
    """
    s = array.spec
    if len(shape) != s.ndim or min(shape, default=0) < 0:
        raise InvalidParam("one length for each dimension, none negative")
    for i, (n, m) in enumerate(zip(s.shape, shape, strict=True)):
        if m < n:
            array = delete(array, i, m if start is None else start[i], n - m)
    s = array.spec
    grown = tuple(shape)
    if grown == s.shape:
        return array
    moved = array.cells()
    for i, (n, m) in enumerate(zip(s.shape, grown, strict=True)):
        if start is not None and m > n and start[i] < n:
            d = f"d{i}"
            moved = moved.withColumn(d, F.when(F.col(d) >= start[i], F.col(d) + (m - n)).otherwise(F.col(d)))
    # Only the new cells are generated, slab by slab: new in dimension i, old in those before it, any in those after it. Nothing is joined.
    new_spec, out = s.with_shape(grown), moved
    for i, (n, m) in enumerate(zip(s.shape, grown, strict=True)):
        if m > n:
            slab = ArraySpec(tuple(s.shape[j] if j < i else m - n if j == i else grown[j] for j in range(s.ndim)))
            coords = geometry.from_flat(slab, F.col("id"))
            for j in range(i):
                if grown[j] > s.shape[j] and start is not None and start[j] < s.shape[j]:
                    coords[j] = F.when(coords[j] >= start[j], coords[j] + (grown[j] - s.shape[j])).otherwise(coords[j])
            coords[i] = coords[i] + (n if start is None else min(start[i], n))
            fresh = array.df.sparkSession.range(slab.nitems).select(*(c.cast("long").alias(d) for c, d in zip(coords, array.dims, strict=True)), F.lit(pad).cast(SPARK_TYPES[s.dtype]).alias("value"))
            out = out.unionByName(fresh)
    return array.with_cells(out, new_spec, True)


def patch(array: ChunkedArray, cells: DataFrame) -> ChunkedArray:
    """Overwrite cells with those of a frame (d0 .. dn-1, value); coordinates may occur once."""
    new = cells.select(*array.dims, F.col("value").alias("_new"), F.lit(True).alias("_there"))
    out = array.cells().join(new, array.dims, "left")
    return array.with_cells(out.select(*array.dims, F.when(F.col("_there"), F.col("_new")).otherwise(F.col("value")).alias("value")), None, True)


def set_slice(array: ChunkedArray, start: Sequence[int], stop: Sequence[int], values: ChunkedArray) -> ChunkedArray:
    """Overwrite [start, stop) with an array of that shape. Cells outside the region pass by the join."""
    array.spec.check_slice(start, stop)
    if tuple(b - a for a, b in zip(start, stop, strict=True)) != values.spec.shape:
        raise InvalidParam("an array of another shape")
    moved = values.cells().select(*((F.col(d) + F.lit(a)).alias(d) for d, a in zip(array.dims, start, strict=True)), "value")
    inside = select._inside(start, stop)
    hit = patch(array.with_cells(array.cells().where(inside)), moved)
    return array.with_cells(array.cells().where(~inside).unionByName(hit.cells()), None, True)


def outer_set(array: ChunkedArray, selection: Sequence[Sequence[int]], values: ChunkedArray) -> ChunkedArray:
    """Write an array to the outer product of index lists; of repeated indices the last position counts."""
    if values.spec.shape != tuple(len(s) for s in selection) or len(selection) != array.spec.ndim:
        raise InvalidParam("an array of another shape")
    df = values.cells().select(*(F.col(d).alias(f"pos_{d}") for d in values.dims), "value")
    for i, wanted in enumerate(selection):
        if bad := [x for x in wanted if not 0 <= x < array.spec.shape[i]]:
            raise InvalidIndex(f"{bad[0]} is not in dimension {i}")
        last = {int(x): p for p, x in enumerate(wanted)}  # only the last position of an index can win
        given = array.df.sparkSession.createDataFrame([(p, x) for x, p in last.items()], f"pos_d{i} long, d{i} long")
        df = df.join(F.broadcast(given) if len(last) <= select.BROADCAST_ROWS else given, f"pos_d{i}")
    return patch(array, df)


def copy_as(array: ChunkedArray, dtype: str) -> ChunkedArray:
    return array.map_value(F.col("value").cast(SPARK_TYPES[dtype]), dtype)


def last_writer(patches: DataFrame, coords: Sequence[str], order: str) -> DataFrame:
    """Of patches to the same cell, the one with the highest order."""
    w = Window.partitionBy(*coords).orderBy(F.desc(order))
    return patches.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def flat_patch(array: ChunkedArray, start: int, values: Sequence[object]) -> ChunkedArray:
    """Overwrite items [start, start + n) of a one-dimensional array with a list."""
    if start < 0 or start + len(values) > array.spec.nitems or array.spec.ndim != 1:
        raise InvalidIndex("a region outside the array")
    spark = array.df.sparkSession
    df = spark.createDataFrame([(start + i, v) for i, v in enumerate(values)], f"d0 long, value {SPARK_TYPES[array.spec.dtype]}")
    return patch(array, F.broadcast(df) if len(values) <= select.BROADCAST_ROWS else df)
