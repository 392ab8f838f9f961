"""Addresses of cells as column expressions; all stay in generated code."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import ArraySpec, row_major


def dims(ndim: int) -> list[str]:
    return [f"d{i}" for i in range(ndim)]


def div(x: Column, by: int) -> Column:
    """Whole part of x / by in whole numbers, for x >= 0."""
    return x if by == 1 else F.call_function("div", x.cast("long"), F.lit(by).cast("long"))


def dot(columns: Sequence[Column], strides: Sequence[int]) -> Column:
    out = F.lit(0).cast("long")
    for c, s in zip(columns, strides, strict=True):
        out = out + c * F.lit(s).cast("long")
    return out


def flat_index(spec: ArraySpec, columns: Sequence[Column] | None = None) -> Column:
    """C-order position of the cell."""
    return dot(columns or [F.col(d) for d in dims(spec.ndim)], spec.strides)


def from_flat(spec: ArraySpec, flat: Column) -> list[Column]:
    """The coordinates of a C-order position."""
    return [div(flat, s) % F.lit(max(n, 1)).cast("long") if i else div(flat, s) for i, (s, n) in enumerate(zip(spec.strides, spec.shape, strict=True))]


def chunk_number(spec: ArraySpec, columns: Sequence[Column] | None = None) -> Column:
    columns = columns or [F.col(d) for d in dims(spec.ndim)]
    return dot([div(x, max(c, 1)) for x, c in zip(columns, spec.chunkshape, strict=True)], row_major(spec.chunk_grid))


def block_number(spec: ArraySpec, columns: Sequence[Column] | None = None) -> Column:
    columns = columns or [F.col(d) for d in dims(spec.ndim)]
    inside = [x % F.lit(max(c, 1)).cast("long") for x, c in zip(columns, spec.chunkshape, strict=True)]
    return dot([div(x, max(b, 1)) for x, b in zip(inside, spec.blockshape, strict=True)], row_major(spec.block_grid))


def block_offset(spec: ArraySpec, columns: Sequence[Column] | None = None) -> Column:
    columns = columns or [F.col(d) for d in dims(spec.ndim)]
    inside = [x % F.lit(max(c, 1)).cast("long") % F.lit(max(b, 1)).cast("long") for x, c, b in zip(columns, spec.chunkshape, spec.blockshape, strict=True)]
    return dot(inside, row_major(spec.blockshape))


def storage_position(spec: ArraySpec, columns: Sequence[Column] | None = None) -> Column:
    items, block = math.prod(spec.extchunkshape), math.prod(spec.blockshape)
    return chunk_number(spec, columns) * F.lit(items).cast("long") + block_number(spec, columns) * F.lit(block).cast("long") + block_offset(spec, columns)


def from_block(spec: ArraySpec, nchunk: Column, nblock: Column, offset: Column) -> list[Column]:
    """The coordinates of a place in a block."""
    of_chunk, of_block, inside = (from_flat(ArraySpec(shape), c) for shape, c in ((spec.chunk_grid, nchunk), (spec.block_grid, nblock), (spec.blockshape, offset)))
    return [c * F.lit(m).cast("long") + b * F.lit(n).cast("long") + i for c, m, b, n, i in zip(of_chunk, spec.chunkshape, of_block, spec.blockshape, inside, strict=True)]
