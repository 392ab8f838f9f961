"""Reading parts of arrays: slices, gathers, outer selections, views, chunks and blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..array import ChunkedArray
from ..errors import ChunkError, InvalidIndex, InvalidParam
from ..functions import geometry
from ..spec import ArraySpec, row_major

#: Rows of a list given by the caller up to which it is broadcast; longer lists are joined like any table.
BROADCAST_ROWS = 100_000
#: Chunk numbers written out in a predicate; beyond it only their range is.
MOST_LISTED = 512


def prune_to(array: ChunkedArray, first: int, last: int, listed: Sequence[int] | None = None) -> DataFrame:
    """The stored chunks from ``first`` to ``last``, or those listed: predicates on the partition column and on the sorted chunk number."""
    if "nchunk" not in array.df.columns:
        return array.df
    df, per = array.df, array.meta.get("_chunks_per_group")
    if "chunk_group" in df.columns and per:
        df = df.where(F.col("chunk_group").between(first // int(per), last // int(per)))
        if listed is not None:
            df = df.where(F.col("chunk_group").isin(sorted({n // int(per) for n in listed})))
    df = df.where(F.col("nchunk").between(first, last))
    return df if listed is None else df.where(F.col("nchunk").isin(sorted(listed)))


def _of_parts(array: ChunkedArray, pruned: Callable[[ChunkedArray], DataFrame]) -> DataFrame:
    """The cells of the parts, each pruned by the geometry it was written in."""
    return reduce(DataFrame.unionByName, [pruned(p).select(*array.dims, "value") for p in array.parts])


def _prune_points(array: ChunkedArray, points: Sequence[Sequence[int]]) -> DataFrame:
    """The stored chunks that hold any of the points."""
    if array.parts:
        return _of_parts(array, lambda p: _prune_points(p, [x for x in points if all(i < n for i, n in zip(x, p.spec.shape, strict=True))]))
    if "nchunk" not in array.df.columns:
        return array.df
    touched = {array.spec.address(x)[0] for x in points}
    if not touched:
        return array.df.where(F.lit(False))
    return prune_to(array, min(touched), max(touched), sorted(touched) if len(touched) <= MOST_LISTED else None)


def prune(array: ChunkedArray, start: Sequence[int], stop: Sequence[int]) -> DataFrame:
    """The stored chunks a region touches."""
    if array.parts:
        return _of_parts(array, lambda p: prune(p, [min(a, n) for a, n in zip(start, p.spec.shape, strict=True)], [min(b, n) for b, n in zip(stop, p.spec.shape, strict=True)]))
    if "nchunk" not in array.df.columns:
        return array.df
    box = array.spec.chunk_box(start, stop)
    count = math.prod(b - a for a, b in box)
    if not count:
        return array.df.where(F.lit(False))
    grid = row_major(array.spec.chunk_grid)
    first, last = (sum(x * s for x, s in zip(at, grid, strict=True)) for at in ([a for a, _ in box], [b - 1 for _, b in box]))
    return prune_to(array, first, last, list(array.spec.slice_chunks(start, stop)) if count <= MOST_LISTED and count < last - first + 1 else None)


def prune_outer(array: ChunkedArray, selection: Sequence[Sequence[int]]) -> DataFrame:
    """The stored chunks an outer selection touches: the listed ones if they are few, else their range."""
    if array.parts:
        return _of_parts(array, lambda p: prune_outer(p, [[x for x in wanted if x < n] for wanted, n in zip(selection, p.spec.shape, strict=True)]))
    parts = [sorted({x // c for x in wanted}) for wanted, c in zip(selection, array.spec.chunkshape, strict=True)]
    if not all(parts):
        return array.df.where(F.lit(False))
    grid = row_major(array.spec.chunk_grid)
    number = lambda at: sum(x * s for x, s in zip(at, grid, strict=True))
    few = math.prod(map(len, parts)) <= MOST_LISTED
    return prune_to(array, number([p[0] for p in parts]), number([p[-1] for p in parts]), [number(at) for at in product(*parts)] if few else None)


def _inside(start: Sequence[int], stop: Sequence[int]) -> Column:
    terms = [(F.col(f"d{i}") >= a) & (F.col(f"d{i}") < b) for i, (a, b) in enumerate(zip(start, stop, strict=True))]
    return reduce(lambda x, y: x & y, terms, F.lit(True))


def get_slice(array: ChunkedArray, start: Sequence[int], stop: Sequence[int], chunkshape: Sequence[int] | None = None, blockshape: Sequence[int] | None = None) -> ChunkedArray:
    """The hyper-rectangle [start, stop) as an array of its own, chunked anew if asked for."""
    array.spec.check_slice(start, stop)
    shape = [b - a for a, b in zip(start, stop, strict=True)]
    df = prune(array, start, stop).where(_inside(start, stop))
    df = df.select(*((F.col(d) - F.lit(a)).alias(d) for d, a in zip(array.dims, start, strict=True)), "value")
    fits = lambda old, new: [min(o, n) if n else 0 for o, n in zip(old, new, strict=True)]
    chunk = list(chunkshape) if chunkshape is not None else fits(array.spec.chunkshape, shape)
    block = list(blockshape) if blockshape is not None else fits(array.spec.blockshape, chunk)
    return array.with_cells(df, ArraySpec(tuple(shape), tuple(chunk), tuple(block), array.spec.dtype))


def slice_chunks(array: ChunkedArray, start: Sequence[int], stop: Sequence[int]) -> DataFrame:
    """(nchunk) of the chunks a slice touches; arithmetic on the box of chunks, no cell is read."""
    box = array.spec.chunk_box(start, stop)
    lengths = [b - a for a, b in box]
    coords = geometry.from_flat(ArraySpec(tuple(lengths)), F.col("id"))
    shifted = [c + F.lit(a) for c, (a, _) in zip(coords, box, strict=True)]
    return array.df.sparkSession.range(math.prod(lengths)).select(geometry.dot(shifted, row_major(array.spec.chunk_grid)).alias("nchunk"))


def _given(array: ChunkedArray, values: Sequence[int], name: str) -> DataFrame:
    df = array.df.sparkSession.createDataFrame([(i, int(v)) for i, v in enumerate(values)], f"pos_{name} long, {name} long")
    return F.broadcast(df) if len(values) <= BROADCAST_ROWS else df


def take(array: ChunkedArray, coords: DataFrame | Sequence[int]) -> DataFrame:
    """(pos, flat_idx, value): a gather by C-order positions, in any order and with repeats.

    ``coords``: a list, or a frame (pos, flat_idx). Positions outside the array raise; a cell that is not stored gives null.
    """
    if array.spec.ndim == 0:
        raise InvalidParam("a gather needs a dimension")
    n, source = array.spec.nitems, array.df
    if isinstance(coords, DataFrame):
        at = F.col("flat_idx").cast("long")
        message = F.concat(at.cast("string"), F.lit(f" is not in an array of {n} items"))
        wanted = coords.select("pos", F.when((at < 0) | (at >= n) | at.isNull(), F.raise_error(F.coalesce(message, F.lit("null position"))).cast("long")).otherwise(at).alias("flat_idx"))
    else:
        if bad := [x for x in coords if not 0 <= x < n]:
            raise InvalidIndex(f"{bad[0]} is not in an array of {n} items")
        wanted = _given(array, coords, "flat_idx").withColumnRenamed("pos_flat_idx", "pos")
        if len(coords) and ("nchunk" in array.df.columns or array.parts):
            source = _prune_points(array, [array.spec.to_multidim(x) for x in coords])
    cells = source.select(geometry.flat_index(array.spec).alias("flat_idx"), "value")
    return wanted.join(cells, "flat_idx", "left").select("pos", "flat_idx", "value")


def outer_index(array: ChunkedArray, selection: Sequence[Sequence[int]]) -> ChunkedArray:
    """The outer product of one list of indices for each dimension; order and repeats are kept, and list positions are the new coordinates."""
    if len(selection) != array.spec.ndim:
        raise InvalidParam("one list for each dimension")
    for i, (wanted, n) in enumerate(zip(selection, array.spec.shape, strict=True)):
        if bad := [x for x in wanted if not 0 <= x < n]:
            raise InvalidIndex(f"{bad[0]} is not in dimension {i} of length {n}")
    low = [min(s, default=0) for s in selection]
    high = [max(s, default=-1) + 1 for s in selection]
    df = prune_outer(array, selection).where(_inside(low, high))
    for i, wanted in enumerate(selection):
        df = df.join(_given(array, wanted, f"d{i}"), f"d{i}")
    df = df.select(*(F.col(f"pos_d{i}").alias(f"d{i}") for i in range(array.spec.ndim)), "value")
    shape = [len(s) for s in selection]
    chunk = [min(c, n) for c, n in zip(array.spec.chunkshape, shape, strict=True)]
    block = [min(b, c) for b, c in zip(array.spec.blockshape, chunk, strict=True)]
    return array.with_cells(df, ArraySpec(tuple(shape), tuple(chunk), tuple(block), array.spec.dtype))


def squeeze(array: ChunkedArray, axes: Sequence[int] | None = None) -> ChunkedArray:
    """Drop all dimensions of length 1, or the chosen ones, which must have length 1."""
    if any(not k.startswith("_") for k in array.meta):
        raise InvalidParam("an array with metadata layers has no views of other shape")
    s = array.spec
    gone = [i for i, n in enumerate(s.shape) if n == 1] if axes is None else list(axes)
    if any(not 0 <= i < s.ndim or s.shape[i] != 1 for i in gone):
        raise InvalidParam("only dimensions of length 1 can go")
    stay = [i for i in range(s.ndim) if i not in gone]
    pick = lambda t: tuple(t[i] for i in stay)
    df = array.df.select(*(F.col(f"d{i}").alias(f"d{k}") for k, i in enumerate(stay)), "value")
    return array.with_cells(df, ArraySpec(pick(s.shape), pick(s.chunkshape), pick(s.blockshape), s.dtype))


def expand_dims(array: ChunkedArray, new: Sequence[bool]) -> ChunkedArray:
    """Add dimensions of length 1 where the mask over the new dimensions is true."""
    if any(not k.startswith("_") for k in array.meta):
        raise InvalidParam("an array with metadata layers has no views of other shape")
    s = array.spec
    if len(new) - sum(new) != s.ndim:
        raise InvalidParam("as many false places in the mask as there are dimensions")
    old = iter(range(s.ndim))
    source = [None if x else next(old) for x in new]
    widen = lambda t: tuple(1 if i is None else t[i] for i in source)
    df = array.df.select(*((F.lit(0).cast("long") if i is None else F.col(f"d{i}")).alias(f"d{k}") for k, i in enumerate(source)), "value")
    return array.with_cells(df, ArraySpec(widen(s.shape), widen(s.chunkshape), widen(s.blockshape), s.dtype))


def rechunk(array: ChunkedArray, chunkshape: Sequence[int], blockshape: Sequence[int] | None = None) -> ChunkedArray:
    """A copy with other chunks; keeps all metadata. Chunk numbers are computed, so this is free until the array is written."""
    return array.with_cells(array.cells(), array.spec.rechunked(chunkshape, blockshape), True)


def chunk(array: ChunkedArray, nchunk: int) -> DataFrame:
    """The addressed cells of one chunk."""
    if not 0 <= nchunk < array.spec.nchunks:
        raise InvalidIndex(f"no chunk {nchunk}")
    grid = row_major(array.spec.chunk_grid)
    at = [nchunk // s % g for s, g in zip(grid, array.spec.chunk_grid, strict=True)]
    start = [a * c for a, c in zip(at, array.spec.chunkshape, strict=True)]
    stop = [min(n, x + c) for n, x, c in zip(array.spec.shape, start, array.spec.chunkshape, strict=True)]
    return ChunkedArray(prune(array, start, stop), array.spec).addressed().where(_inside(start, stop))


def without_blocks(array: ChunkedArray, masked: Sequence[int]) -> DataFrame:
    """The addressed cells but those of the masked blocks (numbers inside each chunk)."""
    if any(not 0 <= b < array.spec.nblocks for b in masked):
        raise InvalidIndex("no such block")
    cells = array.addressed()
    return cells.where(~F.col("nblock").isin(list(masked))) if masked else cells


def get_items(blocks: DataFrame, values: str, start: int, count: int, name: str = "items") -> DataFrame:
    """Items [start, start + count) of an array column, cut at its end."""
    if start < 0 or count < 0:
        raise InvalidIndex("a negative start or count")
    return blocks.withColumn(name, F.slice(values, start + 1, count))


def get_bytes(chunks: DataFrame, payload: str, start: int, count: int, itemsize: int, name: str = "bytes") -> DataFrame:
    """Bytes [start, start + count) of a binary column; both must be whole items."""
    if start % itemsize or count % itemsize or start < 0 or count < 0:
        raise InvalidParam("start and count must be multiples of the item's size")
    return chunks.withColumn(name, F.substring(payload, start + 1, count))


def gather_1d(array: ChunkedArray, coords: DataFrame | Sequence[int], variable_chunks: bool = False) -> DataFrame:
    """The gather of one-dimensional containers, which must have chunks of one size."""
    if variable_chunks:
        raise ChunkError("no gather from chunks of various sizes")
    if array.spec.ndim != 1:
        raise InvalidParam("not one-dimensional")
    return take(array, coords)
