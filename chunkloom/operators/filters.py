"""Reversible transforms of chunks before storage, and their inverses.

A chunk table has ``nchunk``, ``nblock`` (in the chunk), ``i`` (in the block) and ``value`` (a whole number, or a float for the
precision filters). Windows never go beyond a chunk, so chunks are the unit of parallel work.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..array import ChunkedArray
from ..errors import InvalidParam
from ..functions import bits, geometry
from ..spec import ArraySpec, row_major

MOST_FILTERS = 6


def chunk_table(rows: DataFrame, index: Column, value: Column, chunk: int, block: int) -> DataFrame:
    """Rows by position to a chunk table."""
    at = index.cast("long")
    inside = at % F.lit(chunk).cast("long")
    return rows.select(geometry.div(at, chunk).alias("nchunk"), geometry.div(inside, block).alias("nblock"), (inside % F.lit(block).cast("long")).alias("i"), value.alias("value"))


def xor_delta(table: DataFrame) -> DataFrame:
    """Block 0: each value by exclusive-or with the one before it; other blocks: with the value of block 0 at the same place.

    Rows are dealt by chunk once, which both windows can use."""
    in_first = Window.partitionBy("nchunk", "nblock").orderBy("i")
    reference = F.max(F.when(F.col("nblock") == 0, F.col("value"))).over(Window.partitionBy("nchunk", "i"))
    t = table.repartition("nchunk").withColumns({"_before": F.lag("value").over(in_first), "_first": reference})
    out = F.when(F.col("nblock") == 0, F.coalesce(F.col("value").bitwiseXOR(F.col("_before")), F.col("value"))).otherwise(F.col("value").bitwiseXOR(F.col("_first")))
    return t.withColumn("value", out).drop("_before", "_first")


def xor_undelta(table: DataFrame) -> DataFrame:
    """The inverse: a running exclusive-or over block 0, then the other blocks by it."""
    running = Window.partitionBy("nchunk", "nblock").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    t = table.repartition("nchunk").withColumn("_plain", F.when(F.col("nblock") == 0, F.bit_xor("value").over(running)))
    t = t.withColumn("_first", F.max("_plain").over(Window.partitionBy("nchunk", "i")))
    return t.withColumn("value", F.coalesce("_plain", F.col("value").bitwiseXOR(F.col("_first")))).drop("_plain", "_first")


def byte_shuffle(table: DataFrame, itemsize: int) -> DataFrame:
    """(nchunk, nblock, stream, i, byte): byte ``stream`` of every value, stream after stream."""
    t = table.select("nchunk", "nblock", "i", "value", F.explode(F.sequence(F.lit(0), F.lit(itemsize - 1))).alias("stream"))
    return t.select("nchunk", "nblock", F.col("stream").cast("long").alias("stream"), "i", bits.byte_of(F.col("value"), F.col("stream")).alias("byte"))


def byte_unshuffle(streams: DataFrame, itemsize: int) -> DataFrame:
    """The inverse; the highest byte has the sign."""
    joined = F.bit_or(F.call_function("shiftleft", F.col("byte"), (F.col("stream") * 8).cast("int")))
    t = streams.groupBy("nchunk", "nblock", "i").agg(joined.alias("value"))
    if itemsize < 8:
        gap = 64 - 8 * itemsize
        t = t.withColumn("value", F.shiftright(F.shiftleft("value", gap), gap))
    return t


def bit_shuffle(table: DataFrame, itemsize: int) -> DataFrame:
    """(nchunk, nblock, bit, byte_no, byte): bit ``bit`` of eight neighbours as one byte. Values beyond a multiple of eight are
    left out of the transposition and come as they are, in rows with bit -1, ``byte_no`` being their place."""
    size = F.max("i").over(Window.partitionBy("nchunk", "nblock")) + 1
    # As many tasks as there are: a number given stays as it is, where few bytes would else be dealt to one task, and eight rows come of a value.
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = table.repartition(tasks, "nchunk").withColumn("_whole", size - size % 8)
    # Eight planes to a whole number, one byte each: neighbours are put together before their bytes become rows, so that a task
    # holds itemsize numbers for eight values and not a row for each of their bytes.
    spread = [reduce(Column.bitwiseOR, (F.call_function("shiftleft", bits.bit_of(F.col("value"), 8 * k + j), F.lit(8 * j)) for j in range(8))) for k in range(itemsize)]
    placed = [F.bit_or(F.call_function("shiftleft", x, (F.col("i") % 8).cast("int"))).alias(f"_p{k}") for k, x in enumerate(spread)]
    eights = t.where("i < _whole").groupBy("nchunk", "nblock", F.shiftright("i", 3).alias("byte_no")).agg(*placed)
    byte = F.array(*(F.struct(F.lit(8 * k + j).cast("long").alias("bit"), bits.byte_of(F.col(f"_p{k}"), j).alias("byte")) for k in range(itemsize) for j in range(8)))
    packed = eights.select("nchunk", "nblock", "byte_no", F.explode(byte).alias("b")).select("nchunk", "nblock", "b.bit", "byte_no", "b.byte")
    rest = t.where("i >= _whole").select("nchunk", "nblock", F.lit(-1).cast("long").alias("bit"), F.col("i").alias("byte_no"), F.col("value").alias("byte"))
    return packed.unionByName(rest)


def bit_unshuffle(planes: DataFrame, itemsize: int) -> DataFrame:
    # The eight values of a byte are put together side by side, and become rows after that.
    placed = [F.bit_or(F.call_function("shiftleft", bits.bit_of(F.col("byte"), k), F.col("bit").cast("int"))).alias(f"_v{k}") for k in range(8)]
    eights = planes.where("bit >= 0").groupBy("nchunk", "nblock", "byte_no").agg(*placed)
    spread = eights.select("nchunk", "nblock", "byte_no", F.posexplode(F.array(*(f"_v{k}" for k in range(8)))).alias("k", "value"))
    t = spread.select("nchunk", "nblock", (F.col("byte_no") * 8 + F.col("k")).alias("i"), "value")
    if itemsize < 8:
        gap = 64 - 8 * itemsize
        t = t.withColumn("value", F.shiftright(F.shiftleft("value", gap), gap))
    return t.unionByName(planes.where("bit < 0").select("nchunk", "nblock", F.col("byte_no").alias("i"), F.col("byte").alias("value")))


def byte_delta(streams: DataFrame) -> DataFrame:
    """Each byte of a stream less the one before it, modulo 256."""
    w = Window.partitionBy("nchunk", "nblock", "stream").orderBy("i")
    return streams.withColumn("byte", F.pmod(F.col("byte") - F.lag("byte", 1, 0).over(w), F.lit(256)))


def byte_undelta(streams: DataFrame) -> DataFrame:
    w = Window.partitionBy("nchunk", "nblock", "stream").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return streams.withColumn("byte", F.pmod(F.sum("byte").over(w), F.lit(256)))


def int_trunc(table: DataFrame, meta: int, bits_: int) -> DataFrame:
    return table.withColumn("value", bits.int_trunc(F.col("value"), meta, bits_))


def trunc_precision(table: DataFrame, meta: int, dtype: str = "f8") -> DataFrame:
    return table.withColumn("value", bits.trunc_precision(F.col("value"), meta, dtype))


def _cell(array: ChunkedArray, side: int) -> tuple[list[Column], list[Column]]:
    """Of each dimension, the cell's coordinate in its block and the place in the cell."""
    s = array.spec
    inside = [F.col(d) % F.lit(c).cast("long") % F.lit(b).cast("long") for d, c, b in zip(array.dims, s.chunkshape, s.blockshape, strict=True)]
    return [geometry.div(x, side) for x in inside], [x % F.lit(side).cast("long") for x in inside]


def cell_number(array: ChunkedArray, side: int) -> Column:
    """Number of the cell of ``side`` values a side, cut at the block's edge, in its block."""
    cells, _ = _cell(array, side)
    return geometry.dot(cells, row_major([-(-b // side) for b in array.spec.blockshape]))


def cell_order(array: ChunkedArray, side: int) -> DataFrame:
    """Addressed cells with ``cell``, ``in_cell`` and ``position``: a block's values cell after cell, C order inside each.

    The position is computed from the lengths of the cells before; nothing is sorted."""
    if side < 1:
        raise InvalidParam("a cell has a side of 1 at least")
    s = array.spec
    cells, places = _cell(array, side)
    lengths = [F.least(F.lit(side).cast("long"), F.lit(b).cast("long") - c * side) for b, c in zip(s.blockshape, cells, strict=True)]
    in_cell = F.lit(0).cast("long")
    for place, length in zip(places, lengths, strict=True):
        in_cell = in_cell * length + place
    # Values before the cell: in each dimension, those of lower cells, within the box of this cell's lengths before and the whole block's after.
    position = in_cell
    for k in range(s.ndim):
        before = cells[k] * side
        for j in range(s.ndim):
            if j < k:
                before = before * lengths[j]
            elif j > k:
                before = before * F.lit(s.blockshape[j]).cast("long")
        position = position + before
    return array.addressed().withColumns({"cell": cell_number(array, side), "in_cell": in_cell, "position": position})


def from_cell_order(array: ChunkedArray, ordered: DataFrame, side: int) -> ChunkedArray:
    """The inverse of ``cell_order``: (nchunk, nblock, position, value) back to the cells of ``array``'s geometry. The coordinates
    follow from the position, so nothing is joined."""
    s = array.spec
    whole = lambda a, b: F.call_function("div", a, b)
    rest, cells, lengths = F.col("position").cast("long"), [], []
    for k, b in enumerate(s.blockshape):
        unit = F.lit(side * math.prod(s.blockshape[k + 1 :])).cast("long")
        for before in lengths:
            unit = unit * before
        c = whole(rest, unit)
        rest = rest - c * unit
        cells.append(c)
        lengths.append(F.least(F.lit(side).cast("long"), F.lit(b).cast("long") - c * side))
    inside = [F.lit(0)] * s.ndim
    for k in reversed(range(s.ndim)):
        inside[k] = cells[k] * side + rest % lengths[k]
        rest = whole(rest, lengths[k])
    of_chunk, of_block = geometry.from_flat(ArraySpec(s.chunk_grid), F.col("nchunk")), geometry.from_flat(ArraySpec(s.block_grid), F.col("nblock"))
    coords = [c * F.lit(m).cast("long") + b * F.lit(n).cast("long") + i for c, m, b, n, i in zip(of_chunk, s.chunkshape, of_block, s.blockshape, inside, strict=True)]
    return array.with_cells(ordered.select(*(c.cast("long").alias(d) for c, d in zip(coords, array.dims, strict=True)), "value"), None, True)


def cell_mean(array: ChunkedArray, side: int, include_padding: bool = False) -> DataFrame:
    """(nchunk, nblock, cell, mean, n): the mean of every cell, cut at the block's edge, in double precision.

    ``include_padding``: divide by the cell's size in the padded block, counting the zeros beyond the array's edge."""
    a = array.addressed().withColumn("cell", cell_number(array, side))
    total, n = F.sum(F.col("value").cast("double")), F.count("*")
    if include_padding:
        cells, _ = _cell(array, side)
        full = F.lit(1).cast("long")
        for b, c in zip(array.spec.blockshape, cells, strict=True):
            full = full * F.least(F.lit(side).cast("long"), F.lit(b).cast("long") - c * side)
        a = a.withColumn("_full", full)
        mean = total / F.max("_full")
    else:
        mean = total / n
    return a.groupBy("nchunk", "nblock", "cell").agg(mean.alias("mean"), n.alias("n"))


def smooth(array: ChunkedArray, side: int) -> ChunkedArray:
    """Every value replaced by its cell's mean (lossy)."""
    w = Window.partitionBy("nchunk", "nblock", "cell")
    a = array.addressed().withColumn("cell", cell_number(array, side))
    return array.with_cells(a.select(*array.dims, F.avg(F.col("value").cast("double")).over(w).alias("value")), None, True)


@dataclass(frozen=True)
class Stage:
    """One filter of a pipeline: forward and backward functions of chunk tables. ``lossy`` ones have no backward."""

    name: str
    forward: Callable[[DataFrame], DataFrame]
    backward: Callable[[DataFrame], DataFrame] | None = None


class Pipeline:
    """Up to six stages, applied in order and undone in reverse; stages without a backward function are passed over."""

    def __init__(self, stages: Sequence[Stage]):
        if len(stages) > MOST_FILTERS:
            raise InvalidParam(f"more than {MOST_FILTERS} filters")
        if any(s.name == "delta" for s in stages[1:]):
            raise InvalidParam("delta must come first")
        self.stages = list(stages)

    def forward(self, table: DataFrame) -> DataFrame:
        for s in self.stages:
            table = s.forward(table)
        return table

    def backward(self, table: DataFrame) -> DataFrame:
        for s in reversed(self.stages):
            table = s.backward(table) if s.backward else table
        return table


def stage(name: str, **options: int | str) -> Stage:
    """A built-in filter by name: none, shuffle, bitshuffle, delta, trunc_prec, bytedelta, int_trunc."""
    size = int(options.get("itemsize", 8))
    made = {
        "none": lambda: Stage(name, lambda t: t, lambda t: t),
        "delta": lambda: Stage(name, xor_delta, xor_undelta),
        "shuffle": lambda: Stage(name, lambda t: byte_shuffle(t, size), lambda t: byte_unshuffle(t, size)),
        "bitshuffle": lambda: Stage(name, lambda t: bit_shuffle(t, size), lambda t: bit_unshuffle(t, size)),
        "bytedelta": lambda: Stage(name, byte_delta, byte_undelta),
        "trunc_prec": lambda: Stage(name, lambda t: trunc_precision(t, int(options["meta"]), str(options.get("dtype", "f8")))),
        "int_trunc": lambda: Stage(name, lambda t: int_trunc(t, int(options["meta"]), 8 * size)),
    }.get(name)
    if made is None:
        made = _REGISTERED.get(name)
        if made is None:
            raise InvalidParam(f"no filter {name!r}")
        return made
    return made()


_REGISTERED: dict[str, Stage] = {}


def register(new: Stage) -> None:
    """Make a filter of the caller's known by its name."""
    if new.name in _REGISTERED or new.name in ("none", "delta", "shuffle", "bitshuffle", "bytedelta", "trunc_prec", "int_trunc"):
        raise InvalidParam(f"{new.name!r} is taken")
    _REGISTERED[new.name] = new
