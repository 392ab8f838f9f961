"""Filters and codecs of whole blocks: one row a block, its values an array or its bytes a binary.

The relational forms in ``filters`` show every byte as a row; these work on a block at a time, in Arrow batches with numpy, and
are what arrays are encoded with: blocks to filtered bytes to compressed payloads, and back, in one pass each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..array import ChunkedArray
from ..config import ReadOptions, WriteOptions
from ..errors import ChunkError, InvalidParam
from ..functions import geometry
from ..functions.bits import FRACTION
from ..sources import codecs
from ..spec import ITEM_BYTES, SPARK_TYPES

#: Blocks of an Arrow batch that are taken through Python at once.
_ROWS = 256
_ENCODED = "nchunk long, nblock long, nitems long, offsets binary, payload binary"


def shuffle(raw: np.ndarray, size: int) -> np.ndarray:
    """The bytes of items of ``size`` bytes, first bytes first."""
    return raw.reshape(-1, size).T.ravel()


def unshuffle(raw: np.ndarray, size: int) -> np.ndarray:
    return raw.reshape(size, -1).T.ravel()


def bit_shuffle(raw: np.ndarray, size: int) -> np.ndarray:
    """The bits of whole groups of eight items, first bits first; what is left behind them stays as it is."""
    whole = len(raw) // (8 * size) * 8 * size
    bits = np.unpackbits(raw[:whole].reshape(-1, size), axis=1, bitorder="little")
    return np.concatenate([np.packbits(bits.T.ravel(), bitorder="little"), raw[whole:]])


def bit_unshuffle(raw: np.ndarray, size: int) -> np.ndarray:
    whole = len(raw) // (8 * size) * 8 * size
    bits = np.unpackbits(raw[:whole], bitorder="little").reshape(8 * size, -1)
    return np.concatenate([np.packbits(bits.T.ravel(), bitorder="little"), raw[whole:]])


def delta(raw: np.ndarray, size: int) -> np.ndarray:
    """Each item by exclusive-or with the one before it."""
    out = raw.copy()
    out[size:] ^= raw[:-size] if len(raw) > size else raw[:0]
    return out


def undelta(raw: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.accumulate(raw.reshape(-1, size), axis=0).ravel()


def byte_delta(raw: np.ndarray, size: int) -> np.ndarray:
    """Of each stream of shuffled bytes, every byte less the one before it."""
    streams = raw.reshape(size, -1)
    return np.diff(streams, axis=1, prepend=np.zeros((size, 1), np.uint8)).ravel()


def byte_undelta(raw: np.ndarray, size: int) -> np.ndarray:
    return np.cumsum(raw.reshape(size, -1), axis=1, dtype=np.uint8).ravel()


#: Forward and backward by the names that ``WriteOptions.filters`` may have.
FILTERS: dict[str, tuple[Callable[[np.ndarray, int], np.ndarray], Callable[[np.ndarray, int], np.ndarray]]] = {
    "shuffle": (shuffle, unshuffle),
    "bitshuffle": (bit_shuffle, bit_unshuffle),
    "delta": (delta, undelta),
    "bytedelta": (byte_delta, byte_undelta),
}


def trunc_precision(values: np.ndarray, keep: int) -> np.ndarray:
    """Floats with the low bits of their fractions zero, but ``keep`` of them; NaN and infinities stay."""
    fraction = FRACTION[f"f{values.itemsize}"]
    if not 0 < keep <= fraction:
        raise InvalidParam(f"1 to {fraction} bits")
    whole = np.dtype(f"<i{values.itemsize}")
    return np.where(np.isfinite(values), (values.view(whole) & whole.type(-1 << (fraction - keep))).view(values.dtype), values)


def _chosen(names: tuple[str, ...]) -> list:
    if unknown := [n for n in names if n not in FILTERS]:
        raise InvalidParam(f"no filter {unknown[0]!r}")
    return [FILTERS[n] for n in names]


def _mapped(function: Callable[..., tuple], ddl: str, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                rows = [function(*row) for row in zip(*b.slice(at, _ROWS).columns, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def encode(array: ChunkedArray, options: WriteOptions = WriteOptions(codec="zstd")) -> DataFrame:
    """(nchunk, nblock, nitems, offsets, payload): every block's values through the filters in order and then the codec.

    ``offsets`` has the places of the values in the block, as 64-bit integers; null if they are 0, 1, 2 and so on."""
    code, kind, size = codecs.codec(options.codec), np.dtype(f"<{array.spec.dtype}"), ITEM_BYTES[array.spec.dtype]
    steps, level = _chosen(options.filters), options.level

    def one(nchunk, nblock, offsets, values) -> tuple:
        x = values.values.to_numpy(zero_copy_only=False).astype(kind)
        raw = x.view(np.uint8)
        for forward, _ in steps:
            raw = forward(raw, size)
        at = offsets.values.to_numpy(zero_copy_only=False)
        dense = np.array_equal(at, np.arange(len(at)))
        return nchunk.as_py(), nblock.as_py(), len(x), None if dense else at.astype("<i8").tobytes(), bytes([code.number]) + code.encode(raw.tobytes(), level)

    schema = pa.schema([("nchunk", pa.int64()), ("nblock", pa.int64()), ("nitems", pa.int64()), ("offsets", pa.binary()), ("payload", pa.binary())])
    return array.blocks().select("nchunk", "nblock", "offsets", "values").mapInArrow(_mapped(one, _ENCODED, schema), _ENCODED)


def decode(encoded: DataFrame, like: ChunkedArray, options: WriteOptions = WriteOptions(codec="zstd"), read: ReadOptions = ReadOptions()) -> ChunkedArray:
    """The array of ``encode``'s rows; ``like`` gives the geometry, ``options`` the filters. Masked blocks are not decoded."""
    if read.masked_blocks:
        encoded = encoded.where(~F.col("nblock").isin(list(read.masked_blocks)))
    spec, own = like.spec, codecs.registered()
    kind, size, steps = np.dtype(f"<{spec.dtype}"), ITEM_BYTES[spec.dtype], _chosen(options.filters)

    def one(nchunk, nblock, nitems, offsets, payload) -> tuple:
        packed, n = payload.as_py(), nitems.as_py()
        raw = np.frombuffer(codecs.by_number(packed[0], own).decode(packed[1:]), np.uint8)
        if len(raw) != n * size:
            raise ChunkError("a block of another length than its header says")
        for _, backward in reversed(steps):
            raw = backward(raw, size)
        at = np.arange(n) if offsets.as_py() is None else np.frombuffer(offsets.as_py(), "<i8")
        return nchunk.as_py(), nblock.as_py(), at.tolist(), np.ascontiguousarray(raw).view(kind).tolist()

    schema = pa.schema([("nchunk", pa.int64()), ("nblock", pa.int64()), ("offsets", pa.list_(pa.int64())), ("values", pa.list_(pa.from_numpy_dtype(kind)))])
    ddl = f"nchunk long, nblock long, offsets array<long>, values array<{SPARK_TYPES[spec.dtype]}>"
    blocks = encoded.select("nchunk", "nblock", "nitems", "offsets", "payload").mapInArrow(_mapped(one, ddl, schema), ddl)
    cells = blocks.select("nchunk", "nblock", F.explode(F.arrays_zip("offsets", "values")).alias("x")).select("nchunk", "nblock", "x.offsets", F.col("x.values").alias("value"))
    return like.with_cells(cells.select(*(c.alias(d) for c, d in zip(geometry.from_block(spec, F.col("nchunk"), F.col("nblock"), F.col("offsets")), like.dims, strict=True)), "value"), None, True)
