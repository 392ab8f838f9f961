"""Explicit encoding of chunks to binary payloads, for stores whose chunks are opaque.

Payloads start with one byte, the codec's number. Parquet's own codecs are the default way to store arrays; this is for
exchange and for reading single chunks, items or bytes without a table scan.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ChunkError, InvalidParam
from ..spec import ITEM_BYTES

_NUMPY = {k: f"<{k}" for k in ITEM_BYTES}


@dataclass(frozen=True)
class Codec:
    number: int
    name: str
    encode: Callable[[bytes, int], bytes]
    decode: Callable[[bytes], bytes]


def _zstd() -> Codec:
    import zstandard

    return Codec(5, "zstd", lambda raw, level: zstandard.ZstdCompressor(level=level).compress(raw), lambda raw: zstandard.ZstdDecompressor().decompress(raw))


def _lz4() -> Codec:
    def decode(raw: bytes) -> bytes:
        return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "lz4_raw", asbytes=True)

    return Codec(1, "lz4", lambda raw, _: len(raw).to_bytes(8, "little") + pa.compress(raw, "lz4_raw", asbytes=True), decode)


_CODECS = {"none": Codec(0, "none", lambda raw, _: raw, lambda raw: raw), "zlib": Codec(4, "zlib", lambda raw, level: zlib.compress(raw, level), zlib.decompress)}
_MADE = {"zstd": _zstd, "lz4": _lz4}


def codec(name: str) -> Codec:
    if name in _MADE and name not in _CODECS:
        _CODECS[name] = _MADE[name]()
    if name not in _CODECS:
        raise InvalidParam(f"no codec {name!r}")
    return _CODECS[name]


def names() -> list[str]:
    return sorted({*_CODECS, *_MADE})


def registered() -> dict[int, Codec]:
    """The callers' codecs, by number: these travel to the executors with the functions that use them."""
    return {c.number: c for c in _CODECS.values() if c.number >= 160}


def by_number(number: int, own: dict[int, Codec] | None = None) -> Codec:
    if own and number in own:
        return own[number]
    for name in names():
        if codec(name).number == number:
            return codec(name)
    raise InvalidParam(f"no codec {number}")


def register(new: Codec) -> None:
    """A codec of the caller's, numbered 160 to 255. Its functions are sent to the executors by value, or by name if they stand in a
    module there."""
    if not 160 <= new.number <= 255 or new.name in names() or new.number in registered():
        raise InvalidParam("numbers 160 to 255, and a new name")
    _CODECS[new.name] = new


def encode_chunks(table: DataFrame, dtype: str, codec_name: str = "zstd", level: int = 5) -> DataFrame:
    """(nchunk, nitems, special, payload) from (nchunk, values array, in order). A chunk of one value keeps that value only."""
    code, kind = codec(codec_name), _NUMPY[dtype]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, values in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = values.values.to_numpy(zero_copy_only=False).astype(kind)
                raw = x.tobytes()
                first = raw[: x.itemsize]
                if len(x) and raw == first * len(x):
                    special = "zero" if not any(first) else "nan" if kind[1] == "f" and np.isnan(x[0]) else "value"
                    out.append((n, len(x), special, bytes([0]) + first))
                else:
                    out.append((n, len(x), "none", bytes([code.number]) + code.encode(raw, level)))
            yield pa.RecordBatch.from_pylist([dict(zip(("nchunk", "nitems", "special", "payload"), r, strict=True)) for r in out], schema=_ENCODED)

    return table.select("nchunk", "values").mapInArrow(run, "nchunk long, nitems long, special string, payload binary")


_ENCODED = pa.schema([("nchunk", pa.int64()), ("nitems", pa.int64()), ("special", pa.string()), ("payload", pa.binary())])


def decode_payload(payload: bytes, nitems: int, special: str, dtype: str, own: dict[int, Codec] | None = None) -> np.ndarray:
    """The values of one chunk; ``own``: registered codecs that may have encoded it."""
    kind = _NUMPY[dtype]
    if not payload:
        raise ChunkError("a chunk without a header")
    if special != "none":
        return np.full(nitems, np.frombuffer(payload[1:], kind)[0], kind)
    raw = by_number(payload[0], own).decode(payload[1:])
    x = np.frombuffer(raw, kind)
    if len(x) != nitems:
        raise ChunkError("a chunk of another length than its header says")
    return x


def decode_chunks(encoded: DataFrame, dtype: str, spark_type: str) -> DataFrame:
    """(nchunk, values)."""
    own = registered()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            values = [(n, decode_payload(payload, count, special, dtype, own)) for n, count, special, payload in rows]
            arrays = pa.array([v.tolist() for _, v in values], pa.list_(pa.from_numpy_dtype(np.dtype(_NUMPY[dtype]))))
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in values], pa.int64()), arrays], names=["nchunk", "values"])

    return encoded.select("nchunk", "nitems", "special", "payload").mapInArrow(run, f"nchunk long, values array<{spark_type}>")


def payload_info(encoded: DataFrame, dtype: str) -> DataFrame:
    """(nchunk, codec, codec_number, nitems, nbytes, cbytes, special, is_valid) from the headers alone, nothing is decoded. A payload is valid if
    it has a header of a known codec, and a repeated value if it is a special one."""
    known = {codec(n).number: n for n in names()}
    number = F.when(F.length("payload") > 0, F.conv(F.hex(F.substring("payload", 1, 1)), 16, 10).cast("int"))
    name = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))[number]
    size = F.col("nitems") * ITEM_BYTES[dtype]
    whole = F.when(F.col("special") == "none", F.length("payload") > 1).otherwise(F.length("payload") == 1 + ITEM_BYTES[dtype])
    return encoded.select("nchunk", name.alias("codec"), number.alias("codec_number"), "nitems", size.alias("nbytes"), F.length("payload").cast("long").alias("cbytes"), "special", F.coalesce(name.isNotNull() & whole, F.lit(False)).alias("is_valid"))


def library_versions() -> dict[str, str]:
    """The versions of the libraries behind the codecs."""
    import zstandard

    return {"zlib": zlib.ZLIB_RUNTIME_VERSION, "zstd": ".".join(map(str, zstandard.ZSTD_VERSION)), "lz4": f"arrow {pa.__version__}", "none": "-"}


def sizes(encoded: DataFrame, dtype: str) -> DataFrame:
    """(nchunk, nbytes, cbytes), without decoding."""
    return encoded.selectExpr("nchunk", f"nitems * {ITEM_BYTES[dtype]} AS nbytes", "cast(length(payload) AS bigint) AS cbytes")
