"""User-defined input and output: readers of bytes by name, as a Spark data source.

``read_chunks(spark, path, index, io="name")`` reads encoded chunks through a registered backend. Spark makes readers in Python
workers, which know nothing of the driver's registry, so that the backend and the callers' codecs travel in the options.
Neighbouring chunks share a partition of about ``PARTITION_BYTES``.
"""

from __future__ import annotations

import base64
import json
import pickle
from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import InvalidParam
from ..spec import SPARK_TYPES
from .codecs import decode_payload, registered

PARTITION_BYTES = 64 << 20


class Backend(ABC):
    """Bytes by path. Instances are pickled: by value, or by name if their class stands in a module that the executors have."""

    @abstractmethod
    def size(self, path: str) -> int: ...

    @abstractmethod
    def read(self, path: str, offset: int, length: int) -> bytes: ...


class FileBackend(Backend):
    """Files that all machines share."""

    def size(self, path: str) -> int:
        with open(path, "rb") as f:
            return f.seek(0, 2)

    def read(self, path: str, offset: int, length: int) -> bytes:
        with open(path, "rb") as f:
            f.seek(offset)
            return f.read(length)


_BACKENDS: dict[str, Backend] = {"file": FileBackend()}


def register_io(name: str, backend: Backend) -> None:
    if name in _BACKENDS:
        raise InvalidParam(f"{name!r} is taken")
    _BACKENDS[name] = backend


def backends() -> list[str]:
    return sorted(_BACKENDS)


def get_io(name: str) -> Backend:
    if name not in _BACKENDS:
        raise InvalidParam(f"no backend {name!r}")
    return _BACKENDS[name]


class _Chunks(InputPartition):
    """Neighbouring chunks: (nchunk, offset, length, nitems, special) of each."""

    def __init__(self, chunks: list[tuple[int, int, int, int, str]]):
        self.chunks = chunks


class _Reader(DataSourceReader):
    """The index is JSON: [[offset, length, nitems, special], ...] relative to ``offset``."""

    def __init__(self, options: dict[str, str]):
        self.path, self.dtype = options["path"], options.get("dtype", "f8")
        packed = options.get("sent")
        self.backend, self.codecs = pickle.loads(base64.b64decode(packed)) if packed else (get_io(options.get("io", "file")), {})
        self.base, self.index = int(options.get("offset", 0)), json.loads(options["index"])

    def partitions(self) -> list[InputPartition]:
        out: list[list[tuple[int, int, int, int, str]]] = []
        size = PARTITION_BYTES
        for n, (offset, length, items, special) in enumerate(self.index):
            if size + length > PARTITION_BYTES:
                out.append([])
                size = 0
            out[-1].append((n, self.base + offset, length, items, special))
            size += length
        return [_Chunks(x) for x in out]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for n, offset, length, items, special in partition.chunks:
            raw = self.backend.read(self.path, offset, length)
            for i, v in enumerate(decode_payload(raw, items, special, self.dtype, self.codecs).tolist()):
                yield n, i, v


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunkloom"

    def schema(self) -> str:
        return f"nchunk long, i long, value {SPARK_TYPES[self.options.get('dtype', 'f8')]}"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_chunks(spark: SparkSession, path: str, index: Sequence[Sequence], dtype: str = "f8", io: str = "file", offset: int = 0) -> DataFrame:
    """(nchunk, i, value) of the chunks of ``index``, each (offset, length, nitems, special), read through the backend ``io``."""
    spark.dataSource.register(ChunkSource)
    sent = base64.b64encode(cloudpickle.dumps((get_io(io), registered()))).decode()
    options = {"path": path, "dtype": dtype, "offset": str(offset), "index": json.dumps([list(x) for x in index]), "sent": sent}
    return spark.read.format("chunkloom").options(**options).load()
