"""Defaults and session settings."""

from __future__ import annotations

import re
import tempfile
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from . import __version__
from .errors import ChunkloomError, InvalidParam

# Names and numbers of codecs, and the codec Parquet uses for each.
CODECS = {"snappy": 0, "lz4": 1, "lz4hc": 2, "zlib": 4, "zstd": 5}
PARQUET_CODECS = {"snappy": "snappy", "lz4": "lz4_raw", "lz4hc": "lz4_raw", "zlib": "gzip", "zstd": "zstd"}
# Numbers of filters.
FILTERS = {"none": 0, "shuffle": 1, "bitshuffle": 2, "delta": 3, "trunc_prec": 4, "ndcell": 32, "ndmean": 33, "bytedelta": 35, "int_trunc": 36}


@dataclass(frozen=True)
class WriteOptions:
    """How arrays are encoded: see ``operators.blocks``. The item's size follows from the array; threads are Spark's tasks."""

    codec: str = "snappy"
    level: int = 5
    itemsize: int = 8
    filters: tuple[str, ...] = ("shuffle",)
    threads: int = 1


@dataclass(frozen=True)
class ReadOptions:
    """How arrays are decoded: blocks (numbers inside each chunk) to be left out."""

    threads: int = 1
    masked_blocks: tuple[int, ...] = field(default_factory=tuple)


def codec_number(name: str) -> int:
    if name not in CODECS:
        raise InvalidParam(f"no codec {name!r}")
    return CODECS[name]


def codec_name(number: int) -> str:
    for name, n in CODECS.items():
        if n == number:
            return name
    raise InvalidParam(f"no codec {number}")


def list_codecs() -> list[str]:
    return sorted(CODECS)


def version() -> str:
    return __version__


def get_codec(spark: SparkSession) -> str:
    return spark.conf.get("spark.sql.parquet.compression.codec")


def set_codec(spark: SparkSession, name: str) -> None:
    codec_number(name)
    spark.conf.set("spark.sql.parquet.compression.codec", PARQUET_CODECS[name])


def get_parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def set_parallelism(spark: SparkSession, n: int) -> int:
    """Set the number of shuffle partitions; returns what it was."""
    if n < 1:
        raise InvalidParam("at least one partition")
    before = get_parallelism(spark)
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    return before


_TUNERS: dict[str, Callable[[int, int], int]] = {}


def register_tuner(name: str, rule: Callable[[int, int], int]) -> None:
    """A rule (bytes of input, cores) -> number of partitions."""
    if name in _TUNERS:
        raise InvalidParam(f"{name!r} is taken")
    _TUNERS[name] = rule


def partitions_for(nbytes: int, cores: int, tuner: str | None = None, target: int = 128 << 20) -> int:
    """Partitions of about ``target`` bytes, two a core at least; or as a registered tuner says."""
    if tuner is not None:
        if tuner not in _TUNERS:
            raise InvalidParam(f"no tuner {tuner!r}")
        return _TUNERS[tuner](nbytes, cores)
    return max(2 * cores, -(-nbytes // target), 1)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or else the one that checkpoints go to already. In
    local mode a temporary one will do; on a cluster without either this is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
        raise ChunkloomError("set spark.checkpoint.dir to a folder that all machines share")
    return tempfile.mkdtemp(prefix="chunkloom-")


class Timer:
    """Seconds and nanoseconds since it was made."""

    def __init__(self):
        self.began = time.perf_counter_ns()

    def nanoseconds(self) -> int:
        return time.perf_counter_ns() - self.began

    def seconds(self) -> float:
        return self.nanoseconds() / 1e9
