"""Stores of arrays: Parquet cells partitioned by groups of chunks, with versioned metadata committed last.

A store is a folder: ``cells/version=V/chunk_group=G/*.parquet``, sorted by chunk and coordinates, and ``meta/`` with one
small Parquet file for each commit. Readers take the newest metadata and only the cells it names, so that half-written data
is never seen; growth adds cells and then publishes the new shape. All access goes through Spark's file systems.
"""

from __future__ import annotations

import functools
import math
import os
import threading
import time
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..array import ChunkedArray
from ..errors import ChunkloomError, InvalidParam, MetalayerNotFound, StaleSchema, StoreExists
from ..functions import geometry
from ..spec import ArraySpec

#: Cells in a group of chunks, about: one folder and a few files for each.
CELLS_PER_GROUP = 1 << 26
MOST_FIXED, MOST_VL, LONGEST_NAME = 16, 8192, 31
_META = "version long, array_id string, spec string, chunks_per_group long, parts array<string>, layers array<struct<name:string,kind:string,content:binary>>, commit string"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _fs(spark, old)
    if exists(spark, new):
        raise StoreExists(new)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise InvalidParam(f"cannot rename {old}")


class StoreLock:
    """Exclusive use of a store by one writer: ``with StoreLock(spark, path): ...``. All writers here take it, and one that holds
    it already for several operations goes on.

    The lock is a file that only one caller can create; whoever waits tries again until ``wait_s`` has passed. A lock older than
    ``stale_s`` is taken for a dead writer's and removed, by one of those who wait. Readers need no lock."""

    def __init__(self, spark: SparkSession, path: str, wait_s: float = 600.0, stale_s: float = 24 * 3600.0):
        self.spark, self.path, self.wait_s, self.stale_s = spark, f"{path}.lock", wait_s, stale_s

    def _key(self) -> tuple[str, int]:
        return self.path, threading.get_ident()

    def __enter__(self) -> StoreLock:
        if not _HELD.get(self._key()):
            fs, p = _fs(self.spark, self.path)
            until = time.monotonic() + self.wait_s
            while not self._create(fs, p):
                self._remove_stale(fs, p)
                if time.monotonic() >= until:
                    raise ChunkloomError(f"{self.path} is held by another writer")
                time.sleep(0.05)
        _HELD[self._key()] = _HELD.get(self._key(), 0) + 1
        return self

    def _create(self, fs, p) -> bool:
        """Make the file, unless it exists. Local file systems are asked directly, as Hadoop's look first and create then."""
        if fs.getScheme() == "file":
            try:
                os.close(os.open(p.toUri().getPath(), os.O_CREAT | os.O_EXCL))
                return True
            except FileExistsError:
                return False
        try:
            fs.create(p, False).close()
            return True
        except Py4JJavaError:
            return False

    def _remove_stale(self, fs, p) -> None:
        try:
            age = time.time() - fs.getFileStatus(p).getModificationTime() / 1000
        except Py4JJavaError:  # the holder has just let go of it
            return
        if age > self.stale_s:
            gone = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}.{uuid.uuid4().hex}")
            if fs.rename(p, gone):
                fs.delete(gone, False)

    def __exit__(self, *_) -> None:
        _HELD[self._key()] -= 1
        if not _HELD[self._key()]:
            del _HELD[self._key()]
            remove(self.spark, self.path)


#: How often each thread has entered the lock of a path.
_HELD: dict[tuple[str, int], int] = {}


def _locked(write):
    """A writer of (spark, path, ...) that holds the store's lock from reading the newest version to publishing the next."""

    @functools.wraps(write)
    def run(spark: SparkSession, path: str, *args, **kwargs):
        with StoreLock(spark, path):
            return write(spark, path, *args, **kwargs)

    return run


def per_group(spec: ArraySpec) -> int:
    return max(1, CELLS_PER_GROUP // max(1, math.prod(spec.chunkshape)))


def _commit(spark: SparkSession, path: str, version: int, array_id: str, spec: ArraySpec, group: int, parts: Sequence[str], layers: Sequence[tuple[str, str, bytes]]) -> None:
    row = (version, array_id, spec.to_json(), group, list(parts), [tuple(x) for x in layers], uuid.uuid4().hex)
    spark.createDataFrame([row], _META).coalesce(1).write.mode("append").parquet(f"{path}/meta")


def _write_cells(array: ChunkedArray, path: str, part: str, group: int) -> None:
    cells = array.cells().withColumn("nchunk", geometry.chunk_number(array.spec))
    cells = cells.withColumn("chunk_group", geometry.div(F.col("nchunk"), group))
    n = max(1, math.ceil(array.spec.nchunks / group))
    # A group has a bounded number of cells and goes to one task, which writes one file.
    sorted_cells = cells.repartition(n, "chunk_group") if n > 1 else cells.coalesce(max(1, min(8, array.spec.nitems >> 20)))
    sorted_cells.sortWithinPartitions("chunk_group", "nchunk", *array.dims).write.mode("errorifexists").partitionBy("chunk_group").parquet(f"{path}/cells/{part}")


def save(array: ChunkedArray, path: str, array_id: str = "0") -> None:
    """A new store; refuses a path that exists."""
    spark = array.df.sparkSession
    if exists(spark, path):
        raise StoreExists(path)
    save_append(array, path, array_id)


def save_append(array: ChunkedArray, path: str, array_id: str) -> str:
    """Another array in the same store, under an id of its own."""
    with StoreLock(array.df.sparkSession, path):
        return _save_append(array, path, array_id)


def _save_append(array: ChunkedArray, path: str, array_id: str) -> str:
    spark, group, part = array.df.sparkSession, per_group(array.spec), uuid.uuid4().hex
    if exists(spark, f"{path}/meta") and spark.read.schema(_META).parquet(f"{path}/meta").where(F.col("array_id") == array_id).limit(1).count():
        raise StoreExists(f"{path}: {array_id}")
    _write_cells(array, path, part, group)
    layers = [(k, "fixed", bytes(v)) for k, v in array.meta.items() if not k.startswith("_")] + [(k, "vl", bytes(v)) for k, v in array.vlmeta.items()]
    _commit(spark, path, 1, array_id, array.spec, group, [_part(part, array.spec.shape, array.spec.shape)], layers)
    return array_id


def history(spark: SparkSession, path: str, array_id: str = "0") -> DataFrame:
    """Every commit of an array."""
    return spark.read.schema(_META).parquet(f"{path}/meta").where(F.col("array_id") == array_id)


def _newest(spark: SparkSession, path: str, array_id: str):
    row = history(spark, path, array_id).orderBy(F.desc("version"), "commit").first()
    if row is None:
        raise MetalayerNotFound(f"no array {array_id} in {path}")
    return row


def open_array(spark: SparkSession, path: str, array_id: str = "0") -> ChunkedArray:
    """The newest version. Slices of it read only the groups and row groups of the chunks they touch."""
    row = _newest(spark, path, array_id)
    spec = ArraySpec.from_json(row["spec"])
    meta = {x["name"]: bytes(x["content"]) for x in row["layers"] if x["kind"] == "fixed"}
    vlmeta = {x["name"]: bytes(x["content"]) for x in row["layers"] if x["kind"] == "vl"}
    prunable = {"_chunks_per_group": str(row["chunks_per_group"]).encode()}
    parts = tuple(ChunkedArray(df, spec.with_shape(shape), prunable) for df, shape in (_read_part(spark, path, part) for part in row["parts"]))
    if len(parts) == 1 and parts[0].spec == spec:
        return ChunkedArray(parts[0].df, spec, meta | prunable, vlmeta)
    df = parts[0].cells()
    for other in parts[1:]:
        df = df.unionByName(other.cells())
    return ChunkedArray(df, spec, meta, vlmeta, parts)


def _part(folder: str, limits: Sequence[int], shape: Sequence[int]) -> str:
    """A part's folder, up to where it is read, and the shape by which its chunks are numbered."""
    return ":".join([folder, *(",".join(map(str, x)) for x in (limits, shape))])


def _split(part: str) -> tuple[str, list[int], list[int]]:
    folder, *lists = part.split(":")
    limits, shape = ([int(x) for x in text.split(",")] if text else [] for text in lists)
    return folder, limits, shape


def _read_part(spark: SparkSession, path: str, part: str) -> tuple[DataFrame, list[int]]:
    """The cells of a part, up to its limits, and its shape: a shrunk array keeps its files, and what lies beyond is never read again."""
    folder, limits, shape = _split(part)
    df = spark.read.parquet(f"{path}/cells/{folder}")
    for i, n in enumerate(limits):
        df = df.where(F.col(f"d{i}") < n)
    return df, shape


@_locked
def append_cells(spark: SparkSession, path: str, cells: ChunkedArray, axis: int, array_id: str = "0") -> int:
    """Grow a store along an axis: the new cells are written, then the new shape is published. Returns the new version."""
    row = _newest(spark, path, array_id)
    spec = ArraySpec.from_json(row["spec"])
    if any(m != n for i, (m, n) in enumerate(zip(spec.shape, cells.spec.shape, strict=True)) if i != axis) or cells.spec.dtype != spec.dtype:
        raise InvalidParam("cells of another shape or dtype")
    grown = spec.with_shape([n + cells.spec.shape[axis] * (i == axis) for i, n in enumerate(spec.shape)])
    moved = cells.cells().withColumn(f"d{axis}", F.col(f"d{axis}") + F.lit(spec.shape[axis]))
    part = uuid.uuid4().hex
    _write_cells(ChunkedArray(moved, grown), path, part, row["chunks_per_group"])
    _commit(spark, path, row["version"] + 1, array_id, grown, row["chunks_per_group"], [*row["parts"], _part(part, grown.shape, grown.shape)], [tuple(x) for x in row["layers"]])
    return row["version"] + 1


@_locked
def shrink(spark: SparkSession, path: str, shape: Sequence[int], array_id: str = "0") -> int:
    """Publish a smaller shape; cells beyond it are no longer read. To grow again, the cells must be written."""
    row = _newest(spark, path, array_id)
    spec = ArraySpec.from_json(row["spec"])
    if any(m > n for m, n in zip(shape, spec.shape, strict=True)):
        raise InvalidParam("not a smaller shape")
    cut = []
    for part in row["parts"]:
        folder, limits, written = _split(part)
        cut.append(_part(folder, [min(a, b) for a, b in zip(limits, shape, strict=True)], written))
    _commit(spark, path, row["version"] + 1, array_id, spec.with_shape(shape), row["chunks_per_group"], cut, [tuple(x) for x in row["layers"]])
    return row["version"] + 1


def refresh(spark: SparkSession, path: str, array: ChunkedArray, array_id: str = "0") -> tuple[bool, ChunkedArray]:
    """(changed, array): the newest version if the shape changed. Anything but the shape may not change."""
    spec = ArraySpec.from_json(_newest(spark, path, array_id)["spec"])
    if spec.shape == array.spec.shape:
        return False, array
    if spec.with_shape(array.spec.shape) != array.spec:
        raise StaleSchema("more than the shape has changed")
    return True, open_array(spark, path, array_id)


@_locked
def set_layer(spark: SparkSession, path: str, name: str, content: bytes, kind: str = "fixed", array_id: str = "0", update: bool = False) -> None:
    """Add or replace a metadata layer. Fixed ones keep their length when replaced."""
    row = _newest(spark, path, array_id)
    layers = {(x["kind"], x["name"]): bytes(x["content"]) for x in row["layers"]}
    key = (kind, name)
    if kind not in ("fixed", "vl") or not 0 < len(name) <= LONGEST_NAME:
        raise InvalidParam("kind fixed or vl; a name of 1 to 31 characters")
    if (key in layers) != update:
        raise MetalayerNotFound(name) if update else InvalidParam(f"{name!r} is there already")
    if update and kind == "fixed" and len(content) > len(layers[key]):
        raise InvalidParam("a fixed layer cannot grow")
    layers[key] = content
    if sum(k == kind for k, _ in layers) > (MOST_FIXED if kind == "fixed" else MOST_VL):
        raise InvalidParam("too many layers")
    _commit(spark, path, row["version"] + 1, array_id, ArraySpec.from_json(row["spec"]), row["chunks_per_group"], row["parts"], [(n, k, c) for (k, n), c in layers.items()])


def get_layer(spark: SparkSession, path: str, name: str, kind: str = "fixed", array_id: str = "0") -> bytes:
    for x in _newest(spark, path, array_id)["layers"]:
        if x["name"] == name and x["kind"] == kind:
            return bytes(x["content"])
    raise MetalayerNotFound(name)


def has_layer(spark: SparkSession, path: str, name: str, kind: str = "fixed", array_id: str = "0") -> bool:
    return any(x["name"] == name and x["kind"] == kind for x in _newest(spark, path, array_id)["layers"])


@_locked
def delete_layer(spark: SparkSession, path: str, name: str, array_id: str = "0") -> int:
    """Delete a variable-length layer; returns how many stay."""
    row = _newest(spark, path, array_id)
    layers = [(x["name"], x["kind"], bytes(x["content"])) for x in row["layers"] if (x["name"], x["kind"]) != (name, "vl")]
    if len(layers) == len(row["layers"]):
        raise MetalayerNotFound(name)
    _commit(spark, path, row["version"] + 1, array_id, ArraySpec.from_json(row["spec"]), row["chunks_per_group"], row["parts"], layers)
    return sum(k == "vl" for _, k, _ in layers)


def layer_names(spark: SparkSession, path: str, kind: str = "vl", array_id: str = "0") -> list[str]:
    """In order of addition."""
    return [x["name"] for x in _newest(spark, path, array_id)["layers"] if x["kind"] == kind]
