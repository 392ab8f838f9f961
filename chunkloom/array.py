"""A chunked array: a DataFrame of cells (d0 .. dn-1, value) with its geometry and metadata.

Operators are functions in ``chunkloom.operators``; they take and return arrays and only build plans. Nothing runs until the
frame is used.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import InvalidParam
from .functions import geometry
from .spec import SPARK_TYPES, ArraySpec


MOST_ON_DRIVER = 1 << 24


@dataclass(frozen=True)
class ChunkedArray:
    """``df`` has the columns d0 .. dn-1 (long) and value. If it was read from a store it also has ``chunk_group`` and ``nchunk``,
    and reads of a region are pruned by them; one that has grown or shrunk has ``parts``, each with the geometry it was written in.
    ``meta`` and ``vlmeta`` are the fixed and the variable-length metadata layers."""

    df: DataFrame
    spec: ArraySpec
    meta: dict[str, bytes] = field(default_factory=dict)
    vlmeta: dict[str, bytes] = field(default_factory=dict)
    parts: tuple[ChunkedArray, ...] = ()

    @classmethod
    def of(cls, df: DataFrame, spec: ArraySpec, coords: Sequence[Column], value: Column) -> ChunkedArray:
        """From any frame, its coordinates and its value."""
        if len(coords) != spec.ndim:
            raise InvalidParam("one coordinate for each dimension")
        return cls(df.select(*(c.cast("long").alias(d) for c, d in zip(coords, geometry.dims(spec.ndim), strict=True)), value.alias("value")), spec)

    @classmethod
    def from_flat(cls, df: DataFrame, spec: ArraySpec, flat: Column, value: Column) -> ChunkedArray:
        """From (position in C order, value)."""
        return cls.of(df, spec, geometry.from_flat(spec, flat.cast("long")), value)

    @classmethod
    def from_rows(cls, df: DataFrame, spec: ArraySpec, row: Column, values: Column) -> ChunkedArray:
        """A matrix from one array of values for each row."""
        cells = df.select(row.cast("long").alias("d0"), F.posexplode(values).alias("d1", "value"))
        return cls(cells.select("d0", F.col("d1").cast("long").alias("d1"), "value"), spec)

    @classmethod
    def fill(cls, spark: SparkSession, spec: ArraySpec, value: object) -> ChunkedArray:
        """A constant array: the cells are generated, nothing is stored."""
        cells = spark.range(spec.nitems)
        return cls.from_flat(cells, spec, F.col("id"), F.lit(value).cast(SPARK_TYPES[spec.dtype]))

    @classmethod
    def zeros(cls, spark: SparkSession, spec: ArraySpec) -> ChunkedArray:
        return cls.fill(spark, spec, 0)

    empty = uninit = zeros

    @classmethod
    def nans(cls, spark: SparkSession, spec: ArraySpec) -> ChunkedArray:
        if spec.dtype not in ("f4", "f8"):
            raise InvalidParam("NaN needs a float dtype")
        return cls.fill(spark, spec, float("nan"))

    @property
    def dims(self) -> list[str]:
        return geometry.dims(self.spec.ndim)

    def cells(self) -> DataFrame:
        """The coordinates and values alone."""
        return self.df.select(*self.dims, "value")

    def addressed(self) -> DataFrame:
        """Cells with flat_idx, nchunk, nblock, offset and storage position."""
        s = self.spec
        return self.cells().withColumns({"flat_idx": geometry.flat_index(s), "nchunk": geometry.chunk_number(s), "nblock": geometry.block_number(s), "offset": geometry.block_offset(s), "storage_pos": geometry.storage_position(s)})

    def with_cells(self, df: DataFrame, spec: ArraySpec | None = None, keep_vlmeta: bool = False) -> ChunkedArray:
        """Another array from these cells; variable-length metadata stays behind unless asked for."""
        return ChunkedArray(df, spec or self.spec, dict(self.meta), dict(self.vlmeta) if keep_vlmeta else {})

    def map_value(self, value: Column, dtype: str | None = None) -> ChunkedArray:
        return self.with_cells(self.df.withColumn("value", value), replace(self.spec, dtype=dtype) if dtype else None, True)

    def blocks(self) -> DataFrame:
        """The block table: (nchunk, nblock, values) with the values in the order of their offsets; short blocks at the edges stay short."""
        packed = self.addressed().groupBy("nchunk", "nblock").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("b"))
        return packed.select("nchunk", "nblock", F.transform("b", lambda x: x["offset"]).alias("offsets"), F.transform("b", lambda x: x["value"]).alias("values"))

    def to_rows(self) -> list:
        """All values in C order, on the driver: for arrays of up to ``MOST_ON_DRIVER`` items."""
        if self.spec.nitems > MOST_ON_DRIVER:
            raise InvalidParam(f"{self.spec.nitems} items are too many for the driver")
        return [r["value"] for r in self.cells().select(geometry.flat_index(self.spec).alias("f"), "value").orderBy("f").collect()]

    def to_numpy(self):
        import numpy as np

        return np.array(self.to_rows()).reshape(self.spec.shape)

    def describe(self) -> dict[str, object]:
        s = self.spec
        return {"ndim": s.ndim, "shape": s.shape, "chunkshape": s.chunkshape, "blockshape": s.blockshape, "dtype": s.dtype, "nitems": s.nitems, "nchunks": s.nchunks, "meta": sorted(self.meta), "vlmeta": list(self.vlmeta)}
