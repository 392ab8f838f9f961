import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkloom.array import ChunkedArray
from chunkloom.config import ReadOptions, WriteOptions
from chunkloom.errors import InvalidParam
from chunkloom.functions import bits
from chunkloom.operators import aggregate, blocks, callbacks
from chunkloom.spec import ArraySpec


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 60), st.sampled_from([1, 2, 4, 8]), st.integers(0, 1 << 30), st.sampled_from(sorted(blocks.FILTERS)))
def test_filters_are_undone(n, size, seed, name):
    raw = np.random.default_rng(seed).integers(0, 256, n * size).astype(np.uint8)
    forward, backward = blocks.FILTERS[name]
    assert backward(forward(raw, size), size).tolist() == raw.tolist()


def test_filters_by_brute_force():
    x = np.array([1, 258, -3, 7, 9, 11, 2**31 - 1, 5, 77], "<i4")
    raw = x.view(np.uint8)
    assert blocks.shuffle(raw, 4).tolist() == [v.to_bytes(4, "little", signed=True)[k] for k in range(4) for v in x.tolist()]
    planes = [sum((x.tolist()[j] >> bit & 1) << j for j in range(8)) for bit in range(32)]
    assert blocks.bit_shuffle(raw, 4).tolist() == planes + list((77).to_bytes(4, "little"))
    assert blocks.delta(raw, 4).view("<i4").tolist() == [1, *(a ^ b for a, b in zip(x.tolist(), x.tolist()[1:]))]
    assert blocks.byte_delta(np.array([5, 7, 1, 255], np.uint8), 2).tolist() == [5, 2, 1, 254]


@pytest.mark.parametrize("dtype", ["i2", "i8", "f4", "f8"])
@pytest.mark.parametrize("codec, names", [("zstd", ("shuffle", "bytedelta")), ("zlib", ("bitshuffle",)), ("lz4", ("delta",)), ("none", ())])
def test_encode(spark, dtype, codec, names):
    s = ArraySpec((13, 9), (5, 4), (2, 3), dtype)
    a = ChunkedArray.from_flat(spark.range(s.nitems), s, F.col("id"), (F.col("id") * 3 - 50).cast({"i2": "short", "i8": "long", "f4": "float", "f8": "double"}[dtype]))
    options = WriteOptions(codec, filters=names)
    encoded = blocks.encode(a, options)
    back = blocks.decode(encoded, a, options)
    assert back.df.schema["value"].dataType == a.df.schema["value"].dataType and back.to_rows() == a.to_rows()
    part = blocks.decode(encoded, a, options, ReadOptions(masked_blocks=(0,))).cells().count()
    assert part == a.addressed().where("nblock <> 0").count() < s.nitems
    with pytest.raises(InvalidParam):
        blocks.encode(a, WriteOptions(codec, filters=("none such",)))


def test_precision(spark):
    values = [0.1, -0.1, 1e-310, -5e-324, 1e308, float("nan"), float("inf"), 0.0, -0.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(bits.trunc_precision(F.col("v"), 10)).collect()]
    want = [None if v is None else float(x) for v, x in zip(values, blocks.trunc_precision(np.array([v or 0.0 if v != 0 else v for v in values], "<f8"), 10))]
    assert str(got) == str(want)
    with pytest.raises(InvalidParam):
        blocks.trunc_precision(np.zeros(1), 0)


def test_sign_changes_over_absent_chunks(spark, monkeypatch):
    monkeypatch.setattr(aggregate, "_RUN", 4)
    rows = [(0, 1, 2.0), (2, 20, -1.0), (2, 21, 3.0), (11, 90, 4.0), (30, 300, -4.0), (31, 310, -4.0)]
    got = aggregate.sign_changes(spark.createDataFrame(rows, "nchunk long, i long, v double"), "i", F.col("v")).collect()
    assert sorted((r["nchunk"], r["i"], r["before"], r["value"]) for r in got) == [(2, 20, 2.0, -1.0), (2, 21, -1.0, 3.0), (30, 300, 4.0, -4.0)]


def test_combine_with_cells_that_are_not_stored(spark):
    s = ArraySpec((4,), (2,), (2,), "i8")
    a = ChunkedArray.from_flat(spark.range(4), s, F.col("id"), F.col("id"))
    b = ChunkedArray(a.df.where("d0 < 3"), s)
    both = callbacks.combine([a, b], lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(100)))
    assert both.to_rows() == [0, 2, 4, 103]


def test_blocks_go_through_python_a_few_at_a_time():
    """However many rows an Arrow batch has."""
    schema = pa.schema([("n", pa.int64()), ("values", pa.list_(pa.int64()))])
    run = blocks._mapped(lambda n, values: (n.as_py(), values.as_py()), "n long, values array<long>", schema)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k)), pa.array([[i, -i] for i in range(k)], pa.list_(pa.int64()))], schema=schema) for k in (0, 1, 5000)]
    out = list(run(iter(batches)))
    assert max(b.num_rows for b in out) <= 256
    assert pa.Table.from_batches(out, schema).equals(pa.Table.from_batches(batches, schema))
