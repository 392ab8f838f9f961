import itertools
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.array import ChunkedArray
from chunkloom.errors import InvalidParam
from chunkloom.functions import bits
from chunkloom.operators import aggregate, chunks, filters
from chunkloom.spec import ArraySpec


def values_of(table):
    return {(r["nchunk"], r["nblock"], r["i"]): r["value"] for r in table.collect()}


@pytest.fixture(scope="module")
def chunked(spark):
    df = spark.range(530).select("id", ((F.col("id") * 7919) % 1000 - 400).alias("v"))
    return filters.chunk_table(df, F.col("id"), F.col("v"), 100, 30)


@pytest.mark.parametrize(
    "names",
    [["delta"], ["shuffle"], ["bitshuffle"], ["shuffle", "bytedelta"], ["delta", "shuffle", "bytedelta"], ["none", "bitshuffle"]],
)
@pytest.mark.parametrize("itemsize", [2, 8])
def test_roundtrips(chunked, names, itemsize):
    p = filters.Pipeline([filters.stage(n, itemsize=itemsize) for n in names])
    assert values_of(p.backward(p.forward(chunked))) == values_of(chunked)


def test_delta_is_exclusive_or(chunked):
    plain, coded = values_of(chunked), values_of(filters.xor_delta(chunked))
    for (c, b, i), v in coded.items():
        if b:
            assert v == plain[c, b, i] ^ plain[c, 0, i]
        else:
            assert v == (plain[c, 0, i] ^ plain[c, 0, i - 1] if i else plain[c, 0, 0])


def test_pipeline_rules():
    with pytest.raises(InvalidParam):
        filters.Pipeline([filters.stage("none")] * 7)
    with pytest.raises(InvalidParam):
        filters.Pipeline([filters.stage("shuffle"), filters.stage("delta")])
    with pytest.raises(InvalidParam):
        filters.stage("missing")
    filters.register(filters.Stage("plus_one", lambda t: t.withColumn("value", F.col("value") + 1), lambda t: t.withColumn("value", F.col("value") - 1)))
    assert filters.stage("plus_one").name == "plus_one"
    with pytest.raises(InvalidParam):
        filters.register(filters.Stage("shuffle", lambda t: t))


def cut_bits(x, drop, kind):
    whole, fmt = ("<Q", "<d") if kind == "f8" else ("<I", "<f")
    raw = struct.unpack(whole, struct.pack(fmt, x))[0]
    return struct.unpack(fmt, struct.pack(whole, raw >> drop << drop))[0]


@pytest.mark.parametrize("meta, dtype", [(10, "f8"), (-10, "f8"), (1, "f8"), (-1, "f8"), (7, "f4"), (-1, "f4"), (1, "f4")])
def test_precision_matches_masked_bits(spark, meta, dtype):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-30, 30, 300), 2.0 ** np.arange(-20, 20), -(2.0 ** np.arange(-20, 20)), np.nextafter(2.0 ** np.arange(-20, 20), 0)])
    if dtype == "f4":
        x = x.astype(np.float32).astype(float)
        x = x[np.isfinite(x)]
    else:
        x = np.concatenate([x, [5e-324, 1e-310, -1e-310, 1.7e308]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], f"i int, v {'double' if dtype == 'f8' else 'float'}")
    got = [r[1] for r in df.select("i", bits.trunc_precision(F.col("v"), meta, dtype)).orderBy("i").collect()]
    whole = bits.FRACTION[dtype]
    drop = whole - meta if meta >= 0 else -meta
    assert got == [cut_bits(v, drop, dtype) for v in x]


def test_precision_of_odd_values(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-float("inf"),), (0.0,), (-0.0,), (None,)], "v double")
    got = [r[0] for r in df.select(bits.trunc_precision(F.col("v"), 5)).collect()]
    assert math.isnan(got[0]) and got[1:4] == [float("inf"), -float("inf"), 0.0] and math.copysign(1, got[4]) == -1 and got[5] is None
    for meta, dtype in ((0, "f8"), (-52, "f8"), (-23, "f4"), (53, "f8"), (3, "i4")):
        with pytest.raises(InvalidParam):
            bits.trunc_precision(F.lit(1.0), meta, dtype)


def test_int_trunc(spark):
    got = spark.range(-50, 50).select("id", bits.int_trunc(F.col("id"), -3, 64).alias("a"), bits.int_trunc(F.col("id"), 61, 64).alias("b")).collect()
    assert all(r["a"] == r["b"] == (r["id"] >> 3 << 3) for r in got)
    with pytest.raises(InvalidParam):
        bits.int_trunc(F.lit(1), -8, 8)


@pytest.mark.parametrize("shape, chunk, block, side", [((11, 13), (8, 8), (5, 8), 3), ((7,), (7,), (5,), 2), ((6, 5, 4), (4, 5, 3), (4, 3, 3), 2)])
def test_cells(spark, shape, chunk, block, side):
    s = ArraySpec(shape, chunk, block)
    a = ChunkedArray.from_flat(spark.range(s.nitems), s, F.col("id"), F.col("id").cast("double"))
    ordered = filters.cell_order(a, side)
    rows = ordered.collect()
    groups = {}
    for r in rows:
        groups.setdefault((r["nchunk"], r["nblock"]), []).append(r)
    for own in groups.values():
        assert len({r["position"] for r in own}) == len(own)
        by_position = sorted(own, key=lambda r: r["position"])
        assert [(r["cell"], r["in_cell"]) for r in by_position] == sorted((r["cell"], r["in_cell"]) for r in own)
    assert filters.from_cell_order(a, ordered, side).to_rows() == a.to_rows()
    means = {(r["nchunk"], r["nblock"], r["cell"]): r["mean"] for r in filters.cell_mean(a, side).collect()}
    for key, own in itertools.groupby(sorted(rows, key=lambda r: (r["nchunk"], r["nblock"], r["cell"])), key=lambda r: (r["nchunk"], r["nblock"], r["cell"])):
        assert means[key] == pytest.approx(np.mean([r["value"] for r in own]))


def test_chunk_operators(spark):
    t = spark.range(35).select(F.expr("id div 10").alias("nchunk"), F.col("id").alias("v"))
    new = spark.range(3).select((F.col("id") + 100).alias("v"))

    def as_lists(df):
        out = {}
        for r in df.orderBy("nchunk", "v").collect():
            out.setdefault(r["nchunk"], []).append(r["v"])
        return [out[k] for k in sorted(out)]

    base = [list(range(i, min(i + 10, 35))) for i in range(0, 35, 10)]
    assert as_lists(chunks.insert_chunk(t, new, 1, 4)) == [base[0], [100, 101, 102], *base[1:]]
    assert as_lists(chunks.append_chunk(t, new, 4)) == [*base, [100, 101, 102]]
    assert as_lists(chunks.update_chunk(t, new, 3)) == [*base[:3], [100, 101, 102]]
    assert as_lists(chunks.delete_chunk(t, 0, 4)) == base[1:]
    assert as_lists(chunks.reorder_chunks(t, [2, 0, 3, 1])) == [base[2], base[0], base[3], base[1]]
    for bad in ([0, 0, 1, 2], [1, 2, 3, 4]):
        with pytest.raises(InvalidParam):
            chunks.reorder_chunks(t, bad)
    starts = chunks.ragged_starts(t.groupBy("nchunk").agg(F.count("*").alias("nitems"))).orderBy("nchunk").collect()
    assert [r["start"] for r in starts] == [0, 10, 20, 30]
    stats = aggregate.chunk_stats(t.withColumn("v", F.when(F.col("nchunk") == 1, 5).otherwise(F.col("v"))), F.col("v")).orderBy("nchunk").collect()
    assert [r["is_run"] for r in stats] == [False, True, False, False]


def test_variable_length_blocks(spark):
    rows = spark.createDataFrame([(0, "red"), (1, "green-green"), (2, "blue-blue-blue-blue"), (3, None), (4, "")], "n int, t string")
    t = chunks.vl_blocks(rows, F.expr("n div 3"), F.col("n"), F.col("t"))
    assert {r["nchunk"]: r["blocks"] for r in t.collect()} == {0: ["red", "green-green", "blue-blue-blue-blue"], 1: [None, ""]}
    assert [(r["nchunk"], r["block"]) for r in chunks.vl_block(t, 2).collect()] == [(0, "blue-blue-blue-blue")]


def test_sign_changes_across_chunks(spark):
    t = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 2, -1.0), (1, 3, 4.0)], "nchunk long, i long, v double")
    assert [(r["i"], r["before"], r["value"]) for r in aggregate.sign_changes(t, "i", F.col("v")).orderBy("i").collect()] == [(2, 2.0, -1.0), (3, -1.0, 4.0)]


def test_bits_are_put_together_before_they_become_rows(spark):
    """No row for each bit of a value is grouped; the same bytes as by hand with gaps, repeated places, nulls and a short block."""
    rows = [(0, 0, i, (-1) ** i * (i * 7919 + 3)) for i in range(21) if i not in (3, 8, 9)] + [(0, 1, i, None if i % 3 else i) for i in range(8)] + [(0, 0, 5, 1 << 62), (1, 0, 0, 5)]
    table = spark.createDataFrame(rows, "nchunk long, nblock long, i long, value long")
    coded = filters.bit_shuffle(table, 8)
    back = filters.bit_unshuffle(coded, 8)
    for made in (coded, filters.bit_unshuffle(spark.createDataFrame([(0, 0, 1, 0, 3)], coded.schema), 8)):
        plan = made._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")
        assert len(plan) > 1 and not any("Generate" in x for x in plan[1:])
    want: dict = {}
    for c, b, i, v in rows:
        whole = {(0, 0): 16, (0, 1): 8, (1, 0): 0}[c, b]
        for bit in range(64) if i < whole else ():
            was = want.setdefault((c, b, bit, i // 8), None)
            want[c, b, bit, i // 8] = was if v is None else (was or 0) | (v >> bit & 1) << i % 8
        if i >= whole:
            want[c, b, -1, i] = v
    assert {tuple(r)[:4]: r["byte"] for r in coded.collect()} == want and coded.count() == len(want)
    held = {(r["nchunk"], r["nblock"], r["i"]): r["value"] for r in back.collect()}
    assert all(held[c, b, i] == v for c, b, i, v in rows if v is not None and (c, b, i) != (0, 0, 5)) and held[0, 0, 3] == 0


def test_bits_are_dealt_over_all_tasks(spark):
    """Few bytes of values are many rows of bytes; they don't go to one task."""
    table = spark.range(5000).select(F.expr("id div 100 AS nchunk"), F.lit(0).cast("long").alias("nblock"), F.expr("id % 100 AS i"), F.col("id").alias("value"))
    plan = filters.bit_shuffle(table, 8)._jdf.queryExecution().optimizedPlan().toString()
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    dealt = [x.rpartition(" ")[2] for x in plan.splitlines() if "RepartitionByExpression" in x]
    assert dealt and set(dealt) == {tasks}
