import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom import config
from chunkloom.array import ChunkedArray
from chunkloom.errors import ChunkloomError, InvalidParam, MetalayerNotFound, StaleSchema, StoreExists
from chunkloom.operators import select
from chunkloom.sources import codecs, datasource, store
from chunkloom.spec import ArraySpec
from chunkloom.streaming import growth


def ramp(spark, shape, chunk):
    s = ArraySpec(shape, chunk, chunk)
    return ChunkedArray.from_flat(spark.range(s.nitems), s, F.col("id"), F.col("id").cast("double"))


def test_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "CELLS_PER_GROUP", 50)
    path = str(tmp_path / "s")
    a = ramp(spark, (20, 10), (5, 5))
    store.save(ChunkedArray(a.df, a.spec, {"m": b"1"}, {"v": b"2"}), path)
    with pytest.raises(StoreExists):
        store.save(a, path)
    b = store.open_array(spark, path)
    assert b.to_rows() == a.to_rows() and b.meta["m"] == b"1" and b.vlmeta == {"v": b"2"}
    part = select.get_slice(b, (5, 0), (10, 5))
    assert part.to_numpy().tolist() == np.arange(200.0).reshape(20, 10)[5:10, :5].tolist()
    plan = part.df._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(chunk_group" in plan
    far = select.take(b, [199, 0, 199])
    assert [r["value"] for r in far.orderBy("pos").collect()] == [199.0, 0.0, 199.0] and "nchunk" in far._jdf.queryExecution().toString().split("PushedFilters")[1]
    outer = select.outer_index(b, [[19, 0], [9, 9, 0]])
    assert outer.to_numpy().tolist() == [[199, 199, 190], [9, 9, 0]] and "chunk_group" in outer.df._jdf.queryExecution().toString().split("PartitionFilters")[1][:80]
    store.save_append(ramp(spark, (3,), (3,)), path, "other")
    assert store.open_array(spark, path, "other").to_rows() == [0, 1, 2]
    assert store.append_cells(spark, path, ramp(spark, (2, 10), (5, 5)), 0) == 2
    changed, c = store.refresh(spark, path, b)
    assert changed and c.spec.shape == (22, 10) and c.to_rows()[200:] == [float(i) for i in range(20)]
    assert store.refresh(spark, path, c)[0] is False
    store.shrink(spark, path, (10, 10))
    store.append_cells(spark, path, ramp(spark, (1, 10), (5, 5)), 0)
    d = store.open_array(spark, path)
    assert d.to_rows() == [float(i) for i in range(100)] + [float(i) for i in range(10)]
    with pytest.raises(StaleSchema):
        store.refresh(spark, path, ChunkedArray(b.df, ArraySpec((20, 10), (4, 4), (4, 4))))
    store.rename(spark, path, path + "2")
    assert store.exists(spark, path + "2") and not store.exists(spark, path)
    assert store.remove(spark, path + "2")


def test_growth_keeps_pruning(spark, tmp_path, monkeypatch):
    """Each part is pruned by the geometry it was written in, also after growth or a cut along an inner dimension."""
    monkeypatch.setattr(store, "CELLS_PER_GROUP", 50)
    path = str(tmp_path / "s")
    store.save(ramp(spark, (20, 10), (5, 5)), path)
    store.append_cells(spark, path, ramp(spark, (20, 4), (5, 5)), 1)
    whole = np.concatenate([np.arange(200.0).reshape(20, 10), np.arange(80.0).reshape(20, 4)], 1)
    a = store.open_array(spark, path)
    assert len(a.parts) == 2 and a.to_numpy().tolist() == whole.tolist()
    part = select.get_slice(a, (11, 3), (14, 13))
    assert part.to_numpy().tolist() == whole[11:14, 3:13].tolist()
    plan = part.df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("PartitionFilters: [isnotnull(chunk_group") == 2
    assert [r["value"] for r in select.take(a, [279, 0, 153]).orderBy("pos").collect()] == [whole.ravel()[i] for i in (279, 0, 153)]
    assert select.outer_index(a, [[19, 2], [13, 0, 9]]).to_numpy().tolist() == whole[np.ix_([19, 2], [13, 0, 9])].tolist()
    store.shrink(spark, path, (20, 4))
    b = store.open_array(spark, path)
    assert select.get_slice(b, (7, 1), (13, 4)).to_numpy().tolist() == whole[7:13, 1:4].tolist()


def test_one_file_a_group(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "CELLS_PER_GROUP", 100)
    path = tmp_path / "s"
    store.save(ramp(spark, (400, 10), (5, 5)), str(path))
    groups = list(path.glob("cells/*/chunk_group=*"))
    assert len(groups) == 40 and all(len(list(g.glob("*.parquet"))) == 1 for g in groups)


def test_two_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "s")
    store.save(ramp(spark, (4,), (2,)), path)
    threads = [threading.Thread(target=store.append_cells, args=(spark, path, ramp(spark, (3,), (2,)), 0)) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert store.open_array(spark, path).to_rows() == [0, 1, 2, 3] + [0, 1, 2] * 3
    with store.StoreLock(spark, path):
        assert store.append_cells(spark, path, ramp(spark, (1,), (1,)), 0) == 5
    assert not store.exists(spark, path + ".lock")


def test_lock_of_a_dead_writer(spark, tmp_path):
    path = str(tmp_path / "s")
    (tmp_path / "s.lock").write_bytes(b"")
    with pytest.raises(ChunkloomError):
        store.StoreLock(spark, path, wait_s=0.1).__enter__()
    with store.StoreLock(spark, path, wait_s=5, stale_s=-1):
        assert store.exists(spark, path + ".lock")
    assert [x.name for x in tmp_path.iterdir() if x.name.startswith("s.lock")] == []


def test_layers(spark, tmp_path):
    path = str(tmp_path / "s")
    store.save(ramp(spark, (4,), (2,)), path)
    store.set_layer(spark, path, "a", b"xy")
    for bad in (dict(name="a", content=b"x"), dict(name="n" * 32, content=b""), dict(name="a", content=b"longer", update=True)):
        with pytest.raises(InvalidParam):
            store.set_layer(spark, path, **bad)
    with pytest.raises(MetalayerNotFound):
        store.set_layer(spark, path, "none", b"", update=True)
    store.set_layer(spark, path, "v", b"1", "vl")
    store.set_layer(spark, path, "w", b"1", "vl")
    assert store.layer_names(spark, path) == ["v", "w"] and store.delete_layer(spark, path, "v") == 1
    assert store.has_layer(spark, path, "a") and not store.has_layer(spark, path, "v", "vl")
    assert store.get_layer(spark, path, "a") == b"xy"


def test_lock(spark, tmp_path):
    path = str(tmp_path / "s")
    mine, other = store.StoreLock(spark, path), store.StoreLock(spark, path, wait_s=0.1)
    failed = []

    def wait():
        try:
            other.__enter__()
        except ChunkloomError as e:
            failed.append(e)

    with mine, mine:
        thread = threading.Thread(target=wait)
        thread.start()
        thread.join()
        assert len(failed) == 1
    with other:
        assert store.exists(spark, path + ".lock")
    assert not store.exists(spark, path + ".lock")


@pytest.mark.parametrize("name", ["none", "zlib", "zstd", "lz4"])
def test_codecs(spark, name):
    rows = [(0, [1.5, 2.5, -3.0]), (1, [0.0] * 50), (2, [7.0] * 9), (3, [float(i % 3) for i in range(1000)])]
    t = spark.createDataFrame(rows, "nchunk long, values array<double>")
    encoded = codecs.encode_chunks(t, "f8", name)
    assert {r["nchunk"]: r["special"] for r in encoded.collect()} == {0: "none", 1: "zero", 2: "value", 3: "none"}
    assert {r["nchunk"]: r["values"] for r in codecs.decode_chunks(encoded, "f8", "double").collect()} == dict(rows)
    assert codecs.by_number(codecs.codec(name).number).name == name
    with pytest.raises(InvalidParam):
        codecs.register(codecs.Codec(5, "mine", None, None))


def test_user_codec(spark):
    turned = bytes(255 - i for i in range(256))
    if 210 not in codecs.registered():
        codecs.register(codecs.Codec(210, "mine", lambda raw, level: raw.translate(turned), lambda raw: raw.translate(turned)))
    rows = [(0, [1.5, 2.5, -3.0]), (1, [0.0] * 50)]
    encoded = codecs.encode_chunks(spark.createDataFrame(rows, "nchunk long, values array<double>"), "f8", "mine")
    assert {r["nchunk"]: r["values"] for r in codecs.decode_chunks(encoded, "f8", "double").collect()} == dict(rows)
    info = {r["nchunk"]: r for r in codecs.payload_info(encoded, "f8").collect()}
    assert (info[0]["codec"], info[0]["nbytes"], info[0]["is_valid"]) == ("mine", 24, True) and info[1]["special"] == "zero"
    broken = encoded.selectExpr("nchunk", "nitems", "special", "unhex('63') AS payload")
    assert not any(r["is_valid"] for r in codecs.payload_info(broken, "f8").collect())
    assert {"zstd", "zlib"} <= codecs.library_versions().keys()
    with pytest.raises(InvalidParam):
        codecs.register(codecs.Codec(210, "other", None, None))


def test_user_io(spark, tmp_path):
    """A backend that stands in no module of the executors, with whole numbers that doubles cannot hold."""

    class Reversed(datasource.Backend):
        def size(self, path):
            return len(open(path, "rb").read())

        def read(self, path, offset, length):
            return open(path, "rb").read()[::-1][offset : offset + length]

    if "reversed" not in datasource.backends():
        datasource.register_io("reversed", Reversed())
    values = np.array([1 << 60, (1 << 53) + 1, -5], "<i8")
    raw = bytes([0]) + values.tobytes()
    (tmp_path / "f").write_bytes((raw * 2)[::-1])
    df = datasource.read_chunks(spark, str(tmp_path / "f"), [(0, 25, 3, "none"), (25, 25, 3, "none")], "i8", "reversed")
    assert df.schema["value"].dataType.simpleString() == "bigint" and df.rdd.getNumPartitions() == 1
    assert [r["value"] for r in df.orderBy("nchunk", "i").collect()] == values.tolist() * 2
    with pytest.raises(InvalidParam):
        datasource.read_chunks(spark, "x", [], io="none such")


def test_data_source(spark, tmp_path):
    code = codecs.codec("zlib")
    parts = [np.arange(5.0), np.full(3, 2.0)]
    blobs = [bytes([code.number]) + code.encode(parts[0].tobytes(), 5), bytes([0]) + parts[1][:1].tobytes()]
    (tmp_path / "f").write_bytes(b"junk" + b"".join(blobs))
    index = [[0, len(blobs[0]), 5, "none"], [len(blobs[0]), len(blobs[1]), 3, "value"]]
    spark.dataSource.register(datasource.ChunkSource)
    df = spark.read.format("chunkloom").option("path", str(tmp_path / "f")).option("offset", "4").option("index", json.dumps(index)).load()
    assert [r["value"] for r in df.orderBy("nchunk", "i").collect()] == [*parts[0], *parts[1]]


def test_growth(spark, tmp_path):
    cells = spark.range(20).select(F.col("id").alias("d0"), F.col("id").cast("double").alias("value"))
    base = str(tmp_path)
    seen = []
    for version, part in enumerate((cells.where("d0 < 12"), cells.where("d0 >= 12"), cells.where("d0 between 3 and 5").withColumn("value", F.col("value") * 10))):
        growth.write_version(part, f"{base}/in", version)
        growth.drain(growth.follow(spark, f"{base}/in", 1, "double"), f"{base}/out", f"{base}/c1")
        growth.drain_with(growth.follow(spark, f"{base}/in", 1, "double"), lambda df, _: seen.append(df.count()), f"{base}/c2")
    assert sum(seen) == 23
    out = spark.read.schema(growth.cell_schema(1, "double")).parquet(f"{base}/out")
    got = {r["d0"]: r["value"] for r in growth.latest(out, 1, (20,)).collect()}
    assert got == {i: float(i) * (10 if 3 <= i <= 5 else 1) for i in range(20)}
    assert growth.changes(out, 1).where("before is not null").count() == 3


def test_config(spark):
    assert config.codec_name(config.codec_number("zstd")) == "zstd" and "lz4" in config.list_codecs()
    before = config.get_codec(spark)
    config.set_codec(spark, "zstd")
    assert config.get_codec(spark) == "zstd"
    spark.conf.set("spark.sql.parquet.compression.codec", before)
    n = config.set_parallelism(spark, 5)
    assert config.set_parallelism(spark, n) == 5
    config.register_tuner("two", lambda nbytes, cores: 2)
    assert config.partitions_for(1 << 40, 8, "two") == 2 and config.partitions_for(1 << 30, 2) == 8
    assert config.Timer().seconds() >= 0
    with pytest.raises(InvalidParam):
        config.codec_number("none such")
