import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from typeloom.sources import files, sinks
from typeloom.sources.npy import NpySource
from typeloom.sources.sqlite import SqliteSource


def test_npy_shards_and_raw(spark, tmp_path):
    spark.dataSource.register(NpySource)
    a = np.arange(10 * 64, dtype=np.uint8).reshape(10, 1, 8, 8)
    np.save(tmp_path / "shard_00000.npy", a[:6])
    np.save(tmp_path / "shard_00001.npy", a[6:])
    got = {r.row_id: list(r.v) for r in spark.read.format("npy").option("path", str(tmp_path)).load().collect()}
    assert got == {i: a[i].ravel().tolist() for i in range(10)}
    a.tofile(tmp_path / "raw.bin")
    raw = spark.read.format("npy").options(path=str(tmp_path / "raw.bin"), raw="true", dtype="uint8", width="64").load()
    assert raw.count() == 10
    np.save(tmp_path / "assign.npy", np.array([3, 65535, 7], np.uint16))
    assert sorted(tuple(r) for r in files.assignments(spark, str(tmp_path / "assign.npy"), "npy").collect()) == [(0, 3), (2, 7)]


def test_sqlite(spark, tmp_path):
    spark.dataSource.register(SqliteSource)
    db = sqlite3.connect(tmp_path / "g.db")
    db.execute("CREATE TABLE glyphs (id INTEGER, label TEXT)")
    db.executemany("INSERT INTO glyphs VALUES (?, ?)", [(i, f"l{i}") for i in range(25)])
    db.commit()
    read = spark.read.format("sqlite").schema("id bigint, label string").option("path", str(tmp_path / "g.db"))
    assert read.option("table", "glyphs").load().agg(F.count("*"), F.sum("id")).first()[:] == (25, 300)
    assert read.option("query", "SELECT id, label FROM glyphs WHERE id < 3").load().count() == 3


def test_tolerant_text_files(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text('{"glyph_id": 1, "font_hash": "a"}\n\n{"glyph_id": 2\n{"glyph_id": 3}\n{"glyph_id": 4, "font_hash": "b"}\n')
    got = files.jsonl(spark, str(p), "glyph_id long, font_hash string", ("glyph_id", "font_hash"))
    assert sorted(r.glyph_id for r in got.collect()) == [1, 4]
    (tmp_path / "ids.txt").write_text("1\n x\n 22 \n\n3.5\n")
    assert sorted(r.id for r in files.id_list(spark, str(tmp_path / "ids.txt")).collect()) == [1, 22]
    (tmp_path / "c.csv").write_text('label,base\n"a,b",x\n ,y\nc,z\n')
    assert sorted(r.label for r in files.label_rows(spark, str(tmp_path / "c.csv")).collect()) == ["a,b", "c"]
    assert files.blank_labels(spark, str(tmp_path / "c.csv")) == 1
    (tmp_path / "map.json").write_text(json.dumps({"a": 0, "c": 2}))
    assert sorted(tuple(r) for r in files.label_map(spark, str(tmp_path / "map.json")).collect()) == [(0, "a"), (1, "<UNK_1>"), (2, "c")]
    (tmp_path / "log.csv").write_text("epoch,phase,macro_f1,loss\n1,train,,0.5\nx,val,1,1\n1,val,0.7,oops\n")
    m = files.metrics(spark, str(tmp_path / "log.csv"))
    assert sorted((r.epoch, r.phase, r.macro_f1_seen, r.loss) for r in m.collect() if r.phase == "val") == [(1, "val", 0.7, None)]


def test_grid_files(spark, tmp_path):
    g = np.arange(256, dtype="<u2")
    (tmp_path / "7.u16").write_bytes(g.tobytes())
    np.save(tmp_path / "8.npy", g.reshape(16, 16))
    np.save(tmp_path / "row_ids.npy", g)
    got = {r.glyph_id: list(r.grid) for r in files.grid_files(spark, str(tmp_path)).collect()}
    assert got == {7: list(range(256)), 8: list(range(256))}
    (tmp_path / "9.u16").write_bytes(b"short")
    with pytest.raises(Exception, match="grid 9 has 5 bytes"):
        files.grid_files(spark, str(tmp_path)).collect()
    assert files.newest(spark, str(tmp_path), "*.u16").endswith("9.u16")


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"engine": "orientation", "unknown": 1}')
    assert files.RasterSettings.load(str(tmp_path / "c.json")).engine == "orientation"
    with pytest.raises(ValueError):
        files.RasterSettings(cell=4).validate()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b", "train"), (2, "c", "val")], "id long, label string, split string")
    sinks.by_split(df, str(tmp_path / "r"), "label")
    assert (tmp_path / "r/split=train/label_dir=a_b").exists()
    sinks.sharded(spark.range(10).coalesce(1), str(tmp_path / "s"), 4)
    assert len(list((tmp_path / "s").glob("*.parquet"))) == 3
    sinks.metrics_log(df, str(tmp_path / "m"))
    sinks.metrics_log(df, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).count() == 4
    dense = sinks.dense_labels(spark.createDataFrame([(1, 1, None)], "cell_id long, mask long, primitive_id int")).first()
    assert dense.v[0] == 1 and dense.label == 65535
    with pytest.raises(Exception, match="exist"):
        sinks.by_split(df, str(tmp_path / "r"))


def test_stream(spark, tmp_path):
    from typeloom.streaming import ingest

    cells = spark.range(20).selectExpr("id % 15 AS cell_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS extracted_at", "'f' AS font_hash", "id % 2 AS mask", "array(double(id % 15)) AS v")
    cells.write.parquet(str(tmp_path / "in"))
    schema = "cell_id bigint, extracted_at timestamp_ntz, font_hash string, mask bigint, v array<double>"
    stream = ingest.arriving(spark, str(tmp_path / "in"), schema)
    cents = spark.createDataFrame([(0, [0.0]), (1, [10.0])], "centroid_id long, v array<double>")
    ingest.assigned_stream(ingest.first_arrivals(stream), cents, "v", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 15 and {(r.cell_id, r.centroid_id) for r in got.collect()} == {(i, int(i > 5)) for i in range(15)}
    ink = ingest.ink_by_window(stream).writeStream.format("memory").queryName("ink").outputMode("complete").trigger(availableNow=True).start()
    ink.awaitTermination(120)
    assert spark.sql("SELECT sum(cells), sum(filled) FROM ink").first()[:] == (20, 10)


def test_cell_stores_and_packed_grids(spark, tmp_path):
    rng = np.random.default_rng(1)
    cells = (rng.random((9, 8, 8)) < 0.4).astype(np.uint8)
    want = dict(enumerate(np.packbits(cells.reshape(9, 64), axis=1, bitorder="little").view(np.int64).ravel().tolist()))
    read = lambda: {r.row_id: r["mask"] for r in files.cell_store(spark, str(tmp_path)).collect()}
    with pytest.raises(FileNotFoundError):
        read()
    np.save(tmp_path / "cells_bitpack_shard_000.npy", np.array(list(want.values())[:5], np.int64).view(np.uint64))
    np.save(tmp_path / "cells_bitpack_shard_001.npy", np.array(list(want.values())[5:], np.int64).view(np.uint64))
    assert read() == want
    np.save(tmp_path / "shard_00000.npy", cells[:2, None])
    assert read() == {0: want[0], 1: want[1]}
    np.save(tmp_path / "cells.npy", cells[3:4] * 255)
    assert read() == {0: want[3]}
    grids = rng.integers(0, 1024, (3, 256)).astype("<u2")
    grids.tofile(tmp_path / "grids.bin")
    np.save(tmp_path / "ids.npy", np.array([7, 5, 9]))
    got = files.packed_grids(spark, str(tmp_path / "grids.bin"), str(tmp_path / "ids.npy"))
    assert {r.glyph_id: list(r.grid) for r in got.collect()} == {i: g.tolist() for i, g in zip((7, 5, 9), grids)}
    np.save(tmp_path / "ids.npy", np.array([7, 5]))
    with pytest.raises(ValueError):
        files.packed_grids(spark, str(tmp_path / "grids.bin"), str(tmp_path / "ids.npy"))


def test_last_assignment_wins(spark, tmp_path):
    (tmp_path / "a.csv").write_text("cell_id,primitive_id\n1,5\n2,6\n1,7\nx,3\n2,-1\n3,\n")
    assert sorted(tuple(r) for r in files.assignments(spark, str(tmp_path / "a.csv"), "csv").collect()) == [(1, 7)]


def test_ids_and_weights(spark, tmp_path):
    rows = spark.createDataFrame([("a_1.png",), ("b_x_22.png",), ("3.png",), (None,)], "f string")
    ids = spark.createDataFrame([(22,), (3,), (None,)], "i long")
    assert [r.f for r in files.of_ids(rows, "f", ids).collect()] == ["b_x_22.png"] and files.of_ids(rows, "f", ids.limit(0)).count() == 4
    arrays = {"w": np.arange(6.0).reshape(2, 3), "b": np.zeros(2)}
    sinks.weights(spark, arrays, str(tmp_path / "m"))
    again = files.weights(spark, str(tmp_path / "m"))
    assert again.keys() == arrays.keys() and all((again[k] == arrays[k]).all() for k in arrays)


def test_missing_grids(spark):
    grids = spark.createDataFrame([(1, [3] * 256)], "glyph_id long, grid array<int>")
    ids = spark.createDataFrame([(1,), (2,)], "i int")
    assert {r.glyph_id: sum(r.grid) for r in files.grids_of(grids, ids, "zeros").collect()} == {1: 768, 2: 0}
    with pytest.raises(Exception, match="no grid for 2"):
        files.grids_of(grids, ids).collect()
    assert files.grids_of(grids, ids.limit(0)).count() == 0
