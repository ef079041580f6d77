import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from typeloom.functions import bits, geometry, text, vectors
from typeloom.operators import outlines

MASKS = [0, 1, -(1 << 63), -1, 0x0102040810204080, 72057594037927936]


def test_masks_round_trip_and_mirror(spark):
    df = spark.createDataFrame([(m,) for m in MASKS], "mask bigint")
    rows = df.select("mask", bits.pack(bits.unpack(F.col("mask"))).alias("again"), bits.mirrored(F.col("mask")).alias("flip"), bits.unpack(F.col("mask")).alias("v"), bits.unpack(bits.mirrored(F.col("mask"))).alias("w")).collect()
    for r in rows:
        assert r.mask == r.again
        assert np.array_equal(np.array(r.v).reshape(8, 8)[:, ::-1], np.array(r.w).reshape(8, 8))


def test_mask_comparisons(spark):
    r = spark.createDataFrame([(0, 0), (1, 3), (-1, -(1 << 63))], "a bigint, b bigint").select(bits.jaccard(F.col("a"), F.col("b")).alias("j"), bits.differing(F.col("a"), F.col("b")).alias("d"), bits.occupied(F.col("a")).alias("o"), bits.solid(F.col("a")).alias("s")).collect()
    assert [x.j for x in r] == [1.0, 0.5, 1 / 64] and [x.d for x in r] == [0, 1, 63] and [x.o for x in r] == [0, 1, 1] and [x.s for x in r] == [0, -1, -1]


def test_names(spark):
    df = spark.createDataFrame([("a/b/x_y_12.png",), ("plain.png",), ("x_.png",), (None,)], "p string")
    stem = text.stem(F.col("p"))
    got = df.select(text.stem_label(stem).alias("l"), text.stem_id(stem).alias("i")).collect()
    assert [(r.l, r.i) for r in got] == [("x_y", 12), ("plain", None), ("x", None), (None, None)]
    one = spark.createDataFrame([("a b/é*c" + "x" * 80,)], "l string").select(text.safe_label(F.col("l")).alias("s")).first().s
    assert one.startswith("a_b_c") and len(one) == 64


def test_softmax_and_top_k(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, -2.0],), ([700.0, 700.0],)], "v array<double>")
    rows = df.select(vectors.softmax(F.col("v")).alias("p"), vectors.top_k(F.col("v"), 2).alias("t"), vectors.min_max(F.col("v")).alias("m")).collect()
    assert abs(sum(rows[0].p) - 1) < 1e-12 and [x.idx for x in rows[0].t] == [1, 2]
    assert rows[1].p == [0.5, 0.5] and rows[1].m == [0.0, 0.0]


def test_area_extent_and_diacritics(spark):
    square = [Row(x=0.0, y=0.0), Row(x=10.0, y=0.0), Row(x=10.0, y=10.0), Row(x=0.0, y=10.0)]
    df = spark.createDataFrame([([square],), ([square[::-1]],), ([],)], outlines_schema := "o array<array<struct<x:double,y:double>>>")
    rows = df.select(F.aggregate(F.transform("o", geometry.polygon_area), F.lit(0.0), lambda a, x: a + x).alias("a"), geometry.extent(F.col("o")).alias("b")).collect()
    assert [r.a for r in rows] == [100.0, -100.0, 0.0] and tuple(rows[2].b) == (0.0, 0.0, 0.0, 0.0)
    assert outlines_schema
    cases = [(99, 0.9, 0.0, 500.0, 800, -200), (100, 0.9, 0.0, 500.0, 800, -200), (None, 0.1, 0.0, 500.0, 800, -200), (500, 0.2, 500.0, 600.0, 800, -200), (500, 0.2, 500.0, 600.0, 800, 0), (500, 0.3, 500.0, 600.0, 800, -200)]
    df = spark.createDataFrame(cases, "adv int, ratio double, y0 double, y1 double, asc int, desc int").withColumn("box", F.struct(F.lit(0.0).alias("x0"), "y0", F.lit(1.0).alias("x1"), "y1"))
    got = [r[0] for r in df.select(geometry.is_diacritic(F.col("adv"), F.col("ratio"), F.col("box"), F.col("asc"), F.col("desc"))).collect()]
    assert got == [True, False, True, True, False, False]


def test_outline_layouts():
    assert outlines.outline("[[0,0],[10,0],[10,10]]") == [[[0, 0], [10, 0], [10, 10]]]
    assert len(outlines.outline("[[[0,0],[1,0],[1,1]],[[5,5],[6,5]]]")) == 1
    nested = outlines.outline('[[["moveTo",[0,0]],["lineTo",[10,0]],["lineTo",[10,10]],["closePath",null]]]')
    assert nested == outlines.outline('[["moveTo",[0,0]],["lineTo",[10,0]],["lineTo",[10,10]],["closePath",null]]') and len(nested[0]) == 4
    assert len(outlines.outline('[["moveTo",[0,0]],["qCurveTo",[[10,0]]],["closePath",null]]')[0]) == 10
    two = outlines.outline('[["moveTo",[0,0]],["qCurveTo",[[0,10],[10,10],[10,0]]]]')[0]
    assert len(two) == 17 and two[8] == [5.0, 10.0] and two[16] == [10.0, 0.0]
    assert len(outlines.outline('[["moveTo",[0,0]],["curveTo",[[0,10],[10,10],[10,0]]]]')[0]) == 9
    for bad in (None, "", "  ", "[]", "{", '{"a":1}', "[[0,0],[1,1]]", '[["moveTo",[0,0]]]'):
        assert outlines.outline(bad) == []


def test_raster_keeps_holes():
    outer, inner = np.array([[0, 0], [128, 0], [128, 128], [0, 128]], float), np.array([[32, 32], [32, 96], [96, 96], [96, 32]], float)
    for engine in ("winding", "orientation"):
        px = outlines.raster([outer, inner], engine)
        assert px[0, 0] == 255 and px[64, 64] == 0 and set(np.unique(px)) == {0, 255} and (px == 255).sum() == 128 * 128 - 64 * 64
    assert outlines.raster([outer, inner[::-1]])[64, 64] == 255


def test_glyphs_to_cells(spark):
    rows = [(1, "[[0,0],[100,0],[100,100],[0,100]]", 800, -200, 500), (2, None, 800, -200, 500), (3, "[[0,0],[5,0],[9,0]]", 800, -200, None)]
    df = spark.createDataFrame(rows, "id bigint, contours string, ascent int, descent int, advance_width int")
    m = outlines.measured(df)
    assert {r.id: (r.is_diacritic, r.target_dim) for r in m.collect()} == {1: (True, 64), 2: (None, None), 3: (None, None)}
    cells = {r.id: r.cells for r in outlines.cells_of(outlines.rasterised(m, "id"), "id", "at_128").collect()}
    assert sum(c == -1 for c in cells[1]) == 64 and set(cells[2]) == {0} == set(cells[3])
