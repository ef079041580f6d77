from tests.llm.conftest import GRID
from typeloom.llm import near_duplicates


def test_two_grids_of_a_glyph_join_their_classes(spark):
    x, y, z = ([k * 1000 + i for i in range(256)] for k in (1, 2, 3))
    grids = [(5, x[:-1] + [7]), (9, x), (9, y), (12, y[:-1] + [8]), (20, z), (21, z)]
    df = spark.createDataFrame([(g, None, None, None, c, 1, "x", 2, "y") for g, c in grids], GRID)
    members, pairs = near_duplicates.near_duplicates(spark, df)
    got = {r.glyph_id: r.class_id for r in near_duplicates.duplicate_classes(spark, members, pairs).collect()}
    assert got == {5: 5, 9: 5, 12: 5, 20: 20, 21: 20}
