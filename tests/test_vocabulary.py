import pytest

from typeloom.operators import models
from typeloom.plans import evaluation_queries


def test_vocabulary_weighs_points(spark):
    df = spark.createDataFrame([([0.0], 1), ([0.1], 9), ([1.0], 5)], "v array<double>, n int")
    got = [tuple(r.v) for r in models.vocabulary(spark, df, "v", 1, seed=1, weight="n").orderBy("centroid_id").collect()]
    assert got == [(0.0,), (pytest.approx(0.09),)]


def test_kmeans_vocabulary_counts_cells(spark, tmp_path):
    cells = [(i, 0b1011) for i in range(40)] + [(100 + i, -1) for i in range(60)] + [(200, 0xF0)] * 90 + [(300 + i, 0) for i in range(99)]
    cells += [(1000 + i, 1 << i) for i in range(8, 40)] + [(None, 3)] * 200
    spark.createDataFrame(cells * 2, "cell_id long, mask long").write.parquet(str(tmp_path / "cells.parquet"))
    got = {r.centroid_id: [round(x) for x in r.v] for r in evaluation_queries.kmeans_vocabulary(spark, str(tmp_path)).collect()}
    assert len(got) == 1024 and got[0] == [0] * 64
    assert got[1] == [1] * 64 and got[2] == [1, 1, 0, 1] + [0] * 60
