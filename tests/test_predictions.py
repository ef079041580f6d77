from typeloom.plans import evaluation_queries


def test_perceptron_learns_from_every_row(spark, tmp_path):
    rows = [(i, i % 2, [1.0 - 2 * (i % 2), 0.5 + i / 1000]) for i in range(60)] + [(60, None, [1.0, 0.5])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: r.pred for r in evaluation_queries.mlp_predict(spark, str(tmp_path)).collect()}
    assert got == {i: i % 2 for i in range(61)}
