import numpy as np

from typeloom.operators import models


def test_masks_are_points_and_rounds_settle(spark):
    """Masks go in as they are; every centre ends as the mean of the points nearest to it."""
    rng = np.random.default_rng(3)
    shapes = rng.integers(-(2**62), 2**62, 8)
    masks = np.unique(np.concatenate([s ^ (1 << rng.integers(0, 62, 60)) for s in shapes]))
    weight = rng.integers(1, 9, len(masks))
    df = spark.createDataFrame([(int(m), int(w)) for m, w in zip(masks, weight)] + [(None, 5)], "mask long, n int")
    got = np.array([r.v for r in models.vocabulary(spark, df, "mask", 7, seed=1, iterations=50, weight="n").orderBy("centroid_id").collect()])
    assert got.shape == (8, 64) and not got[0].any()
    x = np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    data = spark.createDataFrame([(int(m), float(w), int(m)) for m, w in zip(masks, weight)], "v long, weight double, h long")
    centres = models._starts(data, 9, 1)
    assert centres.shape == (9, 64)
    near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    sums, population = models._assigned(data, centres)
    assert population.tolist() == np.bincount(near, weight, 9).tolist()
    assert np.allclose(sums, [(x[near == k] * weight[near == k][:, None]).sum(0) for k in range(9)])
