import numpy as np
import pytest

from typeloom.operators import models
from typeloom.storage import Stage


def _data(spark, x, weight, kind):
    rows = [(v, float(w), int(h)) for v, w, h in zip(x, weight, np.random.default_rng(5).integers(-(2**62), 2**62, len(weight)))]
    return spark.createDataFrame(rows, f"v {kind}, weight double, h long").repartition(4)


def test_one_job_sums_all_tasks(spark):
    """A pass over the points is one job whose tasks run side by side, not a job for each task in turn."""
    data = _data(spark, range(1, 400), np.ones(399), "long")
    data = Stage(spark, "test").keep(data, "points")
    spark.sparkContext.setJobGroup("pass over the points", "")
    try:
        models._assigned(data, np.eye(9, 64))
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("pass over the points")) == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("kind", ["long", "array<double>"])
def test_rounds_equal_plain_lloyd(spark, monkeypatch, kind):
    """Every round gives what a search through all centres gives, with empty centres, twins of centres and uneven parts."""
    monkeypatch.setattr(models, "PART", 150)
    monkeypatch.setattr(models, "CHUNK", 16)
    rng = np.random.default_rng(2)
    if kind == "long":
        shapes = rng.integers(-(2**62), 2**62, 12)
        masks = np.unique(np.concatenate([s ^ (1 << rng.integers(0, 62, 90)) ^ (1 << rng.integers(0, 62, 90)) for s in shapes]))
        x, points, weight = np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float), masks.tolist(), rng.integers(1, 9, len(masks)).astype(float)
    else:
        x = rng.normal(0, 1, (900, 5)) * rng.choice([0.01, 1, 30], (900, 1))
        points, weight = x.tolist(), rng.random(900)
    c = x[rng.choice(len(x), 40, replace=False)] + rng.normal(0, 0.02, (40, x.shape[1]))
    c[7] = 1e3  # no point is nearest to it
    stage = Stage(spark, "test")
    rounds = models._Rounds(stage, _data(spark, points, weight, kind), c)
    assert rounds.parts > 4
    for _ in range(12):
        near = ((x[:, None] - rounds.centres[None]) ** 2).sum(2).argmin(1)
        assert rounds.total[:, -1].tolist() == np.bincount(near, minlength=40).tolist()
        assert np.allclose(rounds.total[:, -2], np.bincount(near, weight, 40)) and np.allclose(rounds.total[:, :-2], [(x[near == k] * weight[near == k][:, None]).sum(0) for k in range(40)])
        before = rounds.centres
        most = rounds.move()
        assert most == pytest.approx(np.sqrt(((rounds.centres - before) ** 2).sum(1).max())) and rounds.centres[7].tolist() == [1e3] * x.shape[1]
    stage.close()
