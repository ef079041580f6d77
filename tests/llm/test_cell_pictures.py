import random

import numpy as np
import pytest

from tests.llm.test_similarity import components
from typeloom.llm import cell_pictures
from typeloom.llm import queries as llm_queries

CELLS = "cell_id long, glyph_id long, is_empty boolean, mask long, copies int"


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("block", [3, 32_768])
def test_cell_clusters_equal_brute_force(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr(cell_pictures, "BLOCK", block)
    rng = random.Random(5)
    masks = [(1 << 64) - 1, 1, 1 << 63]
    for _ in range(25):
        base = rng.getrandbits(64) & rng.choice([rng.getrandbits(64), (1 << 64) - 1, rng.getrandbits(64) & rng.getrandbits(64)])
        masks += [base] + [base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(rng.randint(0, 4))]
    cells = [(1000 - i, m) for i, m in enumerate(masks + [masks[0]] * 4 + masks[5:9])] + [(7, masks[10]), (7, masks[30])]
    rows = [(i, None, True, signed(m), 9) for i, m in cells + cells[:20]] + [(1, None, False, 0, 9), (None, None, False, -1, 9), (2, None, False, None, 9)]
    pictures = {(i, m) for i, m in cells if m}
    similar = [(x, y) for x in pictures for y in pictures if bin(x[1] & y[1]).count("1") >= 0.7 * bin(x[1] | y[1]).count("1")]
    label = components([(x[0], y[0]) for x, y in similar], {i for i, _ in pictures})
    sizes = {v: sum(x == v for x in label.values()) for v in label.values()}
    want = {(i, c) for i, c in label.items() if sizes[c] >= 3}
    spark.createDataFrame(rows, CELLS).write.parquet(str(tmp_path / "cells.parquet"))
    got = [tuple(r) for r in llm_queries.p7_cells(spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want) and len({c for _, c in want}) > 2
    near = {x: sum(y == x for y, _ in similar) for x in pictures}
    found = cell_pictures.cell_clusters(spark, spark.read.parquet(str(tmp_path / "cells.parquet")))
    assert all(near[r.cell_id, r.mask % (1 << 64)] == r.rho for r in found.collect())
    best = {i: max(n for (k, _), n in near.items() if k == i) for i in label}
    for r in llm_queries.p7_cell_clusters(spark, str(tmp_path)).collect():
        members = sorted((i for i in label if label[i] == r.cluster_id), key=lambda i: (-best[i], i))
        assert r["size"] == len(members) and r.typical == members[:3]


def test_block_links_in_parts(monkeypatch):
    monkeypatch.setattr(cell_pictures, "ENTRIES", 40)
    rng = np.random.default_rng(3)
    pools = [np.unique([sum(1 << int(x) for x in rng.permutation(16)[:p]) for _ in range(60)]).astype(np.uint64) for p in (9, 11)]
    a, b = pools
    wa, wb = rng.integers(1, 9, len(a)), rng.integers(1, 9, len(b))
    linked = np.bitwise_count(a[:, None] & b) / np.bitwise_count(a[:, None] | b).astype(float) >= 0.7
    near_a, near_b, label = cell_pictures.block_links(a, wa, b, wb, 0.7)
    assert (near_a == linked @ wb).all() and (near_b == wa @ linked).all()
    pairs = [(i, len(a) + j) for i, j in zip(*np.nonzero(linked))]
    assert dict(enumerate(label.tolist())) == components(pairs, range(len(label)))


def test_no_cells(spark):
    assert cell_pictures.cell_clusters(spark, spark.createDataFrame([], CELLS)).count() == 0
