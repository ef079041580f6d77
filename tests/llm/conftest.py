import random

import pytest

GRID = "glyph_id long, label string, font_hash string, is_diacritic boolean, cells array<bigint>, fp int, vals string, bucket int, n string"


@pytest.fixture(scope="session")
def grid_rows():
    """Families of edited grids, exact copies, and everything that is dirty. Further columns clash with inner names."""
    rng = random.Random(4)
    rows, gid = [], 100

    def add(cells, times=1):
        nonlocal gid
        gid += 1
        rows.extend([(gid, None, None, None, cells, 1, "x", 2, "y")] * times)
        return gid

    for _ in range(12):
        base = [0] * 60 + [rng.getrandbits(63) - (1 << 62) for _ in range(60)] + [-1] * 136
        rng.shuffle(base)
        for _ in range(rng.randint(1, 7)):
            cells = list(base)
            for _ in range(rng.randint(0, 14)):
                cells[rng.randrange(256)] = rng.getrandbits(63)
            if rng.random() < 0.5:
                rng.shuffle(cells)
            add(cells, rng.choice([1, 1, 2]))
    same = [5] * 256
    for _ in range(30):
        add(same)
    for bad in (None, [1] * 255, [0] * 256, [None] + [1] * 255, []):
        add(bad)
    rows.append((None, None, None, None, same, 1, "x", 2, "y"))
    return rows


@pytest.fixture(scope="session")
def grids_df(spark, grid_rows):
    return spark.createDataFrame(grid_rows, GRID)


def valid(rows):
    return [(r[0], tuple(r[4])) for r in rows if r[0] is not None and r[4] is not None and len(r[4]) == 256 and None not in r[4] and any(r[4])]


@pytest.fixture(scope="session")
def similar(grid_rows):
    """Brute force: the pairs of glyphs with at least 0.7 of their values in common."""
    sets = {(g, frozenset(c) - {0}) for g, c in valid(grid_rows)}
    out = set()
    for g, a in sets:
        for h, b in sets:
            if g < h and len(a & b) >= 0.7 * len(a | b):
                out.add((g, h))
    return out
