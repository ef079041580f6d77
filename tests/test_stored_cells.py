from typeloom.plans import grid_queries


def test_stored_vs_cells_without_a_broadcast(spark, tmp_path):
    """Small files, as repeated grids make them, and everything odd: nulls, copies, two grids of a glyph, places outside."""
    grids = [(g, [g + i if i % 7 else None for i in range(256)]) for g in range(40)] * 2 + [(3, [0] * 256), (4, [1] * 255), (5, None), (None, [1] * 256), (90, [1] * 256)]
    cells = [(g, i // 16, i % 16, None if i % 14 == 0 else g + i) for g in range(39) for i in range(256)] * 2
    cells += [(3, 0, 1, 0), (3, 16, 0, 0), (3, -1, 0, 0), (3, -1, 17, 9), (3, None, 2, 0), (4, 0, 0, 1), (None, 0, 0, 1), (7, 0, 1, None)]
    spark.createDataFrame(grids, "glyph_id long, cells array<long>").write.parquet(str(tmp_path / "cell_grids.parquet"))
    spark.createDataFrame(cells, "glyph_id long, cell_row int, cell_col int, mask long").write.parquet(str(tmp_path / "cells.parquet"))
    found = grid_queries.stored_vs_cells(spark, str(tmp_path))
    got = {r.glyph_id: (r.places, r.same) for r in found.collect()}
    stored = {(g, tuple(c)) for g, c in grids if g is not None and c is not None and len(c) == 256}
    want = {}
    for g, row, col, mask in set(cells):
        for h, c in stored:
            if g == h and row is not None and 0 <= row * 16 + col < 256:
                places, same = want.get(g, (0, 0))
                want[g] = places + 1, same + (mask == c[row * 16 + col])
    assert got == want and len(got) == 39
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
