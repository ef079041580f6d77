import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import GRID, valid
from typeloom.llm import density_peaks, fm_index, lsh, near_duplicates, split_overlap
from typeloom.llm.graph import min_label_components
from typeloom.storage import Stage


def components(pairs, ids):
    label = {i: i for i in ids}
    for _ in ids:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(0)
    for n, share in ((8, 0.5), (60, 0.7), (200, 0.3)):
        both = rng.integers(0, 2**62, n)
        k = int(n * share)
        a, b = both, np.concatenate([both[:k], rng.integers(0, 2**62, n - k)])
        got = []
        for seed in range(40):
            sig = lsh.set_signatures(np.concatenate([a, b]), np.array([0, n, 2 * n]), 64, seed)
            got.append((sig[0] == sig[1]).mean())
        assert abs(np.mean(got) - k / (2 * n - k)) < 0.07


def test_near_duplicates_equal_brute_force(spark, grids_df, similar):
    members, pairs = near_duplicates.near_duplicates(spark, grids_df)
    got = near_duplicates.expanded(members, pairs)
    assert got.columns == ["glyph_a", "glyph_b"]
    assert {tuple(r) for r in got.collect()} == similar and got.count() == len(similar)
    ids = {g for g, _ in valid([r for r in grids_df.collect()])}
    want = components(similar, ids)
    found = {r.glyph_id: r.class_id for r in near_duplicates.duplicate_classes(spark, members, pairs).collect()}
    assert found == want


def _sets(spark, rows):
    df = spark.createDataFrame([(bytes([0]) * 8 + i.to_bytes(8, "big"), v) for i, v in enumerate(rows)], "fp binary, vals array<bigint>")
    return df.select(F.xxhash64("fp").alias("id"), "fp", F.size("vals").alias("size"), "vals")


def test_stars_are_linear_in_a_hot_bucket(spark):
    n = 100_000  # one bucket that holds every record
    entries = spark.range(n).select(F.lit(7).cast("bigint").alias("bucket"), "id", F.lit(9).alias("size"))
    first = lsh.heads(entries)
    assert first.count() == lsh.STARS + 2
    edges = lsh._edges(entries, first.filter(F.col("rank") <= lsh.STARS), 0.7)
    assert edges.count() == sum(n - 1 - k for k in range(lsh.STARS))
    assert edges.select("id_a", "id_b").distinct().count() == edges.count()


@pytest.mark.parametrize("complete", [True, False])
def test_crowded_buckets(spark, complete, monkeypatch):
    """Leaves around a centre that are no more like each other than it is to them, and a family that all links join."""
    monkeypatch.setattr(lsh, "STARS", 4)
    rng = random.Random(5)
    core = [rng.getrandbits(60) for _ in range(30)]
    rows = [sorted(core + [rng.getrandbits(60) for _ in range(20)]) for _ in range(150)]  # 0.43 alike
    family = [rng.getrandbits(60) for _ in range(60)]
    rows += [sorted(family[:i] + family[i + 1 :] + [rng.getrandbits(60)]) for i in range(60)]
    sets = [frozenset(r) for r in rows]
    want = {(i, k) for i in range(len(sets)) for k in range(i) if len(sets[i] & sets[k]) >= 0.7 * len(sets[i] | sets[k])}
    stage = Stage(spark, "t")
    classes = stage.keep(_sets(spark, rows), "classes")
    found = lsh.similar_pairs(stage, classes, "vals", near_duplicates.list_signatures, near_duplicates._measured, 0.7, 64, 4, complete=complete)
    got = {(int.from_bytes(r.fp_b, "big"), int.from_bytes(r.fp_a, "big")) for r in found.collect()}
    assert got <= want and len(want) == 60 * 59 // 2
    label = components(got, range(len(rows)))
    assert len({label[i] for i in range(150, 210)}) == 1
    if complete:
        assert got == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], GRID)
    members, pairs = near_duplicates.near_duplicates(spark, none)
    assert near_duplicates.expanded(members, pairs).count() == 0 == near_duplicates.duplicate_classes(spark, members, pairs).count()
    assert density_peaks.clusters(spark, none).count() == 0
    samples = spark.createDataFrame([], "sample_id long, glyph_id long, split string, source string")
    assert split_overlap.overlaps(spark, samples, none).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "u long, v long")
    extra = spark.createDataFrame([(999,), (3,), (None,)], "id long")
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = components(real, {x for e in real for x in e} | {999})
    got = {r.id: r.label for r in min_label_components(Stage(spark, "t"), df, extra).collect()}
    assert got == want


def test_density_peaks_equal_brute_force(spark, grid_rows, grids_df):
    rng = random.Random(9)
    rows, gid = list(grid_rows), 9000
    for _ in range(6):
        shape = [rng.getrandbits(64) & rng.getrandbits(64) if rng.random() < 0.6 else 0 for _ in range(256)]
        for _ in range(5):
            edited = [c ^ (1 << rng.randrange(64)) if c and rng.random() < 0.9 else c for c in shape]
            gid += 1
            rows.append((gid, None, None, None, [c - (1 << 64) if c >= 1 << 63 else c for c in edited], 1, "x", 2, "y"))
    pictures = {(g, c) for g, c in valid(rows)}
    bits = {p: np.unpackbits(np.array(p[1], np.int64).view(np.uint8)) for p in pictures}
    links = []
    for a in pictures:
        for b in pictures:
            if a[0] < b[0] and (bits[a] & bits[b]).sum() >= 0.7 * (bits[a] | bits[b]).sum():
                links.append((a[0], b[0]))
    label = components(links, {g for g, _ in pictures})
    sizes = {v: sum(x == v for x in label.values()) for v in label.values()}
    want = {(g, c) for g, c in label.items() if sizes[c] >= 3}
    found = density_peaks.clusters(spark, spark.createDataFrame(rows, GRID))
    assert {(r.glyph_id, r.cluster_id) for r in found.collect()} == want
    # peaks, by rho and delta, from the links between pictures
    copies = {}
    for g, c in pictures:
        copies.setdefault(c, []).append(g)
    pixels = {c: np.unpackbits(np.array(c, np.int64).view(np.uint8)) for c in copies}
    sim = {(a, b): (pixels[a] & pixels[b]).sum() / (pixels[a] | pixels[b]).sum() for a in copies for b in copies if a != b}
    rho = {a: len(copies[a]) + sum(len(copies[b]) for b in copies if a != b and sim[a, b] >= 0.7) for a in copies}
    dense = {a: (rho[a], min(copies[a])) for a in copies}
    up = {a: max(((sim[a, b], rho[b], min(copies[b]), b) for b in copies if a != b and sim[a, b] >= 0.7 and dense[b] > dense[a]), default=None) for a in copies}
    peaks = {a for a in copies if rho[a] >= 3 and (up[a] is None or 1 - up[a][0] >= density_peaks.DELTA)}
    top = {a: a for a in copies}
    for a in copies:
        while top[a] not in peaks and up[top[a]] is not None:
            top[a] = up[top[a]][3]
    want = {(min(copies[p]), len({g for a in copies if top[a] == p for g in copies[a]}), rho[p]) for p in peaks}
    described = density_peaks.described(found).collect()
    assert {(r.peak_id, r["size"], r.rho) for r in described} == want and len(described) == len(want)
    assert all(label[g] == r.cluster_id for r in described for g in r.typical) and len({r.cluster_id for r in described}) == len({c for _, c in {(g, c) for g, c in label.items() if sizes[c] >= 3}})


def test_fm_index_matches(spark):
    rng = random.Random(3)
    docs = [sorted(rng.sample(range(-50, 120), rng.randint(1, 40))) for _ in range(60)]
    flat = np.array([x for d in docs for x in d], np.int64)
    offsets = np.cumsum([0] + [len(d) for d in docs])
    fm = fm_index.FMIndex.loads(fm_index.FMIndex.build(flat, offsets).dumps())
    for _ in range(300):  # every substring in the index's order is found exactly where it stands
        d = rng.choice(docs)
        order = sorted(int(x) for x in fm.symbols(np.array(d)))
        i = rng.randrange(len(order))
        j = rng.randint(i + 1, len(order))
        lo, hi = np.array([0]), np.array([fm.n])
        for s in reversed(order[i:j]):
            lo, hi = fm.back(np.array([s]), lo, hi)
        want = {k for k, e in enumerate(docs) if (o := sorted(int(x) for x in fm.symbols(np.array(e)))) and any(o[a : a + j - i] == order[i:j] for a in range(len(o)))}
        assert {int(x) for x in fm.doc[lo[0] : hi[0]]} == want
    queries = [sorted(set(d[: rng.randint(1, len(d))] + rng.sample(range(200, 300), rng.randint(0, 5)))) for d in docs]
    qflat, qoff = np.array([x for q in queries for x in q], np.int64), np.cumsum([0] + [len(q) for q in queries])
    for share in (0.3, 0.7, 1.0):
        q, doc, spans, matched, longest, _ = fm.matches(qflat, qoff, share)
        got = {(i, k): x for i, k, *x in zip(*(x.tolist() for x in (q, doc, spans, matched, longest)))}
        want = {}
        for i, a in enumerate(queries):
            x = sorted(int(v) for v in fm.symbols(np.array(a)))
            for k, b in enumerate(docs):
                y = sorted(int(v) for v in fm.symbols(np.array(b)))
                if len(set(a) & set(b)) >= share * len(set(a) | set(b)):
                    runs, last = [], None
                    for v in sorted(set(x) & set(y)):
                        here = (x.index(v), y.index(v))
                        if last is not None and here == (last[0] + 1, last[1] + 1):
                            runs[-1] += 1
                        else:
                            runs.append(1)
                        last = here
                    want[i, k] = [len(runs), sum(runs), max(runs)]
        assert got == want


def test_maximal_spans_equal_brute_force():
    rng = random.Random(8)
    base = rng.sample(range(400), 60)
    docs = [sorted(rng.sample(base, rng.randint(5, 50))) for _ in range(40)]
    fm = fm_index.FMIndex.build(np.array([x for d in docs for x in d], np.int64), np.cumsum([0] + [len(d) for d in docs]))
    texts = [sorted(int(v) for v in fm.symbols(np.array(d))) for d in docs]
    for query in [*texts[:10], [0, 0, *texts[0]]]:
        q, doc, at, spot, length = fm.maximal_spans(np.array(query), np.array([0]), np.array([len(query)]), np.array([2]))
        got = set(zip(doc.tolist(), at.tolist(), spot.tolist(), length.tolist()))
        want = set()
        for k, t in enumerate(texts):
            for i in range(len(query)):
                for j in range(len(t)):
                    if query[i] == t[j] and query[i] and not (i and j and query[i - 1] == t[j - 1]):
                        n = 0
                        while i + n < len(query) and j + n < len(t) and query[i + n] == t[j + n]:
                            n += 1
                        if n >= 2:
                            want.add((k, i, j, n))
        assert got == want and len(doc) == len(want)


@pytest.mark.parametrize("shard", [3, 32_768])
def test_overlaps_equal_brute_force(spark, grids_df, grid_rows, similar, shard, monkeypatch):
    monkeypatch.setattr(split_overlap, "SHARD_DOCS", shard)
    monkeypatch.setattr(split_overlap, "BLOCK_DOCS", 20)
    rng = random.Random(2)
    ids = sorted({r[0] for r in grid_rows if r[0]}) + [5555]
    names = [" Train", "training", "VAL ", "validation", "test", None, "other", "\tTEST"]
    rows = [(i, rng.choice(ids), rng.choice(names), rng.choice(["a", None]), "clash") for i in range(150)] + [(None, ids[0], "train", "a", "c"), (900, None, "test", "a", "c"), (901, 5555, "test", "a", "c"), (902, 5555, "train", "a", "c")]
    kind = {i: (s or "").strip().lower()[:3] for i, _, s, _, _ in rows}
    counting = {g for g, _ in valid(grid_rows)}
    good = [(i, g) for i, g, s, _, _ in rows if i is not None and g is not None and kind[i] in ("tra", "val", "tes")]
    want = {(t, e) for t, g in good for e, h in good if kind[t] == "tra" and kind[e] != "tra" and ((g == h and g in counting) or (min(g, h), max(g, h)) in similar)}
    samples = spark.createDataFrame(rows, "sample_id long, glyph_id long, split string, source string, fp string")
    found = split_overlap.overlaps(spark, samples, grids_df)
    got = found.collect()
    assert {(r.train_id, r.eval_id) for r in got} == want and len(got) == len(want)
    assert (902, 901) not in want and any(r.kind == "glyph" for r in got) and all((r.kind == "glyph") == (dict(good)[r.train_id] == dict(good)[r.eval_id]) for r in got)
    report = split_overlap.report(spark, samples, grids_df)
    assert report.agg(F.sum("n_pairs")).first()[0] == len(want)
    values = {g: frozenset(c) - {0} for g, c in valid(grid_rows)}
    assert report.agg(F.sum("n_values")).first()[0] == sum(len(values[dict(good)[t]] & values[dict(good)[e]]) for t, e in want)
    spans = split_overlap.span_report(spark, samples, grids_df).collect()
    assert spans and all(r.n_values == len(values[r.glyph_t] & values[r.glyph_e]) and 1 <= r.longest <= r.n_values and r.n_spans <= r.n_values for r in spans)
