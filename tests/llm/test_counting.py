import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from typeloom.llm import fixed_sample, grouped_splits, packing, term_counts


def test_sample_is_distinct_whole_and_independent_of_order(spark):
    df = spark.range(5000).selectExpr("id % 3000 AS cell_id", "'x' AS h", "1 AS bucket", "2 AS record")
    got = fixed_sample.fixed_sample(spark, df, "cell_id", 200, 1)
    first = {r.cell_id: r.position for r in got.collect()}
    assert len(first) == 200 and sorted(first.values()) == list(range(1, 201))
    again = {r.cell_id: r.position for r in fixed_sample.fixed_sample(spark, df.orderBy(F.desc("cell_id")).repartition(7), "cell_id", 200, 1).collect()}
    assert again == first
    assert fixed_sample.fixed_sample(spark, df, "cell_id", 9999).count() == 3000
    assert fixed_sample.fixed_sample(spark, df, "cell_id", 0).count() == 0
    assert fixed_sample.fixed_sample(spark, df.limit(0), "cell_id", 5).count() == 0
    nulls = spark.createDataFrame([(None,), (4,), (4,)], "cell_id long")
    assert [tuple(r) for r in fixed_sample.fixed_sample(spark, nulls, "cell_id", 5).collect()] == [(1, 4)]


def test_sample_survives_heavy_doubling(spark):
    df = spark.range(20000).selectExpr("id % 20 AS cell_id")
    assert fixed_sample.fixed_sample(spark, df, "cell_id", 15).count() == 15


def test_sample_is_uniform(spark):
    df, hits = spark.range(40), Counter()
    for seed in range(60):
        hits.update(r.id for r in fixed_sample.merged_sample(df.limit(0), df, "id", 10, seed).collect())
    assert sum((hits[i] - 15) ** 2 / 15 for i in range(40)) < 80  # chi-squared, 39 degrees of freedom


def test_samples_of_pieces_merge(spark):
    df = spark.range(1000)
    whole = {r.id for r in fixed_sample.fixed_sample(spark, df, "id", 50, 3).collect()}
    state = df.limit(0)
    for lo in (600, 0, 300):
        state = fixed_sample.merged_sample(state, df.filter(f"id >= {lo} AND id < {lo + 400}"), "id", 50, 3)
    assert {r.id for r in state.collect()} == whole


def test_term_counts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(term_counts, "RANGE", 7)
    rng = random.Random(5)
    rows = [(i % 900, rng.choice([None, *range(12)]), rng.choice([0, 0, 0, 3, 4, 5, 99, None, -1, 65535, rng.randrange(200)]), "clash", 1) for i in range(1000)] + [(None, 1, 3, "c", 1)]
    df = spark.createDataFrame(rows, "cell_id long, glyph_id long, primitive_id int, term string, n int")
    places = {(o, r, t) for o, r, t, _, _ in rows if o is not None and t not in (None, -1, 65535)}
    occurrences, records = Counter(t for _, _, t in places), {t: {r for _, r, x in places if x == t and r is not None} for _, _, t in places}
    n = len({r for _, r, _ in places if r is not None})
    want = {(t, k, len(records[t]), "rare" if len(records[t]) < 3 else "common" if len(records[t]) > 0.5 * n else None) for t, k in occurrences.items()}
    got = term_counts.primitive_counts(spark, df)
    assert {tuple(r) for r in got.collect()} == want
    assert term_counts.primitive_counts(spark, df.limit(0)).count() == 0
    words = spark.createDataFrame([(1, 1, "b"), (2, 1, "a"), (3, 2, "a")], "o int, r int, w string")
    assert {tuple(r) for r in term_counts.term_counts(spark, words, "o", "r", "w", 1, 0.6).collect()} == {("a", 2, 2, "common"), ("b", 1, 1, None)}


A, B, C = "a" * 40, "b" * 40, "c" * 39 + "1"


def test_hash_spellings(spark):
    spelled = [A.upper(), f" {A}\n", f"sha1:{A}", f"SHA1-{A}", f"font:{A}", f"{A}.ttf", f"{A}.OTF", f"{A}#0", "-".join([A[:8]] * 5)]
    df = spark.createDataFrame([(x,) for x in spelled + ["zz", "", None, A + "a", "abc"]], "h string")
    got = [r[0] for r in df.select(grouped_splits.hex_of(F.col("h"))).collect()]
    assert got == [A] * len(spelled) + [None] * 5


def test_groups_and_splits(spark):
    rows = [(1, 10, None, A), (2, 10, None, B[:16]), (3, 11, None, B), (4, 12, None, None), (5, 12, None, None), (6, None, None, C), (7, None, None, None), (8, 13, None, "dddddddd"), (9, 11, None, None), (9, 11, None, None)]
    records = spark.createDataFrame(rows, "record_id long, glyph_id long, raster_filename string, font_hash string")
    fonts = spark.createDataFrame([(A, 1), (B, 2), ("d" * 39 + "0", 1), ("d" * 39 + "1", 1), (None, 3)], "file_hash string, label int")
    grouped = grouped_splits.groups(spark, records, fonts)
    got = Counter((r.record_id, r.group_id) for r in grouped.collect())
    assert got == Counter([(1, A), (2, A), (3, A), (4, "g:12"), (5, "g:12"), (6, C), (7, "r:7"), (8, "g:13"), (9, A), (9, A)])
    assert grouped_splits.groups(spark, records.limit(0), fonts).count() == 0
    assert grouped_splits.assign(spark, grouped.limit(0)).count() == 0
    assert grouped_splits.assign(spark, grouped).count() == 10


def test_split_proportions_and_labels(spark):
    rng = random.Random(8)
    forms = ["isol", "init", "fina"]
    rows = [(i, f"x_{forms[(g := int(rng.random() ** 2 * 900)) % 3]}_{i}.png", f"g:{g}") for i in range(6000)]
    df = spark.createDataFrame(rows, "record_id long, raster_filename string, group_id string")
    got = grouped_splits.assign(spark, df).join(df.withColumn("label", grouped_splits.label_of(F.col("raster_filename"))).select("record_id", "label"), "record_id")
    assert got.count() == 6000 and got.groupBy("group_id").agg(F.count_distinct("split").alias("k")).filter("k > 1").count() == 0
    per = {(r.label, r.split): r["count"] for r in got.groupBy("label", "split").count().collect()}
    for label in forms:
        label = f"x_{label}"
        n = sum(v for (x, _), v in per.items() if x == label)
        for split, share in zip(grouped_splits.SPLITS, grouped_splits.PROPORTIONS):
            assert abs(per[label, split] / n - share) < 0.03
    with pytest.raises(ValueError):
        grouped_splits.assign(spark, df, (0.5, 0.1, 0.1))


def test_hot_group_stays_whole(spark):
    df = spark.range(3000).selectExpr("id AS record_id", "'a_isol_1.png' AS raster_filename", "IF(id < 1000, 'hot', concat('g:', id)) AS group_id")
    got = {r.split: r["count"] for r in grouped_splits.assign(spark, df).groupBy("split").count().collect()}
    assert abs(got["train"] - 2400) <= 3 and abs(got["val"] - 300) <= 3


def test_ten_thousand_labels(spark):
    df = spark.range(60_000).selectExpr("id AS record_id", "concat('l', id % 10000, '_', id, '.png') AS raster_filename", "concat('g:', id) AS group_id")
    named = df.withColumn("label", grouped_splits.label_of(F.col("raster_filename")))
    assert named.select("label").distinct().count() == 10_000
    out = grouped_splits.assign(spark, df, (0.5, 0.5), splits=("a", "b"))
    per = out.join(named.select("record_id", "label"), "record_id").groupBy("label").agg(F.count_if(F.col("split") == "a").alias("a"), F.count("*").alias("n"))
    assert per.filter("n <> 6 OR a <> 3").count() == 0
    assert grouped_splits.split_checks(grouped_splits.assign(spark, df)).first()[:2] == (60_000, 0)


def check_patterns(counts, capacity):
    patterns, fixed = packing.solve(counts, capacity)
    seen = Counter()
    for content, many in patterns:
        assert many > 0 and sum(s * k for s, k in content.items()) <= capacity
        for s, k in content.items():
            seen[s] += k * many
    assert seen == Counter(counts)
    return sum(m for _, m in patterns)


def test_packing_never_needs_more_than_best_fit_decreasing():
    rng = random.Random(6)
    for _ in range(60):
        capacity = rng.choice([10, 50, 100])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.choice([1, 5, 60, 400])))
        rooms, n = [], 0
        for s in sorted(counts.elements(), reverse=True):
            at = min((i for i, r in enumerate(rooms) if r >= s), key=lambda i: rooms[i], default=None)
            if at is None:
                rooms.append(capacity)
                at, n = len(rooms) - 1, n + 1
            rooms[at] -= s
        assert check_patterns(dict(counts), capacity) <= n


def test_packing_is_optimal_on_small_cases():
    def optimum(items, capacity):
        best = len(items)

        def place(i, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if i == len(items):
                best = len(rooms)
                return
            for j in {r: j for j, r in enumerate(rooms) if r >= items[i]}.values():
                place(i + 1, rooms[:j] + [rooms[j] - items[i]] + rooms[j + 1 :])
            place(i + 1, rooms + [capacity - items[i]])

        place(0, [])
        return best

    rng, over = random.Random(7), 0
    for _ in range(40):
        items = sorted((rng.randint(1, 20) for _ in range(9)), reverse=True)
        fixed, rest = packing.reduce_by_dominance(Counter(items), 20)
        left = sorted(Counter(rest).elements(), reverse=True)
        assert sum(n for _, n in fixed) + (optimum(left, 20) if left else 0) == optimum(items, 20)  # the reduction loses nothing
        over += check_patterns(dict(Counter(items)), 20) - optimum(items, 20)
    assert over <= 2


def test_packed_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 10)
    rows = [(i, n, "c", 1) for i, n in enumerate([5, 5, 5, 95, 100, 101, 250, 0, None, 60, 40] + [7] * 60)] + [(0, 5, "c", 1), (None, 3, "c", 1)]
    items = spark.createDataFrame(rows, "doc_id long, n_tokens long, size string, bucket int")
    got = packing.packed(spark, items, 100).collect()
    fill = Counter()
    for r in got:
        fill[r.container_id] += r.n_tokens
    assert max(fill.values()) <= 100 and sorted(fill) == list(range(len(fill)))
    per = {}
    for r in got:
        per.setdefault(r.doc_id, []).append((r.piece, r.first_token, r.n_tokens))
    assert sorted(per[6]) == [(0, 0, 100), (1, 100, 100), (2, 200, 50)] and sorted(per[5]) == [(0, 0, 100), (1, 100, 1)] and per[4] == [(0, 0, 100)]
    assert 7 not in per and 8 not in per and len(per[0]) == 2 and sum(fill.values()) == sum(n or 0 for _, n, _, _ in rows)
    assert packing.packed(spark, items.limit(0), 100).count() == 0
    assert packing.summary(packing.packed(spark, items.limit(0), 100), 100).first().n_containers == 0


def test_token_counts(spark):
    from tokenizers import Tokenizer

    texts = ["hello world", "", None, "a " * 20_000, "<|endoftext|>", "\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = Tokenizer.from_file(packing.TOKENIZER)
    t.encode_special_tokens = True
    want = {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts) if x}
    assert {r.doc_id: r.n_tokens for r in packing.token_counts(df).collect()} == want and want[4] > 1
