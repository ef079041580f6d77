import random

import numpy as np
import pyarrow as pa
import pytest

from typeloom.llm import leakage, truncation
from typeloom.llm.words import words

DOCS = "doc_id long, text string, source string, body string, at int"


def test_words():
    assert words("The <b>ﬁrst</b> caf&eacute;, voca­bu-\nlary ６３!") == ["the", "first", "cafe", "vocabulary", "63"]
    assert words(None) == [] == words("") == words(" — ")


def lcs(a, b):
    place, full = {}, (1 << len(a)) - 1
    for i, w in enumerate(a):
        place[w] = place.get(w, 0) | 1 << i
    v = full
    for w in b:
        hit = v & place.get(w, 0)
        v = ((v + hit) | (v - hit)) & full
    return len(a) - v.bit_count()


def found(item, text):
    m = len(item)
    window, slack = 2 * m, max(1, m // 8)
    sure = any(2 * lcs(item, text[s : s + window]) >= m for s in range(max(1, len(text) - window + 1)))
    maybe = any(2 * lcs(item, text[s : s + window + 2 * slack]) >= m for s in range(max(1, len(text) - window + 1)))
    return sure, maybe


@pytest.mark.parametrize("at_once", [100, 16_384])
def test_leaks_equal_brute_force(spark, at_once, monkeypatch):
    monkeypatch.setattr(leakage, "SHARD_WORDS", at_once)
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 200)
    monkeypatch.setattr(leakage, "_ENTRIES", 10_000)
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(120)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: draw(n) for i, n in enumerate([3, 10, 30, 63, 64, 65, 140])}
    docs = {}
    for i in range(42):
        item = list(items[i % len(items)])
        kind = i % 6
        if kind == 0:
            item = item[: len(item) // 2 + 1]
        elif kind == 1:
            item = [w if rng.random() < 0.65 else rng.choice(vocabulary) for w in item]
        elif kind == 2:
            rng.shuffle(item)
        elif kind == 3:
            item = [x for w in item for x in [w, *draw(rng.choice([0, 0, 1, 5]))]]
        elif kind == 4:
            item = draw(len(item))
        docs[i] = draw(rng.choice([0, 3, 90])) + item + draw(rng.choice([0, 3, 90]))
    rows = [(i, ", ".join(w).upper(), None, "clash", 1) for i, w in docs.items()] + [(500, None, "s", "c", 1), (501, "", "s", "c", 1), (None, "w1", "s", "c", 1), (0, ", ".join(docs[0]), "s", "c", 1)]
    df = spark.createDataFrame(rows, DOCS)
    asked = [(i, " ".join(w), None) for i, w in items.items()] + [(90, None, "x"), (91, "", "x"), (92, "...", "x"), (None, "w1 w2", "x"), (0, " ".join(items[0]), None)]
    item_df = spark.createDataFrame(asked, "item_id long, text string, item_set string")
    got = {tuple(r) for r in leakage.leaked(spark, df, item_df).collect()}
    both = {(d, i): found(items[i], docs[d]) for d in docs for i in items}
    assert {k for k, (sure, _) in both.items() if sure} <= got <= {k for k, (_, maybe) in both.items() if maybe}
    assert leakage.leaked(spark, df.limit(0), item_df).count() == 0 == leakage.leaked(spark, df, item_df.limit(0)).count()
    report = {r.item_id: r.n_docs for r in leakage.item_report(item_df, leakage.leaked(spark, df, item_df)).collect()}
    assert report[90] == 0 and report[0] == sum(i == 0 for _, i in got)


def test_a_long_item_widens_nothing_for_the_others():
    rng = random.Random(2)
    codes = [np.array([rng.randrange(5000) for _ in range(n)]) for n in [60] * 200 + [5000]]
    rows = pa.table({"item_id": list(range(201)), "codes": codes, "dfs": codes})
    groups = leakage.groups_of(rows)
    assert max(x.masks.nbytes for g in groups if len(g.ids) > 1 for x in g.items) <= 61 * 8
    assert sum(x.masks.nbytes for g in groups for x in g.items) < 4_000_000
    text = np.concatenate([np.full(70, -1), codes[3][:31], codes[200], np.full(9, -1)])
    found = {(int(d), int(g.ids[k])) for g in groups for docs, k, _, _ in g.search(text, np.array([0, len(text)])) for d in docs}
    assert found == {(0, 3), (0, 200)}


def sentences(rng, n):
    return " ".join("The " + " ".join(rng.choice(["contour", "grid", "stem", "holds", "every", "narrow"]) for _ in range(rng.randint(4, 9))) + "." for _ in range(n))


def test_truncation(spark):
    rng = random.Random(21)
    rows, cut = [], set()

    def add(text, source, is_cut=False):
        if is_cut:
            cut.add(len(rows))
        rows.append((len(rows), text, source, "clash", 1))

    for i in range(120):
        text = sentences(rng, rng.randint(1, 20))
        limited = text[:300]
        add(limited, "limited", len(text) > 300 and not limited.rstrip().endswith("."))
        wide = "ä" * rng.randint(0, 5) + text
        raw = wide.encode()[:200].decode(errors="ignore")
        add(raw, "bytes", len(wide.encode()) > 200 and not raw.rstrip().endswith("."))
        moved = sentences(rng, rng.randint(1, 60)).encode()
        moved = moved[: len(moved) // 256 * 256] if i % 3 and len(moved) > 256 else moved
        add(moved.decode(), "mirror", not moved.rstrip().endswith(b"."))
        add(text + rng.choice(["", "", "\n\n-- the team", "\n\nStatus: open", "\n\n```\nrun --x\n```", "\n| a | 3 |", " To be seen ...", "\n- ask the desk"]), "free")
    for tail in ("The contour hol", "The contour of the ", "The outer ring…", "Each scan line [...]", "Some lower edge ...", "The cont&am", "The c<b", "```\nrun --x"):
        add(sentences(rng, 3) + "\n" + tail, "free", True)
    for whole in ("", "   ", "Done.", "Really?\n\n", '"Done."', "Done.</p>", "x. " * 30_000):
        add(whole, "free")
    add("It ends mid sen", None, True)
    add(None, "free")
    rows.append((None, "It ends mid", "free", "c", 1))
    df = spark.createDataFrame(rows, DOCS)
    out = truncation.truncated(spark, df)
    got = {r.doc_id for r in out.filter("cut").collect()}
    assert got == cut, [(rows[i][2], rows[i][1][-40:]) for i in got ^ cut]
    report = {r.source: r for r in truncation.report(out).collect()}
    assert (report["limited"].unit, report["limited"].limit) == ("chars", 300) and report["bytes"].unit == "bytes" and report["free"].unit is None
    assert report[None].n_cut == 1
    assert report["mirror"].block == 256 and report["mirror"].n_limit == report["mirror"].n_cut > 50 and report["free"].block is None
    assert report["free"].n_transfer == report["free"].n_cut and all(r.n_limit + r.n_transfer == r.n_cut for r in report.values())
    assert truncation.truncated(spark, df.limit(0)).count() == 0
