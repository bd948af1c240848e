import hashlib
import random

import brute
import numpy as np
import pytest

from siftlake.llm import shingles, substring_dedup


def check(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, words string, first int")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove(df, **kw).collect()}
    want = {d: (n, g, hashlib.sha256(k.encode()).hexdigest()) for d, (n, g, k) in brute.repeats(rows, kw.get("span", 50)).items()}
    assert got == want


def corpus(rng, n, passages, words):
    rows = []
    for i in range(n):
        parts = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            parts += p[a : rng.randint(a, len(p))] + [rng.choice(words) for _ in range(rng.randint(0, 30))]
        rows.append((i, " \t".join(parts)))
    return rows


@pytest.mark.parametrize("group", [20_000, 3])
def test_matches_brute_force(spark, group):
    rng = random.Random(8)
    words = [f"v{i}" for i in range(40)] + ["é", "日本", "y" * 100]
    passages = [[rng.choice(words) for _ in range(120)] for _ in range(3)]
    rows = corpus(rng, 60, passages, words)
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "again " * 300), (204, "again " * 120), (205, "a b " * 100)]
    check(spark, rows, group=group)


def test_small_windows(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))) for i in range(40)]
    check(spark, rows, span=8, gram=3)
    check(spark, rows, span=8, gram=3, group=5)


def test_null_ids_repeated_rows_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(3, text), (3, text), (None, text), (None, text)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 99, r["n_removed"]) for r in substring_dedup.remove(df).collect()) == [(3, 0), (3, 0), (99, 60), (99, 60)]
    assert substring_dedup.remove(df.limit(0)).collect() == []


def test_anchors_are_those_of_every_window():
    rng = np.random.default_rng(6)
    g = rng.integers(0, 50, 400).astype(np.uint64)
    size = 50 - 8 + 1
    want = {i + j for i in range(len(g) - size + 1) for j in range(size) if g[i + j] == g[i : i + size].min()}
    assert set(substring_dedup.anchors(g).tolist()) == want
    assert not len(substring_dedup.anchors(g[: size - 1]))


def test_names_are_equal_for_equal_windows():
    rng = np.random.default_rng(7)
    for span in (1, 2, 3, 7, 8, 9, 50):
        w = rng.integers(0, 2, 300 if span < 50 else 51).repeat(1 if span < 50 else 8)
        names = substring_dedup.names_of(w, span)
        windows = [tuple(w[i : i + span]) for i in range(len(w) - span + 1)]
        assert len(names) == len(windows)
        assert len(set(zip(names.tolist(), windows))) == len(set(names.tolist())) == len(set(windows))
    assert not len(substring_dedup.names_of(np.arange(5), 9))


def test_hot_windows_are_looked_up_and_others_joined(spark, monkeypatch):
    rng = random.Random(10)
    shared = " ".join(f"s{i}" for i in range(70))
    rows = [(i, " ".join([*(f"u{i}x{k}" for k in range(rng.randint(0, 9))), shared, f"v{i}"])) for i in range(30)]
    rows += [(50 + i, " \n".join(f"t{i // 2}y{k}" for k in range(55))) for i in range(6)]
    rows += [(60 + i, "\t ".join(f"z{k}" for k in range(51))) for i in range(4)]
    for hot in (1, 20, 1 << 40):
        monkeypatch.setattr(substring_dedup, "HOT_WINDOWS", hot)
        check(spark, rows, group=1)


def test_runs_depend_on_order():
    h = np.array([1, 2, 3, 1, 2], np.uint64)
    r = shingles.runs(h, 2)
    assert r[0] == r[3] != r[1] and len(shingles.runs(h, 6)) == 0
