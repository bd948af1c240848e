import hashlib
import re
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftlake.llm import bloom, exact_dedup, mixing
from siftlake.llm.common import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame([(d, t, "en", s, 1, 7, True) for d, t, s in rows], schema)


@given(st.lists(st.sampled_from([" ", "\t", "\n", "\x0b", "\x0c", "\r", "a", "é", "\xa0", "\x1c"])).map("".join))
@settings(max_examples=200, deadline=None)
def test_normalise(text):
    assert exact_dedup.normalise(text.encode()).decode() == re.sub(r"[\x20\x09-\x0D]+", " ", text)


def test_groups(spark):
    rows = [(5, "a  b", "x"), (2, "a\tb", "x"), (9, "a b", None), (1, " a b", "x"), (3, None, "x"), (4, "", "y"), (7, "z" * 200_000, "y"), (None, "a b", "y"), (8, "solo", "y")]
    got = {r["doc_id"]: tuple(r)[1:] for r in exact_dedup.exact_groups(frame(spark, rows)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {
        2: (2, 4, True, sha("a b")), 5: (2, 4, False, sha("a b")), 9: (2, 4, False, sha("a b")), None: (2, 4, False, sha("a b")), 1: (1, 1, True, sha(" a b")),
        3: (3, 2, True, sha("")), 4: (3, 2, False, sha("")), 7: (7, 1, True, sha("z" * 200_000)), 8: (8, 1, True, sha("solo")),
    }


def test_rows_that_stay(spark):
    rows = [(5, "a  b", "x"), (2, "a\tb", "x"), (2, "a b", "x"), (None, "q", "x"), (None, "q", "x"), (8, "solo", "y")]
    out = exact_dedup.distinct_rows(frame(spark, rows))
    assert out.columns == frame(spark, []).columns
    assert sorted((str(r["doc_id"]), r["text"].split()) for r in out.collect()) == [("2", ["a", "b"]), ("8", ["solo"]), ("None", ["q"])]
    assert exact_dedup.distinct_rows(frame(spark, [])).collect() == [] == exact_dedup.exact_groups(frame(spark, [])).collect()


def test_hot_texts_are_looked_up_and_others_joined(spark, monkeypatch):
    rows = [(i, "common text" if i % 3 else f"text {i // 9}", "x") for i in range(90)]
    want = sorted(map(str, exact_dedup.exact_groups(frame(spark, rows)).collect()))
    for hot in (1, 3, 1 << 30):
        monkeypatch.setattr(exact_dedup, "HOT", hot)
        assert sorted(map(str, exact_dedup.exact_groups(frame(spark, rows)).collect())) == want


def test_filter_of_many_parts(spark):
    h = np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 4000)
    df = spark.createDataFrame([(int(x),) for x in [*h, *h[:300]]], "h long").selectExpr("h", "false AS twice")
    known = bloom.repeated(df, 4300, group=100)
    assert known.maybe(h[:300]).all() and known.maybe(h[300:]).mean() < 0.1


def test_filter_misses_no_repeat(spark):
    rng = np.random.default_rng(2)
    h = rng.integers(-(1 << 62), 1 << 62, 5000)
    keys = np.concatenate([h, h[:700], h[:700]])
    df = spark.createDataFrame([(int(x),) for x in keys], "h long").selectExpr("h", "false AS twice").repartition(3)
    known = bloom.repeated(df, len(keys))
    assert known.maybe(h[:700]).all() and known.maybe(h[700:]).mean() < 0.1
    once = spark.createDataFrame([(5, True), (6, False)], "h long, twice boolean")
    assert bloom.repeated(once, 2).maybe(np.array([5, 6])).tolist() == [True, False]
    assert not bloom.repeated(once.limit(0), 0).maybe(np.array([5])).any()


def test_fill_stops_at_the_caps():
    assert fill_sum([10, 100, 1000], [3, 1, 2], Fraction(1665)) == [20, Fraction(200), 1445]
    assert mixing.fill([0, 0], [3, 1], Fraction(0)) == [0, 0]


def fill_sum(sizes, weights, total):
    out = mixing.fill(sizes, weights, total)
    assert sum(out) == total and all(t <= 2 * s for t, s in zip(out, sizes))
    return out


@given(st.lists(st.integers(0, 2000), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_fill_reshares(sizes):
    w = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    out = mixing.fill(sizes, w, Fraction(3, 2) * sum(sizes))
    assert sum(out) == Fraction(3, 2) * sum(sizes)
    open_ = [t / k for t, k, s in zip(out, w, sizes) if t < 2 * s]
    assert all(t <= 2 * s for t, s in zip(out, sizes)) and len(set(open_)) <= 1


def test_schedule_counts_and_balance(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 64)
    slots = [700, 13, 0, 287]
    rows = mixing.schedule(spark, slots).orderBy("slot").collect()
    no = np.array([r["source_no"] for r in rows])
    assert np.bincount(no, minlength=4).tolist() == slots and len({r["slot"] for r in rows}) == 1000
    for k in (0, 1, 3):
        assert [r["rank"] for r in rows if r["source_no"] == k] == list(range(slots[k]))
        drift = np.abs(np.cumsum(no == k) - np.arange(1, 1001) * slots[k] / 1000)
        assert drift.max() < 4
    assert mixing.schedule(spark, []).collect() == []


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (i % 37), None if i % 5 == 4 else f"s{i % 5}") for i in range(300)] + [(900, None, "s1"), (901, "w " * 3000, "s2"), (901, "w " * 10, "s2"), (None, "w", "s0")]
    got = mixing.mix(frame(spark, rows), block=16).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(frame(spark, rows).repartition(5), block=16).collect()))
    taken, target = {}, {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in taken)
    assert mixing.mix(frame(spark, [])).collect() == []


def test_the_schedule_decides_the_order(spark, monkeypatch):
    rows = [(i, "w " * 40, f"s{i % 3}") for i in range(120)]
    got = mixing.mix(frame(spark, rows), block=16).collect()
    assert all((r["first_slot"] <= r["last_slot"]) if r["taken"] else r["first_slot"] == r["last_slot"] == -1 for r in got)
    order = [r["source"] for r in sorted(got, key=lambda r: r["first_slot"]) if r["taken"]]
    for k in ("s0", "s1", "s2"):
        drift = np.abs(np.cumsum([s == k for s in order]) - np.arange(1, len(order) + 1) * order.count(k) / len(order))
        assert drift.max() < 12
    long = frame(spark, [(i, "w " * 400, f"s{i % 3}") for i in range(120)])
    assert len({r["source"] for r in mixing.mixed_rows(long).collect()[:20]}) == 3
    monkeypatch.setattr(mixing, "fibonacci", lambda n: (n, 1))
    plain = mixing.mix(frame(spark, rows), block=16).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in plain) == sorted((r["doc_id"], r["taken"]) for r in got)
    order = [r["source"] for r in sorted(plain, key=lambda r: r["first_slot"]) if r["taken"]]
    assert len({*order[:20]}) == 1


def test_mixed_texts_have_the_words_taken(spark):
    rows = [(i, " a  b\nc d e" * (i + 1), f"s{i % 2}") for i in range(20)] + [(50, "", "s1")]
    docs = frame(spark, rows)
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect() if r["taken"]}
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    rows_ = {r["doc_id"]: r for r in out.collect()}
    assert {d: len(r["text"].split()) for d, r in rows_.items()} == want and all(r["n_chars"] == len(r["text"]) for r in rows_.values())
    assert mixing.first_words(b" a b  c ", 2) == b" a b" and mixing.first_words(b"a", 5) == b"a" and mixing.first_words(b"a", 0) == b""


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4096])
def test_grid_is_met_once(n):
    grid, g = mixing.fibonacci(n)
    assert n <= grid <= max(1, 2 * n) and sorted(mixing.points(0, grid, grid, g).tolist()) == list(range(grid))
