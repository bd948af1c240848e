import random

import brute
import numpy as np
import pytest

from siftlake.llm import minhash_dedup, shingles


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, sig string, comp long")


def check(spark, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_groups(frame(spark, [(*r, "x", 1) for r in rows])).collect()}
    want = {d: (n, c, d == c) for d, (n, c) in brute.near_groups(rows).items()}
    assert got == want


def test_matches_brute_force_on_edited_copies(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        for _ in range(6):
            copy = list(text)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(500, ""), (501, None), (502, "One two"), (503, "one  TWO"), (504, "a b c d"), (505, "\t\n")]
    check(spark, rows)


def test_chain_of_small_edits_is_one_component(spark):
    words = [f"c{i}" for i in range(200)]
    rows = []
    for k in range(12):
        rows.append((100 - k, " ".join(words)))
        for i in range(4):
            words[(k * 16 + i * 4) % 200] = f"n{k}_{i}"
    check(spark, rows)


def test_many_copies_and_hot_bucket_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base)) for i in range(30)]
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(60)] = f"x{rng.randint(0, 9)}"
        rows.append((100 + i, " ".join(copy)))
    check(spark, rows)


def test_null_ids_repeated_rows_and_empty_table(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (4, "a b c d e")]
    got = sorted(map(str, minhash_dedup.near_groups(frame(spark, [(*r, "x", 1) for r in rows])).collect()))
    assert [("None" in g, "kept=True" in g) for g in got] == [(False, True), (False, True), (False, False), (True, True), (True, True)]
    assert minhash_dedup.near_groups(frame(spark, [])).collect() == []


def test_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for share in (0.0, 0.5, 0.8):
        n = int(round(1000 * 2 * share / (1 + share)))
        got = []
        for _ in range(20):
            x = rng.permutation(pool)
            a, b = x[:1000], np.concatenate([x[:n], x[1000 : 2000 - n]])
            s = [np.frombuffer(minhash_dedup.signature(minhash_dedup.minima(y)), np.uint8) for y in (a, b)]
            got.append(float(minhash_dedup.estimate(s[0], s[1])))
        assert np.mean(got) == pytest.approx(share, abs=0.06)


def test_word_hashes_follow_the_words():
    a, first, end = shingles.word_hashes("  Ab cd e ab\n".encode(), True)
    assert len(a) == 3 and a[0] == a[2] != a[1] and (first[0], end[0]) == (2, 4)
    assert shingles.word_hashes(b"Ab", False)[0][0] != a[0]
    long = b"x" * (1 << 21) + b" ab"
    assert shingles.word_hashes(long, True)[0][1] == a[0]
