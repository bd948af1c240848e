import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftlake.llm import packing


@pytest.fixture(scope="module")
def enc():
    return packing.encoder(packing.TOKENIZER, packing.RANKS)


@given(st.lists(st.sampled_from([" ", "  ", "\n", "\n\n", "\t", "\xa0", "\u2028", "\x00", "foo", "Bar's", "42", "é", "日本", "…", "<|endoftext|>", "don't", "_"])).map("".join))
@settings(max_examples=300, deadline=None)
def test_ids_equal_the_tokenizers(text):
    e = packing.encoder(packing.TOKENIZER, packing.RANKS)
    assert np.frombuffer(e.encode(text), "<u4").tolist() == e.whole.encode(text, add_special_tokens=False).ids


def test_cache_may_be_emptied(enc, monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 3)
    for text in ("one two three four five six", "seven eight\nnine ten one two"):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.whole.encode(text, add_special_tokens=False).ids


@given(st.lists(st.tuples(st.integers(1, 32), st.integers(1, 40)), max_size=20))
@settings(max_examples=60, deadline=None)
def test_plan_uses_up_the_histogram(lengths):
    hist = np.zeros(33, np.int64)
    for k, n in lengths:
        hist[k] += n
    used = np.zeros(33, np.int64)
    for kinds, n in packing.plan(hist, 32):
        assert n > 0 and sum(kinds) <= 32
        for k in kinds:
            used[k] += n
    assert used.tolist() == hist.tolist()


def test_least_squares_solves_a_mixture():
    parts = packing.combinations(16)
    x = np.zeros(len(parts[0]))
    x[[3, 10, 20]] = [50, 30, 20]
    hist = sum(np.bincount(p, x, 17) for p in parts)
    hist[0] = 0
    got = packing.least_squares(hist, parts, 3000)
    back = sum(np.bincount(p, got, 17) for p in parts)
    assert (got >= 0).all() and np.abs(back[1:] - hist[1:]).max() < 0.5


def test_many_lengths_leave_little_padding():
    rng = np.random.default_rng(1)
    hist = np.bincount(rng.integers(1, 1025, 20_000), minlength=1025)
    plan = packing.plan(hist)
    tokens = sum(sum(k) * n for k, n in plan)
    assert tokens / (1024 * sum(n for _, n in plan)) > 0.995


def check(rows, docs, window):
    seqs, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= window
    e = packing.encoder(packing.TOKENIZER, packing.RANKS)
    for doc, text in docs:
        ids = np.append(np.array(e.whole.encode(text or "", add_special_tokens=False).ids, "<u4"), np.uint32(0)).astype("<u4")
        at = 0
        for start, n, crc, total in sorted(pieces[doc]):
            assert start == at and total == len(ids) and crc == zlib.crc32(ids[start : start + n].tobytes())
            at += n
        assert at == len(ids)


def test_pieces_and_places(spark):
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 50, rng.integers(0, 60)))) for i in range(120)] + [(500, None), (501, ""), (502, "same " * 700)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, length int")
    check(packing.pack_documents(df, 64).collect(), docs, 64)
    assert packing.pack_documents(df.limit(0)).collect() == []


def test_repeated_rows_and_null_ids_are_documents_of_their_own(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "d")], "doc_id long, text string")
    rows = packing.pack_documents(df).collect()
    assert len(rows) == 3 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3
