"""Queries take every row that they are said to take."""

import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftlake.operators import embedding, quality, scoring, similarity
from siftlake.plans import catalog, monitoring  # noqa: F401
from test_catalog import SF, pytestmark  # noqa: F401


def test_every_twentieth_vector_is_a_query(spark):
    ids = {r[0] for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()}
    got = {r[0] for r in catalog.QUERIES["v6_vector_search_20"](spark, SF).select("query_id").collect()}
    assert got == {i for i in ids if i % 20 == 0}


def brute_cosines(texts):
    """Cosines of sublinear TF-IDF vectors of words and pairs of neighbours."""
    terms = [re.findall(r"\w\w+", t.lower()) for t in texts]
    counts = [Counter(w + [" ".join(p) for p in zip(w, w[1:])]) for w in terms]
    df = Counter(k for c in counts for k in c)
    v = [{k: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[k])) + 1) for k, n in c.items()} for c in counts]
    size = [math.sqrt(sum(x * x for x in a.values())) for a in v]
    return [[sum(x * b.get(k, 0) for k, x in a.items()) / (m * n) for b, n in zip(v, size)] for a, m in zip(v, size)]


CLUSTERS = "cluster_id string, title string, keywords array<string>"


def test_reworded_regressions_are_found(spark):
    new = [("n1", "crashes when signing in", ["login", "signin", "crashes"]), ("n2", "dark mode", ["theme"]), ("n3", "slow menu loading", ["menu"])]
    old = [("o1", "frozen today", ["login", "signin", "crashes"]), ("o2", "dark mode", ["theme"]), ("o3", "slow menu loading times", ["else"])]
    got = {r[0]: r for r in similarity.regression_matches(spark.createDataFrame(new, CLUSTERS), spark.createDataFrame(old, CLUSTERS), semantic=0.3).collect()}
    cos = brute_cosines([" ".join([t, *k]) for _, t, k in new + old])
    assert (got["n1"]["old_id"], got["n1"]["method"]) == ("o1", "semantic") and got["n1"]["confidence"] == pytest.approx(cos[0][3], abs=6e-4)
    assert tuple(got["n2"]) == ("n2", "o2", "keyword+semantic", 1.0)
    assert got["n3"]["old_id"] == "o3" and got["n3"]["confidence"] == pytest.approx(max(0.75, cos[2][5]), abs=6e-4)


def test_cross_platform_pairs_are_alike(spark):
    android = [("1", "android login crash", ["login", "crash"]), ("2", "android battery drain", ["battery"])]
    ios = [("3", "iphone login crash", ["login", "crash"]), ("1", "android login crash", ["login", "crash"])]
    got = {(r[0], r[1]): r[2] for r in similarity.cross_platform(spark.createDataFrame(android, CLUSTERS), spark.createDataFrame(ios, CLUSTERS)).collect()}
    cos = brute_cosines([" ".join([t, *k]) for _, t, k in android + ios])
    assert set(got) == {(a[0], b[0]) for i, a in enumerate(android) for j, b in enumerate(ios) if a[0] != b[0] and cos[i][2 + j] >= 0.6} == {("1", "3")}
    assert got["1", "3"] == pytest.approx(cos[0][2], abs=6e-4)


def test_ensemble_of_two_models_scores_every_review(spark):
    got = {r["review_id"]: r for r in catalog.QUERIES["d8_p22_calibrated"](spark, SF).collect()}
    assert set(got) == {r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert all(0 <= r["score"] <= 1 and 0 <= r["uncertainty"] <= 1 and 0.3 <= r["confidence"] <= 0.99 for r in got.values())
    row = spark.createDataFrame([(0.9, 0.5, True, 0.0, False, True)], "a double, b double, has_concession boolean, sentiment_contrast double, has_monetization_complaint boolean, has_retention_signal boolean")
    assert row.select(*scoring.doubt(*map(row.__getitem__, "ab"))).first()[:] == pytest.approx((0.16 + 0.25, 0.59 * 0.6 + 0.6 * 0.4))


def test_health_and_alerts_come_from_the_tables(spark):
    r = catalog.QUERIES["p12_p13_health"](spark, SF).first().asDict()
    rates = catalog.QUERIES["p26_p28_adversarial"](spark, SF).selectExpr("avg(int(is_fake_positive))", "avg(int(is_spam))").first()
    assert (r["fake"], r["spam"]) == pytest.approx(tuple(rates), abs=1e-6)
    fires = {"gt": lambda v, t: v > t, "lt": lambda v, t: v < t}
    assert r["alerts"] == sorted(rule for rule, m, op, t in quality.RULES if fires[op](r[m], t))


def test_text_vectors_keep_the_cosines_of_tfidf(spark):
    texts = ["login fails on the phone", "login fails today", "dark mode wanted", "dark mode please", "battery drains", "battery drains fast today"]
    df = spark.createDataFrame([(t,) for t in texts * 2], "text string")
    got = {r["text"]: r["vector"] for r in similarity.text_vectors(df).collect()}
    cos = brute_cosines(texts * 2)
    for i, a in enumerate(texts):
        assert [sum(x * y for x, y in zip(got[a], got[b])) for b in texts] == pytest.approx(cos[i][:6], abs=1e-4)
    small = {len(r["vector"]) for r in similarity.text_vectors(df, dims=3).collect()}
    assert small == {3}


@pytest.mark.parametrize("name", ["j13_p11_evolution", "p10_drift_level", "j14_p9_emerging"])
def test_two_periods_hold_every_review(spark, monkeypatch, name):
    ids, snapshot = [], monitoring.monitoring.snapshot
    monkeypatch.setattr(monitoring.monitoring, "snapshot", lambda rows, *a: ids.extend(r[0] for r in rows.select("review_id").collect()) or snapshot(rows, *a))
    catalog.QUERIES[name](spark, SF)
    assert sorted(ids) == sorted(r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())


def test_two_periods_hold_every_event(spark):
    n = catalog.QUERIES["a8_volume_halves"](spark, SF).first()
    assert n["n_old"] + n["n_new"] == spark.read.parquet(f"{SF}/events.parquet").where("ts IS NOT NULL").count()


def test_repeated_texts_of_many_rows_in_time(spark):
    """10,000 long rows against 100 are a million pairs; as pairs of arrays they took minutes."""
    rng = random.Random(5)
    sample = [[f"w{rng.randrange(3000)}" for _ in range(300)] for _ in range(100)]
    rows = [(i, " ".join(w)) for i, w in enumerate(sample)]
    rows += [(100 + i, " \t".join([*sample[i % 100][:-1], "Other"])) for i in range(9_000)]
    rows += [(20_000, None), (20_001, ""), (20_002, rows[0][1]), (20_003, rows[0][1].upper()), (20_003, rows[1][1].upper())]
    df = spark.createDataFrame(rows, "id long, t string")
    start = time.monotonic()
    got = {r["id"]: r["n_similar"] for r in monitoring.monitoring.repeated_texts(df, df.where("id < 100"), "id", "t").collect()}
    assert time.monotonic() - start < 40
    sets, want = [(t, set((t or "").lower().split())) for _, t in rows[:100]], Counter()
    for i, t in rows:
        mine = set((t or "").lower().split())
        want[i] += sum(t is not None and t != o and bool(mine) and len(mine & s) / len(mine | s) >= 0.9 for o, s in sets)
    assert got == dict(want) and got[20_003] == 2 and got[20_002] == 0 and got[100] == 1
    assert monitoring.monitoring.repeated_texts(df, df.limit(0), "id", "t").collect() == []


def test_frequent_terms_are_counted_in_full(spark):
    """A part lists its own most frequent terms only; the counts kept are those of all rows."""
    rng = random.Random(7)
    names = [f"w{i}" for i in range(40)] + [f"long_word_{i % 7}_{i}" for i in range(40)] + ["a", "éa", "Łódź"]
    texts = [" ".join(rng.choice(names) for _ in range(rng.randrange(12))) for _ in range(300)] + ["", "x y", None, "Zz,zz ZZ"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    n, docs = Counter(), Counter()
    for t in texts:
        w = re.findall(r"\w\w+", (t or "").lower().translate(str.maketrans("éó", "eo")))
        terms = w + [" ".join(p) for p in zip(w, w[1:])]
        n.update(terms)
        docs.update(set(terms))
    words = df.where("text IS NOT NULL").select(F.array_join(similarity.words_of(F.col("text")), " ").cast("binary"))
    for most in (50, 10_000):
        want = sorted(n, key=lambda t: (-n[t], t.encode()))[:most]
        assert embedding.frequent_terms(words, most) == [(t.encode(), docs[t]) for t in want]


def test_words_that_share_a_hash_are_told_apart():
    """With the factor 0 a long word's hash is its end."""
    import numpy as np

    words = [b"abcdefgh_end", b"hgfedcba_end", b"_end", b"abcdefgh_end", b"ab"]
    blob = np.frombuffer(b" ".join([*words, b" " * 8]), np.uint8)
    size = np.array([len(w) for w in words])
    number, held = embedding._numbered(blob, np.cumsum(size + 1) - size - 1, size, (0, 0x9E3779B97F4A7C15))
    assert [held[i] for i in number] == words and len(held) == 5
    with pytest.raises(ArithmeticError):
        embedding._numbered(blob, np.cumsum(size + 1) - size - 1, size, (0,))


def test_text_vectors_of_long_texts_in_time(spark):
    """The thousand texts of sf0.01 took 72 s and more."""
    start = time.monotonic()
    rows = catalog.QUERIES["v10_tfidf_vectors"](spark, SF.replace("sf0.001", "sf0.01")).collect()
    assert time.monotonic() - start < 50
    assert sorted(r[0] for r in rows) == sorted(r[0] for r in spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/documents.parquet").where("text IS NOT NULL").select("doc_id").collect())
    assert {len(r[1]) for r in rows} == {384} and all(sum(x * x for x in r[1]) == pytest.approx(1, abs=1e-4) for r in rows)


def test_row_vectors_of_equal_null_and_empty_texts(spark):
    rows = [(1, "login fails on the phone"), (2, None), (3, ""), (4, "login fails on the phone"), (5, "dark mode wanted"), (5, "dark mode wanted")]
    got = similarity.row_vectors(spark.createDataFrame(rows, "id long, text string")).collect()
    assert sorted(r["id"] for r in got) == [1, 3, 4, 5, 5]
    by = {r["id"]: r["vector"] for r in got}
    assert by[1] == by[4] and not any(by[3]) and by[1] != by[5]
    nothing = similarity.row_vectors(spark.createDataFrame([(1, ""), (2, "a b")], "id long, text string")).collect()
    assert [r["vector"] for r in nothing] == [[0.0], [0.0]]
