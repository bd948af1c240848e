import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from siftlake.llm import lm_scoring, multi_index, recurrent, toxicity


def language(rng, n):
    """Documents of two languages; the words of one never meet those of the other."""
    rows = []
    for i in range(n):
        k = rng.choice("ab")
        words = [f"{k}{rng.randint(0, 30)}" for _ in range(rng.randint(1, 40))]
        rows.append((i, " ".join(words) + (f" new{i}" if i % 5 == 0 else "")))
    return rows


def test_scores_counts_and_base(spark):
    rows = language(random.Random(3), 300) + [(1000, None), (1001, ""), (1002, "A1 a1\tB2 " * 2000)]
    df = spark.createDataFrame([(*r, 4, "z") for r in rows], "doc_id long, text string, n_tokens int, held_out string")
    model, counts, numbered = lm_scoring.fit(df)
    got = {r["doc_id"]: r for r in lm_scoring.score(numbered, model, counts).collect()}
    tokens = {d: (t or "").lower().split() + ["\n"] for d, t in rows}
    train = Counter(w for d, t in tokens.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in t)
    n, v = sum(train.values()), len(train)
    for d, t in tokens.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(d).encode()) % 7 == 2, len(t), sum(train[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        assert r["score"] < 0
    held = [r for r in got.values() if r["held_out"] and r["n_tokens"] > 5]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    none = df.limit(0)
    model, counts, numbered = lm_scoring.fit(none)
    assert lm_scoring.score(numbered, model, counts).collect() == []


def test_one_training_document(spark):
    df = spark.createDataFrame([(2, "x y")], "doc_id long, text string")
    model, counts, numbered = lm_scoring.fit(df)
    r = lm_scoring.score(numbered, model, counts).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 3, 3) and r["base_score"] == pytest.approx(3 * math.log10(2 / 7))


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, "a b"), (7, "a b"), (8, None)], "doc_id long, text string")
    model, counts, numbered = lm_scoring.fit(df)
    rows = lm_scoring.score(numbered, model, counts).collect()
    assert len(rows) == 5 and len({(r["score"], r["base_score"]) for r in rows if r["n_tokens"] == 3}) == 1
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)


def test_score_equals_a_plain_forward_pass(spark):
    """Word by word, with one state and plain sums, from the parameters alone."""
    rows = language(random.Random(4), 200) + [(900, "a1 a2 unseen a3 " * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model, counts, numbered = lm_scoring.fit(df)
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(numbered, model, counts).collect()}
    p = {k: x.astype(float) for k, x in model.net.p.items()}
    d, fan, leaf = recurrent.HIDDEN, recurrent.FAN, model.net.v.leaf
    c = {bytes(r["word"]): r["c"] for r in counts.collect()}

    def softmax(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    def log10_p(text):
        h, feed, total = np.zeros(d), leaf[model.end], 0.0
        for w in [*text.lower().encode().split(), lm_scoring.END]:
            x, g = p["E"][feed], h @ p["Wh"]
            gates = (1 + np.tanh(x[: 2 * d] + g[: 2 * d])) / 2
            n = np.tanh(x[2 * d :] + gates[d:] * g[2 * d :])
            h = n + gates[:d] * (h - n)
            i = model.at.get(w, len(model.at))
            k = int(leaf[i])
            a, b = k // fan // fan, k // fan
            prob = softmax(h @ p["W1"] + p["b1"])[a] * softmax(h @ p["W2"][a] + p["b2"][a])[b % fan] * softmax(h @ p["W3"][b] + p["b3"][b])[k % fan]
            total += math.log10(prob) + model.net.v.inside[i]
            if i == len(model.at):
                total += math.log10((c.get(w, 0) + 1) / (model.rare_tokens + model.rare_words + 1))
            feed = k
        return total

    for doc, text in rows[::20] + rows[-1:]:
        assert got[doc] == pytest.approx(log10_p(text), rel=1e-4)


def test_the_net_learns_from_every_document_once(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", 4000)
    monkeypatch.setattr(lm_scoring, "PIECE", 16)
    df = spark.range(12_000).selectExpr("id AS doc_id", "concat('w', id, ' b', if(id = 5, repeat(' c', 1000), '')) AS text")
    model, counts, numbered = lm_scoring.fit(df)
    seen = [i for r in lm_scoring.pieces(numbered).collect() for i in np.frombuffer(r["ids"], np.int32).tolist()]
    assert len(seen) == model.tokens
    train = [i for i in range(12_000) if zlib.crc32(str(i).encode()) % 7 != 2]
    assert seen.count(model.end) == len(train) and max(len(r["ids"]) for r in lm_scoring.pieces(numbered).collect()) <= 64
    assert not np.array_equal(model.net.flat, recurrent.Net(model.net.v).flat)


def test_parameters_do_not_depend_on_tasks(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", 700)
    df = spark.createDataFrame(language(random.Random(5), 300), "doc_id long, text string")
    one = lm_scoring.fit(df.repartition(1))[0].net.flat
    monkeypatch.setattr(lm_scoring, "TASKS", 2)
    assert np.array_equal(one, lm_scoring.fit(df.repartition(5))[0].net.flat)


def small():
    counts = np.arange(200, 0, -1).astype(float)
    v = recurrent.Vocabulary(counts, 30.0)
    return v, recurrent.Net(v)


def test_probabilities_sum_to_one_and_start_as_counts():
    v, net = small()
    states = np.random.default_rng(0).normal(size=(1, recurrent.HIDDEN)).astype(np.float32)
    words = np.arange(v.n + 1, dtype=np.int32)
    for _ in range(2):
        got, _ = net.output(np.repeat(states, len(words), axis=0), words)
        assert np.exp(got + v.inside[words] * np.log(10)).sum() == pytest.approx(1, abs=1e-4)
        net.flat += np.random.default_rng(1).normal(0, 0.1, net.flat.shape).astype(np.float32)
    counts = np.append(np.arange(200, 0, -1), 30.0)
    got, _ = small()[1].output(np.repeat(states * 0, 201, axis=0), words)
    assert np.exp(got + v.inside * np.log(10)) == pytest.approx(counts / counts.sum(), rel=1e-3)


def test_leaves_of_several_words():
    n = 3 * recurrent.LEAVES
    counts = 1e6 / np.arange(1, n + 1)
    words = [b"%06d" % (i * 7919 % n) for i in range(n)]
    v = recurrent.Vocabulary(counts, 50.0, words)
    half = recurrent.LEAVES // 2
    assert v.leaf[:half].tolist() == list(range(half)) and v.leaf[n] == recurrent.LEAVES - 1
    shared = sorted(range(half, n), key=words.__getitem__)
    assert (np.diff(v.leaf[shared]) >= 0).all() and v.leaf[shared].max() < recurrent.LEAVES - 1
    mass = np.bincount(v.leaf[:n], 10 ** v.inside[:n])
    assert mass[mass > 0] == pytest.approx(1)


def test_gradient_matches_differences(monkeypatch):
    monkeypatch.setattr(recurrent, "F32", np.float64)
    v, net = small()
    net.flat = net.flat.astype(np.float64)
    rng = np.random.default_rng(5)
    net.flat += rng.normal(0, 0.1, net.flat.shape)
    net.p = net.views(net.flat)
    ids = rng.integers(0, 201, (6, 3)).astype(np.int32)
    real = np.ones((6, 3), bool)
    start = np.zeros((6, 3), bool)
    start[0], start[3, 1] = True, True
    real[5, 2] = False
    feed = recurrent.feed_of(ids, start, 0)

    def loss():
        states, _, _ = net.run(v.leaf[feed], start, np.zeros((recurrent.HIDDEN, 3)))
        return -net.output(states.transpose(0, 2, 1)[real], ids[real])[0].sum()

    g = np.zeros_like(net.flat)
    n, _, rows, sums = net.gradient(net.views(g), ids, feed, real, start, np.zeros((recurrent.HIDDEN, 3)))
    net.views(g)["E"][rows] = sums
    assert n == 17
    for i in np.argsort(-np.abs(g))[::17][:120]:
        old = net.flat[i]
        net.flat[i] = old + 1e-4
        up = loss()
        net.flat[i] = old - 1e-4
        down = loss()
        net.flat[i] = old
        assert (up - down) / 2e-4 == pytest.approx(g[i], rel=1e-3, abs=1e-4)


def test_the_training_stream_holds_every_word_once():
    docs = [np.full(n, i, np.int32) for i, n in enumerate((3, 5000, 1, 700, 0, 9000))]
    ids, real, start = recurrent.stream(docs)
    assert np.bincount(ids[real]).tolist() == [len(x) for x in docs[:4]] + [0, 9000]
    assert ids.T.ravel()[: real.sum()].tolist() == np.concatenate(docs).tolist()
    assert start[0].all() and recurrent.stream([])[0].size == 0


def test_windows_and_lanes_do_not_matter():
    v, net = small()
    rng = np.random.default_rng(7)
    net.flat += rng.normal(0, 0.2, net.flat.shape).astype(np.float32)
    docs = [rng.integers(0, 201, n).astype(np.int32) for n in (1, 300, 5, 64, 65, 130)]
    whole = net.score(docs, 0)
    alone = np.array([net.score([x], 0)[0] for x in docs])
    assert whole == pytest.approx(alone, rel=1e-4)
    assert len(net.score([], 0)) == 0


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 900)] + rng.normal(0, 0.4, (900, 16))).astype(np.float32).astype(float)
    x[100:130] = x[99]
    rows = [(i, x[i].tolist(), "c") for i in range(900)]
    odd = [(None, [1.0] * 16), (2000, None), (2001, [0.0] * 16), (2002, [math.nan] * 16), (2003, [math.inf] + [0.0] * 15), (2004, [1.0] * 3), (2020, []), (2040, [None] + [1.0] * 15)]
    df = spark.createDataFrame(rows + [(*r, "c") for r in odd] + rows[:5], "vec_id long, embedding array<double>, key string")
    got = {}
    for r in multi_index.search(df, "vec_id % 20 = 0").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 900, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        s = [(-float((x[i] * x[q]).sum()), i) for i in range(900) if i != q]
        want = {i for _, i in sorted(s)[:20]}
        assert [f[0] for f in found] == list(range(1, 21)) and all(f[2] == pytest.approx(float(x[q] @ x[f[1]]), rel=1e-12) for f in found)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        hits += len(want & {f[1] for f in found})
    assert hits / 20 / len(got) >= 0.9
    few = spark.createDataFrame(rows[:4], df.schema)
    assert sorted(r["vec_id"] for r in multi_index.search(few, "vec_id % 20 = 0").collect()) == [1, 2, 3]
    assert multi_index.search(df.limit(0), "vec_id % 20 = 0").collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="test tables")
def test_recall_on_the_registered_table(spark):
    path = "/root/testdata/sf0.1"
    got = {}
    for r in multi_index.query(spark, path).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect() if r["embedding"] and None not in r["embedding"]]
    rows = [x for x in rows if x[0] is not None and np.isfinite(x[1]).all() and x[1].any()]
    ids, vectors = np.array([x[0] for x in rows]), np.stack([x[1] for x in rows])
    at = {int(i): k for k, i in enumerate(ids)}
    found = []
    for i in (int(i) for i in ids if i % 20 == 0):
        score = (vectors * vectors[at[i]]).sum(axis=1)
        best = [k for k in np.lexsort((ids, -score)) if ids[k] != i][:20]
        mine = sorted(got[i])
        assert [x[0] for x in mine] == list(range(1, 21)) and all(x[2] == pytest.approx(score[at[x[1]]], rel=1e-12) for x in mine)
        found.append(len({x[1] for x in mine} & {int(ids[k]) for k in best}) / 20)
    assert len(found) == sum(ids % 20 == 0) and np.mean(found) >= 0.9


def test_walk_follows_the_summed_distances():
    rng = np.random.default_rng(3)
    index = multi_index.Index(rng.normal(size=(500, 8)), 500, 5)
    index.counts = rng.integers(0, 4, index.k**2)
    a, b = rng.normal(size=index.k), rng.normal(size=index.k)
    got = index.walk(a, b, int(index.counts.sum()))
    total = (a[:, None] + b[None, :]).ravel()
    assert got == [c for c in np.argsort(total, kind="stable").tolist() if index.counts[c]][: len(got)]
    assert sum(index.counts[c] for c in got) == index.counts.sum()


def toxic_rows(rng, n):
    rows, labels = [], []
    for i in range(n):
        w = [f"w{rng.randint(0, 200)}" for _ in range(rng.randint(5, 60))]
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        w += ["dolt"] * insult + ["martians"] * group
        rng.shuffle(w)
        rows.append((i, " ".join(w).capitalize()))
        labels.append((i, int(insult and group)))
    return rows, labels


def test_pairs_of_terms_are_learnt(spark):
    rows, labels = toxic_rows(random.Random(4), 1500)
    rows += [(5000, None), (5001, ""), (5002, "dolt " * 3000), (5003, "martians dolt " * 2000), (None, "x")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    lab = spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, label int")
    model = toxicity.train(docs, lab.where("doc_id % 3 != 0 OR doc_id IS NULL"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    held = [(got[d]["predicted"], y) for d, y in labels if d % 3 == 0]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert got[5000]["predicted"] == got[5001]["predicted"] == got[5002]["predicted"] == 0 and got[5003]["predicted"] == 1
    kept = toxicity.clean_rows(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if not r["predicted"]}
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_training_without_either_label(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for label, want in ((0, 0), (1, 1)):
        model = toxicity.train(docs, spark.createDataFrame([(1, label)], "doc_id long, label int"))
        assert toxicity.score(docs, model).first()["predicted"] == want
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, label int"))
    assert toxicity.score(docs, none).first()["predicted"] == 0


def test_pairs_are_learnt_of_terms_that_tell_nothing_alone(spark):
    """Label 1 if just one of two words is there: neither word goes with the label by itself."""
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join([*(f"w{rng.randint(0, 200)}" for _ in range(20)), *["insult"] * a, *["group"] * b])))
        labels.append((i, int(a != b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels[:2000], "doc_id long, label int"))
    got = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.score(docs, model).collect()}
    assert np.mean([got[i] == y for i, y in labels[2000:]]) > 0.95


def test_the_machine_equals_the_plain_sum_over_pairs():
    rng = np.random.default_rng(3)
    words = [f"word{i}".encode() for i in range(12)]
    m = toxicity.Machine(np.array(sorted({t for w in words for t in toxicity.terms(w)})), 3)
    m.w0, m.w, m.v = 0.3, rng.normal(size=len(m.w)), rng.normal(size=m.v.shape)
    m.w[::3], m.v[::3] = 0, 0
    texts = [b" ".join(words[:k]) for k in range(13)] + [b"none of these", b"WORD3 word3"]
    for machine in (m, m.smaller()):
        got = machine.score(texts, {})
        for text, score in zip(texts, got):
            ids = sorted({m.at[t] for w in text.lower().split() for t in toxicity.terms(w) if t in m.at})
            raw = m.w0 + sum(m.w[i] for i in ids) + sum(float(m.v[i] @ m.v[j]) for k, i in enumerate(ids) for j in ids[:k])
            assert score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, raw)))), rel=1e-9)
    assert len(m.smaller().w) < len(m.w)


def test_the_sample_stays_under_its_bounds(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ("bad " if i % 2 else "good ") * 10) for i in range(400)] + [(999, "bad " * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(999, 1)], "doc_id long, label int")
    seen = []
    monkeypatch.setattr(toxicity.Machine, "fit", lambda self, sets, y: seen.append(len(y)))
    for most, longest, n in ((1 << 27, 1 << 21, 401), (1 << 27, 1000, 400), (4500, 1000, 100)):
        monkeypatch.setattr(toxicity, "MAX_BYTES", most)
        monkeypatch.setattr(toxicity, "LONGEST", longest)
        toxicity.train(docs, labels)
        assert 0.9 * n <= seen[-1] <= 1.12 * n
