"""Toxicity: a factorization machine over hashed terms.

Terms are lower-case words and their prefixes of 4 to 6 bytes, hashed into 2^30 buckets. The buckets that occur in at
least MIN_DOCS training rows make up the machine, whether or not they alone go with the label: it learns a weight per
term and, through latent vectors, one per pair of terms, so that an insult next to a group's name can weigh more than the
two apart. Both are penalised, so that most terms end with nothing and are left out of what is broadcast. The training
rows are a bounded sample of the labelled ones (MAX_TRAIN, MAX_BYTES); scoring reads all whole texts.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold, lower_words, settle, slices, texts, utf8

#: At most so many labelled rows train the model: those whose hashed ids are smallest, up to MAX_BYTES of text
#: together, none of them above LONGEST.
MAX_TRAIN = 20_000
MAX_BYTES = 1 << 27
LONGEST = 1 << 21
#: Terms of the machine: those in at least MIN_DOCS training rows, at most MAX_TERMS, the most frequent.
MIN_DOCS = 5
MAX_TERMS = 1 << 18
BUCKETS = 1 << 30
FACTORS = 4
CACHE = 100_000
THRESHOLD = 0.3


def terms(word: bytes) -> list[int]:
    """Buckets of a word and its prefixes."""
    return [zlib.crc32(word) % BUCKETS, *(zlib.crc32(word[:n], 0x5BD1) % BUCKETS for n in (4, 5, 6) if len(word) >= n)]


class Machine:
    """Scores sets of terms: sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>)."""

    def __init__(self, buckets: np.ndarray, factors: int = FACTORS):
        self.at = {int(b): i for i, b in enumerate(buckets)}
        self.w0, self.w = 0.0, np.zeros(len(buckets))
        self.v = np.random.default_rng(7).normal(0, 0.01, (len(buckets), factors))

    def raw(self, ids: np.ndarray, starts: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores of the sets ids[starts[i]:starts[i] + many[i]], and their sums of latent vectors."""
        sums, rest = np.zeros((len(starts), self.v.shape[1])), np.zeros((len(starts), 2))
        some = many > 0
        if len(ids):
            v = self.v[ids]
            sums[some] = np.add.reduceat(v, starts[some], axis=0)
            rest[some] = np.add.reduceat(np.stack([self.w[ids], (v * v).sum(axis=1)], axis=1), starts[some], axis=0)
        return self.w0 + rest[:, 0] + 0.5 * ((sums * sums).sum(axis=1) - rest[:, 1]), sums

    def fit(self, sets: list[np.ndarray], y: np.ndarray, epochs: int = 6, steps: int = 1500, rate: float = 0.1, l1: float = 1e-3, l1_pairs: float = 3e-3, size: int = 64) -> None:
        """Mini-batch AdaGrad on the logistic loss, with proximal steps for the penalties; at least ``steps`` batches.

        A weight's penalty is smaller for a term whose presence alone goes with the label (likelihood ratio); latent
        vectors are penalised alike, so that pairs can be learnt of terms that tell nothing alone.
        """
        rng, n, f = np.random.default_rng(11), len(self.w), self.v.shape[1]
        y = np.asarray(y, float)
        if not len(y) or not n:
            return
        self.w0 = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        present, toxic = np.zeros(n), np.zeros(n)
        for s, label in zip(sets, y):
            present[s] += 1
            toxic[s] += label
        weak = np.clip(2 * np.log(max(2, n)) / np.maximum(_ratio(toxic, present, y.sum(), float(len(y))), 1e-9), 0, 1)
        l1 = l1 * weak * weak
        g0, gw, gv = 1e-6, np.full(n, 1e-8), np.full((n, f), 1e-8)
        batches = -(-len(sets) // size)
        for _ in range(max(epochs, -(-steps // batches))):
            order = rng.permutation(len(sets))
            for k in range(0, len(order), size):
                pick = order[k : k + size]
                many = np.array([len(sets[i]) for i in pick])
                ids = np.concatenate([sets[i] for i in pick]).astype(np.int64)
                score, sums = self.raw(ids, np.cumsum(many) - many, many)
                d = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[pick]) / len(pick)
                of = np.repeat(np.arange(len(pick)), many)
                met = np.flatnonzero(np.bincount(ids, minlength=n))
                dw = np.bincount(ids, d[of], n)[met]
                dv = np.stack([np.bincount(ids, (d * sums[:, j])[of], n)[met] for j in range(f)], axis=1) - self.v[met] * dw[:, None]
                g0 += d.sum() ** 2
                gw[met] += dw * dw
                gv[met] += dv * dv
                self.w0 -= rate * d.sum() / np.sqrt(g0)
                step = rate / np.sqrt(gw[met])
                self.w[met] = _shrink(self.w[met] - step * dw, step * l1[met])
                step = 0.5 * rate / np.sqrt(gv[met])
                self.v[met] = _shrink(self.v[met] - step * dv, step * l1_pairs)

    def smaller(self) -> "Machine":
        """The same scores without the terms that ended with nothing."""
        kept = np.flatnonzero((self.w != 0) | (self.v != 0).any(axis=1))
        buckets = np.fromiter(self.at, np.int64, len(self.at))
        out = Machine(buckets[kept], self.v.shape[1])
        out.w0, out.w, out.v = self.w0, self.w[kept], self.v[kept]
        return out

    def score(self, batch: list[bytes], cache: dict) -> np.ndarray:
        sets, none = [], ()
        for text in batch:
            held: set[int] = set()
            for word in set(lower_words(text)):
                got = cache.get(word)
                if got is None:
                    if len(cache) >= CACHE:
                        cache.clear()
                    got = cache[word] = tuple(self.at[t] for t in terms(word) if t in self.at) or none
                if got:
                    held.update(got)
            sets.append(np.fromiter(held, np.int64, len(held)))
        many = np.array([len(s) for s in sets], np.int64)
        ids = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        raw, _ = self.raw(ids, np.cumsum(many) - many, many)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def _shrink(x: np.ndarray, by: np.ndarray | float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - by, 0)


def _ratio(a: np.ndarray, n: np.ndarray, t: float, total: float) -> np.ndarray:
    """Likelihood ratio G of "term present" against "label 1": a of n documents with the term, t of total without regard."""

    def part(o, e):
        return np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0)

    return 2 * (part(a, n * t / total) + part(n - a, n * (total - t) / total) + part(t - a, (total - n) * t / total) + part(total - n - t + a, (total - n) * (total - t) / total))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Machine:
    """Fit on the documents that ``labels`` (doc_id, label 0/1) names; several labels of one id count as their largest.

    At most ``max_train`` of them are used. Counts per term are summed on the executors; the driver receives at most
    MAX_TERMS terms and, per training row, the ids of those it has (at most 4 bytes for each 1.7 bytes of text).
    """
    spark = docs.sparkSession
    rows = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    n = rows.count()
    order = F.xxhash64(F.lit(1), "doc_id")
    if n > max_train:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < int(1.2 * max_train) + 100).orderBy(order, "doc_id").limit(max_train)
    picked = texts(docs).join(F.broadcast(rows.select("doc_id", F.col("label").cast("int").alias("label"))), "doc_id").where(F.length("text") <= LONGEST)
    sizes = picked.select(order.alias("h"), F.length("text").alias("n")).orderBy("h").limit(2 * max_train).toArrow()
    bytes_ = np.cumsum(sizes["n"].to_numpy())
    if len(bytes_) and bytes_[-1] > MAX_BYTES:
        picked = picked.where(order < int(sizes["h"][int(np.searchsorted(bytes_, MAX_BYTES, side="right"))].as_py()))

    def count(batches):
        seen: Counter = Counter()  # both labels' counts in one number

        def out():
            t = np.fromiter(seen.keys(), np.int64, len(seen))
            n = np.fromiter(seen.values(), np.int64, len(seen))
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(t), pa.array(n & 0xFFFFFFFF), pa.array(n >> 32)], ["t", "n0", "n1"])

        for b in slices(batches):
            for text, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                step = 1 << 32 if y else 1
                for t in {t for w in set(lower_words(text)) for t in terms(w)}:
                    seen[t] += step
                seen[-1] += step
                if len(seen) > 150_000:
                    yield out()
        yield out()

    counts = picked.mapInArrow(count, "t long, n0 long, n1 long").groupBy("t").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = settle(counts.where(f"t < 0 OR n0 + n1 >= {MIN_DOCS}"), "terms")
    total = counts.where("t < 0").first()
    t1, all_ = (float(total["n1"]), float(total["n0"] + total["n1"])) if total else (0.0, 0.0)
    if not 0 < t1 < all_:
        model = Machine(np.zeros(0, np.int64))
        model.w0 = 30.0 if t1 else -30.0
        return model
    top = counts.where("t >= 0").orderBy(F.expr("n0 + n1").desc(), "t").limit(MAX_TERMS).select("t").toArrow()
    model = Machine(np.sort(top["t"].to_numpy()))
    at = spark.sparkContext.broadcast(model.at)

    def sets(batches):
        for b in slices(batches):
            out = [np.array(sorted({at.value[t] for w in set(lower_words(x)) for t in terms(w) if t in at.value}), "<i4").tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), b.column(2)], ["doc_id", "ids", "label"])

    held = picked.mapInArrow(sets, "doc_id long, ids binary, label int").toArrow().sort_by([("doc_id", "ascending"), ("ids", "ascending"), ("label", "ascending")])
    some = [(np.frombuffer(i, "<i4"), y) for b in held.to_batches(4096) for i, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
    model.fit([x[0] for x in some], np.array([x[1] for x in some], float))
    return model.smaller()


def score(docs: DataFrame, model: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row of ``docs``; null or empty texts get the score of no term at all.

    Only doc_id and text are read. Repeated rows get equal scores. An empty table gives an empty result.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        cache: dict = {}
        for b in slices(batches):
            s = known.value.score(b.column(1).to_pylist(), cache)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def clean_rows(docs: DataFrame, model: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score stays under the threshold, with all their columns."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        cache: dict = {}
        for b in slices(batches):
            yield b.filter(pa.array(known.value.score(utf8(b), cache) < threshold))

    return docs.mapInArrow(run, docs.schema)


def train_labels(labels: DataFrame) -> DataFrame:
    """The rows of ``labels`` that may be learnt from, as doc_id and label."""
    return labels.where(fold("doc_id", 4) != 2).select("doc_id", F.col("toxic").alias("label"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, train_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(docs, model).select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
