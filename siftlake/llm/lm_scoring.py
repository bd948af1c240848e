"""LM scoring: whole documents under a gated recurrent model and under a unigram base.

Counts cover all training documents, and the recurrent model learns from each of them once. The documents are dealt to
ROUNDS rounds and, in a round, to shards of about SHARD_TOKENS tokens; each shard is trained by truncated
backpropagation from the same start, and the shards' parameters are averaged before the next round. Sums are of whole
numbers, so that they do not depend on the order in which tasks end.
"""

from __future__ import annotations

from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold, lower_words, settle, slices, texts
from .recurrent import Net, Vocabulary

#: At most so many words are broadcast; the others' counts reach their documents by a join.
VOCABULARY = 200_000
#: Words of smaller counts stay out, so that the last class learns how often a new word comes.
MIN_COUNT = 2
SHARD_TOKENS = 1 << 20
ROUNDS = 3
#: Longer documents are cut into pieces of so many tokens for training (never for scoring), so that no shard outgrows the others.
PIECE = 1 << 14
#: Shards are trained in at most so many tasks, whose sums of parameters meet in a tree of so many tasks a level; the last level's go to the driver.
TASKS, TREE = 4096, (64, 8)
#: Parameters are summed in units of 1 / SCALE.
SCALE = 1 << 20
#: The end of a document, as a token; no word has white space.
END = b"\n"
HELD_OUT = 2


def held_out(column: str = "doc_id"):
    return F.coalesce(fold(column, 7) == HELD_OUT, F.lit(False))


def count_words(rows: DataFrame) -> DataFrame:
    """word, c over ``rows`` (doc_id, text): counts of lower-case words and of the documents' ends, merged per task."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for b in slices(batches):
            for text in b.column(1).to_pylist():
                seen.update(lower_words(text))
                seen[END] += 1
                if len(seen) > 1_000_000:
                    yield out()
                    seen.clear()
        yield out()

    return rows.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Model:
    """The totals, the base's log10 P of the vocabulary's words, and the net. ``at`` numbers the words."""

    def __init__(self, counts: list[tuple[bytes, int]], tokens: int, distinct: int):
        counts = sorted(counts, key=lambda x: (-x[1], x[0]))
        self.at = {w: i for i, (w, _) in enumerate(counts)}
        c = np.array([x[1] for x in counts], float)
        self.tokens, self.distinct = tokens, distinct
        self.base = np.append(np.log10((c + 1) / (tokens + distinct + 1)), 0.0)
        self.rare_tokens, self.rare_words = tokens - int(c.sum()), distinct - len(counts)
        self.net = Net(Vocabulary(c + 1, float(self.rare_tokens + self.rare_words + 1), [w for w, _ in counts]))
        self.end = self.at.get(END, len(counts))


def words_kept(counts: DataFrame, most: int = VOCABULARY) -> tuple[list[tuple[bytes, int]], int, int]:
    """The most frequent words (at most ``most``, all above some count) and the end, and the totals of tokens and words."""
    band = F.floor(F.log2("c") * 32).cast("int")
    per = sorted(((r["band"], r["n"], r["c"], r["low"]) for r in counts.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"), F.min("c").alias("low")).collect()), reverse=True)
    low, held = None, 0
    for _, n, _, least in per:
        if held + n > most or least < MIN_COUNT:
            break
        low, held = least, held + n
    rows = counts.where((F.col("c") >= (1 << 62 if low is None else low)) | (F.col("word") == F.lit(END))).toArrow()
    return list(zip(rows["word"].to_pylist(), rows["c"].to_pylist())), sum(r[2] for r in per), sum(r[1] for r in per)


class Numbers(dict):
    """Numbers of words; any other word has the number after the last."""

    def __missing__(self, word: bytes) -> int:
        return len(self)


NUMBERED = "uid long, doc_id long, held_out boolean, n long, ids binary, rest array<binary>, times array<int>"


def number(docs: DataFrame, model: Model) -> DataFrame:
    """Each row's tokens as numbers (the vocabulary's size for words outside it), and the words outside it with their counts."""
    known = docs.sparkSession.sparkContext.broadcast((model.at, model.end))

    def run(batches):
        at, end = known.value
        other = len(at)
        at = Numbers(at)
        for b in slices(batches):
            ids, rest = [], []
            for text in b.column(1).to_pylist():
                w = lower_words(text)
                x = np.empty(len(w) + 1, np.int32)
                x[:-1] = np.fromiter(map(at.__getitem__, w), np.int32, len(w))
                x[-1] = end
                ids.append(x)
                rest.append(Counter([w[i] for i in np.flatnonzero(x[:-1] == other).tolist()]))
            arrays = [b.column(3), b.column(0), b.column(2), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
            arrays += [pa.array([list(r) for r in rest], pa.list_(pa.binary())), pa.array([list(r.values()) for r in rest], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["uid", "doc_id", "held_out", "n", "ids", "rest", "times"])

    rows = texts(docs).withColumn("held_out", held_out()).withColumn("uid", F.monotonically_increasing_id())
    return settle(rows.mapInArrow(run, NUMBERED), "lm-numbers")


def pieces(numbered: DataFrame) -> DataFrame:
    """h, ids of the training documents, cut into pieces; h orders and deals them, alike in every run."""

    def run(batches):
        for b in slices(batches):
            h, out = [], []
            for x, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k in range(0, len(ids), 4 * PIECE):
                    h.append((x + k // 4 // PIECE * 0x9E3779B97F4A7C1) % (1 << 62))
                    out.append(ids[k : k + 4 * PIECE])
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(out, pa.binary())], ["h", "ids"])

    h = F.pmod(F.xxhash64(F.lit(3), "doc_id", "ids"), F.lit(1 << 62))
    return numbered.where("NOT held_out").select(h.alias("h"), "ids").mapInArrow(run, "h long, ids binary")


def train(numbered: DataFrame, model: Model, rounds: int = ROUNDS, shard_tokens: int = 0) -> None:
    """Fit the net on the rows that are not held out: shards train alone, and their parameters are averaged by tokens."""
    spark = numbered.sparkSession
    if not model.tokens:
        return
    shards = max(1, round(model.tokens / rounds / (shard_tokens or SHARD_TOKENS)))
    tasks = min(shards, TASKS)
    vocabulary, end = spark.sparkContext.broadcast(model.net.v), model.end
    dealt = pieces(numbered).selectExpr(f"h % {rounds} AS round", f"cast(h div {rounds} % {shards} AS int) AS shard", "h", "ids")
    for k in range(rounds):
        now = spark.sparkContext.broadcast(model.net.flat)

        def row(name: int, sums, tokens: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([sums.tobytes()], pa.binary()), pa.array([tokens], pa.int64())], ["name", "sums", "tokens"])

        def run(batches, now=now):
            rows = ((s, h, i) for b in slices(batches) for s, h, i in zip(*(c.to_pylist() for c in b.columns)))
            total, weight, name = 0, 0, None
            for shard, group in groupby(rows, key=lambda r: r[0]):
                docs = [np.frombuffer(r[2], np.int32) for r in group]
                net = Net(vocabulary.value, now.value.copy())
                net.train(docs, end)
                n = (sum(map(len, docs)) >> 10) + 1
                total, weight = total + np.rint(net.flat.astype(np.float64) * SCALE).astype(np.int64) * n, weight + n
                name = shard if name is None else name
            if weight:
                yield row(name, total, weight)

        def add(table: pa.Table) -> pa.Table:
            total, weight = 0, 0
            for b in table.to_batches(1):
                total, weight = total + np.frombuffer(b.column(1)[0].as_py(), np.int64), weight + b.column(2)[0].as_py()
            return pa.Table.from_batches([row(table["name"][0].as_py(), total, weight)])

        mine = dealt.where(f"round = {k}").select("shard", "h", "ids").repartitionById(tasks, F.expr(f"shard % {tasks}")).sortWithinPartitions("shard", "h", "ids")
        kind = "name int, sums binary, tokens long"
        sums = mine.mapInArrow(run, kind)
        for width in TREE:
            sums = sums.groupBy(F.expr(f"name % {width}")).applyInArrow(add, kind)
        got = sums.toArrow()
        if got.num_rows:
            total, weight = 0, 0
            for b in got.to_batches(1):
                total, weight = total + np.frombuffer(b.column(1)[0].as_py(), np.int64), weight + b.column(2)[0].as_py()
            model.net = Net(model.net.v, (total / (weight * SCALE)).astype(np.float32))


def fit(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model, from the documents that are not held out; their counts; and the rows of ``docs`` as numbers."""
    counts = settle(count_words(texts(docs).where(~held_out())), "lm-counts")
    model = Model(*words_kept(counts))
    numbered = number(docs, model)
    train(numbered, model)
    return model, counts, numbered


def gathered(batches, rows: int = 4096, size: int = 1 << 25):
    """Batches of about ``rows`` rows, or ``size`` bytes: more documents fill a window's lanes better."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows or sum(x.nbytes for x in held) >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def score(numbered: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row that was numbered.

    Words of the vocabulary are scored where they are read. The others go, once per document and word, to the counts
    and come back as sums per row. Null text is empty: its end is its one token. A null id is not held out. Repeated
    rows are scored alike; other columns of the documents are ignored; an empty table gives an empty result.
    """
    known = numbered.sparkSession.sparkContext.broadcast((model.net, model.end, model.base))

    def run(batches):
        net, end, base = known.value
        for b in gathered(batches):
            ids = [np.frombuffer(x, np.int32) for x in b.column(3).to_pylist()]
            inside = [int((x < len(base) - 1).sum()) for x in ids]
            arrays = [*b.columns[:3], pa.array([len(x) for x in ids], pa.int64()), pa.array(inside, pa.int64()), pa.array([float(base[x].sum()) for x in ids]), pa.array(net.score(ids, end))]
            yield pa.RecordBatch.from_arrays(arrays, ["uid", "doc_id", "held_out", "n_tokens", "inside", "base", "got"])

    rows = settle(numbered.select("uid", "doc_id", "held_out", "ids").mapInArrow(run, "uid long, doc_id long, held_out boolean, n_tokens long, inside long, base double, got double"), "lm-scored")
    rest = numbered.where(F.size("rest") > 0).select("uid", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("uid", F.col("x.rest").alias("word"), F.col("x.times").alias("times"))
    log_of = F.log10(F.coalesce("c", F.lit(0)) + 1.0)
    sums = rest.join(counts, "word", "left").groupBy("uid").agg(F.sum(F.col("times") * log_of).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("met"))
    n_rest = F.col("n_tokens") - F.col("inside")
    logs = F.coalesce("logs", F.lit(0.0))
    base_den, rare_den = (float(np.log10(x)) for x in (model.tokens + model.distinct + 1, model.rare_tokens + model.rare_words + 1))
    return rows.join(sums, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("inside") + F.coalesce("met", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs - n_rest * base_den).alias("base_score"),
        (F.col("got") + logs - n_rest * rare_den).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, counts, numbered = fit(documents(spark, sf_dir))
    return score(numbered, model, counts)
