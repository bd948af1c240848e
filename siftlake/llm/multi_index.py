"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised separately, so that K centroids each make K * K cells. A query walks pairs of
centroids in the order of their summed distance (the negative inner product of each half with its centroid) with a
heap, until the cells walked hold a share of all entries that was found, on a sample, to hold almost all neighbours.
Entries of those cells are reranked by the exact inner product.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle, slices

#: Codebooks and the share are fitted on at most about so many vectors, those whose hashed ids are smallest.
SAMPLE = 16_384
MOST_CENTROIDS = 256
#: The share of entries to rerank holds this part of the sample's true neighbours.
COVER = 0.97
#: Entries of a block, at most and at least; a task holds one block at a time and streams queries past it, CHUNK at once.
MOST_BLOCK, LEAST_BLOCK, CHUNK = 32_768, 2048, 256


def vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, key (digest of the vector), vec (its doubles' bytes), dim, for rows that have an id and a usable vector."""

    def run(batches):
        for b in slices(batches, 2048):
            out = []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if i is None or not v or None in v:
                    continue
                x = np.array(v, np.float64) + 0.0
                if np.isfinite(x).all() and x.any():
                    raw = x.tobytes()
                    out.append((i, hashlib.blake2b(raw, digest_size=16).digest(), raw, len(v)))
            held = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, (pa.int64(), pa.binary(), pa.binary(), pa.int32()))], ["vec_id", "key", "vec", "dim"])

    return rows.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>")).mapInArrow(run, "vec_id long, key binary, vec binary, dim int")


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    c = x[np.random.default_rng(1).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(axis=1) - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])], axis=1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class Index:
    """Codebooks, counts per cell, and the share of entries that a query walks."""

    def __init__(self, sample: np.ndarray, n: int, top: int, cover: float = COVER):
        self.half = (sample.shape[1] + 1) // 2
        self.k = max(1, min(MOST_CENTROIDS, int((n / 8) ** 0.5), len(sample)))
        self.books = [kmeans(x, self.k) for x in self.halves(sample)]
        self.counts = np.zeros(self.k * self.k, np.int64)
        self.share = self.calibrate(sample, top, cover)

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, : self.half], x[:, self.half :]]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = (np.argmin((c * c).sum(axis=1) - 2 * h @ c.T, axis=1) for h, c in zip(self.halves(x), self.books))
        return a * self.k + b

    def distances(self, q: np.ndarray) -> list[np.ndarray]:
        return [-(h @ c.T) for h, c in zip(self.halves(q), self.books)]

    def calibrate(self, sample: np.ndarray, top: int, cover: float) -> float:
        """The share of entries, in the order of their cells, that holds ``cover`` of the sample's true neighbours.

        Neighbours among all entries are nearer than those among a sample, so the share errs on the safe side.
        """
        picked = np.arange(0, len(sample), max(1, len(sample) // 200))
        q = sample[picked]
        cell = self.cells(sample)
        a, b = self.distances(q)
        seen = []
        for i in range(len(q)):
            order = np.argsort((a[i][:, None] + b[i][None, :]).ravel()[cell], kind="stable")
            place = np.empty(len(order))
            place[order] = np.arange(1, len(order) + 1) / len(order)
            scores = sample @ q[i]
            scores[picked[i]] = -np.inf  # a query is no candidate of its own, wherever it ranks
            near = np.argsort(-scores, kind="stable")[: min(top, len(sample) - 1)]
            seen.append(place[near])
        all_ = np.concatenate(seen) if seen else np.ones(1)
        return float(np.quantile(all_, cover)) if len(all_) else 1.0

    def walk(self, a: np.ndarray, b: np.ndarray, least: int) -> list[int]:
        """Cells by summed distance (a, b: a query's distances to the two books) until they hold ``least`` entries."""
        i, j = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
        x, y = a[i].tolist(), b[j].tolist()
        counts, k = self.counts, self.k
        heap, reached, out, held = [(x[0] + y[0], 0, 0)], [0] * k, [], 0
        while heap and held < least:
            _, r, c = heapq.heappop(heap)
            cell = i[r] * k + j[c]
            n = int(counts[cell])
            if n:
                out.append(cell)
                held += n
            # a pair follows when its left and upper neighbours are out: column c of row r + 1, column c + 1 of row r
            reached[r] = c + 1
            if c + 1 < k and (r == 0 or reached[r - 1] > c + 1):
                heapq.heappush(heap, (x[r] + y[c + 1], r, c + 1))
            if r + 1 < k and reached[r + 1] == c:
                heapq.heappush(heap, (x[r + 1] + y[c], r + 1, c))
        return out


def rerank(entries: np.ndarray, ids: list[list[int]], cell: np.ndarray, query: np.ndarray, walked: list[np.ndarray], top: int):
    """Per query the best (score, id) of the entries in the cells it walked: larger scores, then smaller ids, first."""
    scores = query @ entries.T
    for i, cells in enumerate(walked):
        have = np.flatnonzero(np.isin(cell, cells))
        if not len(have):
            yield []
            continue
        s = scores[i, have]
        if len(have) > 2 * top:
            cut = np.partition(s, len(s) - top)[len(s) - top]
            have = have[s >= cut - 1e-9 * max(1.0, abs(cut))]
        exact = (entries[have] * query[i]).sum(axis=1)
        found = sorted((-float(x), v) for x, h in zip(exact, have.tolist()) for v in ids[h])
        yield [(-s, v) for s, v in found[:top]]


def search(rows: DataFrame, queries, top: int = 20, cover: float = COVER) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``top`` nearest found of each row that ``queries`` (a condition on vec_id) picks.

    ``rows``: vec_id, embedding. Equal vectors are one entry with the ids that can matter, the smallest top + 1, so that
    many copies neither crowd a cell nor multiply pairs; queries with equal vectors are searched once. An entry goes to
    one block, a query to the blocks of the cells it walks; a task holds one block's entries and streams queries past
    them. Rows without an id, and vectors null, zero, or with null or non-finite components, take no part; nor do
    vectors whose length is not the most common one (of lengths that tie, the smallest), which have no inner product
    with the others. Rows that repeat an id and its vector count once; an id with several vectors is a candidate by each
    of them, and a query by each. Other columns are ignored; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    held = settle(vectors(rows).dropDuplicates(["vec_id", "key"]), "vectors")
    dims = held.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if not dims:
        return spark.createDataFrame([], out)
    dim = dims["dim"]
    held = held.where(F.col("dim") == dim)
    nth = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    few = held.withColumn("nth", nth).where(F.col("nth") <= top + 1)
    distinct = settle(few.groupBy("key").agg(F.min("vec").alias("vec"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "entries")
    n = distinct.count()
    near = distinct.where(F.pmod(F.xxhash64("key"), F.lit(max(1, n // SAMPLE))) == 0).orderBy("key").limit(2 * SAMPLE).select("vec").collect()
    sample = np.stack([np.frombuffer(r["vec"]) for r in near]) if near else np.frombuffer(distinct.first()["vec"])[None]
    index = Index(sample, n, top, cover)
    known = spark.sparkContext.broadcast(index)

    def place(batches):
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist())).reshape(b.num_rows, dim)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(known.value.cells(x).astype(np.int32))], ["key", "vec", "ids", "cell"])

    placed = settle(distinct.select("key", "vec", "ids").mapInArrow(place, "key binary, vec binary, ids array<long>, cell int"), "cells")
    for r in placed.groupBy("cell").count().collect():
        index.counts[r["cell"]] = r["count"]
    # cells next to each other share blocks of about ``size`` entries; a larger cell is split
    size = min(MOST_BLOCK, max(LEAST_BLOCK, n // 12))
    parts = np.maximum(1, -(-index.counts // size))
    block_of = np.cumsum(np.where(parts > 1, 0, index.counts)) // size
    first_own = int(block_of[-1]) + 1
    own = np.cumsum(np.where(parts > 1, parts, 0)) - np.where(parts > 1, parts, 0) + first_own
    block_of = np.where(parts > 1, own, block_of)
    walker = spark.sparkContext.broadcast((index, block_of, parts))
    asked = held.where(queries)
    least = max(top + 1, int(np.ceil(index.share * n)))

    def entry_block(batches):
        _, blocks, parts = walker.value
        for b in batches:
            cell = b.column(3).to_numpy()
            spread = np.array([int.from_bytes(k[:4], "little") for k in b.column(0).to_pylist()], np.int64)
            block = blocks[cell] + spread % parts[cell]
            yield pa.RecordBatch.from_arrays([pa.array(block), b.column(0), b.column(1), b.column(2), b.column(3)], ["block", "key", "vec", "ids", "cell"])

    def ask(batches):
        index, blocks, parts = walker.value
        for b in slices(batches, CHUNK):
            rows = []
            q = np.frombuffer(b"".join(b.column(1).to_pylist())).reshape(b.num_rows, dim)
            a, c = index.distances(q)
            for i, (key, vec) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                walked = np.array(index.walk(a[i], c[i], least), np.int32)
                of = blocks[walked]
                for block in np.unique(of).tolist():
                    mine = np.sort(walked[of == block])
                    for part in range(int(parts[mine[0]])):
                        rows.append((block + part, key, vec, mine.tobytes()))
            held = list(zip(*rows)) or [()] * 4
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(held, kinds)], ["block", "key", "vec", "cells"])

    def meet(batches):
        block, held, entries = None, [], None
        for b in slices(batches, CHUNK):
            at, asks = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(at)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                part = b.slice(i, j - i)
                if at[i] != block:
                    block, held, entries = at[i], [], None
                vec = np.frombuffer(b"".join(part.column(3).to_pylist())).reshape(j - i, dim)
                if not asks[i]:
                    held.append((vec, part.column(4).to_pylist(), part.column(5).to_numpy()))
                elif held:
                    entries = entries or (np.concatenate([x[0] for x in held]), [x for y in held for x in y[1]], np.concatenate([x[2] for x in held]))
                    got = rerank(*entries, vec, [np.frombuffer(x, np.int32) for x in part.column(6).to_pylist()], top + 1)
                    found = list(zip(*((k, v, s) for k, best in zip(part.column(2).to_pylist(), got) for s, v in best))) or [()] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, (pa.binary(), pa.int64(), pa.float64()))], ["key", "vec_id", "score"])

    entries = placed.mapInArrow(entry_block, "block long, key binary, vec binary, ids array<long>, cell int")
    entries = entries.select("block", F.lit(False).alias("asks"), "key", "vec", "ids", "cell", F.lit(None).cast("binary").alias("cells"))
    ones = asked.groupBy("key").agg(F.min("vec").alias("vec")).mapInArrow(ask, "block long, key binary, vec binary, cells binary")
    ones = ones.select("block", F.lit(True).alias("asks"), "key", "vec", F.lit(None).cast("array<long>").alias("ids"), F.lit(0).alias("cell"), "cells")
    both = entries.unionAll(ones).repartition("block").sortWithinPartitions("block", "asks")
    found = both.mapInArrow(meet, "key binary, vec_id long, score double")
    order = [F.desc("score"), "vec_id"]
    best = found.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("nth") <= top + 1)
    lists = best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("near"))
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, top)
    result = asked.select("key", F.col("vec_id").alias("query_id")).join(lists, "key").select("query_id", F.posexplode(others).alias("pos", "x"))
    return result.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
