"""Offline text vectors: TF-IDF of words and word pairs, reduced by a truncated SVD.

Texts are read three times, and no row is shuffled. First each task adds up its terms' counts by a hash into BUCKETS sums, and
lists its own most frequent terms; these give a count that the last term kept reaches at least, and no term of a smaller
bucket can. Then the terms of the other buckets are counted in full, and the most frequent ones are kept. Last, each text
becomes numbers of terms and weights, which the SVD's rounds read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StructField, StructType

BUCKETS = 1 << 20
#: Texts are worked on by so many bytes or texts at a time (one of LONG bytes alone), so that two words and a text make a number of 63 bits.
BYTES, TEXTS, LONG = 12 << 20, 1 << 16, 1 << 22
#: Rows of a block of the SVD, and the share of the rows from which a term's column is a dense one.
BLOCK, DENSE = 8192, 0.1
#: Partial sums that the driver adds up at a time; more of them meet in so many tasks before.
SUMS = 8
_PLAIN = bytes(c if c < 128 and (chr(c).isalnum() or c == 95) else 32 for c in bytes(range(256)).lower())
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _numbered(blob: np.ndarray, start: np.ndarray, size: np.ndarray, factors=(0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)) -> tuple[np.ndarray, list[bytes]]:
    """A number from 1 on for each distinct word of ``blob`` (eight bytes longer than its words), and the words by number.

    Words are sorted by a number of 64 bits, which are the word itself up to eight bytes and a hash beyond, and compared
    in full with the first of their number; if two words share one, another factor is taken.
    """
    eight = np.ndarray((len(blob) - 7,), np.dtype("<u8"), blob, strides=(1,))

    eighth = lambda of, at: eight[start[of] + at] & _MASK[np.minimum(size[of] - at, 8)]
    short, long = eight[start] & _MASK[np.minimum(size, 8)], np.flatnonzero(size > 8)

    def beyond():
        left, at = long, 8
        while len(left):
            yield left, at, eighth(left, at)
            left, at = left[size[left] > at + 8], at + 8

    for factor in factors:
        code = short.copy()
        for mine, at, x in beyond():
            code[mine] = (code[mine] ^ code[mine] >> np.uint64(29)) * np.uint64(factor) + x
        order = np.argsort(code)
        code = code[order]
        first = np.append(True, code[1:] != code[:-1])[: len(code)]
        number = np.empty(len(start), np.int64)
        number[order] = np.cumsum(first)
        of = order[first]
        like = of[number - 1]
        if (size == size[like]).all() and (short[long] == short[like[long]]).all() and all((x == eighth(like[mine], at)).all() for mine, at, x in beyond()):
            break
    else:
        raise ArithmeticError("words that share their numbers under every factor")
    data = blob.tobytes()
    return number, [b"", *(data[i : i + n] for i, n in zip(start[of].tolist(), size[of].tolist()))]


def _parts(batches):
    """Batches and their terms, by about BYTES bytes: other columns, words, bits of a word and of a text, sorted keys.

    A key is first word, second word (0: none) and text. ``batches`` hold the text last: ASCII as it is, any other as its
    words with spaces between.
    """
    held, texts, total = [], [], 0

    def out():
        ends = np.cumsum([len(t) + 1 for t in texts])
        blob = np.frombuffer(b" ".join([b"", *texts, b" " * 8]), np.uint8)
        inside = blob != 32
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        start, size = edges[::2], edges[1::2] - edges[::2]
        start, size = start[size > 1], size[size > 1]
        x, words = _numbered(blob, start, size)
        doc = np.searchsorted(ends, start)
        bits, of = len(words).bit_length(), len(texts).bit_length()
        pair = doc[1:] == doc[:-1]
        keys = np.concatenate([x << (bits + of) | doc, ((x[:-1] << bits | x[1:]) << of | doc[:-1])[pair]])
        keys.sort()
        return pa.Table.from_batches(held), words, bits, of, keys

    for b in batches:
        start = 0
        for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
            if texts and (total >= BYTES or len(texts) >= TEXTS or len(t) > LONG):
                held.append(b.slice(start, i - start))
                yield out()
                held, texts, total, start = [], [], 0, i
            texts.append(t.translate(_PLAIN) if t.isascii() else t)
            total = BYTES if len(t) > LONG else total + len(t)
        held.append(b.slice(start))
    if texts:
        yield out()


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers of a sorted array and how often each is there."""
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(np.append(first, len(x)))


def _buckets(terms: np.ndarray, words: list[bytes], bits: int) -> np.ndarray:
    h = np.array([zlib.crc32(w) for w in words], np.uint64)
    x = h[terms >> bits] * np.uint64(0x9E3779B97F4A7C15) + h[terms & ((1 << bits) - 1)] * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)).astype(np.int64) % BUCKETS


def _named(terms: np.ndarray, words: list[bytes], bits: int) -> pa.Array:
    low = (1 << bits) - 1
    return pa.array([words[t >> bits] + (b" " + words[t & low] if t & low else b"") for t in terms.tolist()], pa.binary())


def _tasks(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, each of which makes one partial sum."""
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism)


def _sum(arrays: DataFrame, of: type) -> np.ndarray:
    """The sum of the arrays in the rows of ``arrays`` (x), one or more per task of ``_tasks``."""

    def add(batches):
        total = 0
        for b in batches:
            for x in b.column(0):
                total = total + np.frombuffer(x.as_buffer(), of).astype(np.float64)
        return total

    def meet(batches):
        total = add(batches)
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(of).tobytes()], pa.binary())], ["x"])

    if arrays.sparkSession.sparkContext.defaultParallelism > SUMS:
        arrays = arrays.repartition(SUMS).mapInArrow(meet, "x binary")
    return add(arrays.toArrow().to_batches())


def frequent_terms(words: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The ``most`` terms of the largest counts (ties to the smaller term) and in how many rows each is; words has the text last."""

    def count(batches):
        """The most frequent terms of each part, and the task's sums of buckets."""
        total = np.zeros(BUCKETS)
        for _, held, bits, of, keys in _parts(batches):
            terms, n = _runs(keys >> of)
            total += np.bincount(_buckets(terms, held, bits), n, BUCKETS)
            if len(terms) > 2 * most:
                kept = np.argpartition(n, -2 * most)[-2 * most :]
                terms, n = terms[kept], n[kept]
            yield pa.RecordBatch.from_arrays([_named(terms, held, bits), pa.array(n), pa.nulls(len(n), pa.binary())], ["term", "n", "x"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([total.tobytes()], pa.binary())], ["term", "n", "x"])

    def full(batches):
        for _, held, bits, of, keys in _parts(batches):
            pairs, n = _runs(keys)
            at = pairs >> of
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
            terms, df = _runs(at)
            mine = open_.value[_buckets(terms, held, bits)]
            n = np.add.reduceat(n, first) if len(first) else n
            yield pa.RecordBatch.from_arrays([_named(terms[mine], held, bits), pa.array(n[mine]), pa.array(df[mine])], ["term", "n", "df"])

    words = words.select(words.columns[-1])
    rows = _tasks(words)
    counted = rows.mapInArrow(count, "term binary, n long, x binary").persist(StorageLevel.DISK_ONLY)
    total = _sum(counted.where("x IS NOT NULL").select("x"), np.float64)
    known = counted.where("x IS NULL").groupBy("term").agg(F.sum("n").alias("n")).orderBy(F.desc("n")).limit(most).agg(F.min("n"), F.count("n")).first()
    counted.unpersist()
    least = known[0] if known[1] == most else 1
    open_ = words.sparkSession.sparkContext.broadcast(total >= least)
    top = rows.mapInArrow(full, "term binary, n long, df long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).orderBy(F.desc("n"), "term").limit(most)
    return [(r["term"], r["df"]) for r in top.select("term", "df").collect()]


def weighted(words: DataFrame, terms: list[tuple[bytes, int]], total: int) -> DataFrame:
    """The columns of ``words`` but its last (the text), the numbers of the row's ``terms`` (16 bits each) and their weights (float32)."""
    sent = words.sparkSession.sparkContext.broadcast(([t.split(b" ") for t, _ in terms], np.log((1.0 + total) / (1.0 + np.array([df for _, df in terms], float))) + 1.0))
    kind = StructType([*words.schema[:-1], *(StructField(name, BinaryType()) for name in ("ids", "weights"))])
    names = kind.names

    def run(batches):
        known, idf = sent.value
        for rows, held, bits, of, keys in _parts(batches):
            at = {w: i for i, w in enumerate(held)}
            here = [(i, at[t[0]] << bits | (at[t[1]] if len(t) > 1 else 0)) for i, t in enumerate(known) if all(w in at for w in t)]
            number, code = (np.array([x[k] for x in here], np.int64) for k in (0, 1))
            low, high = np.searchsorted(keys, code << of), np.searchsorted(keys, (code + 1) << of)
            n = high - low
            doc = keys[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())] & ((1 << of) - 1)
            cell, tf = _runs(np.sort(doc << 16 | np.repeat(number, n)))
            doc, ids = cell >> 16, cell & 0xFFFF
            w = (1.0 + np.log(tf)) * idf[ids]
            w /= np.sqrt(np.bincount(doc, w * w, rows.num_rows))[doc]
            ends = np.append(0, np.cumsum(np.bincount(doc, minlength=rows.num_rows)))
            more = [pa.Array.from_buffers(pa.binary(), rows.num_rows, [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in (ids.astype(np.uint16), w.astype(np.float32))]
            out = pa.Table.from_arrays([*(rows.column(i) for i in range(rows.num_columns - 1)), *more], names)
            yield from out.to_batches(1024)

    return words.mapInArrow(run, kind)


class _Block:
    """Rows of terms as a dense matrix of the terms below ``hot`` and, sorted both ways, the cells of the others."""

    def __init__(self, rows: list[bytes], weights: list[bytes], hot: int):
        self.n, self.hot = len(rows), hot
        lens = np.array([len(x) // 2 for x in rows])
        ids, w = np.frombuffer(b"".join(rows), np.uint16), np.frombuffer(b"".join(weights), np.float32)
        row = np.repeat(np.arange(self.n, dtype=np.int32), lens)
        dense = ids < hot
        self.x = np.zeros((self.n, hot), np.float32)
        self.x[row[dense], ids[dense]] = w[dense]
        self.row, self.ids, self.w = row[~dense], ids[~dense], w[~dense]

    def _times(self, of: np.ndarray, by: np.ndarray, w: np.ndarray, y: np.ndarray, out: np.ndarray) -> None:
        """Add to out[k] the rows y[by] of each run of k in ``of``, by weight."""
        held, n = _runs(of)
        ends = np.cumsum(n)
        space = np.empty((int(n.max(initial=0)), y.shape[1]), y.dtype)
        for k, i, j in zip(held.tolist(), (ends - n).tolist(), ends.tolist()):
            part = space[: j - i]
            np.take(y, by[i:j], axis=0, out=part, mode="clip")
            out[k] += w[i:j] @ part

    def times(self, q: np.ndarray) -> np.ndarray:
        """rows @ q"""
        y = self.x.astype(q.dtype, copy=False) @ q[: self.hot]
        self._times(self.row, self.ids, self.w.astype(q.dtype, copy=False), q, y)
        return y

    def back(self, y: np.ndarray, out: np.ndarray) -> None:
        """Add rows.T @ y to ``out``."""
        out[: self.hot] += self.x.T @ y
        order = np.argsort(self.ids, kind="stable")
        self._times(self.ids[order], self.row[order], self.w[order], y, out)


def _blocks(batches, hot: int):
    """Blocks of up to BLOCK rows, each with its other columns."""
    held: list[pa.RecordBatch] = []

    def out():
        t = pa.Table.from_batches(held)
        return t.select(t.column_names[:-2]), _Block(*(t.column(i).to_pylist() for i in (-2, -1)), hot)

    for b in batches:
        for i in range(0, b.num_rows, 1024):
            held.append(b.slice(i, 1024))
            if sum(x.num_rows for x in held) > BLOCK - 1024:
                yield out()
                held = []
    if held:
        yield out()


def vectors(df: DataFrame, words: Column, dims: int, most: int, rounds: int = 5, extra: int = 10, digits: int | None = None, once: bool = False) -> DataFrame:
    """``df`` and vector: TF-IDF of the rows' texts, reduced by a truncated SVD to at most ``dims``, at length 1.

    ``words``: the row's text, if it is ASCII, else its words with spaces between; rows where it is null have no part. ``once``: rows
    that are equal give one row. The SVD is a randomized one: each round multiplies by the rows' products in one pass. The
    driver holds the terms (at most ``most``) and matrices of terms x dims. Texts without a term have a vector of zeros.
    """
    spark = df.sparkSession
    texts = df.withColumn("_words", words.cast("binary")).where("_words IS NOT NULL").persist(StorageLevel.DISK_ONLY)
    terms = sorted(frequent_terms(texts, most), key=lambda t: (-t[1], t[0]))
    total = texts.count()
    n, k = len(terms), max(1, min(dims, len(terms) - 1, total - 1))
    kind = StructType([*df.schema, StructField("vector", ArrayType(DoubleType()))])
    if not n:
        out = texts.drop("_words").withColumn("vector", F.array(F.lit(0.0)))
        return out.distinct() if once else out
    hot = sum(t[1] >= DENSE * total for t in terms)
    rows = weighted(texts, terms, total).persist(StorageLevel.DISK_ONLY)

    def summed(q: np.ndarray, inner: bool) -> np.ndarray:
        now = spark.sparkContext.broadcast(q.astype(np.float32))

        def part(batches):
            total = None
            for _, x in _blocks(batches, hot):
                if total is None:
                    total = np.zeros((q_cols, q_cols) if inner else (n, q_cols))
                y = x.times(now.value)
                if inner:
                    total += y.T @ y
                else:
                    x.back(y, total)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["x"])

        q_cols = q.shape[1]
        return _sum(_tasks(rows.select("ids", "weights")).mapInArrow(part, "x binary"), np.float32).reshape(-1, q_cols)

    q = np.linalg.qr(np.random.default_rng(42).normal(size=(n, min(n, k + extra))))[0]
    for _ in range(rounds):
        q = np.linalg.qr(summed(q, False))[0]
        texts.unpersist()
    v = q @ np.linalg.eigh(summed(q, True))[1][:, ::-1][:, :k]
    v *= np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1, 1)
    final = spark.sparkContext.broadcast(v)

    def reduced(batches):
        for other, x in _blocks(batches, hot):
            # in double precision, so that equal texts have equal vectors wherever they are in a block
            y = x.times(final.value)
            size = np.linalg.norm(y, axis=1, keepdims=True)
            y /= np.where(size > 0, size, 1)
            if digits is not None:
                y = np.rint(y * 10.0**digits) / 10.0**digits
            ends = np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]
            out = pa.Table.from_arrays([*other.columns, pa.ListArray.from_arrays(ends, y.ravel())], kind.names)
            yield from out.to_batches(1024)

    return (rows.dropDuplicates(df.columns) if once else rows).mapInArrow(reduced, kind)
