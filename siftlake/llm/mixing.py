"""Mixing sources to target weights: a low-discrepancy schedule of equal-token blocks.

N slots take golden-ratio points on a grid: with F the smallest Fibonacci number from N on and G the one before it, time
t = 0, 1, ... stands at grid point t * G mod F, and points from N on are left out. Each of the N others is met once, so
that cumulative weights give each source exactly its number of slots, and any run of slots holds the sources nearly in
proportion. A slot's rank within its source names a
block of that source's shuffled token stream; ranks beyond the last block start over. A document is met in the slots
from first_slot to last_slot; the mix is read in the order of slots.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, WORD, documents, settle, slices, spare, utf8

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
MOST = 2
BLOCK = 1024
CHUNK = 16384
BUCKET_ROWS = 4096


def fill(sizes: list[int], weights: list[int], total: Fraction, most: int = MOST) -> list[Fraction]:
    """Share ``total`` by weight; no share exceeds ``most`` times its size, the excess is reshared until none does."""
    share, left, open_ = [Fraction(0)] * len(sizes), Fraction(total), set(range(len(sizes)))
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if level * weights[i] > most * sizes[i]]
        for i in full or open_:
            share[i] = Fraction(most * sizes[i]) if full else level * weights[i]
        if not full:
            break
        left -= sum(share[i] for i in full)
        open_ -= set(full)
    return share


def fibonacci(n: int) -> tuple[int, int]:
    """The smallest Fibonacci number from ``n`` on, and the one before it."""
    a, b = 1, 1
    while b < n:
        a, b = b, a + b
    return b, a


def points(start: int, count: int, n: int, g: int) -> np.ndarray:
    """Grid points (of n) at the times start .. start + count - 1."""
    return ((start * g) % n + (np.arange(count, dtype=np.int64) * g) % n) % n


def schedule(spark: SparkSession, slots: list[int]) -> DataFrame:
    """slot, source_no, rank: a row per slot, in the order of slot; source i gets slots[i] of them, ranked from 0.

    Ranks come from counts per chunk of slots and source, summed over the chunks before, so that no task sees all
    slots of a source.
    """
    n = sum(slots)
    ends = np.cumsum(slots)
    grid, g = fibonacci(n)
    grid = grid if n else 0
    chunks = spark.range(0, -(-grid // CHUNK), 1, max(1, min(-(-grid // CHUNK), 10_000))).withColumnRenamed("id", "chunk")

    def sources(chunk: int) -> tuple[np.ndarray, np.ndarray]:
        at = points(chunk * CHUNK, min(CHUNK, grid - chunk * CHUNK), grid, g)
        kept = np.flatnonzero(at < n)
        return chunk * CHUNK + kept, np.searchsorted(ends, at[kept], side="right").astype(np.int32)

    def count(batches):
        for b in batches:
            for chunk in b.column(0).to_pylist():
                no, many = np.unique(sources(chunk)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(no), chunk)), pa.array(no), pa.array(many)], ["chunk", "source_no", "n"])

    def rank(batches):
        for b in batches:
            for chunk, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                slot, no = sources(chunk)
                base = {x["source_no"]: x["before"] for x in before}
                order = np.argsort(no, kind="stable")
                held, first, many = np.unique(no[order], return_index=True, return_counts=True)
                ranks = np.empty(len(no), np.int64)
                ranks[order] = np.arange(len(no)) - np.repeat(first, many) + np.repeat([base[x] for x in held.tolist()], many)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(no), pa.array(ranks)], ["slot", "source_no", "rank"])

    before = F.coalesce(F.sum("n").over(Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    counted = chunks.mapInArrow(count, "chunk long, source_no int, n long").withColumn("before", before)
    return counted.groupBy("chunk").agg(F.collect_list(F.struct("source_no", "before")).alias("before")).mapInArrow(rank, "slot long, source_no int, rank long")


def mix(docs: DataFrame, keep: tuple[str, ...] = (), weights=WEIGHTS, share: Fraction = SHARE, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target (its source's), taken, the words that the mix takes, and first_slot and
    last_slot, between which it takes them (-1 if none), of every row of ``docs``.

    Columns used: doc_id, text, source; those of ``keep`` come along in a struct named row. A source's documents are put in the order of a hash of their
    ids, their words form one stream, and the stream is cut into blocks of ``block`` words. The schedule's slots join
    these blocks; a source's last slot is cut so that its words reach the rounded target. As a target is at most twice
    the source's size, a block is taken at most twice.

    Null text has size 0, and nothing is taken of it; null sources form one source, the last. Rows of equal ids are
    documents of their own. The driver holds one row per source, never one per document.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    row = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []
    held = settle(docs.select(F.col("doc_id"), F.col("source"), size.alias("size"), F.monotonically_increasing_id().alias("_uid"), *row), "mix")
    per = sorted(((r["source"], r["size"] or 0, r["n"]) for r in held.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    sizes, total = [r[1] for r in per], sum(r[1] for r in per)
    target = fill(sizes, [weights[i % len(weights)] for i in range(len(per))], share * total)
    words = [math.floor(t + Fraction(1, 2)) for t in target]
    blocks = [-(-s // block) for s in sizes]
    slots = [w // s * b + -(-(w % s) // block) if s else 0 for w, s, b in zip(words, sizes, blocks)]
    table = spark.createDataFrame(
        [(i, r[0], r[1], float(target[i]), words[i], blocks[i]) for i, r in enumerate(per)],
        "source_no int, _source string, source_size long, target double, _words long, _blocks long",
    )

    buckets = 1 << max(6, (sum(r[2] for r in per) // BUCKET_ROWS).bit_length())
    h = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    rows = held.select("_uid", "doc_id", "source", "size", h.alias("h")).withColumn("bucket", F.shiftright("h", 60 - (buckets.bit_length() - 1)))
    rows = rows.join(table, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
    up_to = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("n")).select("source_no", "bucket", F.coalesce(F.sum("n").over(up_to.partitionBy("source_no")), F.lit(0)).alias("base"))
    within = Window.partitionBy("source_no", "bucket").orderBy("h", "doc_id", "size", "_uid").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["source_no", "bucket"]).withColumn("start", F.col("base") + F.col("before"))

    pieces = rows.where("size > 0").select("_uid", "source_no", "start", "size", "_words", "_blocks", "source_size", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
    taken = schedule(spark, slots).join(table.select("source_no", F.col("_blocks").alias("_b")), "source_no").select("slot", "source_no", F.expr("rank % _b").alias("block"), F.expr("rank div _b").alias("pass"))
    left = f"least(block * {block} + {block}, start + size, _words - pass * source_size) - greatest(block * {block}, start)"
    met = pieces.join(taken, ["source_no", "block"]).withColumn("got", F.expr(left)).where("got > 0")
    got = met.groupBy("_uid").agg(F.sum("got").alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))
    about = settle(rows.select("_uid", "source_size", "target").join(got, "_uid", "left"), "mix-about")
    about = about.hint("merge") if keep else about  # whole rows are dealt by a hash at any size, as mixed_rows has it
    return held.join(about, "_uid").select("doc_id", "source", *(["row"] if keep else []), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *(F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("first_slot", "last_slot")))


def first_words(text: bytes, n: int) -> bytes:
    """The text up to the end of its n-th word."""
    if n <= 0:
        return b""
    parts = text.split(None, n)
    return (text[: len(text) - len(parts[n])] if len(parts) > n else text).rstrip(SPACE)


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of which the mix takes words, with the columns of ``docs``: the text holds the words taken, n_chars their length.

    A text taken whole stays as it is; whole repeats and the last, cut one follow on a new line. Each partition,
    a sample of all rows by a hash, is written in the order of the slots in which the schedule first meets its rows, so
    that any run of a file holds the sources in proportion.
    Null and empty texts go, as nothing is taken of them; null ids and repeated rows count as documents of their own.
    Columns of any name may come along; an empty table gives an empty result.
    """
    whole, rest, slot = (spare(docs, c) for c in ("whole", "rest", "slot"))
    rows = mix(docs, keep=tuple(docs.columns)).where("taken > 0")
    rows = rows.select("row.*", F.col("first_slot").alias(slot), F.expr("taken div size").alias(whole), F.expr("taken % size").alias(rest))
    rows = rows.sortWithinPartitions(slot, "doc_id").drop(slot)
    at = docs.columns.index("text")

    def run(batches):
        for b in slices(batches):
            out = []
            for text, n, more in zip(utf8(b), *(b.column(b.num_columns - k).to_pylist() for k in (2, 1))):
                out.append(b"\n".join([text] * n + ([first_words(text, more)] if more else [])))
            columns = list(b.columns[:-2])
            columns[at] = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-2])

    out = rows.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns]) if "n_chars" in docs.columns else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST) AS k FROM s),
c AS (
  SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         sum(w) OVER (ORDER BY k DESC) AS w_left, 3 * (SELECT sum(size) FROM d) AS twice FROM o),
f AS (
  SELECT min(k) AS k FROM c WHERE (twice - 2 * full_before) * w <= 2 * w_left * 2 * source_size),
l AS (
  SELECT (c.twice - 2 * c.full_before)::DOUBLE AS num, (2 * c.w_left)::DOUBLE AS den, c.k FROM c JOIN f USING (k)),
t AS (
  SELECT c.source, c.source_size, CASE WHEN c.k < l.k THEN (2 * c.source_size)::DOUBLE ELSE l.num * c.w / l.den END AS target
  FROM c, l),
u AS (
  SELECT d.doc_id, d.source, row_number() OVER () AS uid, d.size, t.source_size::BIGINT AS source_size, t.target, floor(t.target + 0.5)::BIGINT AS words,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (
  SELECT source, source_size::BIGINT AS total, floor(target + 0.5)::BIGINT AS words, (source_size::BIGINT + 1023) // 1024 AS blocks,
         row_number() OVER (ORDER BY source NULLS LAST) AS no FROM t),
e AS (
  SELECT *, CASE WHEN total = 0 THEN 0 ELSE words // total * blocks + (words % total + 1023) // 1024 END AS slots FROM r),
y AS (SELECT *, sum(slots) OVER (ORDER BY no) AS up_to FROM e),
fib AS (
  WITH RECURSIVE f(a, b) AS (SELECT 1::BIGINT, 1::BIGINT UNION ALL SELECT b, a + b FROM f WHERE b < (SELECT sum(slots) FROM e))
  SELECT max(b) AS grid, max_by(a, b) AS step FROM f),
p AS (
  SELECT slot, slot * step % grid AS point FROM fib, (SELECT unnest(range((SELECT grid FROM fib))) AS slot)),
v AS (
  SELECT p.slot, y.no, y.source, y.total, y.words, y.blocks, row_number() OVER (PARTITION BY y.no ORDER BY p.slot) - 1 AS rank
  FROM p JOIN y ON p.point >= y.up_to - y.slots AND p.point < y.up_to),
m AS (
  SELECT u.uid, v.slot,
         least(rank % blocks * 1024 + 1024, start + size, v.words - rank // blocks * total) - greatest(rank % blocks * 1024, start) AS got
  FROM u JOIN v ON u.source IS NOT DISTINCT FROM v.source AND rank % blocks BETWEEN start // 1024 AND (start + size - 1) // 1024
  WHERE u.size > 0),
g AS (SELECT uid, sum(got)::BIGINT AS taken, min(slot) AS first_slot, max(slot) AS last_slot FROM m WHERE got > 0 GROUP BY uid)
SELECT doc_id, size, source_size, target, coalesce(g.taken, 0)::BIGINT AS taken, coalesce(first_slot, -1) AS first_slot, coalesce(last_slot, -1) AS last_slot
FROM u LEFT JOIN g USING (uid)
"""
