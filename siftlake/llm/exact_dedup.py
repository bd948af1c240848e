"""Exact dedup: two-pass Bloom filtering finds possibly repeated hashes; only those rows shuffle."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import bloom
from .common import SPACE, documents, settle, slices, spare, texts, utf8

#: A text with more than this part of the rows that may repeat is a hot one; there are at most so many.
HOT = 4096


def normalise(text: bytes) -> bytes:
    """Each run of ASCII white space becomes one space, at the ends too."""
    if not text:
        return text
    out = b" ".join(text.split())
    if not out:
        return b" "
    return (b" " if text[0] in SPACE else b"") + out + (b" " if text[-1] in SPACE else b"")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, sha256 of the normalised text (32 bytes), and its first 8 bytes as h."""

    def run(batches):
        for b in slices(batches):
            sha = [hashlib.sha256(normalise(t)).digest() for t in b.column(1).to_pylist()]
            h = np.frombuffer(b"".join(sha), "<i8").reshape(-1, 4)[:, 0] if sha else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sha, pa.binary()), pa.array(np.ascontiguousarray(h))], ["doc_id", "sha", "h"])

    return texts(docs).mapInArrow(run, "doc_id long, sha binary, h long")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs``.

    The texts are read once, and never shuffled. Rows that the filter calls unique pass straight through; of the rest
    the ids and hashes meet in a grouped minimum (combined before the shuffle). The groups of hot texts, at most HOT by
    their definition, are broadcast back to their rows; the others, each a small part of the rows, are joined.

    A null text equals an empty one. A null id is larger than any other; in a group of null ids alone all rows stay,
    as do all rows that carry the smallest id. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = settle(digests(docs), "digests")
    n = rows.count()
    known = spark.sparkContext.broadcast(bloom.repeated(rows.select("h", F.lit(False).alias("twice")), n))

    def split(batches):
        for b in batches:
            maybe = known.value.maybe(b.column(2).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(maybe)], ["doc_id", "sha", "maybe"])

    rows = rows.mapInArrow(split, "doc_id long, sha binary, maybe boolean")
    alone = rows.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    meet = settle(rows.where("maybe").select("doc_id", "sha"), "meet")
    groups = settle(meet.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    most = meet.count() // HOT
    hot = F.broadcast(groups.where(F.col("group_size") > max(most, 1)))
    rest = meet.join(hot.select("sha"), "sha", "left_anti").join(groups.where(F.col("group_size") <= max(most, 1)), "sha")
    both = meet.join(hot, "sha").unionByName(rest).select("doc_id", "keep_id", "group_size", "sha")
    return both.unionAll(alone).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def distinct_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the one with the smallest doc_id.

    A null text equals an empty one. A null id is larger than any other; of rows that tie, one stays. Texts that the
    filter calls unique are not shuffled; of the others each task sends at most one row per text. Columns of any name
    may come along; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    keys = settle(digests(docs).select("h", F.lit(False).alias("twice")), "keys")
    known = spark.sparkContext.broadcast(bloom.repeated(keys, keys.count()))
    names, sha_col, nth = docs.columns, spare(docs, "sha"), spare(docs, "nth")

    def part(want):
        def run(batches):
            for b in slices(batches):
                sha = [hashlib.sha256(normalise(t)).digest() for t in utf8(b)]
                h = np.frombuffer(b"".join(sha), "<i8").reshape(-1, 4)[:, 0] if sha else np.zeros(0, np.int64)
                maybe = known.value.maybe(np.ascontiguousarray(h))
                out = pa.RecordBatch.from_arrays([*b.columns, pa.array(sha, pa.binary())], [*b.schema.names, sha_col])
                yield out.filter(pa.array(maybe == want))

        return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(sha_col, T.BinaryType())]))

    first = F.row_number().over(Window.partitionBy(sha_col).orderBy(F.col("doc_id").asc_nulls_last()))
    kept = [F.col(f"`{c}`") for c in names]
    one = part(True).withColumn(nth, first).where(F.col(nth) == 1).select(*kept)
    return part(False).select(*kept).unionAll(one)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
