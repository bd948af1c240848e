"""MinHash near-dedup with b-bit signatures.

Documents with equal shingle sets form a class; classes get HASHES minima, whose bands of ROWS give candidates, and
whose lowest BITS bits are packed into a signature. Candidate pairs whose similarity, estimated from the equal
signature cells and corrected for chance collisions, is far too low are dropped; the others are confirmed on the full
sets. Groups are never expanded into all pairs: each bucket first ties its members to two of them, and only buckets
that still hold several components compare members across components.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom, shingles
from .common import documents, settle, slices, spare, texts

WORDS = 4
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
#: A pair at 0.8 shares none of 32 bands of 4 with probability (1 - 0.8^4)^32 = 5e-8.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BITS = 4
#: Pairs estimated below this similarity are dropped; at 0.8 an estimate has a standard deviation of 0.04.
LEAST_ESTIMATE = 0.6
#: A bucket of more members than this is compared in blocks.
BLOCK = 1024

_RNG = np.random.default_rng(977)
_A = (_RNG.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]


def minima(s: np.ndarray) -> np.ndarray:
    """HASHES minima of a set of 64-bit hashes."""
    low = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 4096):
        x = low[None, k : k + 4096] * _A
        x += _B
        np.minimum(out, x.min(axis=1), out=out)
    return out


def bands(m: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = shingles.mix(out * np.uint64(shingles.ODD) + m[k::ROWS].astype(np.uint64))
    return out


def signature(m: np.ndarray) -> bytes:
    """The minima's lowest BITS bits, plane by plane."""
    return b"".join(np.packbits((m >> np.uint32(b)) & np.uint32(1)).tobytes() for b in range(BITS))


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of signatures (arrays of ... x bytes): the share of equal cells, less the 2^-BITS that are so by chance."""
    x = np.bitwise_xor(a, b).reshape(*np.broadcast_shapes(a.shape, b.shape)[:-1], BITS, HASHES // 8)
    unequal = np.bitwise_count(np.bitwise_or.reduce(x, axis=-2)).sum(axis=-1, dtype=np.int32)
    chance = 0.5**BITS
    return (1 - unequal / HASHES - chance) / (1 - chance)


def sketch(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, set_id (null without shingles), keys (per band), sig."""

    def run(batches):
        for b in slices(batches):
            rows: list[tuple] = []
            for text in b.column(1).to_pylist():
                s = shingles.shingle_set(text, size)
                if not len(s):
                    rows.append((0, None, None, None))
                    continue
                m = minima(s)
                rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), bands(m).view(np.int64).tolist(), signature(m)))
            held = list(zip(*rows)) or [()] * 4
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(held, kinds))], ["doc_id", "n_shingles", "set_id", "keys", "sig"])

    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long, set_id binary, keys array<long>, sig binary")


def read_again(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """doc_id, text of the documents named by ``reps`` (rep), written once. A Bloom filter of their ids comes first, so
    that the other texts are not shuffled."""
    ids = reps.select(F.xxhash64("rep").alias("h"), F.lit(True).alias("twice"))
    known = docs.sparkSession.sparkContext.broadcast(bloom.repeated(ids, reps.count()))

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(known.value.maybe(b.column(2).to_numpy(zero_copy_only=False)))).select([0, 1])

    some = texts(docs).where("doc_id IS NOT NULL").withColumn("h", F.xxhash64("doc_id")).mapInArrow(run, "doc_id long, text binary")
    return settle(some.join(reps.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi"), "near-texts")


def alone(held: DataFrame, size: int) -> DataFrame:
    """rep, n, u, shingles of the texts ``held``: the shingle set, its size, and how many of it no other text has.

    A Bloom filter tells which shingles may be in several texts, so u may be too small, never too large. No link can
    have more shingles in common than either side's n - u.
    """

    def keys(batches):
        for b in slices(batches):
            out = [shingles.shingle_set(t, size) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(out) if out else np.zeros(0, np.uint64)).view(np.int64))], ["h"])

    all_ = held.select("text").mapInArrow(keys, "h long").withColumn("twice", F.lit(False))
    many = held.agg(F.sum(F.length("text"))).first()[0] or 0
    known = held.sparkSession.sparkContext.broadcast(bloom.repeated(all_, many // 6))

    def count(batches):
        for b in slices(batches):
            out = [shingles.shingle_set(t, size) for t in b.column(1).to_pylist()]
            n = np.array([len(x) for x in out], np.int64)
            maybe = known.value.maybe((np.concatenate(out) if out else np.zeros(0, np.uint64)).view(np.int64))
            met = np.bincount(np.repeat(np.arange(len(n)), n), maybe, len(n)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(n - met), pa.array([x.tobytes() for x in out], pa.binary())], ["rep", "n", "u", "shingles"])

    return held.select("doc_id", "text").mapInArrow(count, "rep long, n long, u long, shingles binary")


def can_link(n, u, n2, u2, percent: int = PERCENT):
    """May sets of sizes n and n2, of which u and u2 are shared with no other set, be similar enough?"""
    common = np.minimum(n - u, n2 - u2)
    return 100 * common >= percent * (n + n2 - common)


def likely(pairs: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and signatures (``about``: rep, sig, n, u) do not rule out."""

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, BITS * HASHES // 8) for i in (2, 5))
            n, u, n2, u2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 6, 7))
            yield b.filter(pa.array((estimate(x, y) >= LEAST_ESTIMATE) & can_link(n, u, n2, u2, percent))).select([0, 1])

    one, two = (about.select(F.col("rep").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("sig", "n", "u"))) for k in ("a", "b"))
    both = pairs.join(one, "a").join(two, "b")
    return both.select("a", "b", "sig_a", "n_a", "u_a", "sig_b", "n_b", "u_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, about: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs that are links, by their full sets (``about``: rep, shingles)."""

    def run(batches):
        for b in slices(batches):
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield b.filter(pa.array(keep, pa.bool_())).select([0, 1])

    one, two = (about.select(F.col("rep").alias(k), F.col("shingles").alias(f"set_{k}")) for k in ("a", "b"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, comp: the smallest node that can be reached, for every node of ``links`` (a, b).

    Each round takes the smallest label next to a node and then that label's own label, so that chains halve; rounds go
    on until none changes. Every round is written to the shared folder.
    """
    spark = links.sparkSession
    links = settle(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links")
    at = settle(links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "node"), name)
    while True:
        near = links.join(at.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("low"))
        step = at.join(near.withColumnRenamed("a", "node"), "node").select("node", "comp", F.least("comp", "low").alias("low"))
        jump = at.select(F.col("node").alias("low"), F.col("comp").alias("lower"))
        new = settle(step.join(jump, "low", "left").select("node", F.least("low", "lower").alias("comp"), (F.least("low", "lower") < F.col("comp")).alias("moved")), name)
        moved = new.where("moved").limit(1).count()
        at = new.select("node", "comp")
        if not moved:
            return at


def across(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of one bucket that lie in different components; enough of them to join these.

    ``members``: key, rep, comp, sig, n, u, size (the bucket's) and shingles (sorted hashes). Pairs that sizes and
    signatures do not rule out are compared on the full sets, unless links found before have joined them. Buckets above
    BLOCK are dealt out as pairs of blocks, so that no task holds more than two blocks; every pair of members meets in
    one of them.
    """
    g = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = members.withColumn("g", g).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int"))
    dealt = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep", "comp", "sig", "n", "u", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        part, rep, comp, n, u = (table[c].to_numpy() for c in ("part", "rep", "comp", "n", "u"))
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(len(rep), -1)
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        comp = comp.copy()
        found: list[tuple[int, int]] = []
        left, right = (np.flatnonzero(part == i), np.flatnonzero(part == j))
        for x in left if len(np.unique(comp)) > 1 else ():
            y = right[(comp[right] != comp[x]) & can_link(n[right], u[right], n[x], u[x], percent) & ((rep[right] > rep[x]) if i == j else True)]
            if not len(y):
                continue
            y = y[estimate(sig[x][None], sig[y]) >= LEAST_ESTIMATE]
            if not len(y):
                continue
            all_ = np.concatenate([sets[k] for k in y])
            hit = sets[x][np.minimum(np.searchsorted(sets[x], all_), n[x] - 1)] == all_
            common = np.bincount(np.repeat(np.arange(len(y)), n[y]), hit, len(y))
            for k in y[100 * common >= percent * (n[x] + n[y] - common)].tolist():
                if comp[k] != comp[x]:
                    found.append((min(rep[x], rep[k]), max(rep[x], rep[k])))
                    comp[comp == comp[k]] = comp[x]
        held = list(zip(*found)) or [()] * 2
        return pa.table({"a": pa.array(held[0], pa.int64()), "b": pa.array(held[1], pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_groups(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that can be reached over links, the document's own included. Documents without
    words have the size 0 and are linked with nothing. A null id is linked with nothing, its component is null, and it
    is kept. Rows that repeat an id and its text get equal results; of rows that repeat an id with different texts each
    counts for the links of that id. Other columns are ignored.
    """
    rows = settle(sketch(docs, size), "sketches")
    real = rows.where("set_id IS NOT NULL AND doc_id IS NOT NULL")
    reps = real.groupBy("set_id").agg(F.min("doc_id").alias("rep"))
    first = F.col("doc_id") == F.col("rep")
    classes = settle(real.join(reps, "set_id").where(first).select("set_id", "rep", "keys", "sig").dropDuplicates(["set_id"]), "classes")
    member = classes.select("rep", F.explode("keys").alias("key"))
    shared = settle(member.join(member.groupBy("key").count().where("count > 1"), "key", "left_semi"), "buckets")
    held = read_again(docs, settle(shared.select("rep").distinct(), "candidates"))
    about = alone(held, size).where(100 * (F.col("n") - F.col("u")) >= percent * F.col("n"))
    about = settle(about.join(classes.select("rep", "sig"), "rep"), "about")

    # a member with few shingles of its own is the likeliest to be near the others
    first, second = F.struct(F.col("u") / F.col("n"), "rep"), F.struct(F.xxhash64("rep").alias("h"), "rep")
    able = settle(shared.join(about.select("rep", "n", "u"), "rep"), "able")
    ends = able.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(first).alias("lo"), F.min(second).alias("hi")).where("size > 1")
    able = able.join(ends.select("key", "size", F.col("lo.rep").alias("lo"), F.col("hi.rep").alias("hi")), "key")
    star = able.select("rep", F.explode(F.array("lo", "hi")).alias("to")).where("rep != to").select(F.least("rep", "to").alias("a"), F.greatest("rep", "to").alias("b")).distinct()
    tried = settle(likely(star, about, percent), "star")
    links = settle(confirmed(tried, about, percent), "links")
    at = components(links)

    placed = able.select("key", "rep", "size").join(at.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "size", F.coalesce("comp", "rep").alias("comp"))
    split = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    more = settle(across(placed.join(split, "key", "left_semi").join(about, "rep"), percent), "across")
    if not more.isEmpty():
        at = components(links.unionAll(more), "components2")
    whole = classes.select("set_id", "rep").join(at.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", F.coalesce("comp", "rep").alias("root"))
    joined = rows.select("doc_id", "n_shingles", "set_id").join(whole, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def first_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the document with the smallest id.

    Texts without words, null among them, are in no component and stay, as do rows with a null id. Rows that repeat an
    id stay or go together. Only rows whose id a Bloom filter takes for one that goes are shuffled. Columns of any name
    may come along; an empty table gives an empty result.
    """
    gone = settle(near_groups(docs).where(~F.col("kept")).select("doc_id").distinct(), "gone")
    ids = gone.select(F.xxhash64("doc_id").alias("h"), F.lit(True).alias("twice"))
    known = docs.sparkSession.sparkContext.broadcast(bloom.repeated(ids, gone.count()))
    hashed = docs.withColumn(spare(docs, "h"), F.xxhash64(F.col("doc_id").cast("long")))
    kept = [F.col(f"`{c}`") for c in docs.columns]

    def part(want):
        def run(batches):
            for b in batches:
                maybe = known.value.maybe(b.column(b.num_columns - 1).to_numpy(zero_copy_only=False))
                yield b.filter(pa.array(maybe == want)).select(list(range(b.num_columns - 1)))

        return hashed.mapInArrow(run, docs.schema).select(*kept)

    return part(False).unionAll(part(True).join(gone, "doc_id", "left_anti").select(*kept))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))
