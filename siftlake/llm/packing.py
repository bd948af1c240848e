"""Packing by non-negative least squares over the histogram of piece lengths.

Documents are tokenised and cut into whole windows and a rest. Ways to fill a window with up to three rests are listed;
non-negative least squares finds how often each should be used so that together they use up the histogram; the counts
are rounded down, and the rests that remain are packed greedily, the longest first into the tightest gap. All of this
needs the histogram only, which has as many entries as the window has tokens. Pieces then find their place by the rank
among those of their length.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .common import KEPT, documents, settle

WINDOW = 1024
END_ID = 0
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: The same vocabulary as ranks; only words not met before go through it.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CACHE = 300_000
SALT_ROWS = 8192


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit integers, equal to those of the tokenizer file.

    Before its merges this tokenizer splits a text at every single space (which goes with what follows) and around
    every single line end, so the ids of such parts are kept and joined. Texts with runs of white space, other white
    space than these two, or special tokens go through the tokenizer as a whole.
    """

    def __init__(self, path: str = TOKENIZER, ranks: str = RANKS):
        self.whole = Tokenizer.from_file(path)
        special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.odd = re.compile(r"\s\s|[^\S \n]|\x00" + "".join("|" + re.escape(t) for t in special))
        with open(ranks, "rb") as f:
            held = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=held, special_tokens={})
        self.bytes_of = np.zeros(max(held.values()) + 1, np.int64)
        for token, i in held.items():
            self.bytes_of[i] = len(token)
        self.kept: dict[str, bytes] = {}

    def learn(self, parts: list[str]) -> None:
        """Encode parts in one go, with a line end after each, and cut the ids at the parts' bytes."""
        if len(self.kept) + len(parts) > CACHE:
            self.kept.clear()
        self.kept[""], line = b"", self.words.encode_ordinary("\n")
        self.kept["\n"] = struct.pack(f"<{len(line)}I", *line)
        parts = [p for p in parts if p not in self.kept]
        ids = np.array(self.words.encode_ordinary("\n".join(parts) + "\n"), "<u4")
        ends = np.cumsum(self.bytes_of[ids])
        stops = np.searchsorted(ends, np.cumsum([len(p.encode()) + 1 for p in parts])).tolist()
        raw, at = ids.tobytes(), 0
        for part, stop in zip(parts, stops):
            self.kept[part] = raw[4 * at : 4 * stop]
            at = stop + 1

    def encode(self, text: str) -> bytes:
        if self.odd.search(text) or text[-1:].isspace():
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00")
        got = list(map(self.kept.get, parts))
        if None in got:
            self.learn(list({p for p, g in zip(parts, got) if g is None}))
            got = list(map(self.kept.get, parts))
            if None in got:  # the cache was emptied
                self.learn(list(set(parts)))
                got = list(map(self.kept.__getitem__, parts))
        return b"".join(got)


def encoder(path: str, ranks: str) -> Encoder:
    """One encoder per Python worker and file."""
    if ("encoder", path, ranks) not in KEPT:
        KEPT["encoder", path, ranks] = Encoder(path, ranks)
    return KEPT["encoder", path, ranks]


def pieces(docs: DataFrame, window: int = WINDOW, path: str = TOKENIZER, ranks: str = RANKS, ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and the ids): each document's ids and END_ID, cut at the window."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    end = struct.pack("<I", END_ID)

    def run(batches):
        enc = encoder(path, ranks)
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = enc.encode(text) + end
                n = len(raw) // 4
                for at in range(0, n, window):
                    part = raw[4 * at : 4 * (at + window)]
                    out.append((doc, at, len(part) // 4, zlib.crc32(part), n, part if ids else None))
            held = list(zip(*out)) or [()] * 6
            arrays = [pa.array(held[i], pa.int64()) for i in range(5)] + ([pa.array(held[5], pa.binary())] if ids else [])
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(arrays)])

    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * ids)


def combinations(window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All a >= b >= c >= 0 with a + b + c = window and b > 0: the ways to fill a window with two or three pieces."""
    a, b = np.meshgrid(np.arange(1, window), np.arange(1, window), indexing="ij")
    c = window - a - b
    ok = (a >= b) & (b >= c) & (c >= 0)
    return a[ok], b[ok], c[ok]


def least_squares(hist: np.ndarray, parts: tuple[np.ndarray, ...], rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |A x - hist|^2, A's columns counting the lengths in a combination (0: no piece).

    Projected gradient steps with momentum, restarted when the loss rises; A is never laid out.
    """

    def forward(x):
        y = sum(np.bincount(p, x, len(hist)) for p in parts)
        y[0] = 0
        return y

    def back(r):
        return sum(r[p] for p in parts)

    h = hist.astype(float)
    h[0] = 0
    probe = np.ones(len(parts[0]))
    for _ in range(12):
        probe = back(forward(probe))
        norm = np.linalg.norm(probe) or 1.0
        probe /= norm
    rate = 1 / (1.05 * norm)
    x = y = np.zeros(len(parts[0]))
    t, last = 1.0, np.inf
    for _ in range(rounds):
        r = forward(y) - h
        r[0] = 0
        new = np.maximum(0, y - rate * back(r))
        loss = float(r @ r)
        t = 1.0 if loss > last else t
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t, last = new + (t - 1) / t_new * (new - x), new, t_new, loss
    return x


def plan(hist: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that use up ``hist`` (hist[n]: pieces of n tokens)."""
    left = hist.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = [((window,), int(left[window]))] if left[window] else []
    left[window] = 0
    if left.sum():
        parts = combinations(window)
        x = np.floor(least_squares(left, parts) + 1e-6).astype(np.int64)
        for i in np.argsort(-x, kind="stable")[: int((x > 0).sum())]:
            lengths = tuple(int(p[i]) for p in parts if p[i])
            n = min(int(x[i]), *(int(left[k]) // lengths.count(k) for k in lengths))
            if n:
                out.append((lengths, n))
                for k in lengths:
                    left[k] -= n
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for k in range(window - 1, 0, -1):
        n = int(left[k])
        for gap in range(k, window):
            while n and gaps[gap]:
                held, many = gaps[gap].pop()
                use = min(n, many)
                if many > use:
                    gaps[gap].append((held, many - use))
                gaps[gap - k].append((held + (k,), use))
                n -= use
            if not n:
                break
        each = window // k
        if n >= each:
            gaps[window - each * k].append(((k,) * each, n // each))
            n %= each
        if n:
            gaps[window - n * k].append(((k,) * n, 1))
    return out + [x for gap in sorted(gaps) for x in gaps[gap]]


def pack(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``cut`` (doc_id, start, length, ...) with sequence_id and offset.

    Ranks among the pieces of a length come from salted groups and running sums of their sizes, so that a length that
    most pieces have is not one task's. The driver holds the histogram and the plan, whose sizes depend on the window
    alone. Rows of equal ids are documents of their own; an empty table gives an empty result.
    """
    hist = np.zeros(window + 1, np.int64)
    for r in cut.groupBy("length").count().collect():
        hist[r["length"]] = r["count"]
    slots: dict[int, list[tuple]] = defaultdict(list)
    used, sequence = np.zeros(window + 1, np.int64), 0
    for lengths, n in plan(hist, window):
        at = 0
        for k in lengths:
            slots[k].append((int(used[k]), sequence, at))
            used[k] += n
            at += k
        sequence += n
    table = {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in slots.items()}

    salts = 1 << max(5, int(hist.sum() // SALT_ROWS).bit_length())
    rows = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")))
    ranked = ranked.join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("n") - 1).drop("salt", "n", "base").select(*cut.columns, "rank")

    def place(batches):
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for k in np.unique(length).tolist():
                first, base, at = table[k]
                here = length == k
                i = np.searchsorted(first, rank[here], side="right") - 1
                seq[here], off[here] = base[i] + rank[here] - first[i], at[i]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq), pa.array(off)], [*b.schema.names[:-1], "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every row of ``docs``.

    Null text is empty: one piece, END_ID alone. Other columns are ignored; a null id is kept as such.
    """
    return pack(settle(pieces(docs, window), "pieces"), window)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
