"""Blocked Bloom filters of what occurs more than once, built without gathering the keys anywhere.

Keys (64-bit hashes) are dealt to segments by their leading bits. Each task first merges its own equal keys, so that a
key with a third of all rows reaches its segment once per task. A segment with more than GROUP keys is split by further
bits of the hash, so that a task's memory does not grow with the input; the parts' filters are united. A task runs the two
passes over its keys: a key whose bits are all set when it arrives goes into the filter of repeated keys. Only that second
filter leaves the task. Its size is bounded by MAX_BITS whatever the input; beyond about 27 million distinct repeated keys it lets more
keys through that occur once, which costs shuffle and never a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MAX_BITS = 1 << 28
SEGMENT_BITS = 1 << 16
PROBES = 5
#: Keys that one task's two passes take, about; each needs some 250 bytes.
GROUP = 1 << 18


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    """A second hash of 64-bit hashes (the finaliser of splitmix64)."""
    z = h + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    """PROBES positions per key below ``bits``, as an array of keys x PROBES."""
    a, b = _mix(h, 1), _mix(h, 2) | np.uint64(1)
    return np.stack([((a + np.uint64(i) * b) >> np.uint64(8)) % np.uint64(bits) for i in range(PROBES)], axis=1)


def _segment(h: np.ndarray, segments: int) -> np.ndarray:
    return (_mix(h, 3) % np.uint64(segments)).astype(np.int32)


def repeated_in_order(h: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Per key, in the order of arrival: does a Bloom filter of the earlier ones (or ``twice``) have it already?

    The filter has 16 bits a key. A bit is set before row i if the first row that sets it comes earlier, so that the
    whole pass is two array operations.
    """
    if not len(h):
        return np.zeros(0, bool)
    bits = max(1024, 16 * len(h))
    pos = _positions(h, bits).astype(np.int64)
    row = np.repeat(np.arange(len(h)), PROBES)
    first = np.full(bits, len(h), np.int64)
    flat = pos.ravel()
    first[flat[::-1]] = row[::-1]
    return twice | (first[pos] < np.arange(len(h))[:, None]).all(axis=1)


class RepeatFilter:
    """Answers "may this key occur more than once?"; yes for every key that does."""

    def __init__(self, parts: dict[int, bytes], segments: int):
        self.segments = segments
        self.at = np.full(segments, -1, np.int64)
        for n, s in enumerate(sorted(parts)):
            self.at[s] = n
        self.bits = np.frombuffer(b"".join(parts[s] for s in sorted(parts)), np.uint8) if parts else np.zeros(0, np.uint8)

    def maybe(self, h: np.ndarray) -> np.ndarray:
        h = np.asarray(h).astype(np.int64, copy=False).view(np.uint64)
        at = self.at[_segment(h, self.segments)]
        found = at >= 0
        if found.any():
            pos = _positions(h[found], SEGMENT_BITS).astype(np.int64) + (at[found] * SEGMENT_BITS)[:, None]
            found[found] = ((self.bits[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1).all(axis=1)
        return found


def repeated(keys: DataFrame, n: int, group: int = 0) -> RepeatFilter:
    """The filter of keys that occur in ``keys`` (columns h long, twice boolean) more than once; ``n``: rows, about.

    ``twice`` marks a row that already stands for several. The driver receives at most MAX_BITS bits.
    """
    spark: SparkSession = keys.sparkSession
    split = group or GROUP
    segments = max(1, min(MAX_BITS, 1 << max(16, int(8 * max(n, 1)).bit_length())) // SEGMENT_BITS)
    parts = max(1, -(-n // (segments * split)))

    def merge(batches):
        held: list[np.ndarray] = []

        def out():
            h = np.concatenate([x[0] for x in held])
            t = np.concatenate([x[1] for x in held])
            h, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
            many = (count > 1) | (np.bincount(inverse, weights=t, minlength=len(h)) > 0)
            held.clear()
            u = h.view(np.uint64)
            part = (_mix(u, 4) % np.uint64(parts)).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(_segment(u, segments)), pa.array(part), pa.array(h), pa.array(many)], ["segment", "part", "h", "twice"])

        size = 0
        for b in batches:
            held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)))
            size += b.num_rows
            if size >= 4_000_000:
                yield out()
                size = 0
        if held:
            yield out()

    def build(table: pa.Table) -> pa.Table:
        h = table["h"].to_numpy().view(np.uint64)
        hit = repeated_in_order(h, table["twice"].to_numpy())
        if not hit.any():
            return pa.table({"segment": pa.array([], pa.int32()), "bits": pa.array([], pa.binary())})
        bits = np.zeros(SEGMENT_BITS, np.uint8)
        bits[_positions(h[hit], SEGMENT_BITS).ravel().astype(np.int64)] = 1
        return pa.table({"segment": table["segment"][:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    def unite(table: pa.Table) -> pa.Table:
        bits = [np.frombuffer(x, np.uint8) for x in table["bits"].to_pylist()]
        return pa.table({"segment": table["segment"][:1], "bits": pa.array([np.bitwise_or.reduce(bits).tobytes()], pa.binary())})

    out = "segment int, bits binary"
    merged = keys.select("h", "twice").mapInArrow(merge, "segment int, part int, h long, twice boolean")
    filters = merged.groupBy("segment", "part").applyInArrow(build, out)
    rows = (filters.groupBy("segment").applyInArrow(unite, out) if parts > 1 else filters).collect()
    return RepeatFilter({r["segment"]: bytes(r["bits"]) for r in rows}, segments)
