"""Substring dedup by prefix-partitioned suffix trees.

A window is SPAN consecutive words; windows are suffixes cut at SPAN words. Its prefix runs from its first word to the end
of its anchor, the run of GRAM words with the smallest hash inside it, so prefixes have GRAM to SPAN words, and equal
windows have equal prefixes. Suffixes are dealt to groups by anchor, and each group's subtree is held as a suffix array
over the distinct texts around the anchor: neighbours that agree on SPAN words lie below one internal node of that depth.
Where such a node has leaves in several documents, all but those of the smallest id are removed; neighbouring windows
make up the maximal repeat. Only anchors that a Bloom filter calls repeated leave their documents, with the words around
them that their windows can reach. The prefixes of anchors with more than GROUP occurrences are lengthened to whole
windows, so that a group is one node, of which a grouped minimum (combined before the shuffle) is all that is asked.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom, shingles
from .common import documents, settle, slices, words

SPAN = 50
GRAM = 8
#: Occurrences of an anchor that one task may hold (or 2^-20 of all, if that is more); one has about 100 words.
GROUP = 20_000
#: Occurrences whose suffix arrays are built at once, of whole groups.
BATCH = 4096
#: Hot anchors are at most HOT by that; so are hot windows, which have more than this part of all rows. Both are broadcast.
HOT = 1 << 20
HOT_WINDOWS = 1 << 17
#: Longer words are replaced by their digest in what is shuffled.
LONG_WORD = 64
#: The multiplier of a window's second hash.
OTHER = 0x9FB21C651E98DF25
LAST = (1 << 63) - 1


def _slide(x: np.ndarray, size: int, op) -> np.ndarray:
    """``op`` (minimum or maximum) over every ``size`` neighbours, by doubling."""
    n, have, out = len(x) - size + 1, 1, x
    while 2 * have <= size:
        out = op(out[: len(out) - have], out[have:])
        have *= 2
    return op(out[:n], out[size - have : size - have + n])


def anchors(grams: np.ndarray, span: int = SPAN, gram: int = GRAM) -> np.ndarray:
    """Places of the grams that are the smallest of some window of ``span`` words; all places, if several are equal."""
    size = span - gram + 1
    if len(grams) < size:
        return np.zeros(0, np.int64)
    low = _slide(grams, size, np.minimum)
    pad = np.zeros(size - 1, np.uint64)
    return np.flatnonzero(_slide(np.concatenate([pad, low, pad]), size, np.maximum) == grams)


def _source(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))


def anchor_keys(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """The distinct anchors of each document."""

    def run(batches):
        for b in slices(batches):
            out = []
            for text in b.column(0).to_pylist():
                g = shingles.runs(shingles.word_hashes(text, False)[0], gram)
                out.append(np.unique(g[anchors(g, span, gram)]))
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(out) if out else np.zeros(0, np.uint64)).view(np.int64))], ["h"])

    return _source(docs).select("text").mapInArrow(run, "h long")


def occurrences(docs: DataFrame, known, span: int, gram: int) -> DataFrame:
    """anchor, doc_id, th, at (the anchor's first word), left (words before it in ``words``), words: for repeated anchors."""

    def run(batches):
        for b in slices(batches):
            found, marks = [], []
            for text in b.column(2).to_pylist():
                h, first, end = shingles.word_hashes(text, False)
                g = shingles.runs(h, gram)
                a = anchors(g, span, gram)
                found.append((text, first, end, a))
                marks.append(g[a])
            all_ = np.concatenate(marks) if marks else np.zeros(0, np.uint64)
            maybe, at = known.value.maybe(all_.view(np.int64)), 0
            rows: list[tuple] = []
            for doc, th, (text, first, end, a), m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), found, marks):
                keep = maybe[at : at + len(m)]
                at += len(m)
                if not keep.any():
                    continue
                long = int((end - first).max()) > LONG_WORD
                for p, key in zip(a[keep].tolist(), m[keep].view(np.int64).tolist()):
                    lo, hi = max(0, p - (span - gram)), min(len(first), p + span)
                    part = text[first[lo] : end[hi - 1]]
                    if long:
                        part = b" ".join(w if len(w) <= LONG_WORD else b"\x00" + hashlib.blake2b(w, digest_size=20).hexdigest().encode() for w in words(part))
                    rows.append((key, doc, th, p, p - lo, part))
                if len(rows) > 20_000:
                    yield table(rows)
                    rows = []
            yield table(rows)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    names = ["anchor", "doc_id", "th", "at", "left", "words"]

    def table(rows):
        held = list(zip(*rows)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, kinds)], names)

    return _source(docs).mapInArrow(run, "anchor long, doc_id long, th long, at int, left int, words binary")


def names_of(words_at: np.ndarray, span: int) -> np.ndarray:
    """The rank of each place's next ``span`` words among all places, by doubling; the last span - 1 places have none.

    Sorting places by it gives their suffix array to that depth; places of equal rank share ``span`` words.
    """
    rank, have = words_at.astype(np.int64), 1
    while have < span:
        step = min(have, span - have)
        if len(rank) <= step:
            return np.zeros(0, np.int64)
        rank = np.unique(rank[:-step] * (int(rank.max()) + 1) + rank[step:], return_inverse=True)[1]
        have += step
    return rank


def node_owners(texts_: list[list[bytes]], owners: np.ndarray, span: int) -> list[np.ndarray]:
    """For each text and each of its windows, the smallest owner of a text that holds the window.

    In the suffix array of all texts' windows, those that share a node of depth ``span`` are neighbours.
    """
    sizes = np.array([len(t) for t in texts_])
    number: dict[bytes, int] = {}
    all_ = np.fromiter((number.setdefault(w, len(number)) for t in texts_ for w in t), np.int64, int(sizes.sum()))
    first = np.cumsum(sizes) - sizes
    many = np.maximum(sizes - span + 1, 0)
    places = np.arange(int(many.sum())) + np.repeat(first - (np.cumsum(many) - many), many)
    rank = names_of(all_, span)[places] if len(places) else np.zeros(0, np.int64)
    held = np.repeat(owners, many)
    array = np.argsort(rank, kind="stable")
    starts = np.flatnonzero(np.diff(rank[array], prepend=-1))
    least = np.empty(len(places), np.int64)
    if len(places):
        least[array] = np.repeat(np.minimum.reduceat(held[array], starts), np.diff([*starts, len(array)]))
    return np.split(least, np.cumsum(many)[:-1])


def repeats_of(group: list[tuple], span: int) -> list[tuple[int, int, int]]:
    """(row, first word, end) of the words to remove around the occurrences (anchor, doc, first word, words) of whole groups."""
    held: dict[tuple, list[int]] = {}
    for i, (anchor, _, _, part) in enumerate(group):
        held.setdefault((anchor, part), []).append(i)
    several = {}
    for anchor, _ in held:
        several[anchor] = several.get(anchor, 0) + 1
    docs = [LAST if g[1] is None else g[1] for g in group]
    out, compared = [], []
    for (anchor, part), rows in held.items():
        owner = min(docs[i] for i in rows)
        if several[anchor] > 1:
            compared.append((rows, owner, words(part)))
        if len(rows) > 1:
            n = len(words(part))
            out += [(i, group[i][2], group[i][2] + n) for i in rows if docs[i] > owner] if n >= span else []
    if compared:
        for (rows, owner, _), least in zip(compared, node_owners([c[2] for c in compared], np.array([c[1] for c in compared], np.int64), span)):
            starts = np.flatnonzero(least < owner)
            if len(starts):
                cut = np.flatnonzero(np.diff(starts) > 1)
                runs = list(zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist()))
                out += [(i, group[i][2] + a, group[i][2] + b + span) for i in rows if docs[i] == owner for a, b in runs]
    return out


SPANS = "doc_id long, th long, spans array<struct<first: int, end: int>>"


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    """A row for each document of ``rows`` (doc_id, th, first, end)."""
    held: dict[tuple, list] = {}
    for doc, th, first, end in rows:
        held.setdefault((doc, th), []).append((first, end))
    sizes = [len(x) for x in held.values()]
    flat = [y for x in held.values() for y in x]
    return _span_rows(pa.array([k[0] for k in held], pa.int64()), pa.array([k[1] for k in held], pa.int64()), np.cumsum([0, *sizes]), [x[0] for x in flat], [x[1] for x in flat])


def _span_rows(docs: pa.Array, ths: pa.Array, offsets: np.ndarray, first, end) -> pa.RecordBatch:
    inner = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(end, pa.int32())], ["first", "end"])
    return pa.RecordBatch.from_arrays([docs, ths, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)], ["doc_id", "th", "spans"])


def small_groups(occ: DataFrame, span: int) -> DataFrame:
    """Spans to remove, from a suffix array per anchor; a task meets the rows of an anchor one after the other."""

    def run(batches):
        group: list[tuple] = []
        ths: list[int] = []

        def close():
            out = _spans([(group[i][1], ths[i], first, end) for i, first, end in repeats_of(group, span)])
            group.clear()
            ths.clear()
            return out

        for b in slices(batches, 2048):
            for anchor, doc, th, at, left, part in zip(*(c.to_pylist() for c in b.columns)):
                if len(group) >= BATCH and group[-1][0] != anchor:
                    yield close()
                group.append((anchor, doc, at - left, part))
                ths.append(th)
        yield close()

    return occ.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, SPANS)


def windows_of(b: pa.RecordBatch, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of occurrences: two hashes of each window around an anchor, its row, and its first word in the document."""
    parts = b.column(5).to_pylist()
    h, begin, _ = shingles.word_hashes(b"\n".join(parts), False)
    ends = np.cumsum([len(x) + 1 for x in parts])
    row = np.searchsorted(ends, begin, side="right")
    places = np.flatnonzero(row[: max(0, len(row) - span + 1)] == row[span - 1 :]) if len(row) >= span else np.zeros(0, np.int64)
    row_of = row[places]
    within = places - np.searchsorted(row, np.arange(len(parts)))[row_of]
    start = b.column(3).to_numpy().astype(np.int64) - b.column(4).to_numpy()
    w1, w2 = (shingles.runs(h, span, odd)[places].view(np.int64) for odd in (shingles.ODD, OTHER))
    return w1, w2, row_of, start[row_of] + within


class Owners:
    """The smallest documents of some windows, by binary search."""

    def __init__(self, rows: pa.Table):
        w1, w2, least = (rows[c].to_numpy() for c in ("w1", "w2", "least"))
        order = np.lexsort((w2, w1))
        self.w1, self.w2, self.least = w1[order], w2[order], least[order]

    def find(self, w1: np.ndarray, w2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which windows are among them, and their owners. Of windows that agree on w1 alone only the first is found."""
        if not len(self.w1):
            return np.zeros(len(w1), bool), np.zeros(len(w1), np.int64)
        at = np.minimum(np.searchsorted(self.w1, w1), len(self.w1) - 1)
        return (self.w1[at] == w1) & (self.w2[at] == w2), self.least[at]


def large_groups(occ: DataFrame, span: int) -> DataFrame:
    """The same for anchors of many occurrences: a group per window, with the whole window as its prefix.

    A window's rows meet in a minimum that is combined before the shuffle. The owners of hot windows, at most HOT_WINDOWS
    by their definition, are broadcast back to the rows; of the other rows those whose window a Bloom filter calls
    repeated, each window a small part of all rows, are joined.
    """
    spark = occ.sparkSession

    def windows(batches):
        for b in slices(batches, 2048):
            w1, w2, row, _ = windows_of(b, span)
            yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), b.column(1).take(pa.array(row))], ["w1", "w2", "doc_id"])

    per = occ.mapInArrow(windows, "w1 long, w2 long, doc_id long").groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    per = settle(per.where("n > 1 AND least IS NOT NULL"), "windows")
    total = per.agg(F.sum("n")).first()[0] or 0
    hot, rest = (F.col("n") > total // HOT_WINDOWS), per.where(F.col("n") <= total // HOT_WINDOWS)
    owners = spark.sparkContext.broadcast(Owners(per.where(hot).select("w1", "w2", "least").toArrow()))
    known = spark.sparkContext.broadcast(bloom.repeated(rest.select(F.col("w1").alias("h"), F.lit(True).alias("twice")), rest.count()))

    def look(batches):
        for b in slices(batches, 2048):
            w1, w2, row, first = windows_of(b, span)
            docs = b.column(1).fill_null(LAST).to_numpy()[row]
            found, owner = owners.value.find(w1, w2)
            gone = np.flatnonzero(found & (owner < docs))
            # what touches in a document is one repeat
            th = b.column(2).to_numpy()[row]
            gone = gone[np.lexsort((first[gone], th[gone], docs[gone]))]
            other = (np.diff(docs[gone]) != 0) | (np.diff(th[gone]) != 0)
            cut = np.flatnonzero(other | (np.diff(first[gone]) > span))
            a, z = (gone[x] for x in (np.append(0, cut + 1), np.append(cut, len(gone) - 1))) if len(gone) else (gone, gone)
            new = np.append(True, (np.diff(docs[a]) != 0) | (np.diff(th[a]) != 0)) if len(a) else np.zeros(0, bool)
            at = pa.array(row[a[new]])
            out = _span_rows(b.column(1).take(at), b.column(2).take(at), np.append(np.flatnonzero(new), len(a)), first[a], first[z] + span)
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, *out.columns], ["w1", "w2", *out.schema.names])
            maybe = np.flatnonzero(~found)
            maybe = maybe[known.value.maybe(w1[maybe])]
            at = pa.array(row[maybe])
            out = _span_rows(b.column(1).take(at), b.column(2).take(at), np.arange(len(maybe) + 1), first[maybe], first[maybe] + span)
            yield pa.RecordBatch.from_arrays([pa.array(w1[maybe]), pa.array(w2[maybe]), *out.columns], ["w1", "w2", *out.schema.names])

    rows = settle(occ.mapInArrow(look, f"w1 long, w2 long, {SPANS}"), "window-rows")
    joined = rows.where("w1 IS NOT NULL").join(rest.select("w1", "w2", "least"), ["w1", "w2"]).where("doc_id IS NULL OR least < doc_id")
    return rows.where("w1 IS NULL").select("doc_id", "th", "spans").unionByName(joined.select("doc_id", "th", "spans"))


def spans(docs: DataFrame, span: int = SPAN, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, th (hash of the text), spans: the runs of words of each document that windows of smaller ids repeat.

    Documents without such runs have no row. See ``remove`` for nulls and repeated rows.
    """
    spark = docs.sparkSession
    keys = settle(anchor_keys(docs, span, gram), "anchors")
    known = spark.sparkContext.broadcast(bloom.repeated(keys.select("h", F.lit(False).alias("twice")), keys.count()))
    occ = settle(occurrences(docs, known, span, gram), "occurrences")
    per = occ.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    hot = per.where(F.col("n") > max(group, occ.count() // HOT)).select("anchor").toArrow()["anchor"].to_numpy()
    if not len(hot):
        found = small_groups(occ, span)
    else:
        anchors_ = spark.sparkContext.broadcast(np.sort(hot))

        def part(of_hot):
            def run(batches):
                for b in batches:
                    yield b.filter(pa.array(np.isin(b.column(0).to_numpy(), anchors_.value) == of_hot))

            return occ.mapInArrow(run, occ.schema)

        found = small_groups(part(False), span).unionAll(large_groups(settle(part(True), "hot-occurrences"), span))
    return found.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove(docs: DataFrame, span: int = SPAN, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space), kept_sha256 of every row of ``docs``.

    A word goes if a window of ``span`` words that covers it also starts in a document of smaller id. Null text has no
    words. A null id is larger than any other. Rows of equal ids do not repeat each other, whatever their texts. Other
    columns are ignored; an empty table gives an empty result.
    """
    found = spans(docs, span, gram, group).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "spans")
    joined = _source(docs).join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left").select("doc_id", "text", "spans")

    def run(batches):
        for b in slices(batches):
            rows = []
            for doc, text, gone in zip(*(c.to_pylist() for c in b.columns)):
                w = words(text)
                if gone:
                    mark = np.zeros(len(w) + 1, np.int32)
                    for s in gone:
                        mark[s["first"]] += 1
                        mark[s["end"]] -= 1
                    stay = np.cumsum(mark[:-1]) == 0
                    kept = [x for x, k in zip(w, stay.tolist()) if k]
                else:
                    kept = w
                out = b" ".join(kept)
                rows.append((doc, len(w), len(w) - len(kept), out.decode(), hashlib.sha256(out).hexdigest()))
            held = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, kinds)], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(documents(spark, sf_dir)).drop("kept")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT doc_id, w, len(w) AS n FROM w),
s AS (
  SELECT doc_id, unnest(range(1, n - 48)) AS i, w FROM n WHERE n >= 50),
k AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM s),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS owner FROM k) WHERE owner < doc_id),
g AS (SELECT DISTINCT doc_id, i + o AS j FROM d, (SELECT unnest(range(50)) AS o)),
r AS (SELECT doc_id, list(j) AS gone FROM g GROUP BY doc_id),
a AS (
  SELECT n.doc_id, n.n, n.w, coalesce(r.gone, []) AS gone FROM n LEFT JOIN r USING (doc_id)),
u AS (SELECT doc_id, n, unnest(w) AS x, unnest(range(1, n + 1)) AS j FROM a WHERE n > 0),
q AS (SELECT u.doc_id, string_agg(u.x, ' ' ORDER BY u.j) AS kept FROM u LEFT JOIN g ON g.doc_id = u.doc_id AND g.j = u.j WHERE g.j IS NULL GROUP BY u.doc_id)
SELECT a.doc_id, a.n::BIGINT AS n_words, len(a.gone)::BIGINT AS n_removed, sha256(coalesce(q.kept, '')) AS kept_sha256
FROM a LEFT JOIN q USING (doc_id)
"""
