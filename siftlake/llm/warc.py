"""Zstandard WARC archives: a dictionary in the leading skippable frame, one frame per record.

Archives are written by the executors into a folder that all share, through pyarrow's file systems (local, HDFS, S3,
GCS by URI). A file is written under a temporary name and renamed, so that a lost executor leaves no half file, and a
task that runs again replaces its own files. Reading goes through Spark's binary file source, file by file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, qualified, settle

#: Magic of the skippable frame that holds the dictionary, and of any Zstandard frame.
DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: An archive is closed when it has so many bytes; a page is never cut.
ROLL_BYTES = 16 << 20
#: The dictionary is trained on about so many pages, picked by the hash of their ids, and has at most so many bytes.
DICT_PAGES = 400
DICT_BYTES = 32 << 10
DATE = "2024-01-01T00:00:00Z"
MIN_BYTES = 0


class BadArchive(ValueError):
    """A frame, header or length that does not fit."""


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}/{digest}'.encode()).digest(), version=4)}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit (``refers_to`` given) has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers (lower-case names), payload (None for a revisit), after checks of version, lengths and digest."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise BadArchive("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise BadArchive(f"no field: {line[:80]}")
        fields[name.strip().lower()] = value.strip()
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if need not in fields:
            raise BadArchive(f"{need} is missing")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise BadArchive(f"Content-Length is {n}, the block has {len(rest) - 4} bytes")
    http, found, payload = rest[:n].partition(b"\r\n\r\n")
    if not found or not http.startswith(b"HTTP/"):
        raise BadArchive("no HTTP header")
    if fields["warc-type"] == "revisit":
        if payload:
            raise BadArchive("a revisit has a payload")
        payload = None
    else:
        if len(payload) != int(fields.get("x-payload-length", len(payload))):
            raise BadArchive("the payload's length differs")
        if f"sha1:{digest_of(payload)}" != fields["warc-payload-digest"]:
            raise BadArchive("the payload's digest differs")
    return {"fields": fields, "payload": payload}


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends: its header and its blocks' headers are walked."""
    if len(data) - at < 6 or struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise BadArchive(f"no frame at {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    pos = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        if pos + 3 > len(data):
            raise BadArchive("a frame is cut off")
        head = data[pos] | data[pos + 1] << 8 | data[pos + 2] << 16
        pos += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    pos += 4 * (flags >> 2 & 1)
    if pos > len(data):
        raise BadArchive("a frame is cut off")
    return pos


def read_archive(content: bytes):
    """Yield the parsed records of an archive, one frame each."""
    data, at, known = memoryview(content), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data, 0)[0] == DICT_MAGIC:
        at = 8 + struct.unpack_from("<I", data, 4)[0]
        if at > len(data):
            raise BadArchive("the dictionary is cut off")
        raw = bytes(data[8:at])
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        known = zstandard.ZstdCompressionDict(raw) if raw else None
    reader = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    while at < len(data):
        end = frame_end(data, at)
        yield parse(reader.decompress(data[at:end]))
        at = end


def dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary trained on the samples; the samples' own beginning where there are too few to train; empty without any."""
    whole = b"".join(samples)
    try:
        return zstandard.train_dictionary(min(size, max(256, len(whole) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return whole[:size]


def write_archives(records: DataFrame, path: str, known: bytes, roll: int = ROLL_BYTES) -> DataFrame:
    """Write page_id, url, payload, digest, refers_to to archives below ``path``; gives name, records, bytes per archive.

    The workers write to the file system that Spark reads ``path`` from, also where it has no scheme.
    """
    path = qualified(records.sparkSession, path)

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        made: list[tuple] = []
        task, held, size, n = TaskContext.get(), [], 0, 0
        writer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(known) if known else None, write_checksum=True)
        packed = zstandard.ZstdCompressor(level=9).compress(known) if known else b""
        first = struct.pack("<II", DICT_MAGIC, len(packed)) + packed

        def close():
            nonlocal held, size, n
            name = f"part-{task.partitionId():06d}-{len(made):05d}.warc.zst"
            temp = f"{root}/_{name}.{task.taskAttemptId()}"
            with fs.open_output_stream(temp) as out:
                out.write(first)
                for x in held:
                    out.write(x)
            fs.move(temp, f"{root}/{name}")
            made.append((name, n, size + len(first)))
            held, size, n = [], 0, 0

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                frame = writer.compress(record(*row))
                held.append(frame)
                size, n = size + len(frame), n + 1
                if size >= roll:
                    close()
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], ["name", "records", "bytes"])

    rows = records.select("page_id", "url", "payload", "digest", "refers_to")
    return settle(rows.mapInArrow(run, "name string, records long, bytes long"), "warc-manifest")


RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``, checked; the payload of a revisit is null."""

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows: list[tuple] = []
                for r in read_archive(content.as_py()):
                    f = r["fields"]
                    at, to = f.get("x-page-id"), f.get("x-refers-to-page")
                    rows.append((at and int(at), f.get("warc-target-uri"), f["warc-type"], int(f.get("x-payload-length", 0)), f["warc-payload-digest"].partition(":")[2], to and int(to), r["payload"]))
                    if len(rows) >= 500:
                        yield table(rows)
                        rows = []
                yield table(rows)

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.zst").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (html in UTF-8, null: empty), digest (SHA-1), payload_bytes, same (SHA-256, by which payloads are equal)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))

    def run(batches):
        for b in batches:
            html = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([digest_of(x) for x in html], pa.string()), pa.array([len(x) for x in html], pa.int64()), pa.array([hashlib.sha256(x).digest() for x in html], pa.binary())], ["page_id", "url", "payload", "digest", "payload_bytes", "same"])

    return rows.mapInArrow(run, "page_id long, url string, payload binary, digest string, payload_bytes long, same binary")


def archive(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) to archives below ``path``; gives the manifest.

    Of records with equal payloads of ``min_bytes`` or more, the one with the largest page_id is the response and the
    others revisit it. A null id counts as smaller than any other; among null ids alone, and among rows that repeat the
    largest id, all are responses. Null html is empty; an empty table gives no archive. Other columns are ignored. Only
    ids and digests meet in a shuffle by digest, combined beforehand; pages are
    shuffled by their own id, and only if the revisits are too many to broadcast within Spark's limit.
    """
    spark = pages.sparkSession
    rows = payloads(pages)
    seen = settle(rows.select("page_id", "same", "payload_bytes"), "warc-digests")
    largest = seen.where(F.col("payload_bytes") >= min_bytes).groupBy("same").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    revisits = seen.where(F.col("payload_bytes") >= min_bytes).join(largest, "same").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    revisits = revisits.select(F.col("page_id").alias("_id"), F.col("same").alias("_same"), "refers_to").dropDuplicates(["_id", "_same"])
    some = max(1, seen.count() // DICT_PAGES)
    sample = [bytes(r[0]) for r in rows.where(F.pmod(F.xxhash64("page_id"), F.lit(some)) == 0).select("payload").limit(2 * DICT_PAGES).collect()]
    joined = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("same") == F.col("_same")), "left")
    return write_archives(joined, path, dictionary(sorted(x[:16384] for x in sample)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    made = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    if made.isEmpty():
        return spark.createDataFrame([], RECORD).drop("url", "payload")
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(html) AS sha, max(page_id) OVER (PARTITION BY html) AS top FROM p),
b AS (
  SELECT *, array_to_string(list_transform(range(4), lambda k: array_to_string(list_transform(range(8), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, 10 * k + 1, 10))::BIGINT >> (35 - 5 * j)) % 32)::INT, 1)), '')), '') AS payload_digest FROM h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN top IS NULL OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top IS NULL OR page_id = top THEN NULL ELSE top END AS refers_to
FROM b
"""
