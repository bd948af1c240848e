"""What the operators of this subpackage share: words, shared folders, Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts have it; ``bytes.split()`` splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = b" \t\n\x0b\x0c\r"


def words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text, unchanged."""
    return text.split()


def lower_words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text with A-Z in lower case."""
    return text.lower().split()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session. Only a session without one that runs in the driver's own process
    gets a temporary folder; anywhere else the setting is needed.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="siftlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Rows in a batch that goes to a Python worker, at most; whole texts are wide, and both sides hold a batch in memory.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to BATCH_ROWS, unless it has fewer already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; it goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/siftlake/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and authority of the file system that Spark takes it from."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return out.replace("file:/", "file:///", 1) if out.startswith("file:/") and not out.startswith("file://") else out


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder whose rows nobody reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: it is not computed twice, and no lineage is left."""
    spark = df.sparkSession
    small_batches(spark)
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text as UTF-8 bytes (null: empty), and the columns named; other columns of the table are not read."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
        *more,
    )


def spare(df: DataFrame, name: str) -> str:
    """A name for a column of one's own that no column of ``df`` has, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: What one operator keeps in a Python worker from task to task; the next operator's first task there drops it.
KEPT: dict = {}


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def slices(batches, rows: int = 256):
    """The batches cut into small ones, so that a worker holds what it makes of few texts at a time."""
    if KEPT:
        KEPT.clear()
        trim()
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    trim()


def utf8(b, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8 bytes; null is empty."""
    return [t or b"" for t in b.column(b.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(column: str, of: int):
    """crc32 of the id as text, modulo ``of``; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % of
