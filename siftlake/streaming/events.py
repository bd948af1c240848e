"""Event streams: envelopes, idempotent consumers, retries with a dead-letter sink, windows, incremental loads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = "id string, event_type string, payload map<string, string>, timestamp timestamp, retry_count int, max_retries int, dead_letter boolean"
MAX_RETRIES = 3


def file_source(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files below ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def kafka_source(spark: SparkSession, servers: str, topics: str, per_trigger: int = 100) -> DataFrame:
    """A stream of topics by pattern; needs the Kafka connector's jar on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribePattern", topics).option("maxOffsetsPerTrigger", per_trigger).load()


def opened(raw: DataFrame, column: str = "value") -> DataFrame:
    """Envelopes from JSON text; what is no envelope has a null id."""
    return raw.select(F.from_json(F.col(column).cast("string"), ENVELOPE).alias("e")).select("e.*")


def once_per_consumer(events: DataFrame, consumer: str, key: str = "id", at: str = "timestamp", delay: str = "1 day") -> DataFrame:
    """Events that this consumer has not had within ``delay``."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key]).withColumn("consumer", F.lit(consumer))


def claims(inbox: DataFrame, events: DataFrame, consumer: str) -> DataFrame:
    """The events that the inbox table (event_id, consumer_name) has no claim on yet, once each."""
    mine = inbox.where(F.col("consumer_name") == consumer).select(F.col("event_id").alias("id"))
    return events.dropDuplicates(["id"]).join(mine, "id", "left_anti")


def routed(events: DataFrame, ok) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(handled, to try again with a count one higher, dead) by the condition ``ok``."""
    again = F.coalesce(F.col("retry_count"), F.lit(0)) + 1
    most = F.coalesce(F.col("max_retries"), F.lit(MAX_RETRIES))
    good = F.coalesce(ok, F.lit(False))
    failed = events.where(~good).withColumn("retry_count", again)
    return events.where(good), failed.where(F.col("retry_count") < most), failed.where(F.col("retry_count") >= most).withColumn("dead_letter", F.lit(True)).withColumn("failed_at", F.current_timestamp())


def consume(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, name: str):
    """Run until the input is used up; offsets are committed after ``handle`` returns (at least once)."""
    return events.writeStream.queryName(name).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, at: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts and sums of ``value`` per window and key (an extension)."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, at: str, gap: str, late: str, *keys: str) -> DataFrame:
    """Counts per session (an extension)."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), *keys).agg(F.count(F.lit(1)).alias("n"))


def above_mark(rows: DataFrame, loaded: DataFrame | None, at: str) -> DataFrame:
    """Rows at or after the newest one loaded; all of them, if nothing is."""
    mark = loaded.agg(F.max(at)).first()[0] if loaded is not None else None
    return rows if mark is None else rows.where(F.col(at) >= F.lit(mark))
