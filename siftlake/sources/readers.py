"""Reading review files with unknown headers, stage tables, and exports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as lex

#: Columns that are not loaded into the warehouse.
EXCLUDED = ("embedding", "actionability_features")
CANONICAL = ("reviewId", "userName", "content", "score", "appVersion", "thumbsUpCount", "at")


class NoText(ValueError):
    """No column of the file can be the review text."""


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, quotes and line breaks inside fields; all columns are strings."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def detect(df: DataFrame, sample: int = 100) -> dict[str, str]:
    """Canonical name -> column of ``df``.

    Headers are compared in lower case without ``_`` and ``-``. If none means the text, the string column with the
    largest mean length above 20 over the first values that are not null is taken.
    """
    found: dict[str, str] = {}
    for column in df.columns:
        key = re.sub(r"[_\-]", "", column.strip().lower())
        for name, words in lex.HEADER_SYNONYMS.items():
            if key in words and name not in found:
                found[name] = column
    if "at" in df.columns:
        found["at"] = "at"
    if "content" not in found:
        strings = [f.name for f in df.schema if f.dataType.simpleString() == "string" and f.name not in found.values()]
        best = None
        if strings:
            means = df.limit(sample).agg(*[F.avg(F.length(F.col(f"`{c}`"))).alias(f"m{i}") for i, c in enumerate(strings)]).first()
            best = max(((m or 0.0, -i) for i, m in enumerate(means)), default=None)
        if not best or best[0] <= 20:
            raise NoText(f"no text column among {', '.join(df.columns)}")
        found["content"] = strings[-best[1]]
    return found


def canonical(df: DataFrame) -> DataFrame:
    """``df`` with the canonical columns: missing ids are numbered, missing scores are 3, the text is trimmed."""
    have = detect(df)
    col = lambda name, kind, other: F.coalesce(F.col(f"`{have[name]}`").try_cast(kind), other) if name in have else other
    null = F.lit(None)
    return df.select(
        col("reviewId", "string", F.monotonically_increasing_id().cast("string")).alias("reviewId"),
        col("userName", "string", null.cast("string")).alias("userName"),
        F.trim(col("content", "string", F.lit(""))).alias("content"),
        col("score", "double", F.lit(3.0)).alias("score"),
        col("appVersion", "string", null.cast("string")).alias("appVersion"),
        col("thumbsUpCount", "long", F.lit(0).cast("long")).alias("thumbsUpCount"),
        (F.try_to_timestamp(F.col("at").cast("string")) if "at" in have else null.cast("timestamp")).alias("at"),
    )


def capped(df: DataFrame, order: str, rows: int = 5000) -> DataFrame:
    """The first rows in the order of a column: a sampling scan for monitors."""
    return df.orderBy(order).limit(rows)


def stage_path(root: str, upload_id: int, run_id: str, stage: str) -> str:
    for part in (run_id, stage):
        if not re.fullmatch(r"[A-Za-z0-9_\-]+", part):
            raise ValueError(f"not an identifier: {part!r}")
    return f"{root.rstrip('/')}/staging/upload={int(upload_id)}/run={run_id}/{stage}.parquet"


def write_stage(df: DataFrame, root: str, upload_id: int, run_id: str, stage: str) -> str:
    path = stage_path(root, upload_id, run_id, stage)
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)
    return path


def delete_run(spark: SparkSession, root: str, upload_id: int, run_id: str) -> bool:
    """Delete one run's stages; gives whether there were any."""
    path = stage_path(root, upload_id, run_id, "x").rsplit("/", 1)[0]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def load_table(df: DataFrame, path: str, keys: tuple[str, ...] = ("upload_id",), sort: tuple[str, ...] = ()) -> None:
    """Replace the partitions that ``df`` has rows for, and no others: a load that can run again."""
    out = df.drop(*EXCLUDED)
    if sort:
        out = out.repartition(*keys).sortWithinPartitions(*keys, *sort)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def flat(reviews: DataFrame) -> DataFrame:
    """Nested review records (metadata, actionability structs) as one flat row each."""
    return reviews.select("id", "text", "metadata.*", F.col("actionability.score").alias("actionability_score"), F.col("actionability.confidence").alias("actionability_confidence"), F.col("actionability.features").alias("actionability_features"), F.col("actionability.is_actionable").alias("is_actionable"))


def nested(rows: DataFrame) -> DataFrame:
    """The inverse of ``flat``."""
    meta = [c for c in rows.columns if c not in ("id", "text", "actionability_score", "actionability_confidence", "actionability_features", "is_actionable")]
    score = F.struct(F.col("actionability_score").alias("score"), F.col("actionability_confidence").alias("confidence"), F.col("actionability_features").alias("features"), "is_actionable")
    return rows.select("id", "text", F.struct(*meta).alias("metadata"), score.alias("actionability"))


def report_rows(clusters: DataFrame, samples: DataFrame, key: str = "cluster_id") -> DataFrame:
    """``clusters`` with the first three sample texts, cut at 100 characters and joined by `` | ``; for a CSV report.

    ``samples``: key, ordinal, content.
    """
    from ..operators.issues import top_per_group

    three = top_per_group(samples, [key], ["ordinal"], 3).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", F.substring("content", 1, 100).alias("c")))).alias("s"))
    joined = F.array_join(F.transform("s", lambda x: x["c"]), " | ")
    return clusters.join(three, key, "left").withColumn("samples", F.coalesce(joined, F.lit(""))).drop("s")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def ticket(title, severity, count, kind):
    """Markdown of a ticket, as a column."""
    return F.concat_ws("\n", F.format_string("## [%s] %s", F.upper(severity), title), F.format_string("- **Type:** %s", kind), F.format_string("- **Reviews:** %d", count))


def account_export(uploads: DataFrame, clusters: DataFrame, key: str = "upload_id") -> DataFrame:
    """Uploads with the list of their clusters (empty, if none)."""
    fields = [c for c in clusters.columns if c != key]
    lists = clusters.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("clusters"))
    return uploads.join(lists, key, "left").withColumn("clusters", F.coalesce("clusters", F.array().cast(lists.schema["clusters"].dataType)))


def load_metrics(row: DataFrame, path: str) -> None:
    """Replace the metrics of one upload and pipeline version (columns upload_id, pipeline_version and figures)."""
    load_table(row, path, ("upload_id", "pipeline_version"))


def append_chunks(df: DataFrame, path: str, order: str, chunk: int = 500) -> DataFrame:
    """Append the rows in files of at most ``chunk`` of them; gives the rows as written."""
    df.sort(order).write.mode("append").option("maxRecordsPerFile", chunk).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_report(report: DataFrame, path: str, title: str) -> str:
    """A report of few rows as JSON lines below ``path``/json and as Markdown below ``path``/markdown; gives the Markdown's path.

    Each row becomes a list of its columns; nested values are written as JSON.
    """
    report.write.mode("overwrite").json(f"{path}/json")
    flat_types = ("string", "int", "bigint", "double", "float", "boolean", "date", "timestamp", "timestamp_ntz")
    value = lambda c, t: F.coalesce(F.col(f"`{c}`").cast("string") if t in flat_types or t.startswith("decimal") else F.to_json(F.col(f"`{c}`")), F.lit("-"))
    lines = [F.concat(F.lit(f"- **{c}:** "), value(c, t)) for c, t in report.dtypes]
    report.select(F.concat_ws("\n", F.lit(f"## {title}"), *lines, F.lit("")).alias("value")).write.mode("overwrite").text(f"{path}/markdown")
    return f"{path}/markdown"
