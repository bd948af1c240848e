"""Review, cluster and run tables made from the test tables, for Spark and (as SQL) for the comparison engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

#: Put before each document's text, so that the word lists have something to find.
PHRASES = [
    "App crashes after update 2.1.3 on my Pixel, it is a great app but broken!!",
    "good",
    "Please add dark mode, would be nice to have. I wish it had more features.",
    "Login issue on iPhone when I open the menu, terrible. Refund please",
    "love it! best ever, sure... great job. crash crash bug error",
    "Too slow and laggy v3.2, battery drains while loading",
    "nice app",
    "Subscription price is expensive, I will uninstall. Switching to another one",
    "It works, however the previous version was better than this?",
    "BUY NOW at https://promo.example.com use promo code SAVE10, call 555-123-4567",
    "yeah right, awesome update! it fails and fails!!",
    "Screen freezes on Samsung Galaxy 4.0.1 during login, not working",
]


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review per document: review_id, upload_id, tenant_id, content, rating, is_actionable, cluster_id, at, filename, embedding."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "label", "embedding")
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % len(PHRASES) + 1).cast("int"))
    return (
        docs.join(labels, "doc_id", "left")
        .join(vectors, "doc_id", "left")
        .select(
            F.col("doc_id").alias("review_id"),
            F.expr("CAST(substr(source, 4) AS INT)").alias("upload_id"),
            F.col("lang").alias("tenant_id"),
            F.concat(phrase, F.lit(" "), F.col("text")).alias("content"),
            (1 + (F.col("doc_id") * 7 + F.col("n_chars")) % 5).cast("int").alias("rating"),
            (F.col("quality") == 1).alias("is_actionable"),
            F.col("label").alias("cluster_id"),
            F.expr("timestamp_seconds(1704067200 + (doc_id * 7919) % 5184000)").cast("timestamp_ntz").alias("at"),
            phrase.alias("title"),
            "embedding",
        )
    )


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An issue per upload, tenant and label: cluster_id, title, severity, status, review_count, avg_rating, keywords, created_at."""
    per = (
        reviews(spark, sf_dir)
        .where("cluster_id IS NOT NULL")
        .groupBy("upload_id", "tenant_id", "cluster_id")
        .agg(F.min_by("title", "review_id").alias("title"), F.count(F.lit(1)).alias("review_count"), F.avg("rating").alias("avg_rating"), F.min("at").alias("created_at"))
    )
    severity = F.when(F.col("avg_rating") <= 2, "critical").when(F.col("avg_rating") <= 2.5, "high").when(F.col("avg_rating") <= 3.5, "medium").otherwise("low")
    return per.select(
        F.concat_ws("-", "upload_id", "tenant_id", "cluster_id").alias("cluster_id"),
        "upload_id",
        "tenant_id",
        F.col("cluster_id").alias("label"),
        "title",
        severity.alias("severity"),
        F.when(F.col("review_count") % 3 == 0, "resolved").otherwise("open").alias("status"),
        "review_count",
        "avg_rating",
        F.array_sort(F.filter(F.array_distinct(X.tokens(F.col("title"))), lambda w: F.length(w) > 3)).alias("keywords"),
        "created_at",
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue counts per tenant and weekly run, from the events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    per = events.groupBy((F.col("user_id") % 25).alias("tenant_id"), F.col("event_type").alias("issue_fingerprint"), F.floor((F.dayofmonth("ts") - 1) / 7).cast("int").alias("run_seq")).agg(F.count(F.lit(1)).alias("review_count"))
    return per.withColumn("severity_rank", (1 + (F.col("review_count") + F.col("run_seq")) % 4).cast("int"))


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


REVIEWS_SQL = f"""reviews AS (
  SELECT d.doc_id AS review_id, CAST(substr(d.source, 4) AS INT) AS upload_id, d.lang AS tenant_id,
         {_list(PHRASES)}[CAST(d.doc_id % {len(PHRASES)} + 1 AS INT)] || ' ' || d.text AS content,
         CAST(1 + (d.doc_id * 7 + d.n_chars) % 5 AS INT) AS rating, (l.quality = 1) AS is_actionable, e.label AS cluster_id,
         make_timestamp((1704067200 + (d.doc_id * 7919) % 5184000) * 1000000) AS "at",
         {_list(PHRASES)}[CAST(d.doc_id % {len(PHRASES)} + 1 AS INT)] AS title, e.embedding
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""

CLUSTERS_SQL = f"""{REVIEWS_SQL},
clusters0 AS (
  SELECT upload_id, tenant_id, cluster_id AS label, arg_min(title, review_id) AS title, count(*) AS review_count,
         avg(rating) AS avg_rating, min("at") AS created_at FROM reviews WHERE cluster_id IS NOT NULL GROUP BY ALL),
clusters AS (
  SELECT concat_ws('-', upload_id, tenant_id, label) AS cluster_id, upload_id, tenant_id, label, title,
         CASE WHEN avg_rating <= 2 THEN 'critical' WHEN avg_rating <= 2.5 THEN 'high' WHEN avg_rating <= 3.5 THEN 'medium' ELSE 'low' END AS severity,
         CASE WHEN review_count % 3 = 0 THEN 'resolved' ELSE 'open' END AS status, review_count, avg_rating,
         list_sort(list_filter(list_distinct(string_split_regex(lower(title), '\\s+')), lambda w: len(w) > 3)) AS keywords, created_at
  FROM clusters0)"""

RUNS_SQL = """runs0 AS (
  SELECT user_id % 25 AS tenant_id, event_type AS issue_fingerprint, CAST(floor((extract(day FROM ts) - 1) / 7) AS INT) AS run_seq,
         count(*) AS review_count FROM events GROUP BY ALL),
runs AS (SELECT *, CAST(1 + (review_count + run_seq) % 4 AS INT) AS severity_rank FROM runs0)"""
