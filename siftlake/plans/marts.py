"""Warehouse marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import issues


def issue_summary(clusters: DataFrame, reviews: DataFrame, keys: list[str], since=None, digits: int = 4) -> DataFrame:
    """Clusters with the counts of their reviews and a priority in 0..1.

    ``reviews`` are reduced to those of the clusters at hand before they are counted. ``since`` limits the clusters to
    those ingested at or after it (column created_at), for incremental runs.
    """
    if since is not None:
        clusters = clusters.where(F.col("created_at") >= F.lit(since))
    score = F.when(F.col("is_actionable").isNotNull(), F.col("is_actionable").cast("int"))
    rollup = reviews.join(clusters.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("actual_review_count"), F.count_if("is_actionable").alias("actionable_count"), F.avg(score).alias("avg_actionability"))
    out = clusters.join(rollup, keys, "left")
    priority = issues.priority_mart(F.col("severity"), F.col("review_count"), F.col("avg_actionability"), F.col("avg_rating"))
    return out.withColumn("priority_score", F.round(priority, digits))


def regression_mart(metrics: DataFrame, clusters: DataFrame, since=None, lookback_days: int = 30) -> DataFrame:
    """Each issue's runs against the run before; ``since`` reads back ``lookback_days``, so that the run before is seen.

    ``metrics``: upload_id, tenant_id, pipeline_version, created_at; ``clusters``: upload_id, tenant_id, cluster_id,
    issue_fingerprint, title, severity, review_count.
    """
    if since is not None:
        metrics = metrics.where(F.col("created_at") >= F.lit(since) - F.expr(f"INTERVAL {int(lookback_days)} DAYS"))
    runs = metrics.select("upload_id", "tenant_id", "pipeline_version", F.col("created_at").alias("run_created_at")).join(clusters.drop("created_at"), ["upload_id", "tenant_id"])
    runs = runs.withColumn("severity_rank", issues.severity_rank(F.col("severity")))
    return issues.regression_status(runs, ["tenant_id", "issue_fingerprint"], ["run_created_at", "pipeline_version"])
