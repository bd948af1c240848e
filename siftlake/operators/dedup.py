"""Exact deduplication, compute-once and last-write-wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in ``order``; Spark limits each group before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def computed_once(df: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], id_col: str) -> DataFrame:
    """``df`` with the columns that ``compute`` adds to its distinct keys, and the smallest id of each key."""
    distinct = df.groupBy(key).agg(F.min(id_col).alias("representative"))
    return df.join(compute(distinct), key)


def latest(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Both tables' rows, the one of the largest version per key."""
    return first_by(old.unionByName(new), keys, [F.desc(version)])
