"""Severity, priority and regression of issues (clusters of reviews)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicons as lex
from ..functions import text as X

RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}


def severity_rank(severity: Column) -> Column:
    out = F.lit(0)
    for name, n in RANK.items():
        out = F.when(severity == name, n).otherwise(out)
    return out


def severity_v1(text: Column, avg_rating: Column) -> Column:
    """The text's keyword tier; satisfied ratings lower it, dissatisfied ones raise it."""
    low = F.lower(text)
    tier = F.lit("low")
    for name in ("medium", "high", "critical"):
        tier = F.when(X.has_any(low, lex.SEVERITY_TIERS[name]), name).otherwise(tier)
    rated = X.yes(avg_rating > 0)
    return (
        F.when(rated & (avg_rating >= 3.8), "low")
        .when(rated & (avg_rating <= 2.0) & tier.isin("low", "medium"), "high")
        .when(rated & (avg_rating <= 2.8) & (tier == "low"), "medium")
        .otherwise(tier)
    )


def severity_v2(avg_rating: Column) -> Column:
    r = F.coalesce(F.nullif(avg_rating, F.lit(0.0)), F.lit(3.0))
    return F.when(r <= 2, "critical").when(r <= 2.5, "high").when(r <= 3.5, "medium").otherwise("low")


def _weight(severity: Column, weights: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for name, w in weights.items():
        out = F.when(severity == name, F.lit(w)).otherwise(out)
    return out


def priority_v1(severity: Column, size: Column, text: Column, avg_rating: Column, cohesion: Column, specificity: Column) -> Column:
    clamp = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), c))
    base = _weight(severity, {"critical": 100.0, "high": 50.0, "medium": 20.0, "low": 5.0}, 1.0) + F.log10(size + 1.0) * 10 + 5 * X.count_of(F.lower(text), lex.PRIORITY_KEYWORDS)
    rating = F.when(X.yes(avg_rating > 0), clamp((4.0 - avg_rating) / 3.0, 0.05, 1.0)).otherwise(1.0)
    return base * (0.1 + rating) * (0.5 + 0.5 * clamp(cohesion, 0.0, 1.0)) * clamp(0.4 + 2.5 * specificity, 0.1, 1.5)


def priority_v2(severity: Column, size: Column, avg_rating: Column) -> Column:
    weight = _weight(severity, {"critical": 1.0, "high": 0.75, "medium": 0.5, "low": 0.25}, 0.25)
    return 0.4 * weight + 0.3 * (F.log10(size + 1.0) / 5) + 0.2 * ((5 - avg_rating) / 5) + 0.05


def priority_mart(severity: Column, size: Column, avg_actionability: Column, avg_rating: Column) -> Column:
    weight = _weight(severity, {"critical": 1.0, "high": 0.75, "medium": 0.5}, 0.25)
    return F.round(F.least(size / F.lit(100.0), F.lit(1.0)) * 0.25 + weight * 0.35 + F.coalesce(avg_actionability, F.lit(0.0)) * 0.25 + (5 - F.coalesce(avg_rating, F.lit(3.0))) / 5 * 0.15, 4)


def priority_triage(severity: Column, faithfulness: Column, regressed: Column, confidence: Column, size: Column) -> Column:
    weight = _weight(F.lower(severity), {"critical": 100.0, "high": 70.0, "medium": 40.0, "low": 15.0}, 20.0)
    boost = F.when(X.yes(regressed), 30.0 * F.coalesce(confidence, F.lit(0.5))).otherwise(0.0)
    return F.round(weight + 20.0 * F.coalesce(faithfulness, F.lit(0.5)) + boost + 5.0 * F.log1p(F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("double")), 2)


def impact(volume: Column, avg_score: Column, retention: Column, money: Column, wishes: Column) -> Column:
    return 0.3 * volume + 30.0 * avg_score + 5 * retention + 3 * money + 2 * wishes


def regression_status(runs: DataFrame, keys: list[str], order: list[str], rank: str = "severity_rank", count: str = "review_count", version: str | None = None) -> DataFrame:
    """``runs`` with the run before of the same issue, the change, and NEW, REGRESSED_*, IMPROVED or STABLE.

    One window, hence one shuffle and sort for all columns of the run before.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    out = runs.withColumn("prev_rank", F.lag(rank).over(w)).withColumn("prev_count", F.lag(count).over(w)).withColumn("prev_run", F.lag(version or order[-1]).over(w))
    r, n, pr, pn = F.col(rank), F.col(count), F.col("prev_rank"), F.col("prev_count")
    status = (
        F.when(F.col("prev_run").isNull(), "NEW")
        .when(r > pr, "REGRESSED_SEVERITY")
        .when(n > pn * 1.5, "REGRESSED_VOLUME")
        .when((r < pr) | (n < pn * 0.5), "IMPROVED")
        .otherwise("STABLE")
    )
    return out.select("*", (n - pn).alias("count_delta"), F.try_divide(n, pn).alias("count_ratio"), status.alias("regression_status"))


def top_per_group(df: DataFrame, group: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per group; Spark limits each group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def velocity_spikes(clusters: DataFrame, group: str = "upload_id", count: str = "review_count") -> DataFrame:
    """``clusters`` with is_spike: at least 15 and 1.5 population deviations above the mean of a group of 3 or more."""
    w = Window.partitionBy(group)
    limit = F.greatest(F.avg(count).over(w) + 1.5 * F.stddev_pop(count).over(w), F.lit(15.0))
    return clusters.withColumn("is_spike", (F.count(F.lit(1)).over(w) >= 3) & (F.col(count) >= limit))


def volume_change(old: DataFrame, new: DataFrame, key: str, size: str, least: int = 5) -> DataFrame:
    """Full outer comparison of two label tables: status new, disappeared or common, growth in percent, is_spike."""
    a, b = old.select(key, F.col(size).alias("old_size")), new.select(key, F.col(size).alias("new_size"))
    o, n = F.coalesce("old_size", F.lit(0)), F.coalesce("new_size", F.lit(0))
    growth = F.try_divide((n - o) * 100.0, F.nullif(o, F.lit(0)))
    return a.join(b, key, "full_outer").select(
        key,
        o.alias("old_size"),
        n.alias("new_size"),
        F.when(F.col("old_size").isNull(), "new").when(F.col("new_size").isNull(), "disappeared").otherwise("common").alias("status"),
        growth.alias("growth_pct"),
        X.yes((growth > 50) & (n - o >= 10) & (n >= least)).alias("is_spike"),
    )


def evolution(pct: Column, severity_change: Column) -> tuple[Column, Column]:
    """(status, drifted) of a cluster whose size changed by ``pct`` percent."""
    status = F.when(pct.isNull() | (pct <= -100), "disappeared").when(F.abs(pct) < 30, "stable").when(pct > 0, "growing").otherwise("shrinking")
    return status, X.yes(F.abs(pct) > 30) | X.yes(F.abs(severity_change) > 0.15)


def urgency(size: Column, severity: Column, actionability: Column, critical_size: float = 100.0) -> tuple[Column, Column]:
    score = size / F.lit(critical_size) * 0.4 + severity * 0.3 + actionability * 0.3
    return score, F.when(score > 0.8, "critical").when(score > 0.6, "high").when(score > 0.4, "medium").otherwise("low")


def category_volume(clusters: DataFrame) -> DataFrame:
    """Reviews per issue category; a cluster counts in every category its title names."""
    low = F.lower("title")
    hits = F.array_compact(F.array(*[F.when(X.has_any(low, words), F.lit(name)) for name, words in lex.CATEGORIES.items()]))
    return clusters.select(F.explode(hits).alias("category"), "review_count").groupBy("category").agg(F.sum("review_count").alias("reviews"))


def version_bisect(df: DataFrame, key: list[str], version: str = "version") -> DataFrame:
    """Per group: the earliest version by its numbers, the most common one, and how many there are."""
    numbers = F.transform(F.slice(F.regexp_extract_all(version, F.lit(r"\d+"), F.lit(0)), 1, 4), lambda x: x.cast("long"))
    per = df.where(F.coalesce(F.col(version), F.lit("")) != "").groupBy(*key, version).agg(F.count(F.lit(1)).alias("n")).withColumn("numbers", numbers)
    return per.groupBy(*key).agg(
        F.min_by(version, F.when(F.size("numbers") > 0, F.struct("numbers", version))).alias("earliest_version"),
        F.max_by(version, F.struct("n", version)).alias("most_common_version"),
        F.count(F.lit(1)).alias("distinct_versions"),
    )
