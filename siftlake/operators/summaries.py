"""Summaries of scored reviews, clusters and pipeline runs. Each is one or two aggregates over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distribution(df: DataFrame, column: str, cuts: dict[str, float], above: float | None = None) -> DataFrame:
    """One row: n, mean, median, population deviation, the percentiles named by ``cuts`` and the share above ``above``.

    Nulls take no part. Percentiles are exact and interpolated.
    """
    x = F.col(column).cast("double")
    q = F.percentile(x, F.array(F.lit(0.5), *map(F.lit, cuts.values())))
    out = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), q.alias("q"), *([F.avg((x > above).cast("int")).alias("rate_above")] if above is not None else []))
    names = ["median", *cuts]
    return out.select("n", "mean", "std", *[F.element_at("q", i + 1).alias(c) for i, c in enumerate(names)], *(["rate_above"] if above is not None else []))


def level(n: Column, high: Column, medium: Column, top: str) -> Column:
    return F.when(n > high, top).when(n > medium, "medium").otherwise("low")


def business_summary(f: DataFrame) -> DataFrame:
    """One row of counts, rates, means and signal severities.

    ``f``: is_actionable, rating, score, confidence, uncertainty, has_retention_signal, has_monetization_complaint,
    feature_request_count, has_concession.
    """
    yes, n = F.coalesce("is_actionable", F.lit(False)), F.count(F.lit(1))
    happy = F.col("rating") >= 4
    out = f.agg(
        n.alias("n"),
        F.count_if(yes).alias("actionable"),
        F.avg("score").alias("avg_score"),
        F.avg("confidence").alias("avg_confidence"),
        F.count_if("has_retention_signal").alias("retention"),
        F.count_if("has_monetization_complaint").alias("money"),
        F.sum("feature_request_count").cast("long").alias("feature_requests"),
        F.count_if("has_concession").alias("mixed"),
        F.count_if(happy & yes).alias("happy_issues"),
        F.count_if(happy).alias("happy"),
        F.count_if(F.col("uncertainty") > 0.3).alias("uncertain"),
    )
    c = F.col
    return out.select(
        "n", "actionable", F.try_divide("actionable", "n").alias("actionable_rate"), "avg_score", "avg_confidence", "retention", "money", "feature_requests", "mixed", "happy_issues", "uncertain",
        level(c("retention"), c("n") * 0.05, c("n") * 0.02, "critical").alias("retention_severity"),
        level(c("money"), c("n") * 0.1, c("n") * 0.05, "high").alias("money_severity"),
        level(c("happy_issues"), F.lit(10), F.lit(5), "critical").alias("reputation_severity"),
        F.try_divide("happy_issues", "happy").alias("happy_issue_rate"),
        (c("feature_requests") * 0.1 + c("mixed") * 0.05).alias("opportunity"),
    )


#: Weights of priority levels in the comparison of two versions' outputs; any other counts 3.
LEVELS = {"P0": 5, "P1": 4, "P2": 3, "P3": 2, "P4": 1}


def version_match(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: how far two versions' clusters (severity P0 to P4, actionability, priority) agree, 0 to 1, and whether it matters."""

    def one(df: DataFrame, k: str) -> DataFrame:
        weight = F.coalesce(*[F.when(F.col("severity") == s, w) for s, w in LEVELS.items()], F.lit(3))
        zero = lambda x: F.coalesce(x, F.lit(0.0))
        return df.agg(F.count(F.lit(1)).alias(f"n_{k}"), zero(F.avg("actionability")).alias(f"a_{k}"), zero(F.avg(weight)).alias(f"s_{k}"), F.count_if(F.col("priority") > 50).alias(f"p_{k}"))

    c, most = F.col, F.greatest("n_1", "n_2")
    row = one(old, "1").crossJoin(one(new, "2"))
    diffs = [(c(f"{k}_2") - c(f"{k}_1")).alias(f"{name}_diff") for k, name in (("n", "cluster"), ("a", "actionability"), ("s", "severity"), ("p", "priority"))]
    row = row.select("n_1", "n_2", *diffs)
    same = F.when(most > 0, 1 - F.abs("cluster_diff") / most).otherwise(F.lit(1.0))
    score = (same + (1 - F.abs("actionability_diff") / 5.0) + (1 - F.abs("severity_diff") / 5.0)) / 3
    big = (F.abs("cluster_diff") > 1) | (F.abs("actionability_diff") > 0.5) | (F.abs("severity_diff") > 0.5) | (F.abs("priority_diff") > 5)
    overlap = F.when(most > 0, F.least("n_1", "n_2") / most * 100).otherwise(F.lit(100.0))
    return row.select("cluster_diff", "actionability_diff", "severity_diff", "priority_diff", overlap.alias("overlap_pct"), score.alias("match_score"), big.alias("significant"))


def benchmark(pair: DataFrame) -> DataFrame:
    """One row: v2 against v1. ``pair``: seconds, memory, throughput, clusters, high, medium, low, each with _1 and _2."""
    c = F.col
    gain = lambda name, sign: sign * F.try_divide((c(f"{name}_2") - c(f"{name}_1")) * 100.0, c(f"{name}_1"))
    dot = sum(c(f"{k}_1") * c(f"{k}_2") for k in ("high", "medium", "low"))
    size = lambda i: F.sqrt(sum(c(f"{k}_{i}") * c(f"{k}_{i}") for k in ("high", "medium", "low")))
    out = pair.select(
        gain("seconds", -1).alias("runtime_pct"),
        gain("memory", -1).alias("memory_pct"),
        gain("throughput", 1).alias("throughput_pct"),
        F.coalesce(gain("clusters", 1), F.lit(0.0)).alias("clusters_pct"),
        F.coalesce(F.try_divide(dot, size(1) * size(2)), F.lit(0.0)).alias("severity_cosine"),
    )
    stable = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs("clusters_pct") / 100))
    out = out.withColumn("stability", stable)
    speed = c("runtime_pct") / 100 * 0.4 + c("memory_pct") / 100 * 0.2 + c("throughput_pct") / 100 * 0.2
    total = (speed * 0.6 + (c("severity_cosine") * 0.5 + c("stability") * 0.5) * 0.4) * 100
    verdict = F.when(total > 20, "strong").when(total > 10, "recommended").when(total > 0, "marginal").when(total > -10, "neutral").otherwise("regression")
    return out.withColumn("overall", total).withColumn("verdict", verdict)


def evaluation(df: DataFrame, truth: str, guess: str, confidence: str, rating: str, mixed: str) -> DataFrame:
    """One row: recall among actionable reviews of high ratings, accuracy on mixed sentiment and by confidence band."""
    t, g, sure = F.col(truth), F.col(guess), F.col(confidence)
    right = (t == g).cast("int")
    liked = t & (F.col(rating) >= 4)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return df.agg(
        F.count_if(liked).alias("liked"),
        zero(F.avg(F.when(liked, g.cast("int")))).alias("liked_recall"),
        zero(F.avg(F.when(liked, sure))).alias("liked_confidence"),
        F.count_if(mixed).alias("mixed"),
        zero(F.avg(F.when(F.col(mixed), right))).alias("mixed_accuracy"),
        F.count_if(sure >= 0.8).alias("sure"),
        zero(F.avg(F.when(sure >= 0.8, right))).alias("sure_accuracy"),
        F.count_if(sure < 0.6).alias("unsure"),
        zero(F.avg(F.when(sure < 0.6, right))).alias("unsure_accuracy"),
    )


def simple_drift(base: DataFrame, now: DataFrame, rating: str, text: str) -> DataFrame:
    """One row: has the mean rating moved by more than 0.5, or the mean length by more than 30 percent?"""

    def one(df: DataFrame, k: str) -> DataFrame:
        return df.agg(F.avg(rating).alias(f"mean_{k}"), F.avg(F.length(text)).alias(f"length_{k}"), F.count(F.lit(1)).alias(f"rows_{k}"))

    shift, relative = F.abs(F.col("mean_1") - F.col("mean_2")), F.try_divide(F.abs(F.col("length_1") - F.col("length_2")), F.col("length_1"))
    out = one(base, "1").crossJoin(one(now, "2")).select("rows_1", "rows_2", shift.alias("rating_shift"), relative.alias("length_shift"))
    return out.withColumn("drifted", F.coalesce(F.col("rating_shift") > 0.5, F.lit(False)) | F.coalesce(F.col("length_shift") > 0.3, F.lit(False)))


def distinct_bursts(found: DataFrame, group: str, order: list, ids: str = "review_ids") -> DataFrame:
    """Of each group's bursts, by ``order``, those of whose reviews under half are in bursts kept before.

    The choice is greedy, so each depends on those before it; a group's bursts are folded over in their order, inside
    one row per group. Ids of a burst are an array without repeats.
    """
    row = F.struct(*order, *[F.col(c) for c in found.columns if c != group and c not in order])
    start = F.struct(F.expr(f"CAST(array() AS {dict(found.dtypes)[ids]})").alias("used"), F.expr("CAST(array() AS array<int>)").alias("kept"), F.lit(0).alias("i"))

    def step(acc, b):
        fresh = F.size(F.array_intersect(b[ids], acc["used"])) < F.size(b[ids]) * 0.5
        return F.struct(
            F.when(fresh, F.array_union(acc["used"], b[ids])).otherwise(acc["used"]).alias("used"),
            F.when(fresh, F.concat(acc["kept"], F.array(acc["i"]))).otherwise(acc["kept"]).alias("kept"),
            (acc["i"] + 1).alias("i"),
        )

    per = found.groupBy(group).agg(F.array_sort(F.collect_list(row)).alias("b")).withColumn("kept", F.aggregate("b", start, step)["kept"])
    return per.select(group, F.explode(F.transform("kept", lambda i: F.get("b", i))).alias("x")).select(group, *[F.col(f"x.{c}") for c in found.columns if c != group])


def shuffled(parts: list[DataFrame], seed: int, key: str) -> DataFrame:
    """The rows of several tables together (missing columns null), in an order that the seed alone decides."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.orderBy(F.xxhash64(F.lit(seed), key), key)


def balanced(df: DataFrame, label: str, key: str, method: str = "under", seed: int = 42) -> DataFrame:
    """As many rows of each label: the rarest one's number (under), or the commonest one's (over, by whole repeats and a rest).

    Which rows go or repeat is decided by a hash of ``key``.
    """
    from pyspark.sql.window import Window

    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    goal = sizes.agg((F.min if method == "under" else F.max)("_n").alias("_goal"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), key), key))
    rows = df.join(F.broadcast(sizes), label).crossJoin(F.broadcast(goal)).withColumn("_r", rank)
    times = F.floor(F.col("_goal") / F.col("_n")).cast("int") + (F.col("_r") <= F.col("_goal") % F.col("_n")).cast("int")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), times))).where("copy > 0").drop("_n", "_goal", "_r")
