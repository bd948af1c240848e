"""Catalog queries of summaries, comparisons and reads that stand beside those of ``catalog`` and ``monitoring``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import text as X
from ..operators import issues, quality, scoring, summaries
from ..sources.reviews import CLUSTERS_SQL, REVIEWS_SQL, RUNS_SQL, clusters, reviews, runs
from . import monitoring  # noqa: F401  (its queries are built upon here)
from .catalog import _HYBRID, FEATURES_SQL, ORACLE, QUERIES, featured, query

R, C = f"WITH {REVIEWS_SQL}", f"WITH {CLUSTERS_SQL}"


def rounded(df, *but, digits: int = 6):
    """``df`` with its double columns rounded."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in but else F.col(c) for c, t in df.dtypes])


@query("a13_uncertainty_stats", f"{R}, u AS (SELECT abs(rating - 3) / 4.0::DOUBLE AS u FROM reviews) SELECT count(u) AS n, round(avg(u), 6) AS mean, round(stddev_pop(u), 6) AS std, round(quantile_cont(u, 0.5), 6) AS median, round(quantile_cont(u, 0.25), 6) AS p25, round(quantile_cont(u, 0.75), 6) AS p75, round(quantile_cont(u, 0.95), 6) AS p95, round(avg((u > 0.3)::INT), 6) AS rate_above FROM u")
def a13(spark, d):
    u = reviews(spark, d).withColumn("u", F.abs(F.col("rating") - 3) / F.lit(4.0))
    return rounded(summaries.distribution(u, "u", {"p25": 0.25, "p75": 0.75, "p95": 0.95}, 0.3))


@query("a14_confidence_stats", f"{FEATURES_SQL}, h AS (SELECT ({_HYBRID})[2]::DOUBLE AS c FROM f) SELECT count(c) AS n, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std, round(quantile_cont(c, 0.5), 6) AS median, round(quantile_cont(c, 0.05), 6) AS p05, round(quantile_cont(c, 0.95), 6) AS p95 FROM h")
def a14(spark, d):
    _, sure = scoring.hybrid_rule(None)
    return rounded(summaries.distribution(featured(spark, d).select(sure.alias("c")), "c", {"p05": 0.05, "p95": 0.95}))


_SCORED = f"""{FEATURES_SQL}, h AS (SELECT *, {_HYBRID} AS h, abs(rating - 3) / 4.0::DOUBLE AS uncertainty FROM f),
s AS (SELECT *, h[1] = 1 AS guess, h[2]::DOUBLE AS confidence FROM h)"""


def scored(spark, d):
    yes, sure = scoring.hybrid_rule(None)
    return featured(spark, d).withColumn("guess", yes).withColumn("confidence", sure).withColumn("uncertainty", F.abs(F.col("rating") - 3) / F.lit(4.0))


@query("a4_business_summary", f"""{_SCORED},
a AS (SELECT count(*) AS n, coalesce(count_if(is_actionable), 0) AS actionable, avg(confidence) AS avg_confidence, avg(guess::INT) AS avg_score, count_if(has_retention_signal) AS retention, count_if(has_monetization_complaint) AS money,
  sum(feature_request_count)::BIGINT AS feature_requests, count_if(has_concession) AS mixed, coalesce(count_if(rating >= 4 AND is_actionable), 0) AS happy_issues, count_if(rating >= 4) AS happy, count_if(uncertainty > 0.3) AS uncertain FROM s)
SELECT n, actionable, round(actionable / n, 6) AS actionable_rate, round(avg_score, 6) AS avg_score, round(avg_confidence, 6) AS avg_confidence, retention, money, feature_requests, mixed, happy_issues, uncertain,
  CASE WHEN retention > n * 0.05 THEN 'critical' WHEN retention > n * 0.02 THEN 'medium' ELSE 'low' END AS retention_severity, CASE WHEN money > n * 0.1 THEN 'high' WHEN money > n * 0.05 THEN 'medium' ELSE 'low' END AS money_severity,
  CASE WHEN happy_issues > 10 THEN 'critical' WHEN happy_issues > 5 THEN 'medium' ELSE 'low' END AS reputation_severity, round(happy_issues / happy, 6) AS happy_issue_rate, round(feature_requests * 0.1::DOUBLE + mixed * 0.05::DOUBLE, 6) AS opportunity FROM a""")
def a4(spark, d):
    return rounded(summaries.business_summary(scored(spark, d).withColumn("score", F.col("guess").cast("int"))))


@query("f9_f10_slices", f"{_SCORED} SELECT review_id, confidence >= 0.7 AS confident, uncertainty > 0.3 AS uncertain FROM s WHERE confidence >= 0.7 OR uncertainty > 0.3")
def f9(spark, d):
    out = scored(spark, d).select("review_id", (F.col("confidence") >= 0.7).alias("confident"), (F.col("uncertainty") > 0.3).alias("uncertain"))
    return out.where("confident OR uncertain")


@query("a31_evaluation", f"""{_SCORED} SELECT count_if(is_actionable AND rating >= 4) AS liked, round(coalesce(avg(CASE WHEN is_actionable AND rating >= 4 THEN guess::INT END), 0), 6)::DOUBLE AS liked_recall,
  round(coalesce(avg(CASE WHEN is_actionable AND rating >= 4 THEN confidence END), 0), 6)::DOUBLE AS liked_confidence, count_if(both_) AS mixed, round(coalesce(avg(CASE WHEN both_ THEN (is_actionable = guess)::INT END), 0), 6)::DOUBLE AS mixed_accuracy,
  count_if(confidence >= 0.8) AS sure, round(coalesce(avg(CASE WHEN confidence >= 0.8 THEN (is_actionable = guess)::INT END), 0), 6)::DOUBLE AS sure_accuracy, count_if(confidence < 0.6) AS unsure,
  round(coalesce(avg(CASE WHEN confidence < 0.6 THEN (is_actionable = guess)::INT END), 0), 6)::DOUBLE AS unsure_accuracy
FROM (SELECT *, positive_words > 0 AND negative_words > 0 AS both_ FROM s WHERE is_actionable IS NOT NULL)""")
def a31(spark, d):
    rows = scored(spark, d).where("is_actionable IS NOT NULL").withColumn("both", (F.col("positive_words") > 0) & (F.col("negative_words") > 0))
    return rounded(summaries.evaluation(rows, "is_actionable", "guess", "confidence", "rating", "both"))


@query("a9_size_histogram", f"{R}, s AS (SELECT count(*) AS size FROM reviews WHERE cluster_id IS NOT NULL GROUP BY cluster_id, upload_id) SELECT size, count(*) AS clusters FROM s GROUP BY size")
def a9(spark, d):
    return reviews(spark, d).where("cluster_id IS NOT NULL").groupBy("cluster_id", "upload_id").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("clusters"))


@query("a20_version_counts", f"""{R}, v AS (SELECT upload_id, nullif(regexp_extract(lower(content), 'v?(\\d+\\.\\d+(?:\\.\\d+)?)', 0), '') AS version, count(*) AS n FROM reviews GROUP BY ALL)
SELECT upload_id, version, n, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY n DESC, version) AS r FROM v WHERE version IS NOT NULL) WHERE r <= 5""")
def a20(spark, d):
    per = reviews(spark, d).withColumn("version", X.version_in(F.col("content"))).where("version IS NOT NULL").groupBy("upload_id", "version").agg(F.count(F.lit(1)).alias("n"))
    return issues.top_per_group(per, ["upload_id"], [F.desc("n"), "version"], 5).select("upload_id", "version", "n", "rank")


_DEVICE = f"CASE {' '.join(f"WHEN contains(lower(content), '{x}') THEN '{x.capitalize()}'" for x in lex.DEVICES)} END"


@query("a22_devices", f"{R}, v AS (SELECT DISTINCT upload_id, {_DEVICE} AS v FROM reviews) SELECT upload_id, coalesce(list(v ORDER BY v) FILTER (v IS NOT NULL), []) AS devices FROM v GROUP BY upload_id")
def a22(spark, d):
    return reviews(spark, d).groupBy("upload_id").agg(F.array_sort(F.collect_set(X.device_in(F.col("content")))).alias("devices"))


_LEVELLED = f"""{C}, g AS (SELECT *, CASE severity WHEN 'critical' THEN 'P0' WHEN 'high' THEN 'P1' WHEN 'medium' THEN 'P2' ELSE 'P3' END AS p, least(5, review_count)::DOUBLE AS actionability, review_count * 10 AS priority FROM clusters)"""


def levelled(spark, d):
    c = clusters(spark, d)
    p = F.when(F.col("severity") == "critical", "P0").when(F.col("severity") == "high", "P1").when(F.col("severity") == "medium", "P2").otherwise("P3")
    return c.withColumn("severity", p).withColumn("actionability", F.least(F.lit(5), "review_count").cast("double")).withColumn("priority", F.col("review_count") * 10)


@query("a24_version_match", f"""{_LEVELLED}, w AS (SELECT *, CASE p WHEN 'P0' THEN 5 WHEN 'P1' THEN 4 WHEN 'P2' THEN 3 ELSE 2 END AS w FROM g),
x AS (SELECT count(*) AS n, coalesce(avg(actionability), 0) AS a, coalesce(avg(w), 0) AS s, count_if(priority > 50) AS p FROM w WHERE status = 'open'),
y AS (SELECT count(*) AS n, coalesce(avg(actionability), 0) AS a, coalesce(avg(w), 0) AS s, count_if(priority > 50) AS p FROM w WHERE status = 'resolved'),
k AS (SELECT y.n - x.n AS cluster_diff, y.a - x.a AS ad, y.s - x.s AS sd, y.p - x.p AS priority_diff, greatest(x.n, y.n) AS most, least(x.n, y.n) AS least_ FROM x, y)
SELECT cluster_diff, round(ad, 6) AS actionability_diff, round(sd, 6) AS severity_diff, priority_diff, round(CASE WHEN most > 0 THEN least_ / most * 100 ELSE 100 END, 6)::DOUBLE AS overlap_pct,
  round((CASE WHEN most > 0 THEN 1 - abs(cluster_diff) / most ELSE 1 END + 1 - abs(ad) / 5 + 1 - abs(sd) / 5) / 3, 6)::DOUBLE AS match_score, abs(cluster_diff) > 1 OR abs(ad) > 0.5 OR abs(sd) > 0.5 OR abs(priority_diff) > 5 AS significant FROM k""")
def a24(spark, d):
    c = levelled(spark, d)
    return rounded(summaries.version_match(c.where("status = 'open'"), c.where("status = 'resolved'")))


@query("a25_benchmark", f"""{C}, m AS (SELECT (status = 'open') AS one, sum(review_count)::DOUBLE AS seconds, max(review_count)::DOUBLE AS memory, avg(review_count) AS throughput, count(*)::DOUBLE AS clusters,
  count_if(severity IN ('critical', 'high'))::DOUBLE AS high, count_if(severity = 'medium')::DOUBLE AS medium, count_if(severity = 'low')::DOUBLE AS low FROM clusters GROUP BY 1),
p AS (SELECT (a.seconds - b.seconds) / a.seconds * 100 AS runtime_pct, (a.memory - b.memory) / a.memory * 100 AS memory_pct, (b.throughput - a.throughput) / a.throughput * 100 AS throughput_pct, coalesce((b.clusters - a.clusters) / nullif(a.clusters, 0) * 100, 0) AS clusters_pct,
  coalesce((a.high * b.high + a.medium * b.medium + a.low * b.low) / nullif(sqrt(a.high ** 2 + a.medium ** 2 + a.low ** 2) * sqrt(b.high ** 2 + b.medium ** 2 + b.low ** 2), 0), 0) AS severity_cosine FROM m a, m b WHERE a.one AND NOT b.one),
q AS (SELECT *, greatest(0, least(1, 1 - abs(clusters_pct) / 100)) AS stability FROM p),
r AS (SELECT *, ((runtime_pct / 100 * 0.4::DOUBLE + memory_pct / 100 * 0.2::DOUBLE + throughput_pct / 100 * 0.2::DOUBLE) * 0.6::DOUBLE + (severity_cosine * 0.5::DOUBLE + stability * 0.5::DOUBLE) * 0.4::DOUBLE) * 100 AS overall FROM q)
SELECT round(runtime_pct, 6) AS runtime_pct, round(memory_pct, 6) AS memory_pct, round(throughput_pct, 6) AS throughput_pct, round(clusters_pct, 6) AS clusters_pct, round(severity_cosine, 6) AS severity_cosine, round(stability, 6)::DOUBLE AS stability, round(overall, 6) AS overall,
  CASE WHEN overall > 20 THEN 'strong' WHEN overall > 10 THEN 'recommended' WHEN overall > 0 THEN 'marginal' WHEN overall > -10 THEN 'neutral' ELSE 'regression' END AS verdict FROM r""")
def a25(spark, d):
    c = clusters(spark, d)

    def one(status: str, k: str):
        s = F.col("severity")
        figures = {"seconds": F.sum("review_count"), "memory": F.max("review_count"), "throughput": F.avg("review_count"), "clusters": F.count(F.lit(1)), "high": F.count_if(s.isin("critical", "high")), "medium": F.count_if(s == "medium"), "low": F.count_if(s == "low")}
        return c.where(F.col("status") == status).agg(*[x.cast("double").alias(f"{n}_{k}") for n, x in figures.items()])

    return rounded(summaries.benchmark(one("open", "1").crossJoin(one("resolved", "2"))))


@query("a26_digest_regressions", f"WITH {RUNS_SQL}, l AS (SELECT *, lag(severity_rank) OVER w AS pr, lag(review_count) OVER w AS pn FROM runs WINDOW w AS (PARTITION BY tenant_id, issue_fingerprint ORDER BY run_seq)) SELECT tenant_id, count(*) AS runs, count_if(pr IS NOT NULL AND (severity_rank > pr OR review_count > pn * 1.5)) AS regressions FROM l GROUP BY tenant_id")
def a26(spark, d):
    r = issues.regression_status(runs(spark, d), ["tenant_id", "issue_fingerprint"], ["run_seq"])
    return r.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("regression_status").startswith("REGRESSED")).alias("regressions"))


@query("w3_lag_by_run", f"WITH {RUNS_SQL}, l AS (SELECT lag(run_seq) OVER (PARTITION BY tenant_id, issue_fingerprint, run_seq ORDER BY run_seq) AS p FROM runs) SELECT count(*) AS n, count_if(p IS NULL) AS n_new FROM l")
def w3(spark, d):
    alone = runs(spark, d).withColumn("cluster", F.concat_ws("/", "tenant_id", "issue_fingerprint", "run_seq"))
    return issues.regression_status(alone, ["cluster"], ["run_seq"]).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("regression_status") == "NEW").alias("n_new"))


@query("w5_top10_per_severity", f"{C} SELECT severity, cluster_id, r AS rank FROM (SELECT severity, cluster_id, row_number() OVER (PARTITION BY severity ORDER BY review_count DESC, cluster_id) AS r FROM clusters) WHERE r <= 10")
def w5(spark, d):
    return issues.top_per_group(clusters(spark, d), ["severity"], [F.desc("review_count"), "cluster_id"], 10).select("severity", "cluster_id", "rank")


@query("t3_dashboard", f"SELECT cluster_id, priority_score FROM ({ORACLE['j3_j4_p6_mart']}) ORDER BY priority_score DESC, cluster_id LIMIT 50")
def t3(spark, d):
    return QUERIES["j3_j4_p6_mart"](spark, d).select("cluster_id", "priority_score").orderBy(F.desc("priority_score"), "cluster_id").limit(50)


@query("t6_high_risk", f"SELECT review_id, greatest(fake_positive, sarcasm, spam) AS suspicion FROM ({ORACLE['p26_p28_adversarial']}) ORDER BY suspicion DESC, review_id LIMIT 20")
def t6(spark, d):
    out = QUERIES["p26_p28_adversarial"](spark, d).select("review_id", F.greatest("fake_positive", "sarcasm", "spam").alias("suspicion"))
    return out.orderBy(F.desc("suspicion"), "review_id").limit(20)


@query("t8_spikes", f"""WITH {RUNS_SQL}, a AS (SELECT issue_fingerprint, sum(review_count)::BIGINT AS n FROM runs WHERE run_seq = 0 GROUP BY 1), b AS (SELECT issue_fingerprint, sum(review_count)::BIGINT AS n FROM runs WHERE run_seq = 1 GROUP BY 1)
SELECT issue_fingerprint, a.n AS n_old, b.n AS n_new, round((b.n - a.n) * 100.0 / a.n, 6)::DOUBLE AS growth, growth > 50 AND b.n - a.n > 10 AS is_spike FROM a JOIN b USING (issue_fingerprint) ORDER BY growth DESC, issue_fingerprint""")
def t8(spark, d):
    one = lambda k, name: runs(spark, d).where(F.col("run_seq") == k).groupBy("issue_fingerprint").agg(F.sum("review_count").alias(name))
    both = one(0, "n_old").join(one(1, "n_new"), "issue_fingerprint")
    growth = F.round((F.col("n_new") - F.col("n_old")) * 100.0 / F.col("n_old"), 6).cast("double")
    both = both.withColumn("growth", growth).withColumn("is_spike", (F.col("growth") > 50) & (F.col("n_new") - F.col("n_old") > 10))
    return both.orderBy(F.desc("growth"), "issue_fingerprint")


@query("p36_simple_drift", f"""{R}, a AS (SELECT avg(rating) AS m, avg(len(content)) AS l, count(*) AS n FROM reviews WHERE review_id % 2 = 0), b AS (SELECT avg(rating) AS m, avg(len(content)) AS l, count(*) AS n FROM reviews WHERE review_id % 2 = 1)
SELECT a.n AS rows_1, b.n AS rows_2, round(abs(a.m - b.m), 6) AS rating_shift, round(abs(a.l - b.l) / a.l, 6) AS length_shift, abs(a.m - b.m) > 0.5 OR abs(a.l - b.l) / a.l > 0.3 AS drifted FROM a, b""")
def p36(spark, d):
    r = reviews(spark, d)
    return rounded(summaries.simple_drift(r.where("review_id % 2 = 0"), r.where("review_id % 2 = 1"), "rating", "content"))


_KS = """v AS (SELECT value AS x, count_if(event_id % 2 = 0) AS a, count_if(event_id % 2 = 1) AS b FROM events WHERE value IS NOT NULL GROUP BY value),
c AS (SELECT sum(a) OVER (ORDER BY x) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY x) / sum(b) OVER () AS fb, sum(a) OVER ()::DOUBLE AS na, sum(b) OVER ()::DOUBLE AS nb FROM v),
l AS (SELECT max(abs(fa - fb)) AS statistic, any_value(sqrt(na * nb / (na + nb))) * max(abs(fa - fb)) AS lam FROM c),
ks AS (SELECT statistic, CASE WHEN lam < 0.2 THEN 1.0::DOUBLE ELSE greatest(0, least(1, list_sum(list_transform(range(1, 30), lambda k: 2 * (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0::DOUBLE * k * k * lam * lam))))) END AS p FROM l)"""


@query("d2_ks_p_value", f"WITH {_KS} SELECT round(statistic, 9) AS statistic, round(p, 6) AS p_value FROM ks")
def d2(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    out = quality.ks(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "value")
    return out.select(F.round("statistic", 9).alias("statistic"), F.round("p_value", 6).alias("p_value"))


@query("d3_measured_severity", f"WITH {_KS}, x AS ({ORACLE['d1_psi']}) SELECT CASE WHEN psi > 0.25 AND p < 0.01 THEN 'high' WHEN psi > 0.1 OR p < 0.05 THEN 'medium' ELSE 'none' END AS severity FROM x, ks")
def d3(spark, d):
    return QUERIES["d1_psi"](spark, d).crossJoin(F.broadcast(d2(spark, d))).select(quality.drift_severity(F.col("psi"), F.col("p_value")).alias("severity"))


@query("d4_top_new_words", f"""{R}, a AS (SELECT DISTINCT unnest(list_filter(string_split_regex(lower(content), '\\s+'), lambda w: w <> '')) AS w FROM reviews WHERE review_id % 2 = 0),
b AS (SELECT w, count(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(lower(content), '\\s+'), lambda w: w <> '')) AS w FROM reviews WHERE review_id % 2 = 1) GROUP BY w)
SELECT w AS word, n FROM b ANTI JOIN a USING (w) ORDER BY n DESC, word LIMIT 20""")
def d4(spark, d):
    r = reviews(spark, d)
    words = lambda k: r.where(F.col("review_id") % 2 == k).select(F.explode(X.tokens(F.col("content"))).alias("word"))
    return words(1).groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(words(0).distinct(), "word", "left_anti").orderBy(F.desc("n"), "word").limit(20)


@query("d5_neutral_shift", f"{R} SELECT round(avg((rating = 3)::INT) FILTER (review_id % 2 = 1) - avg((rating = 3)::INT) FILTER (review_id % 2 = 0), 9) AS neutral_shift FROM reviews")
def d5(spark, d):
    share = lambda k: F.avg(F.when(F.col("review_id") % 2 == k, (F.col("rating") == 3).cast("int")))
    return reviews(spark, d).agg(F.round(share(1) - share(0), 9).alias("neutral_shift"))


@query("d7_reliability_bins", f"""{R}, x AS (SELECT (rating - 1) / 4.0::DOUBLE AS p, is_actionable::INT::DOUBLE AS y FROM reviews WHERE is_actionable IS NOT NULL)
SELECT (ceil(p * 10) - 1)::INT AS bin, count(*) AS n, round(avg(p), 9) AS confidence, round(avg(y), 9) AS accuracy FROM x WHERE p > 0 GROUP BY 1""")
def d7(spark, d):
    r = reviews(spark, d).where("is_actionable IS NOT NULL").select(((F.col("rating") - 1) / 4.0).cast("double").alias("p"), F.col("is_actionable").cast("int").alias("y"))
    per = r.where("p > 0").groupBy((F.ceil(F.col("p") * 10) - 1).cast("int").alias("bin"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 9).alias("confidence"), F.round(F.avg("y"), 9).alias("accuracy"))


@query("x10_x11_names", f"""{C} SELECT cluster_id, regexp_replace('[' || upper(severity) || '] Issue: ' || title, '^\\[(CRITICAL|HIGH|MEDIUM|LOW)\\]\\s*(Issue:\\s*)?', '', 'i') AS title, 'My App ' || upload_id AS app FROM clusters""")
def x10(spark, d):
    raw = F.concat(F.lit("["), F.upper("severity"), F.lit("] Issue: "), F.col("title"))
    return clusters(spark, d).select("cluster_id", X.clean_title(raw).alias("title"), X.app_name(F.concat(F.lit("my_app-"), F.col("upload_id"), F.lit(".csv"))).alias("app"))


@query("x12_device_platform", f"""{R}, v AS (SELECT upload_id, list(DISTINCT lower({_DEVICE})) FILTER ({_DEVICE} IS NOT NULL) AS v FROM reviews GROUP BY upload_id),
p AS (SELECT upload_id, len(list_filter(v, lambda x: x IN ({', '.join(f"'{w}'" for w in lex.ANDROID_WORDS)}))) > 0 AS a, len(list_filter(v, lambda x: x IN ({', '.join(f"'{w}'" for w in lex.IOS_WORDS)}))) > 0 AS i FROM v)
SELECT upload_id, CASE WHEN a AND i THEN 'both' WHEN a THEN 'android' WHEN i THEN 'ios' ELSE 'unknown' END AS platform FROM p""")
def x12(spark, d):
    per = reviews(spark, d).groupBy("upload_id").agg(F.collect_set(X.device_in(F.col("content"))).alias("devices"))
    return per.select("upload_id", X.platform_of_devices(F.col("devices")).alias("platform"))


@query("x13_type_of_title_and_keywords", f"""{C}, t AS (SELECT cluster_id, lower(title || ' ' || array_to_string(keywords, ' ')) AS t FROM clusters)
SELECT cluster_id, CASE {' '.join(f"WHEN regexp_matches(t, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in lex.CLUSTER_TYPES)} ELSE 'bug' END AS kind FROM t""")
def x13(spark, d):
    return clusters(spark, d).select("cluster_id", X.cluster_type(F.concat_ws(" ", "title", F.array_join("keywords", " "))).alias("kind"))


@query("u2_shuffled_union", f"{R} SELECT review_id, rating, CASE WHEN review_id % 2 = 1 THEN title END AS title FROM reviews")
def u2(spark, d):
    r = reviews(spark, d)
    parts = [r.where("review_id % 2 = 0").select("review_id", "rating"), r.where("review_id % 2 = 1").select("review_id", "rating", "title")]
    return summaries.shuffled(parts, 42, "review_id")


@query("p25_balanced", f"{R}, n AS (SELECT is_actionable AS y, count(*) AS n FROM reviews WHERE is_actionable IS NOT NULL GROUP BY 1) SELECT 'under' AS method, y AS label, (SELECT min(n) FROM n) AS n FROM n UNION ALL SELECT 'over', y, (SELECT max(n) FROM n) FROM n")
def p25(spark, d):
    r = reviews(spark, d).where("is_actionable IS NOT NULL").select("review_id", F.col("is_actionable").alias("label"))
    count = lambda m: summaries.balanced(r, "label", "review_id", m).groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit(m).alias("method"), "label", "n")
    return count("under").unionByName(count("over"))


@query("s9_fingerprinted_load", f"SELECT c.cluster_id, c.keywords, f.* EXCLUDE (cluster_id) FROM (SELECT cluster_id, keywords FROM ({ORACLE['s9_cluster_load']})) c JOIN ({ORACLE['x5_fingerprint']}) f USING (cluster_id)")
def s9(spark, d):
    return QUERIES["s9_cluster_load"](spark, d).select("cluster_id", "keywords").join(QUERIES["x5_fingerprint"](spark, d), "cluster_id")


@query("u7_distinct_bursts")
def u7(spark, d):
    """Windows of 48 hours that start every 12, by upload, of 2 reviews or more; larger ones first."""
    r = reviews(spark, d).where("upload_id IS NOT NULL").select("upload_id", "review_id", F.window(F.col("at").cast("timestamp"), "48 hours", "12 hours").alias("w"))
    found = r.groupBy("upload_id", F.unix_timestamp("w.start").alias("start")).agg(F.array_sort(F.collect_set("review_id")).alias("review_ids"))
    found = found.where(F.size("review_ids") >= 2).withColumn("rank", -F.size("review_ids"))
    return summaries.distinct_bursts(found, "upload_id", ["rank", "start"]).select("upload_id", "start", "review_ids")
