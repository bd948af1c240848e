"""More catalog queries: reads, snapshots, monitoring and model quality."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicons as lex
from ..functions import text as X
from ..operators import issues, monitoring, quality, scoring, similarity
from ..sources import readers
from ..sources.reviews import CLUSTERS_SQL, REVIEWS_SQL, RUNS_SQL, clusters, reviews, runs
from .catalog import _TFIDF, FEATURE_COLUMNS, FEATURE_RATIOS, FEATURES_SQL, TOKENS, _any, featured, query

R, C = f"WITH {REVIEWS_SQL}", f"WITH {CLUSTERS_SQL}"


@query("f8_uncertain", f"{R} SELECT review_id, round(abs(rating - 3) / 4.0, 6)::DOUBLE AS uncertainty FROM reviews WHERE abs(rating - 3) / 4.0 >= 0.3 ORDER BY uncertainty DESC, review_id LIMIT 100")
def f8(spark, d):
    u = F.round(F.abs(F.col("rating") - 3) / 4.0, 6).cast("double")
    return reviews(spark, d).select("review_id", u.alias("uncertainty")).where("uncertainty >= 0.3").orderBy(F.desc("uncertainty"), "review_id").limit(100)


@query("f9_confident", f"{FEATURES_SQL} SELECT review_id, mixed_sentiment FROM f WHERE (is_actionable AND rating >= 4) OR mixed_sentiment")
def f9(spark, d):
    return featured(spark, d).where((X.yes(F.col("is_actionable")) & (F.col("rating") >= 4)) | F.col("mixed_sentiment")).select("review_id", "mixed_sentiment")


@query("f10_a3_a4_signals", f"""{FEATURES_SQL} SELECT rating, count(*) AS n, coalesce(count_if(is_actionable), 0) AS n_actionable, count_if(has_retention_signal) AS retention, count_if(has_monetization_complaint) AS money, round(avg(word_count), 6) AS mean_words FROM f GROUP BY rating""")
def f10(spark, d):
    return featured(spark, d).groupBy("rating").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_actionable").alias("n_actionable"), F.count_if("has_retention_signal").alias("retention"), F.count_if("has_monetization_complaint").alias("money"), F.round(F.avg("word_count"), 6).alias("mean_words"))


@query("a1_a2_rollup", f"{R} SELECT cluster_id, count(*) AS n, coalesce(count_if(is_actionable), 0) AS actionable, round(avg(rating), 6) AS mean_rating FROM reviews WHERE cluster_id IS NOT NULL GROUP BY cluster_id")
def a1(spark, d):
    return reviews(spark, d).where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_actionable").alias("actionable"), F.round(F.avg("rating"), 6).alias("mean_rating"))


@query("a5_top_values", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def a5(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("a6_snapshot", f"""{R}, w AS (SELECT upload_id, w, count(*) AS n FROM (SELECT upload_id, unnest({TOKENS}) AS w FROM reviews) WHERE len(w) > 3 GROUP BY ALL),
k AS (SELECT upload_id, list(w ORDER BY n DESC, w) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY n DESC, w) AS r FROM w) WHERE r <= 10 GROUP BY upload_id)
SELECT upload_id, arg_min(title, review_id) AS theme, count(*) AS size, round(avg(rating), 6) AS severity, any_value(keywords) AS keywords FROM reviews JOIN k USING (upload_id) GROUP BY upload_id""")
def a6(spark, d):
    return monitoring.snapshot(reviews(spark, d), "upload_id", "title", {"severity": "rating"}, "review_id", "content").withColumn("severity", F.round("severity", 6))


@query("a8_volume", "SELECT round(100.0 * (count_if(event_id % 3 = 0) - count_if(event_id % 3 = 1)) / nullif(count_if(event_id % 3 = 1), 0), 6)::DOUBLE AS volume_change_pct FROM events")
def a8(spark, d):
    old, new = (F.count_if(F.col("event_id") % 3 == k) for k in (1, 0))
    return spark.read.parquet(f"{d}/events.parquet").agg(F.round(F.try_divide(100.0 * (new - old), F.nullif(old, F.lit(0))), 6).cast("double").alias("volume_change_pct"))


@query("a8_volume_halves", """WITH c AS (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) / 2.0 AS cut FROM events), n AS (SELECT count_if(epoch_us(ts) < cut) AS old, count_if(epoch_us(ts) >= cut) AS new FROM events, c)
SELECT old::BIGINT AS n_old, new::BIGINT AS n_new, round(100.0 * (new::BIGINT - old::BIGINT) / nullif(old::BIGINT, 0), 6)::DOUBLE AS volume_change_pct FROM n""")
def a8_halves(spark, d):
    """The first and the second half of the time hold every event that has a time."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    cut = e.agg(((F.min("t") + F.max("t")) / 2.0).alias("cut"))
    n = e.crossJoin(F.broadcast(cut)).agg(F.count_if(F.expr("t < cut")).alias("n_old"), F.count_if(F.expr("t >= cut")).alias("n_new"))
    return n.withColumn("volume_change_pct", F.round(F.try_divide(100.0 * (F.col("n_new") - F.col("n_old")), F.nullif("n_old", F.lit(0))), 6).cast("double"))


@query("a9_cluster_sizes", f"{R}, s AS (SELECT cluster_id, upload_id, count(*) AS size FROM reviews WHERE cluster_id IS NOT NULL GROUP BY ALL) SELECT count(*) AS clusters, round(avg(size), 6) AS mean_size, round(stddev_pop(size), 6) AS std_size, max(size) AS largest, min(size) AS smallest, round(avg((size = 1)::INT), 6) AS singleton_rate FROM s")
def a9(spark, d):
    out = monitoring.size_stats(clusters_of(spark, d), "k")
    return out.select("clusters", *[F.round(c, 6).alias(c) for c in ("mean_size", "std_size")], "largest", "smallest", F.round("singleton_rate", 6).alias("singleton_rate"))


def clusters_of(spark, d):
    return reviews(spark, d).where("cluster_id IS NOT NULL").withColumn("k", F.struct("cluster_id", "upload_id"))


@query("a13_a14_distribution", f"{R}, u AS (SELECT abs(rating - 3) / 4.0::DOUBLE AS u FROM reviews) SELECT CASE WHEN u < 0.1 THEN 0 WHEN u < 0.2 THEN 1 WHEN u < 0.3 THEN 2 WHEN u < 0.5 THEN 3 ELSE 4 END AS bin, count(*) AS n FROM u GROUP BY 1")
def a13(spark, d):
    return monitoring.bins(reviews(spark, d).withColumn("u", F.abs(F.col("rating") - 3) / F.lit(4.0)), "u", [0.0, 0.1, 0.2, 0.3, 0.5, 1.0])


@query("a15_signal_rates", f"{FEATURES_SQL} SELECT round(avg(has_concession::INT), 9) AS concession, round(avg(has_retention_signal::INT), 9) AS retention, round(avg(has_bug_keywords::INT), 9) AS bugs FROM f")
def a15(spark, d):
    return featured(spark, d).agg(*[F.round(F.avg(F.col(c).cast("int")), 9).alias(n) for n, c in (("concession", "has_concession"), ("retention", "has_retention_signal"), ("bugs", "has_bug_keywords"))])


@query("a22_distinct_devices", f"""{R}, v AS (SELECT DISTINCT upload_id, nullif(regexp_extract(lower(content), 'v?(\\d+\\.\\d+(?:\\.\\d+)?)', 0), '') AS v FROM reviews) SELECT upload_id, coalesce(list(v ORDER BY v) FILTER (v IS NOT NULL), []) AS versions FROM v GROUP BY upload_id""")
def a22(spark, d):
    return reviews(spark, d).groupBy("upload_id").agg(F.array_sort(F.collect_set(X.version_in(F.col("content")))).alias("versions"))


@query("a23_user_stats", "SELECT user_id, count(*) AS events, sum(json_extract_string(props, '$.k')::INT)::BIGINT AS total, round(avg(value), 6) AS mean_value FROM events GROUP BY user_id")
def a23(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.sum(F.get_json_object("props", "$.k").cast("int")).alias("total"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("a24_a25_version_comparison", f"""{FEATURES_SQL}, a AS (SELECT count_if(rating <= 3) AS kept_v1, count_if(is_actionable IS NULL OR is_actionable) AS kept_v2 FROM f) SELECT *, round(100.0 * (kept_v2 - kept_v1) / kept_v1, 6)::DOUBLE AS change_pct FROM a""")
def a24(spark, d):
    out = reviews(spark, d).agg(F.count_if(F.col("rating") <= 3).alias("kept_v1"), F.count_if(F.col("is_actionable").isNull() | F.col("is_actionable")).alias("kept_v2"))
    return out.select("*", F.round(F.try_divide(100.0 * (F.col("kept_v2") - F.col("kept_v1")), F.col("kept_v1")), 6).cast("double").alias("change_pct"))


@query("a27_u1_table_counts", "SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'pages', count(*) FROM pages")
def a27(spark, d):
    out = None
    for name in ("events", "documents", "pages"):
        one = spark.read.parquet(f"{d}/{name}.parquet").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("a28_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def a28(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("a30_j15_label_impact", f"""{FEATURES_SQL}, h AS (SELECT review_id, rating_value <= 2 AND complaint_verbs > 0 AS n, rating <= 3 AS o FROM f) SELECT count(*) AS n, count_if(n <> o) AS changed FROM h""")
def a30(spark, d):
    f = featured(spark, d)
    row = lambda y: f.select("review_id", y.alias("is_actionable"), F.lit(0.5).alias("confidence"), F.lit(0.1).alias("uncertainty"))
    return monitoring.label_impact(row(F.col("rating") <= 3), row((F.col("rating_value") <= 2) & (F.col("complaint_verbs") > 0)), "review_id").select("n", "changed")


@query("a32_throughput", f"{R} SELECT upload_id, count(*) AS n, CASE WHEN upload_id % 4 = 0 THEN 0 ELSE round(count(*) / (upload_id % 4 * 100) * 1000, 6) END::DOUBLE AS per_second FROM reviews GROUP BY upload_id")
def a32(spark, d):
    per = reviews(spark, d).groupBy("upload_id").agg(F.count(F.lit(1)).alias("n"))
    return per.select("upload_id", "n", F.round(monitoring.throughput(F.col("n"), F.col("upload_id") % 4 * 100), 6).alias("per_second"))


@query("w5_w10_recent", "SELECT user_id, event_id, n AS rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 10")
def w5(spark, d):
    return issues.top_per_group(spark.read.parquet(f"{d}/events.parquet"), ["user_id"], [F.desc("ts"), "event_id"], 10).select("user_id", "event_id", "rank")


@query("w3_lag_by_cluster", f"WITH {RUNS_SQL} SELECT count(*) AS n, count(*) AS n_new FROM runs")
def w3(spark, d):
    alone = runs(spark, d).withColumn("cluster", F.concat_ws("/", "tenant_id", "issue_fingerprint", "run_seq"))
    return issues.regression_status(alone, ["cluster"], ["run_seq"]).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("regression_status") == "NEW").alias("n_new"))


@query("t1_t4_pages", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 20")
def t1(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(20).limit(50)


@query("t5_first_samples", f"{R} SELECT upload_id, review_id, n AS rank FROM (SELECT upload_id, review_id, row_number() OVER (PARTITION BY upload_id ORDER BY review_id) AS n FROM reviews) WHERE n <= 5")
def t5(spark, d):
    return issues.top_per_group(reviews(spark, d), ["upload_id"], ["review_id"], 5).select("upload_id", "review_id", "rank")


@query("t7_oldest_pending", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def t7(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'O'").orderBy("o_orderdate", "o_orderkey").limit(1).select("o_orderkey")


@query("u2_u3_label_sets", f"WITH {RUNS_SQL}, a AS (SELECT DISTINCT issue_fingerprint, tenant_id FROM runs WHERE run_seq = 0), b AS (SELECT DISTINCT issue_fingerprint, tenant_id FROM runs WHERE run_seq = 3) SELECT 'gone' AS side, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'both', * FROM (SELECT * FROM a INTERSECT SELECT * FROM b)")
def u2(spark, d):
    a, b = (runs(spark, d).where(F.col("run_seq") == k).select("issue_fingerprint", "tenant_id").distinct() for k in (0, 3))
    return a.subtract(b).select(F.lit("gone").alias("side"), "*").unionByName(a.intersect(b).select(F.lit("both").alias("side"), "*"))


@query("u8_e4_claims", "SELECT DISTINCT user_id, event_type FROM events WHERE user_id % 7 <> 3")
def u8(spark, d):
    from ..streaming.events import claims

    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", F.concat_ws("/", "user_id", "event_type").alias("id"))
    inbox = e.where("user_id % 7 = 3").select(F.col("id").alias("event_id"), F.lit("warehouse").alias("consumer_name")).distinct()
    return claims(inbox, e, "warehouse").select("user_id", "event_type")


@query("j5_j6_j7_user_clusters", f"{C} SELECT c.cluster_id, u.n_reviews FROM clusters c JOIN (SELECT upload_id, count(*) AS n_reviews FROM reviews WHERE tenant_id = 'de' GROUP BY upload_id) u USING (upload_id) WHERE c.tenant_id = 'de'")
def j5(spark, d):
    uploads = reviews(spark, d).where("tenant_id = 'de'").groupBy("upload_id").agg(F.count(F.lit(1)).alias("n_reviews"))
    return clusters(spark, d).where("tenant_id = 'de'").join(uploads, "upload_id").select("cluster_id", "n_reviews")


@query("j9_cross_platform", f"""{C}, p AS (SELECT *, regexp_matches(lower(title), '\\bandroid\\b|\\bpixel\\b') AS a, regexp_matches(lower(title), '\\biphone\\b') AS i FROM clusters),
v AS (SELECT label, list(m ORDER BY k) AS c FROM (SELECT label, k, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY ALL) GROUP BY label)
SELECT x.cluster_id AS android_id, y.cluster_id AS ios_id FROM p x JOIN p y ON x.a AND y.i AND x.cluster_id <> y.cluster_id AND x.label = y.label""")
def j9(spark, d):
    p = clusters(spark, d).withColumn("low", F.lower("title"))
    a = p.where(F.col("low").rlike(r"\bandroid\b|\bpixel\b")).select(F.col("cluster_id").alias("android_id"), "label")
    i = p.where(F.col("low").rlike(r"\biphone\b")).select(F.col("cluster_id").alias("ios_id"), "label")
    return a.join(i, "label").where("android_id <> ios_id").select("android_id", "ios_id")


@query("j9_cross_platform_cosine", f"""{C}, p AS (SELECT *, regexp_matches(lower(title), '\\bandroid\\b|\\bpixel\\b') AS a, regexp_matches(lower(title), '\\biphone\\b') AS i FROM clusters),
t AS (SELECT * FROM p WHERE a UNION ALL SELECT * FROM p WHERE i), {_TFIDF},
s AS (SELECT x.cluster_id AS android_id, y.cluster_id AS ios_id, round(sum(x.x * y.x), 9) AS cosine FROM u x JOIN u y USING (term) JOIN p q ON q.cluster_id = x.cluster_id AND q.a JOIN p r ON r.cluster_id = y.cluster_id AND r.i WHERE x.cluster_id <> y.cluster_id GROUP BY ALL)
SELECT android_id, ios_id, round(cosine, 3) AS confidence FROM s WHERE cosine >= 0.6""")
def j9_cosine(spark, d):
    p = clusters(spark, d).withColumn("low", F.lower("title"))
    return similarity.cross_platform(p.where(F.col("low").rlike(r"\bandroid\b|\bpixel\b")), p.where(F.col("low").rlike(r"\biphone\b")))


@query("j13_p11_evolution")
def j13(spark, d):
    r = reviews(spark, d).withColumn("s", F.col("rating") / 5.0)
    snap = lambda k: monitoring.snapshot(r.where(F.col("review_id") % 2 == k), "upload_id", "title", {"severity": "s", "actionability": "s"}, "review_id", "title")
    old, new = snap(0), snap(1)
    return monitoring.evolution(old, new, "upload_id", monitoring.matched(old, new, "upload_id"))


@query("j14_p9_emerging")
def j14(spark, d):
    """Uploads are whole: the earlier half of them is the old period, the later half the new one."""
    r = reviews(spark, d).withColumn("s", F.col("rating") / 5.0)
    snap = lambda rows: monitoring.snapshot(rows, "upload_id", "title", {"severity": "s", "actionability": "s"}, "review_id", "title")
    cut = r.agg(F.percentile("upload_id", 0.5).alias("cut"))
    sided = r.crossJoin(F.broadcast(cut)).withColumn("early", X.yes(F.col("upload_id") <= F.col("cut")))
    old, new = snap(sided.where("early")), snap(sided.where("NOT early"))
    return monitoring.emerging(old, new, "upload_id", monitoring.matched(old, new, "upload_id", least=0.95))


@query("j16_v3_nearest_centroid", """WITH u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
c AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u) GROUP BY ALL) GROUP BY label),
s AS (SELECT vec_id, c.label, round(list_dot_product(v, c) / sqrt(list_dot_product(c, c)), 6) AS s FROM u, c), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS n FROM s)
SELECT vec_id, CASE WHEN s >= 0.2 THEN label END AS assigned FROM b WHERE n = 1""")
def j16(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return similarity.nearest_centroid(e, similarity.centroids(e, "label", "embedding"), "embedding", "vec_id", 0.2)


@query("p10_drift_level")
def p10(spark, d):
    r = reviews(spark, d).withColumn("s", F.col("rating") / 5.0)
    snap = lambda k: monitoring.snapshot(r.where(F.col("review_id") % 2 == k), "upload_id", "title", {"severity": "s", "actionability": "s"}, "review_id", "title")
    old, new = snap(0), snap(1)
    pairs = monitoring.matched(old, new, "upload_id")
    return monitoring.drift_level(monitoring.evolution(old, new, "upload_id", pairs), monitoring.emerging(old, new, "upload_id", pairs))


@query("p14_p15_changes", f"""{R}, m AS (SELECT review_id % 2 AS side, avg(rating) AS r, avg(len(content)) AS l FROM reviews GROUP BY 1), t AS (SELECT 'rating' AS metric, r AS v, side, 0.05 AS lim FROM m UNION ALL SELECT 'length', l, side, 0.0001 FROM m)
SELECT a.metric, round(100 * (b.v - a.v) / abs(a.v), 6) AS change_pct, CASE WHEN abs(100 * (b.v - a.v) / a.v) > 200 * a.lim THEN 'high' WHEN abs(100 * (b.v - a.v) / a.v) > 100 * a.lim THEN 'medium' END AS alert FROM t a JOIN t b USING (metric) WHERE a.side = 0 AND b.side = 1""")
def p14(spark, d):
    one = lambda k: monitoring.unpivoted(reviews(spark, d).where(F.col("review_id") % 2 == k).agg(F.avg("rating").alias("rating"), F.avg(F.length("content")).alias("length")))
    return monitoring.changes(one(0), one(1), {"rating": 0.05, "length": 0.0001}).select("metric", F.round("change_pct", 6).alias("change_pct"), "alert")


@query("p21_polarity", f"{FEATURES_SQL} SELECT review_id, round(polarity, 9) AS polarity, mixed_sentiment FROM f")
def p21(spark, d):
    return featured(spark, d).select("review_id", F.round("polarity", 9).alias("polarity"), "mixed_sentiment")


@query("p29_repetition", f"""{R}, t AS (SELECT review_id, content, list_distinct({TOKENS}) AS w FROM reviews), s AS (SELECT content AS c2, w AS w2 FROM t ORDER BY review_id LIMIT 100)
SELECT review_id, count_if(content <> c2 AND len(list_intersect(w, w2)) / len(list_distinct(list_concat(w, w2))) >= 0.9) AS n_similar FROM t, s GROUP BY review_id""")
def p29(spark, d):
    r = reviews(spark, d).select("review_id", "content")
    return monitoring.repeated_texts(r, readers.capped(r, "review_id", 100), "review_id", "content").select("review_id", "n_similar")


@query("p30_j10_j11_coordinated")
def p30(spark, d):
    r = reviews(spark, d).select("review_id", "upload_id", "at", F.col("title"))
    return monitoring.coordinated(r, "upload_id", "at", "title", "review_id", hours=240, similar=0.2)


@query("p34_p36_verdicts", f"""{R}, a AS (SELECT avg((content IS NULL)::INT) AS nulls, 1 - count(DISTINCT content) / count(*) AS dups, stddev_samp(rating) AS spread FROM reviews) SELECT nulls > 0.1 AS null_alert, dups > 0.2 AS duplicate_alert, spread > 1.5 AS rating_alert FROM a""")
def p34(spark, d):
    a = reviews(spark, d).agg(F.avg(F.col("content").isNull().cast("int")).alias("n"), (1 - F.count_distinct("content") / F.count(F.lit(1))).alias("u"), F.stddev_samp("rating").alias("s"))
    return a.select((F.col("n") > 0.1).alias("null_alert"), (F.col("u") > 0.2).alias("duplicate_alert"), (F.col("s") > 1.5).alias("rating_alert"))


@query("d3_drift_severity", "SELECT * FROM (VALUES (0.3, 0.001, 'high'), (0.2, 0.5, 'medium'), (0.05, 0.01, 'medium'), (0.05, 0.5, 'none')) t(psi, p, severity)".replace("(0.3, 0.001", "(0.3::DOUBLE, 0.001::DOUBLE"))
def d3(spark, d):
    rows = spark.createDataFrame([(0.3, 0.001), (0.2, 0.5), (0.05, 0.01), (0.05, 0.5)], "psi double, p double")
    return rows.select("psi", "p", quality.drift_severity(F.col("psi"), F.col("p")).alias("severity"))


@query("d6_embedding_shift", """WITH x AS (SELECT vec_id % 2 AS side, unnest(embedding)::DOUBLE AS x FROM embeddings), a AS (SELECT side, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY side) SELECT round(b.m - a.m, 9) AS mean_shift, round(b.s - a.s, 9) AS std_shift FROM a JOIN a b ON a.side = 0 AND b.side = 1""")
def d6(spark, d):
    x = spark.read.parquet(f"{d}/embeddings.parquet").select((F.col("vec_id") % 2).alias("side"), F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    part = lambda k: x.where(F.col("side") == k).agg(F.avg("x").alias(f"m{k}"), F.stddev_pop("x").alias(f"s{k}"))
    return part(0).crossJoin(part(1)).select(F.round(F.col("m1") - F.col("m0"), 9).alias("mean_shift"), F.round(F.col("s1") - F.col("s0"), 9).alias("std_shift"))


@query("d8_p22_calibrated")
def d8(spark, d):
    """Platt calibration of the rule score by logistic regression, and the ensemble over the features, of every review."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    r = featured(spark, d).withColumns({"label": F.col("is_actionable").cast("double"), "raw": scoring.rule_score(F.col("content"), F.col("rating")).cast("double")})
    scored = scoring.ensemble(r, [*FEATURE_COLUMNS, *FEATURE_RATIOS], "is_actionable")
    points = VectorAssembler(inputCols=["raw"], outputCol="features").transform(scored.select("review_id", "label", "raw", "score", "uncertainty", "confidence"))
    model = LogisticRegression(maxIter=50).fit(VectorAssembler(inputCols=["raw"], outputCol="features").transform(r.where("label IS NOT NULL").select("label", "raw")))
    return model.transform(points).select("review_id", "raw", F.round(vector_to_array("probability")[1], 6).alias("calibrated"), *[F.round(c, 6).alias(c) for c in ("score", "uncertainty", "confidence")])


@query("d9_tfidf_labels")
def d9(spark, d):
    """New labels by TF-IDF similarity of at most 50 words to the old ones."""
    from pyspark.ml.feature import IDF, CountVectorizer, Normalizer
    from pyspark.ml.functions import vector_to_array

    from ..functions import vectors as V

    c = clusters(spark, d).select("cluster_id", "status", X.tokens(F.col("title")).alias("w"))
    tf = CountVectorizer(inputCol="w", outputCol="tf", vocabSize=50).fit(c).transform(c)
    x = Normalizer(inputCol="idf", outputCol="unit").transform(IDF(inputCol="tf", outputCol="idf").fit(tf).transform(tf)).select("cluster_id", "status", vector_to_array("unit").alias("v"))
    titles = x.groupBy("status", "v").agg(F.min("cluster_id").alias("cluster_id"))
    old = titles.where("status = 'resolved'").select(F.col("v").alias("u"))
    best = titles.where("status = 'open'").join(old).groupBy("cluster_id").agg(F.max(V.dot(F.col("v"), F.col("u"))).alias("best"))
    return best.select("cluster_id", F.round("best", 6).alias("best"), (F.col("best") < 0.6).alias("is_new"))


@query("v10_tfidf_vectors")
def v10(spark, d):
    """Offline text vectors: sublinear TF-IDF of words and word pairs, reduced to at most 384 dimensions, at length 1."""
    r = reviews(spark, d).select("review_id", F.col("content").alias("text"))
    return similarity.row_vectors(r, digits=6).select("review_id", "vector")


@query("v11_cache_hits", f"{R}, h AS (SELECT sha256(content) AS k, review_id FROM reviews), c AS (SELECT DISTINCT k FROM h WHERE review_id % 2 = 0) SELECT count(*) AS asked, count(c.k) AS hits, round(count(c.k) / count(*), 9) AS hit_rate FROM h LEFT JOIN c USING (k)")
def v11(spark, d):
    h = reviews(spark, d).select("review_id", F.sha2("content", 256).alias("k"))
    cache = h.where("review_id % 2 = 0").select("k", F.lit(1).alias("hit")).dropDuplicates(["k"])
    return h.join(cache, "k", "left").agg(F.count(F.lit(1)).alias("asked"), F.count("hit").alias("hits"), F.round(F.count("hit") / F.count(F.lit(1)), 9).alias("hit_rate"))


@query("s4_capped_scan", f"{R} SELECT review_id FROM reviews ORDER BY review_id LIMIT 5000")
def s4(spark, d):
    return readers.capped(reviews(spark, d).select("review_id"), "review_id")


@query("s9_cluster_load", f"{C} SELECT cluster_id, array_to_string(keywords, ',') AS keywords FROM clusters")
def s9(spark, d):
    return clusters(spark, d).select("cluster_id", F.concat_ws(",", "keywords").alias("keywords"))


@query("s14_report", f"""{C}, s AS (SELECT upload_id, tenant_id, cluster_id AS label, list(substr(content, 1, 100) ORDER BY review_id) AS t FROM reviews WHERE cluster_id IS NOT NULL GROUP BY ALL) SELECT cluster_id, array_to_string(t[1:3], ' | ') AS samples FROM clusters JOIN s USING (upload_id, tenant_id, label)""")
def s14(spark, d):
    r = reviews(spark, d).where("cluster_id IS NOT NULL").select(F.concat_ws("-", "upload_id", "tenant_id", "cluster_id").alias("cluster_id"), F.col("review_id").alias("ordinal"), "content")
    return readers.report_rows(clusters(spark, d).select("cluster_id"), r)


@query("s16_account_export", f"{C} SELECT upload_id, list(cluster_id ORDER BY cluster_id) AS ids FROM clusters GROUP BY upload_id")
def s16(spark, d):
    uploads = reviews(spark, d).select("upload_id").where("cluster_id IS NOT NULL").distinct()
    return readers.account_export(uploads, clusters(spark, d).select("upload_id", "cluster_id")).select("upload_id", F.transform("clusters", lambda c: c["cluster_id"]).alias("ids"))


@query("m5_m6_dates", "SELECT o_orderkey, (o_orderdate - INTERVAL 30 DAY)::DATE AS lookback, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::DATE AS next_month, strftime(o_orderdate, '%Y-%m') AS ym FROM orders")
def m5(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.expr("CAST(o_orderdate - INTERVAL 30 DAYS AS DATE)").alias("lookback"), F.to_date(F.trunc(F.add_months("o_orderdate", 1), "MM")).alias("next_month"), F.date_format("o_orderdate", "yyyy-MM").alias("ym"))


@query("e12_incremental", f"WITH {RUNS_SQL} SELECT tenant_id, issue_fingerprint, run_seq, review_count FROM runs WHERE run_seq >= 2")
def e12(spark, d):
    from ..streaming.events import above_mark

    r = runs(spark, d)
    return above_mark(r, r.where("run_seq < 3"), "run_seq").select("tenant_id", "issue_fingerprint", "run_seq", "review_count")


@query("e10_rolling", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS rolling FROM events")
def e10(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-99, 0)
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.round(F.avg("value").over(w), 9).alias("rolling"))


@query("ext_tumbling", "SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n FROM events GROUP BY ALL")
def ext(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("p17_fallback_score", f"""{R}
SELECT review_id, (CASE WHEN rating <= 2 THEN 4 WHEN rating <= 3 THEN 2 ELSE 0 END + CASE WHEN {_any('lower(content)', lex.RULE_KEYWORDS)} THEN 3 ELSE 0 END + CASE WHEN len(content) >= 25 THEN 2 ELSE 0 END
  + CASE WHEN contains(content, '!') OR len(regexp_extract_all(content, '\\p{{Lu}}')) > 0.3 * len(content) THEN 1 ELSE 0 END) / 10.0::DOUBLE AS score FROM reviews""")
def p17(spark, d):
    return reviews(spark, d).select("review_id", scoring.fallback_score(F.col("content"), F.col("rating")).cast("double").alias("score"))


@query("p3_specificity", """WITH u AS (SELECT label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings) SELECT label, round(avg(v[1] - v[2]), 6) AS specificity FROM u GROUP BY label""")
def p3(spark, d):
    issue, generic = [1.0] + [0.0] * 63, [0.0, 1.0] + [0.0] * 62
    return similarity.specificity(spark.read.parquet(f"{d}/embeddings.parquet"), "label", "embedding", issue, generic).withColumn("specificity", F.round("specificity", 6))


@query("x26_common_phrases", f"""{R}, t AS (SELECT upload_id, {TOKENS} AS w FROM reviews), p AS (SELECT upload_id, unnest(list_transform(list_zip(w[1:len(w) - 1], w[2:len(w)]), lambda z: z[1] || ' ' || z[2])) AS phrase FROM t),
n AS (SELECT upload_id, phrase, count(*) AS n FROM p GROUP BY ALL), s AS (SELECT upload_id, count(*) AS texts FROM reviews GROUP BY ALL)
SELECT upload_id, phrase, n FROM (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY n DESC, phrase) AS r FROM n JOIN s USING (upload_id) WHERE n >= greatest(2, texts // 3)) WHERE r <= 5""")
def x26(spark, d):
    return similarity.common_phrases(reviews(spark, d), "upload_id", "content")


@query("x31_x10_m13_cleaning", f"""{C} SELECT cluster_id, regexp_replace(title, '^\\s*\\d+[.)]\\s*', '') AS unnumbered, least(5, greatest(1, label - 2)) AS clamped FROM clusters""")
def x31(spark, d):
    return clusters(spark, d).select("cluster_id", F.regexp_replace("title", r"^\s*\d+[.)]\s*", "").alias("unnumbered"), F.least(F.lit(5), F.greatest(F.lit(1), F.col("label") - 2)).alias("clamped"))


@query("e2_e3_routing", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN 'ok' WHEN event_id % 4 + 1 < 3 THEN 'retry' ELSE 'dead' END AS route FROM events")
def e2(spark, d):
    from ..streaming.events import routed

    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("event_id") % 4).cast("int").alias("retry_count"), F.lit(3).alias("max_retries"), F.lit(False).alias("dead_letter"))
    good, again, dead = routed(e, F.col("event_id") % 5 != 0)
    out = [df.select("event_id", F.lit(name).alias("route")) for name, df in (("ok", good), ("retry", again), ("dead", dead))]
    return out[0].unionByName(out[1]).unionByName(out[2])
