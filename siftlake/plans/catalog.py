"""Queries over the test tables, each with SQL for the comparison engine where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicons as lex
from ..functions import text as X
from ..functions import vectors as V
from ..operators import dedup, issues, monitoring, quality, scoring, similarity
from ..sources.reviews import CLUSTERS_SQL, REVIEWS_SQL, RUNS_SQL, clusters, reviews, runs

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def _any(text: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p.replace(chr(39), chr(39) * 2)}')" for p in phrases) + ")"


def _count(text: str, phrases) -> str:
    return "(" + " + ".join(f"contains({text}, '{p.replace(chr(39), chr(39) * 2)}')::INT" for p in phrases) + ")"


def _in(words: str, lexicon) -> str:
    quoted = ", ".join("'" + w.replace("'", "''") + "'" for w in lexicon)
    return f"len(list_filter({words}, lambda w: w IN ({quoted})))"


R, C = f"WITH {REVIEWS_SQL}", f"WITH {CLUSTERS_SQL}"
TOKENS = "list_filter(string_split_regex(lower(content), '\\s+'), lambda w: w <> '')"


# ---- filters -------------------------------------------------------------------------------------------------------


@query("f1_noise_v1", f"""{R}
SELECT review_id, rating FROM reviews WHERE rating <= 3 OR {_any('lower(content)', lex.NEGATIVE_KEYWORDS)}
  OR NOT ((len(content) < 25 AND rating >= 4) OR ({_any('lower(content)', lex.POSITIVE_PATTERNS)} AND NOT {_any('lower(content)', lex.NEGATIVE_KEYWORDS)} AND rating >= 4))""")  # fmt: skip
def f1(spark: SparkSession, d: str) -> DataFrame:
    return reviews(spark, d).where(scoring.keep_v1(F.col("content"), F.col("rating"))).select("review_id", "rating")


@query("f2_noise_v2", f"{R} SELECT review_id FROM reviews WHERE CASE WHEN is_actionable IS NOT NULL THEN is_actionable ELSE NOT (rating >= 4 AND len(content) < 25) END")
def f2(spark, d):
    return reviews(spark, d).where(scoring.keep_v2(F.col("content"), F.col("rating"), F.col("is_actionable"))).select("review_id")


@query("f3_actionable", f"{R} SELECT review_id, upload_id FROM reviews WHERE is_actionable")
def f3(spark, d):
    return reviews(spark, d).where("is_actionable").select("review_id", "upload_id")


@query("f4_staging", f'{R} SELECT review_id, tenant_id, content AS "text", rating, CAST("at" AS DATE) AS review_date FROM reviews WHERE content IS NOT NULL')
def f4(spark, d):
    return reviews(spark, d).where("content IS NOT NULL").select("review_id", "tenant_id", F.col("content").alias("text"), "rating", F.to_date("at").alias("review_date"))


@query("f5_split_lists", f"{C} SELECT cluster_id, string_split(array_to_string(keywords, ','), ',') AS keywords FROM clusters WHERE len(keywords) > 0")
def f5(spark, d):
    joined = clusters(spark, d).where(F.size("keywords") > 0).select("cluster_id", F.array_join("keywords", ",").alias("k"))
    return joined.select("cluster_id", F.split("k", ",").alias("keywords"))


@query("f6_paged", f"{C} SELECT cluster_id, review_count FROM clusters WHERE upload_id IN (1, 2, 3) AND status = 'open' ORDER BY review_count DESC, cluster_id LIMIT 10 OFFSET 5")
def f6(spark, d):
    return clusters(spark, d).where(F.col("upload_id").isin(1, 2, 3) & (F.col("status") == "open")).orderBy(F.desc("review_count"), "cluster_id").offset(5).limit(10).select("cluster_id", "review_count")


@query("f7_urgent", f"{C} SELECT cluster_id, severity, review_count FROM clusters WHERE severity IN ('critical', 'high') ORDER BY review_count DESC, cluster_id LIMIT 5")
def f7(spark, d):
    return clusters(spark, d).where(F.col("severity").isin("critical", "high")).orderBy(F.desc("review_count"), "cluster_id").limit(5).select("cluster_id", "severity", "review_count")


@query("f11_filtered_search", """
WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id = 0),
s AS (SELECT e.vec_id AS id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS similarity FROM embeddings e, q WHERE e.vec_id <> q.vec_id AND e.label = 3)
SELECT id, similarity FROM s ORDER BY similarity DESC, id LIMIT 5""")
def f11(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    found = similarity.vector_search(e.where("vec_id = 0"), e.where("label = 3"), 5)
    return found.select("id", F.round("similarity", 6).alias("similarity"))


@query("f12_tenant_rows", f"{R} SELECT review_id, tenant_id FROM reviews WHERE tenant_id = 'en'")
def f12(spark, d):
    return reviews(spark, d).where(F.col("tenant_id") == "en").select("review_id", "tenant_id")


@query("f13_plan_gate", f"""{R}
SELECT upload_id, n, plan, most, n <= coalesce(most, n) AS allowed FROM (SELECT upload_id, count(*) AS n, CASE upload_id % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' ELSE 'enterprise' END AS plan FROM reviews GROUP BY upload_id)
JOIN (VALUES ('free', 40), ('pro', 10000), ('enterprise', NULL)) p(plan, most) USING (plan)""")
def f13(spark, d):
    plans = spark.createDataFrame([("free", 40), ("pro", 10000), ("enterprise", None)], "plan string, most int")
    per = reviews(spark, d).groupBy("upload_id").agg(F.count(F.lit(1)).alias("n"))
    per = per.withColumn("plan", F.when(F.col("upload_id") % 3 == 0, "free").when(F.col("upload_id") % 3 == 1, "pro").otherwise("enterprise"))
    return per.join(F.broadcast(plans), "plan").select("upload_id", "n", "plan", "most", (F.col("n") <= F.coalesce("most", "n")).alias("allowed"))


# ---- text functions and features -----------------------------------------------------------------------------------


@query("x2_normalise", f"{R} SELECT review_id, trim(regexp_replace(lower(content), '\\s+', ' ', 'g')) AS norm FROM reviews")
def x2(spark, d):
    return reviews(spark, d).select("review_id", X.normalised(F.col("content")).alias("norm"))


@query("x5_fingerprint", f"""{C},
k AS (SELECT cluster_id, list_sort(list_distinct(list_concat(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda w: NOT list_contains({[*lex.FINGERPRINT_FILLERS]}, w)), keywords))) AS w FROM clusters)
SELECT cluster_id, substr(sha256(array_to_string(w, '|')), 1, 32) AS issue_fingerprint FROM k""")
def x5(spark, d):
    return clusters(spark, d).select("cluster_id", X.fingerprint(F.col("title"), F.col("keywords")).alias("issue_fingerprint"))


@query("x6_x10_titles", f"""{C}
SELECT cluster_id, nullif(regexp_extract(lower(title), 'v?(\\d+\\.\\d+(?:\\.\\d+)?)', 0), '') AS version,
  CASE {' '.join(f"WHEN contains(lower(title), '{x}') THEN '{x.capitalize()}'" for x in lex.DEVICES)} END AS device,
  '[' || upper(severity) || '] ' || CASE WHEN contains(lower(title), 'crash') THEN 'App crashes' WHEN contains(lower(title), 'login') THEN 'Login issues'
    WHEN contains(lower(title), 'slow') OR contains(lower(title), 'lag') THEN 'Performance issues' WHEN contains(lower(title), 'subscription') OR contains(lower(title), 'payment') THEN 'Payment/subscription issues'
    ELSE 'Issue: ' || substr(title, 1, 50) || '...' END AS title_v1,
  CASE WHEN len(title) > 100 THEN substr(title, 1, 100) || '...' ELSE title END AS title_v2 FROM clusters""")
def x6(spark, d):
    t = F.col("title")
    return clusters(spark, d).select("cluster_id", X.version_in(t).alias("version"), X.device_in(t).alias("device"), X.title_v1(t, F.col("severity")).alias("title_v1"), X.title_v2(t).alias("title_v2"))


@query("x12_platform", f"""{C}
SELECT cluster_id, CASE WHEN a AND i THEN 'both' WHEN a THEN 'android' WHEN i THEN 'ios' ELSE 'unknown' END AS platform
FROM (SELECT cluster_id, regexp_matches(lower(title), '\\bandroid\\b|\\bplay.?store\\b') AS a, regexp_matches(lower(title), '\\bios\\b|\\biphone\\b|\\bipad\\b|\\bapp.?store\\b') AS i FROM clusters)""")
def x12(spark, d):
    return clusters(spark, d).select("cluster_id", X.platform_of(F.col("title")).alias("platform"))


@query("x13_cluster_type", f"""{C}
SELECT cluster_id, CASE {' '.join(f"WHEN regexp_matches(lower(title), '{p}') THEN '{n}'" for n, p in lex.CLUSTER_TYPES)} ELSE 'bug' END AS kind,
  CASE WHEN regexp_matches(title, '{lex.COMPLAINT_TITLE}') THEN false WHEN regexp_matches(title, '{lex.PRAISE_TITLE}') THEN true ELSE severity = 'low' END AS praise,
  CASE WHEN review_count >= 500 THEN 'Dominant' WHEN review_count >= 100 THEN 'Very Strong' WHEN review_count >= 20 THEN 'Strong' WHEN review_count >= 5 THEN 'Moderate' ELSE 'Weak' END AS signal FROM clusters""")
def x13(spark, d):
    t = F.col("title")
    return clusters(spark, d).select("cluster_id", X.cluster_type(t).alias("kind"), X.is_praise(t, F.col("severity")).alias("praise"), X.signal_strength(F.col("review_count")).alias("signal"))


@query("x21_scripts", f"""{R}
SELECT review_id, CASE WHEN len(f) > 0 THEN f WHEN regexp_matches(content, '\\p{{L}}') THEN ['english'] ELSE ['unknown'] END AS scripts
FROM (SELECT review_id, content, list_filter([{', '.join(f"CASE WHEN regexp_matches(content, '{p}') THEN '{n}' END" for n, p in lex.SCRIPTS.items())}], lambda x: x IS NOT NULL) AS f FROM reviews)""")
def x21(spark, d):
    return reviews(spark, d).select("review_id", X.scripts(F.col("content")).alias("scripts"))


@query("x28_x29_x30_misc", f"""{R}
SELECT review_id, sha256(content) AS cache_key, regexp_replace('db://u' || upload_id || ':pw@host', '://([^:/@]+):[^@]*@', '://\\1:***@') AS dsn,
  CASE rating WHEN 1 THEN false WHEN 5 THEN true END AS label FROM reviews""")
def x28(spark, d):
    value = F.when(F.col("rating") == 1, "No").when(F.col("rating") == 5, " YES ").otherwise("maybe")
    return reviews(spark, d).select("review_id", F.sha2("content", 256).alias("cache_key"), X.redacted(F.concat(F.lit("db://u"), F.col("upload_id"), F.lit(":pw@host"))).alias("dsn"), X.label_of(value).alias("label"))


FEATURES_SQL = f"""{R},
w AS (SELECT *, {TOKENS} AS w, lower(content) AS low FROM reviews),
f0 AS (
  SELECT review_id, content, low, is_actionable, cluster_id, upload_id, "at", rating, rating::DOUBLE AS rating_value, len(content) AS length, len(w) AS word_count,
    {_in('w', lex.POSITIVE_WORDS)} AS positive_words, {_in('w', lex.NEGATIVE_WORDS)} AS negative_words, {_in('w', lex.COMPLAINT_VERBS)} AS complaint_verbs,
    len(content) - len(replace(content, '?', '')) AS question_marks, len(content) - len(replace(content, '!', '')) AS exclamation_marks,
    len(regexp_extract_all(content, '[.,!?;:]')) / len(content) AS punctuation_ratio, len(regexp_extract_all(content, '\\p{{Lu}}')) / len(content) AS caps_ratio,
    {_any('low', lex.BUG_KEYWORDS)} AS has_bug_keywords, {_any('low', lex.FEATURE_KEYWORDS)} AS has_feature_request, {_any('low', lex.COMPARISONS)} AS has_comparison,
    regexp_matches(content, '{lex.DETAILS}') AS has_specific_details, {_any('low', lex.CONCESSIONS)} AS has_concession, {_count('low', lex.CONCESSIONS)} AS concession_count,
    {_any('low', lex.MONETIZATION)} AS has_monetization_complaint, {_any('low', lex.RETENTION)} AS has_retention_signal, {_count('low', lex.FEATURE_REQUESTS)} AS feature_request_count
  FROM w),
f AS (
  SELECT *, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (negative_words + complaint_verbs - positive_words) / word_count)) AS emotion_intensity,
    CASE WHEN positive_words > 0 AND negative_words > 0 THEN least(positive_words, negative_words) / word_count ELSE 0 END AS sentiment_contrast,
    greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (positive_words - negative_words) / word_count)) AS polarity,
    positive_words > 0 AND negative_words > 0 AND least(positive_words, negative_words) > 0.3 * greatest(positive_words, negative_words) AS mixed_sentiment FROM f0)"""
FEATURE_COLUMNS = (
    "length word_count positive_words negative_words complaint_verbs question_marks exclamation_marks has_bug_keywords has_feature_request has_comparison "
    "has_specific_details has_concession concession_count has_monetization_complaint has_retention_signal feature_request_count mixed_sentiment"
).split()
FEATURE_RATIOS = "punctuation_ratio caps_ratio emotion_intensity sentiment_contrast polarity".split()


def featured(spark, d) -> DataFrame:
    return scoring.features(reviews(spark, d))


@query("p20_features", f"{FEATURES_SQL} SELECT review_id, {', '.join(FEATURE_COLUMNS)}, {', '.join(f'round({c}, 9) AS {c}' for c in FEATURE_RATIOS)} FROM f")
def p20(spark, d):
    return featured(spark, d).select("review_id", *FEATURE_COLUMNS, *[F.round(c, 9).alias(c) for c in FEATURE_RATIOS])


_HYBRID = """CASE WHEN rating_value <= 2 AND complaint_verbs > 0 THEN [1, 0.95] WHEN has_bug_keywords AND has_specific_details THEN [1, 0.9]
  WHEN complaint_verbs >= 2 AND negative_words >= 3 THEN [1, 0.85] WHEN mixed_sentiment THEN [1, 0.75] WHEN has_feature_request AND has_specific_details THEN [1, 0.8]
  WHEN rating_value >= 4 AND negative_words = 0 AND word_count < 10 THEN [0, 0.85] WHEN word_count < 5 OR length < 20 THEN [0, 0.8]
  WHEN polarity < -0.3 THEN [1, 0.6] WHEN polarity > 0.3 THEN [0, 0.6] ELSE [1, 0.5] END"""


@query("p18_hybrid_rule", f"{FEATURES_SQL} SELECT review_id, h[1] = 1 AS actionable, h[2]::DOUBLE AS confidence FROM (SELECT review_id, {_HYBRID} AS h FROM f)")
def p18(spark, d):
    yes, sure = scoring.hybrid_rule(None)
    return featured(spark, d).select("review_id", yes.alias("actionable"), sure.alias("confidence"))


@query("p19_fast_rule", f"""{FEATURES_SQL}
SELECT review_id, CASE WHEN rating_value <= 2 AND complaint_verbs > 0 THEN 1.0 WHEN word_count < 5 THEN 0.0 WHEN negative_words >= 3 THEN 0.9 WHEN rating_value >= 4 AND negative_words = 0 THEN 0.2 ELSE 0.5 END::DOUBLE AS score FROM f""")
def p19(spark, d):
    return featured(spark, d).select("review_id", scoring.fast_rule().alias("score"))


@query("p16_rule_score", f"""{R}
SELECT review_id, greatest(0, least(10, CASE WHEN rating <= 2 THEN 4 WHEN rating <= 3 THEN 2 ELSE 0 END + CASE WHEN {_any('lower(content)', lex.RULE_KEYWORDS)} THEN 3 ELSE 0 END
  + CASE WHEN len(content) >= 25 THEN 2 ELSE -1 END + CASE WHEN contains(content, '!') THEN 1 ELSE 0 END)) / 10.0::DOUBLE AS score FROM reviews""")
def p16(spark, d):
    return reviews(spark, d).select("review_id", scoring.rule_score(F.col("content"), F.col("rating")).cast("double").alias("score"))


@query("p23_auto_label", f"""{FEATURES_SQL}
SELECT review_id, reason, reason IN ('low_rating_with_complaints', 'bug_with_details', 'multiple_complaints', 'technical_issue_with_details', 'feature_request_with_details', 'mixed_sentiment', 'critical_error', 'negative_sentiment', 'question_uncertain', 'default_include') AS label FROM (
SELECT review_id, CASE WHEN trim(content) = '' THEN 'empty_review' WHEN rating_value <= 2 AND complaint_verbs >= 1 THEN 'low_rating_with_complaints' WHEN has_bug_keywords AND has_specific_details THEN 'bug_with_details'
  WHEN complaint_verbs >= 2 AND negative_words >= 3 THEN 'multiple_complaints' WHEN has_specific_details AND negative_words >= 2 THEN 'technical_issue_with_details'
  WHEN has_feature_request AND has_specific_details THEN 'feature_request_with_details' WHEN mixed_sentiment THEN 'mixed_sentiment'
  WHEN {_any('low', ['crash', 'crashes', 'crashing', 'freeze', 'not working', 'cant open', 'wont load'])} THEN 'critical_error' WHEN word_count < 3 OR length < 15 THEN 'too_short'
  WHEN rating_value >= 4.5 AND negative_words = 0 AND complaint_verbs = 0 THEN 'high_rating_no_negatives' WHEN positive_words >= 3 AND negative_words = 0 AND rating_value >= 4 THEN 'pure_praise'
  WHEN word_count <= 5 AND {_any('low', ['good', 'nice', 'ok', 'fine', 'thanks', 'thank you'])} THEN 'generic_positive' WHEN len(regexp_extract_all(content, '\\p{{L}}')) < 5 THEN 'mostly_symbols'
  WHEN polarity < -0.3 THEN 'negative_sentiment' WHEN polarity > 0.3 AND rating_value >= 4 THEN 'positive_sentiment' WHEN question_marks > 0 AND negative_words < 2 THEN 'question_uncertain' ELSE 'default_include' END AS reason FROM f)""")
def p23(spark, d):
    return featured(spark, d).select("review_id", scoring.auto_label().alias("l")).select("review_id", "l.reason", "l.label")


@query("p24_label_maps", f"{R} SELECT review_id, rating >= 3 AS label, CASE WHEN rating = 3 THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN rating = 3 THEN 0.5 ELSE 1.0 END::DOUBLE AS weight FROM reviews")
def p24(spark, d):
    word = F.when(F.col("rating") > 3, "actionable").when(F.col("rating") < 3, "non_actionable").otherwise("uncertain")
    return reviews(spark, d).withColumn("manual", word).select("review_id", (F.col("manual") != "non_actionable").alias("label"), F.when(F.col("manual") == "uncertain", 0.5).otherwise(0.9).alias("confidence"), F.when(F.col("manual") == "uncertain", 0.5).otherwise(1.0).alias("weight"))


@query("p25_stratified_split", f"""{R}
SELECT review_id, is_actionable, (row_number() OVER (PARTITION BY is_actionable ORDER BY md5(review_id::VARCHAR), review_id) - 1) * 5 >= 4 * count(*) OVER (PARTITION BY is_actionable) AS is_test FROM reviews WHERE is_actionable IS NOT NULL""")
def p25(spark, d):
    w = Window.partitionBy("is_actionable")
    n = F.row_number().over(w.orderBy(F.md5(F.col("review_id").cast("string")), "review_id")) - 1
    return reviews(spark, d).where("is_actionable IS NOT NULL").select("review_id", "is_actionable", (n * 5 >= 4 * F.count(F.lit(1)).over(w)).alias("is_test"))


@query("p26_p28_adversarial", f"""{R},
w AS (SELECT *, {TOKENS} AS w, lower(content) AS low, len(content) - len(replace(content, '!', '')) AS shouts FROM reviews),
m AS (SELECT review_id, max(n) AS most FROM (SELECT review_id, x, count(*) AS n FROM (SELECT review_id, unnest(w) AS x FROM w) GROUP BY ALL) GROUP BY review_id),
s AS (
  SELECT w.review_id, CASE WHEN rating >= 4 THEN CASE WHEN {_count('low', lex.HOSTILE)} >= 3 THEN 4 ELSE 0 END + CASE WHEN {_any('low', lex.SARCASM)} AND {_any('low', lex.HOSTILE)} THEN 3 ELSE 0 END
      + CASE WHEN regexp_matches(low, '{lex.CONTRADICTION}') THEN 2 ELSE 0 END ELSE 0 END AS f,
    CASE WHEN rating <= 2 AND {_any('low', lex.SARCASM)} THEN least(10, 3 + 2 * {_count('low', lex.SARCASM)}) + CASE WHEN shouts >= 2 THEN 1 ELSE 0 END
      + CASE WHEN len(regexp_extract_all(content, '\\p{{Lu}}')) > 0.3 * len(content) THEN 1 ELSE 0 END ELSE 0 END AS i,
    {' + '.join(f"CASE WHEN regexp_matches(content, '{p}') THEN 3 ELSE 0 END" for p in lex.SPAM)} + CASE WHEN len(w) < 5 THEN 2 ELSE 0 END + CASE WHEN most > 0.3 * len(w) THEN 2 ELSE 0 END AS p
  FROM w LEFT JOIN m USING (review_id))
SELECT review_id, (f / 10.0)::DOUBLE AS fake_positive, (i / 10.0)::DOUBLE AS sarcasm, (p / 10.0)::DOUBLE AS spam, f >= 6 AS is_fake_positive, i >= 5 AS is_sarcastic, p >= 5 AS is_spam FROM s""")
def p26(spark, d):
    out = scoring.adversarial(reviews(spark, d).select("review_id", "content", "rating"))
    return out.select("review_id", *[F.col(c).cast("double").alias(c) for c in ("fake_positive", "sarcasm", "spam")], "is_fake_positive", "is_sarcastic", "is_spam")


@query("p31_adversarial_report")
def p31(spark, d):
    flags = scoring.adversarial(reviews(spark, d).select("review_id", "content", "rating"))
    rates = flags.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("double")).alias(c) for c in ("is_fake_positive", "is_sarcastic", "is_spam")], F.max(F.greatest("fake_positive", "sarcasm", "spam")).alias("worst"))
    return rates.select("*", (F.col("is_fake_positive") > 0.1).alias("fake_alert"), (F.col("is_spam") > 0.05).alias("spam_alert"))


@query("p33_validation", f"""{R}
SELECT review_id, content <> '' AS is_valid, len(content) AS clean_length, least(5, greatest(1, rating - 1 + 1)) AS clean_score FROM (SELECT review_id, rating, substr(regexp_replace(content, '^\\s+|\\s+$', '', 'g'), 1, 10000) AS content FROM reviews)""")
def p33(spark, d):
    return scoring.validated(reviews(spark, d)).select("review_id", "is_valid", F.length("clean_content").alias("clean_length"), "clean_score")


# ---- issues --------------------------------------------------------------------------------------------------------


@query("p1_p2_v1_ranking", f"""{C},
s AS (SELECT *, CASE WHEN {_any('lower(title)', lex.SEVERITY_TIERS['critical'])} THEN 'critical' WHEN {_any('lower(title)', lex.SEVERITY_TIERS['high'])} THEN 'high' WHEN {_any('lower(title)', lex.SEVERITY_TIERS['medium'])} THEN 'medium' ELSE 'low' END AS tier FROM clusters),
v AS (SELECT *, CASE WHEN avg_rating >= 3.8 THEN 'low' WHEN avg_rating <= 2 AND tier IN ('low', 'medium') THEN 'high' WHEN avg_rating <= 2.8 AND tier = 'low' THEN 'medium' ELSE tier END AS sev FROM s)
SELECT cluster_id, sev AS severity_v1, round((CASE sev WHEN 'critical' THEN 100 WHEN 'high' THEN 50 WHEN 'medium' THEN 20 ELSE 5 END + log10(review_count + 1) * 10 + 5 * {_count('lower(title)', lex.PRIORITY_KEYWORDS)})
  * (0.1 + greatest(0.05, least(1.0, (4 - avg_rating) / 3))) * 0.9 * 0.65, 6) AS priority FROM v""")
def p1(spark, d):
    s = issues.severity_v1(F.col("title"), F.col("avg_rating"))
    score = issues.priority_v1(F.col("severity_v1"), F.col("review_count"), F.col("title"), F.col("avg_rating"), F.lit(0.8), F.lit(0.1))
    return clusters(spark, d).withColumn("severity_v1", s).select("cluster_id", "severity_v1", F.round(score, 6).alias("priority"))


@query("p4_p5_v2_ranking", f"""{C}
SELECT cluster_id, severity, round(0.4 * CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.5 ELSE 0.25 END + 0.3 * log10(review_count + 1) / 5 + 0.2 * (5 - avg_rating) / 5 + 0.05, 6) AS priority FROM clusters""")
def p4(spark, d):
    s = issues.severity_v2(F.col("avg_rating"))
    return clusters(spark, d).withColumn("severity", s).select("cluster_id", "severity", F.round(issues.priority_v2(F.col("severity"), F.col("review_count"), F.col("avg_rating")), 6).alias("priority"))


@query("p7_triage", f"""{C}
SELECT cluster_id, round(CASE severity WHEN 'critical' THEN 100.0 WHEN 'high' THEN 70 WHEN 'medium' THEN 40 WHEN 'low' THEN 15 ELSE 20 END + 10.0 + CASE WHEN status = 'resolved' THEN 15.0 ELSE 0 END + 5.0 * ln(1 + review_count), 2) AS priority,
  rank() OVER (ORDER BY review_count DESC) AS volume_rank FROM clusters""")
def p7(spark, d):
    c = clusters(spark, d)
    score = issues.priority_triage(F.col("severity"), F.lit(None).cast("double"), F.col("status") == "resolved", F.lit(None).cast("double"), F.col("review_count"))
    sizes = c.groupBy("review_count").agg(F.count(F.lit(1)).alias("k"))
    ranks = sizes.select("review_count", (1 + F.coalesce(F.sum("k").over(Window.orderBy(F.desc("review_count")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("volume_rank"))
    return c.withColumn("priority", score).join(ranks, "review_count").select("cluster_id", "priority", "volume_rank")


@query("p8_a2_business_impact", f"""{FEATURES_SQL}
SELECT cluster_id, volume, avg_score, round(impact, 6) AS impact, CASE WHEN impact > 100 THEN 'critical' WHEN impact > 50 THEN 'high' ELSE 'medium' END AS severity FROM (
SELECT cluster_id, count(*) AS volume, round(avg(rating), 9) AS avg_score, 0.3 * count(*) + 30.0 * avg(rating) + 5 * count_if(has_retention_signal) + 3 * count_if(has_monetization_complaint) + 2 * sum(feature_request_count) AS impact FROM f WHERE cluster_id IS NOT NULL GROUP BY cluster_id) WHERE volume >= 10""")
def p8(spark, d):
    per = featured(spark, d).where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("volume"), F.avg("rating").alias("a"), F.count_if("has_retention_signal").alias("r"), F.count_if("has_monetization_complaint").alias("m"), F.sum("feature_request_count").alias("w"))
    per = per.where("volume >= 10").withColumn("i", issues.impact(F.col("volume"), F.col("a"), F.col("r"), F.col("m"), F.col("w")))
    return per.select("cluster_id", "volume", F.round("a", 9).alias("avg_score"), F.round("i", 6).alias("impact"), F.when(F.col("i") > 100, "critical").when(F.col("i") > 50, "high").otherwise("medium").alias("severity"))


@query("a18_categories", f"""{C}, k AS ({' UNION ALL '.join(f"SELECT '{n}' AS category, review_count FROM clusters WHERE {_any('lower(title)', w)}" for n, w in lex.CATEGORIES.items())})
SELECT category, sum(review_count)::BIGINT AS reviews FROM k GROUP BY category""")
def a18(spark, d):
    return issues.category_volume(clusters(spark, d))


@query("a19_top_complaint", f"""{C},
p AS (SELECT *, CASE WHEN regexp_matches(title, '{lex.COMPLAINT_TITLE}') THEN false WHEN regexp_matches(title, '{lex.PRAISE_TITLE}') THEN true ELSE severity = 'low' END AS praise FROM clusters),
r AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY praise, review_count DESC, cluster_id) AS n, sum(review_count) OVER (PARTITION BY upload_id) AS total FROM p)
SELECT upload_id, cluster_id, praise, round(review_count * 100.0 / total, 6)::DOUBLE AS share FROM r WHERE n = 1""")
def a19(spark, d):
    c = clusters(spark, d).withColumn("praise", X.is_praise(F.col("title"), F.col("severity")))
    c = c.withColumn("total", F.sum("review_count").over(Window.partitionBy("upload_id")))
    return issues.top_per_group(c, ["upload_id"], ["praise", F.desc("review_count"), "cluster_id"], 1).select("upload_id", "cluster_id", "praise", F.round(F.col("review_count") * 100.0 / F.col("total"), 6).cast("double").alias("share"))


@query("a20_versions", f"""{R},
v AS (SELECT upload_id, nullif(regexp_extract(lower(content), 'v?(\\d+\\.\\d+(?:\\.\\d+)?)', 0), '') AS version, count(*) AS n FROM reviews GROUP BY ALL),
k AS (SELECT *, list_transform(regexp_extract_all(version, '\\d+')[1:4], lambda x: x::BIGINT) AS numbers FROM v WHERE version IS NOT NULL)
SELECT upload_id, arg_min(version, struct_pack(a := numbers, b := version)) AS earliest_version, arg_max(version, struct_pack(a := n, b := version)) AS most_common_version, count(*) AS distinct_versions FROM k GROUP BY upload_id""")
def a20(spark, d):
    return issues.version_bisect(reviews(spark, d).withColumn("version", X.version_in(F.col("content"))), ["upload_id"])


@query("w4_top5_per_severity", f"{C} SELECT severity, cluster_id, n AS rank FROM (SELECT severity, cluster_id, row_number() OVER (PARTITION BY severity ORDER BY review_count DESC, cluster_id) AS n FROM clusters) WHERE n <= 5")
def w4(spark, d):
    return issues.top_per_group(clusters(spark, d), ["severity"], [F.desc("review_count"), "cluster_id"], 5).select("severity", "cluster_id", "rank")


@query("w6_velocity_spike", f"{C} SELECT cluster_id, is_spike FROM (SELECT cluster_id, count(*) OVER w >= 3 AND review_count >= greatest(avg(review_count) OVER w + 1.5 * stddev_pop(review_count) OVER w, 15) AS is_spike FROM clusters WINDOW w AS (PARTITION BY upload_id))")
def w6(spark, d):
    return issues.velocity_spikes(clusters(spark, d)).select("cluster_id", "is_spike")


REGRESSION_SQL = f"""WITH {RUNS_SQL},
l AS (SELECT *, lag(severity_rank) OVER w AS pr, lag(review_count) OVER w AS pn, lag(run_seq) OVER w AS ps FROM runs WINDOW w AS (PARTITION BY tenant_id, issue_fingerprint ORDER BY run_seq))
SELECT tenant_id, issue_fingerprint, run_seq, review_count - pn AS count_delta, review_count / pn AS count_ratio, CASE WHEN ps IS NULL THEN 'NEW' WHEN severity_rank > pr THEN 'REGRESSED_SEVERITY'
  WHEN review_count > pn * 1.5 THEN 'REGRESSED_VOLUME' WHEN severity_rank < pr OR review_count < pn * 0.5 THEN 'IMPROVED' ELSE 'STABLE' END AS regression_status FROM l"""


@query("w1_w2_regression", REGRESSION_SQL)
def w1(spark, d):
    return issues.regression_status(runs(spark, d), ["tenant_id", "issue_fingerprint"], ["run_seq"]).select("tenant_id", "issue_fingerprint", "run_seq", "count_delta", "count_ratio", "regression_status")


@query("p35_j12_volume_change", f"""WITH {RUNS_SQL}, o AS (SELECT issue_fingerprint || '/' || tenant_id AS label, review_count AS n FROM runs WHERE run_seq = 0), k AS (SELECT issue_fingerprint || '/' || tenant_id AS label, review_count AS n FROM runs WHERE run_seq = 3)
SELECT label, coalesce(o.n, 0) AS old_size, coalesce(k.n, 0) AS new_size, CASE WHEN o.n IS NULL THEN 'new' WHEN k.n IS NULL THEN 'disappeared' ELSE 'common' END AS status,
  round((coalesce(k.n, 0) - o.n) * 100.0 / o.n, 6)::DOUBLE AS growth_pct, coalesce((coalesce(k.n, 0) - o.n) * 100.0 / o.n > 50 AND coalesce(k.n, 0) - o.n >= 10 AND coalesce(k.n, 0) >= 5, false) AS is_spike FROM o FULL JOIN k USING (label)""")
def p35(spark, d):
    r = runs(spark, d).withColumn("label", F.concat_ws("/", "issue_fingerprint", "tenant_id"))
    out = issues.volume_change(r.where("run_seq = 0"), r.where("run_seq = 3"), "label", "review_count")
    return out.withColumn("growth_pct", F.round(F.col("growth_pct").cast("double"), 6))


@query("j1_j2_metrics_join", f"""{C}, m AS (SELECT upload_id, tenant_id, count(*) AS total_reviews, coalesce(count_if(is_actionable), 0) AS actionable_reviews FROM reviews GROUP BY ALL)
SELECT cluster_id, total_reviews, actionable_reviews, coalesce(r.rank, 0) AS severity_rank FROM m JOIN clusters c USING (upload_id, tenant_id) LEFT JOIN (VALUES ('low', 1), ('medium', 2), ('high', 3), ('critical', 4)) r(severity, rank) USING (severity)""")
def j1(spark, d):
    m = reviews(spark, d).groupBy("upload_id", "tenant_id").agg(F.count(F.lit(1)).alias("total_reviews"), F.count_if("is_actionable").alias("actionable_reviews"))
    return m.join(clusters(spark, d), ["upload_id", "tenant_id"]).select("cluster_id", "total_reviews", "actionable_reviews", issues.severity_rank(F.col("severity")).alias("severity_rank"))


@query("j3_j4_p6_mart", f"""{C}, r AS (SELECT upload_id, tenant_id, cluster_id AS label, count(*) AS n, coalesce(count_if(is_actionable), 0) AS actionable_count, avg(is_actionable::INT) AS avg_actionability FROM reviews WHERE (upload_id, tenant_id, cluster_id) IN (SELECT (upload_id, tenant_id, label) FROM clusters) GROUP BY ALL)
SELECT cluster_id, severity, review_count, actionable_count, round(least(review_count / 100.0, 1.0) * 0.25::DOUBLE + CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.5 ELSE 0.25 END * 0.35::DOUBLE
  + coalesce(avg_actionability, 0) * 0.25::DOUBLE + (5 - coalesce(avg_rating, 3)) / 5 * 0.15::DOUBLE, 4) AS priority_score FROM clusters LEFT JOIN r USING (upload_id, tenant_id, label)""")
def j3(spark, d):
    from .marts import issue_summary

    out = issue_summary(clusters(spark, d), reviews(spark, d).withColumnRenamed("cluster_id", "label"), ["upload_id", "tenant_id", "label"])
    return out.select("cluster_id", "severity", "review_count", "actionable_count", "priority_score")


@query("a16_a17_distributions", f"""{C} SELECT upload_id, count_if(severity = 'critical') AS critical, count_if(severity = 'high') AS high, count_if(severity = 'medium') AS medium, count_if(severity = 'low') AS low,
  round(count_if(status = 'resolved') * 100.0 / count(*))::INT AS resolution_rate FROM clusters GROUP BY upload_id""")
def a16(spark, d):
    s = [F.count_if(F.col("severity") == k).alias(k) for k in ("critical", "high", "medium", "low")]
    return clusters(spark, d).groupBy("upload_id").agg(*s, F.round(F.count_if(F.col("status") == "resolved") * 100.0 / F.count(F.lit(1))).cast("int").alias("resolution_rate"))


@query("a21_keywords", f"""{R}, w AS (SELECT upload_id, w, count(*) AS n FROM (SELECT upload_id, unnest(regexp_extract_all(lower(content), '[a-z]{{3,}}')) AS w FROM reviews) WHERE w NOT IN ({', '.join(f"'{x}'" for x in lex.TITLE_STOP)}) GROUP BY ALL)
SELECT upload_id, w AS keyword, n FROM (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY n DESC, w) AS k FROM w) WHERE k <= 8""")
def a21(spark, d):
    words = reviews(spark, d).select("upload_id", F.explode(F.regexp_extract_all(F.lower("content"), F.lit("[a-z]{3,}"), F.lit(0))).alias("keyword")).where(~F.col("keyword").isin(*lex.TITLE_STOP))
    per = words.groupBy("upload_id", "keyword").agg(F.count(F.lit(1)).alias("n"))
    return issues.top_per_group(per, ["upload_id"], [F.desc("n"), "keyword"], 8).select("upload_id", "keyword", "n")


@query("a26_digest", f"""{C} SELECT upload_id, count_if(severity = 'critical') AS critical, count_if(status = 'resolved') AS resolved, list_transform(list_sort(list(struct_pack(k := -review_count, id := cluster_id)))[1:3], lambda x: x.id) AS top FROM clusters GROUP BY upload_id""")
def a26(spark, d):
    c = clusters(spark, d)
    counts = c.groupBy("upload_id").agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("status") == "resolved").alias("resolved"))
    top = issues.top_per_group(c, ["upload_id"], [F.desc("review_count"), "cluster_id"], 3).groupBy("upload_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cluster_id"))), lambda x: x["cluster_id"]).alias("top"))
    return counts.join(top, "upload_id")


# ---- quality and drift ---------------------------------------------------------------------------------------------


@query("a10_profile", f"""{R} SELECT count(*) AS n_rows, count_if(content IS NULL) AS n_null, count_if(len(content) > 10000) AS n_too_long, count(*) - count(DISTINCT content) AS n_duplicates, round(avg(len(content)), 6) AS mean_length, round(stddev_pop(len(content)), 6) AS std_length,
  round(quantile_cont(len(content), 0.5), 6)::DOUBLE AS p50, round(quantile_cont(len(content), 0.9), 6)::DOUBLE AS p90, round(avg(len({TOKENS})), 6) AS mean_words, round(stddev_samp(rating), 6) AS std_rating FROM reviews""")
def a10(spark, d):
    p = quality.profile(reviews(spark, d))
    r6 = [F.round(c, 6).alias(c) for c in ("mean_length", "std_length", "mean_words", "std_rating")]
    return p.select("n_rows", "n_null", "n_too_long", "n_duplicates", *r6, F.round(F.col("length_percentiles")[2], 6).alias("p50"), F.round(F.col("length_percentiles")[4], 6).alias("p90"))


@query("a11_entropy", 'WITH p AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang) SELECT round(-sum(n / t * log2(n / t)), 9) AS entropy, count(*) AS "values" FROM p, (SELECT sum(n) AS t FROM p)')
def a11(spark, d):
    return quality.language_entropy(spark.read.parquet(f"{d}/documents.parquet"), "lang").select(F.round("entropy", 9).alias("entropy"), "values")


@query("a12_latency", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def a12(spark, d):
    return quality.latency(spark.read.parquet(f"{d}/events.parquet"), ["event_type"], "value").select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99")])


@query("a29_duplicates", f"{R} SELECT round(1 - count(DISTINCT content) / count(*), 9) AS duplicate_rate, round(avg((len(content) < 30)::INT), 9) AS short_rate FROM reviews")
def a29(spark, d):
    return reviews(spark, d).agg(F.round(1 - F.count_distinct("content") / F.count(F.lit(1)), 9).alias("duplicate_rate"), F.round(F.avg((F.length("content") < 30).cast("int")), 9).alias("short_rate"))


@query("a31_confusion", f"""{R}, c AS (SELECT count_if(t AND g) AS tp, count_if(NOT t AND g) AS fp, count_if(t AND NOT g) AS fn, count_if(NOT t AND NOT g) AS tn FROM (SELECT is_actionable AS t, rating <= 3 AS g FROM reviews WHERE is_actionable IS NOT NULL))
SELECT *, round(tp / (tp + fp), 9) AS "precision", round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c""")
def a31(spark, d):
    r = reviews(spark, d).where("is_actionable IS NOT NULL").select(F.col("is_actionable").alias("t"), (F.col("rating") <= 3).alias("g"))
    return quality.confusion(r, "t", "g").select("tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("d1_psi", """WITH b AS (SELECT n_chars::DOUBLE AS x, (doc_id % 2)::INT AS side FROM documents), s AS (SELECT min(x) AS lo, max(x) AS hi, count_if(side = 0) AS n0, count_if(side = 1) AS n1 FROM b),
c AS (SELECT least(floor((x - lo) / (hi - lo) * 10), 9)::INT AS bin, count_if(side = 0) AS c0, count_if(side = 1) AS c1 FROM b, s GROUP BY 1),
p AS (SELECT (coalesce(c0, 0) + 1e-6) / (n0 + 1e-5) AS p0, (coalesce(c1, 0) + 1e-6) / (n1 + 1e-5) AS p1 FROM (SELECT unnest(range(10))::INT AS bin) g LEFT JOIN c USING (bin), s)
SELECT round(sum((p1 - p0) * ln(p1 / p0)), 9) AS psi FROM p""")
def d1(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return quality.psi(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "n_chars").select(F.round("psi", 9).alias("psi"))


@query("d2_ks", """WITH v AS (SELECT value AS x, count_if(event_id % 2 = 0) AS a, count_if(event_id % 2 = 1) AS b FROM events WHERE value IS NOT NULL GROUP BY value),
c AS (SELECT sum(a) OVER (ORDER BY x) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY x) / sum(b) OVER () AS fb FROM v) SELECT round(max(abs(fa - fb)), 9) AS statistic FROM c""")
def d2(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return quality.ks(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "value").select(F.round("statistic", 9).alias("statistic"))


@query("d4_vocabulary", """WITH w AS (SELECT DISTINCT doc_id % 2 AS side, w FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM documents)),
b AS (SELECT max((side = 0)::INT) AS o, max((side = 1)::INT) AS n FROM w GROUP BY w), c AS (SELECT count_if(o = 0) AS n_new, count_if(n = 0) AS n_gone, count_if(o = 1 AND n = 1) AS n_common FROM b)
SELECT *, round(n_new / (n_common + n_gone), 9) AS new_ratio, round(n_gone / (n_common + n_gone), 9) AS gone_ratio, round(n_common / (n_common + n_gone + n_new), 9) AS jaccard FROM c""")
def d4(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = quality.vocabulary_drift(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "text")
    return out.select("n_new", "n_gone", "n_common", *[F.round(c, 9).alias(c) for c in ("new_ratio", "gone_ratio", "jaccard")])


@query("d5_sentiment_drift", f"""{R}, a AS (SELECT avg(rating) m, stddev_pop(rating) s, avg((rating >= 4)::INT) p, avg((rating <= 2)::INT) n FROM reviews WHERE review_id % 2 = 0), b AS (SELECT avg(rating) m, stddev_pop(rating) s, avg((rating >= 4)::INT) p, avg((rating <= 2)::INT) n FROM reviews WHERE review_id % 2 = 1)
SELECT round(b.m - a.m, 9) AS mean_shift, round(b.s - a.s, 9) AS std_shift, round(b.p - a.p, 9) AS pos_shift, round(b.n - a.n, 9) AS neg_shift FROM a, b""")
def d5(spark, d):
    r = reviews(spark, d)
    out = quality.sentiment_drift(r.where("review_id % 2 = 0"), r.where("review_id % 2 = 1"), "rating")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("d7_calibration", f"""{R}, x AS (SELECT (rating - 1) / 4.0::DOUBLE AS p, is_actionable::INT::DOUBLE AS y FROM reviews WHERE is_actionable IS NOT NULL),
b AS (SELECT CASE WHEN p > 0 THEN ceil(p * 10) - 1 END AS bin, count(*) AS n, sum((p - y) * (p - y)) AS sq, avg(p) AS conf, avg(y) AS acc FROM x GROUP BY 1)
SELECT round(sum(sq) / sum(n), 9) AS brier, round(sum(CASE WHEN bin IS NOT NULL THEN abs(conf - acc) * n END) / sum(n), 9) AS ece, round(max(CASE WHEN bin IS NOT NULL THEN abs(conf - acc) END), 9) AS mce FROM b""")
def d7(spark, d):
    r = reviews(spark, d).where("is_actionable IS NOT NULL").select(((F.col("rating") - 1) / 4.0).cast("double").alias("p"), F.col("is_actionable").cast("int").alias("y"))
    out = quality.calibration(r, "p", "y")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("w7_head_tail", """WITH a AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY ALL), r AS (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM a)
SELECT event_type, round(avg(v) FILTER (i > n - least(7, n // 2)) - avg(v) FILTER (i <= least(7, n // 2)), 6) AS change FROM r GROUP BY event_type""")
def w7(spark, d):
    daily = spark.read.parquet(f"{d}/events.parquet").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return quality.head_tail(daily, ["event_type"], "day", "v").select("event_type", F.round("change", 6).alias("change"))


@query("w8_slope", """WITH a AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY ALL), r AS (SELECT event_type, v, (row_number() OVER (PARTITION BY event_type ORDER BY day) - 1)::DOUBLE AS x FROM a)
SELECT event_type, round(regr_slope(v, x), 6) AS slope, count(*) AS days FROM r GROUP BY event_type""")
def w8(spark, d):
    daily = spark.read.parquet(f"{d}/events.parquet").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return quality.slope(daily, ["event_type"], "day", "v").select("event_type", F.round("slope", 6).alias("slope"), "days")


@query("w9_bursts", "SELECT event_id, n_window FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN CURRENT ROW AND 86399999999 FOLLOWING) AS n_window FROM events WHERE ts IS NOT NULL) WHERE n_window >= 5")
def w9(spark, d):
    return similarity.bursts(spark.read.parquet(f"{d}/events.parquet"), at="ts", group="user_id").select("event_id", "n_window")


@query("p12_p13_health")
def p12(spark, d):
    """Health, risk and the alerts that fire, from the metrics of even against odd review ids."""
    r = reviews(spark, d).withColumn("s", F.col("rating") / 5.0)
    old, new = (r.where(F.col("review_id") % 2 == k) for k in (0, 1))
    snap = lambda rows: monitoring.snapshot(rows, "upload_id", "title", {"severity": "s", "actionability": "s"}, "review_id", "title")
    base, now = snap(old), snap(new)
    pairs = monitoring.matched(base, now, "upload_id")
    numbers = lambda rows: rows.select(F.explode("embedding").alias("x"))
    row = quality.psi(numbers(old), numbers(new), "x").select("psi")
    for more in (
        quality.vocabulary_drift(old, new, "content").select(F.col("new_ratio").alias("vocab")),
        quality.sentiment_drift(old, new, "rating").select(F.col("mean_shift").alias("sentiment")),
        monitoring.emerging(base, now, "upload_id", pairs).agg(F.count(F.lit(1)).alias("emerging")),
        monitoring.evolution(base, now, "upload_id", pairs).agg(F.avg((F.col("status") == "stable").cast("int")).alias("stability")),
        scoring.adversarial(r.select("content", "rating")).agg(F.avg(F.col("is_fake_positive").cast("int")).alias("fake"), F.avg(F.col("is_spam").cast("int")).alias("spam")),
        monitoring.coordinated(r, "upload_id", "at", "title", "review_id").agg(F.count(F.lit(1)).alias("bursts")),
    ):
        row = row.crossJoin(more)
    row = row.select(*[F.col(c).cast("double").alias(c) for c in row.columns]).localCheckpoint()
    fired = quality.alerts(monitoring.unpivoted(row)).agg(F.array_sort(F.collect_list("rule")).alias("alerts"))
    score = quality.health({k: F.col(k) for k in row.columns})
    return row.crossJoin(fired).select(*[F.round(c, 6).alias(c) for c in row.columns], score.alias("health"), quality.risk(score).alias("risk"), "alerts")


# ---- similarity, dedup ---------------------------------------------------------------------------------------------


_COS = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6)"


@query("v6_vector_search", f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS} AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS n FROM s) WHERE n <= 5""")
def v6(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return similarity.vector_search(e.where("vec_id % 50 = 0"), e, 5).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@query("v6_vector_search_20", f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS} AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS n FROM s) WHERE n <= 5""")
def v6_20(spark, d):
    """Every row whose id is divisible by 20 is a query."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return similarity.vector_search(e.where("vec_id % 20 = 0"), e, 5).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@query("p32_title_matches", f"""{C}, w AS (SELECT cluster_id, status, list_filter(list_distinct(list_filter(string_split_regex(lower(title), '\\s+'), lambda x: x <> '')), lambda x: x NOT IN ({', '.join(f"'{x}'" for x in lex.TITLE_STOP)})) AS w FROM clusters),
s AS (SELECT a.cluster_id AS new_id, b.cluster_id AS old_id, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS similarity FROM w a, w b WHERE a.status = 'open' AND b.status = 'resolved')
SELECT new_id, old_id, round(similarity, 9) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY similarity DESC, old_id) AS n FROM s WHERE similarity >= 0.4) WHERE n = 1""")
def p32(spark, d):
    c = clusters(spark, d)
    return similarity.title_matches(c.where("status = 'open'"), c.where("status = 'resolved'")).withColumn("similarity", F.round("similarity", 9))


_TFIDF = r"""g AS (SELECT cluster_id, regexp_extract_all(lower(concat_ws(' ', title, array_to_string(keywords, ' '))), '\w\w+') AS w FROM t),
tf AS (SELECT cluster_id, term, 1 + ln(count(*)) AS tf FROM (SELECT cluster_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM g) GROUP BY ALL),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM t)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term), v AS (SELECT cluster_id, term, tf * idf AS x FROM tf JOIN idf USING (term)),
u AS (SELECT cluster_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY cluster_id)) AS x FROM v)"""


@query("p32_j8_regressions", f"""{C}, t AS (SELECT * FROM clusters WHERE status IN ('open', 'resolved')), {_TFIDF},
c AS (SELECT a.cluster_id AS new_id, b.cluster_id AS old_id, round(sum(a.x * b.x), 9) AS cosine FROM u a JOIN u b USING (term) GROUP BY ALL),
w AS (SELECT cluster_id, status, list_filter(list_distinct(list_filter(string_split_regex(lower(title), '\\s+'), lambda x: x <> '')), lambda x: x NOT IN ({', '.join(f"'{x}'" for x in lex.TITLE_STOP)})) AS w FROM t),
s AS (SELECT a.cluster_id AS new_id, b.cluster_id AS old_id, coalesce(round(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0), 9), 0) AS jaccard, coalesce(cosine, 0) AS cosine
  FROM w a JOIN w b ON a.status = 'open' AND b.status = 'resolved' LEFT JOIN c ON c.new_id = a.cluster_id AND c.old_id = b.cluster_id),
b AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY greatest(jaccard, cosine) DESC, old_id) AS n FROM s)
SELECT new_id, old_id, CASE WHEN jaccard >= 0.4 AND cosine >= 0.62 THEN 'keyword+semantic' WHEN cosine >= 0.62 THEN 'semantic' ELSE 'keyword' END AS method, round(greatest(jaccard, cosine), 3) AS confidence
FROM b WHERE n = 1 AND (jaccard >= 0.4 OR cosine >= 0.62)""")
def p32_j8(spark, d):
    c = clusters(spark, d)
    return similarity.regression_matches(c.where("status = 'open'"), c.where("status = 'resolved'"))


@query("m9_w11_cohesion", """WITH u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
p AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u) GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) AS c FROM p GROUP BY label),
s AS (SELECT label, vec_id, round(list_dot_product(v, c) / sqrt(list_dot_product(c, c)), 9) AS s FROM u JOIN c USING (label)) SELECT label, round(avg(s), 6) AS cohesion, count(*) AS n FROM s GROUP BY label""")
def m9(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return similarity.cohesion(e, "label", "embedding", "vec_id").select("label", F.round("cohesion", 6).alias("cohesion")).join(e.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label")


@query("m10_shorten", "SELECT vec_id, round(list_dot_product(e, e), 6) AS len2 FROM (SELECT vec_id, list_transform(embedding[1:16]::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding[1:16]::DOUBLE[], embedding[1:16]::DOUBLE[]))) AS e FROM embeddings)")
def m10(spark, d):
    s = V.shortened(F.col("embedding"), 16)
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.round(V.dot(s, s), 6).alias("len2"))


@query("v7_bm25", """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM t),
f AS (SELECT doc_id, len(w) AS l, x, len(list_filter(w, lambda y: y = x)) AS tf FROM t, (VALUES ('the'), ('stupid'), ('trash')) q(x)), k AS (SELECT x, count(*) AS df FROM f WHERE tf > 0 GROUP BY x)
SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))), 6) AS score FROM f JOIN k USING (x), s WHERE tf > 0 GROUP BY doc_id""")
def v7(spark, d):
    return similarity.bm25(spark.read.parquet(f"{d}/documents.parquet"), ["the", "stupid", "trash"], "doc_id", "text").select("doc_id", F.round("score", 6).alias("score"))


@query("v8_rank_fusion", """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 20), b AS (SELECT doc_id, row_number() OVER (ORDER BY len(text) - doc_id DESC, doc_id) AS rank FROM documents QUALIFY rank <= 20)
SELECT doc_id, round(sum(1.0 / (60 + rank)), 9)::DOUBLE AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id ORDER BY rrf DESC, doc_id LIMIT 10""")
def v8(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    lists = []
    for key in (F.col("n_chars"), F.length("text") - F.col("doc_id")):
        top = docs.select("doc_id", key.alias("k")).orderBy(F.desc("k"), "doc_id").limit(20)
        lists.append(top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("k"), "doc_id"))))
    return similarity.fuse(lists, "doc_id").select("doc_id", F.round(F.col("rrf").cast("double"), 9).alias("rrf"))


@query("v1_kmeans_labels")
def v1(spark, d):
    return similarity.kmeans_labels(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding")


@query("u5_first_copy", f"{R} SELECT review_id FROM reviews QUALIFY row_number() OVER (PARTITION BY content ORDER BY review_id) = 1")
def u5(spark, d):
    return dedup.first_by(reviews(spark, d), ["content"], ["review_id"]).select("review_id")


@query("u6_embed_once", f"""{R}, n AS (SELECT review_id, trim(regexp_replace(lower(content), '\\s+', ' ', 'g')) AS norm FROM reviews) SELECT review_id, len(norm) AS value, min(review_id) OVER (PARTITION BY norm) AS representative FROM n""")
def u6(spark, d):
    r = reviews(spark, d).select("review_id", "content").withColumn("norm", X.normalised(F.col("content")))
    return dedup.computed_once(r, "norm", lambda u: u.withColumn("value", F.length("norm")), "review_id").select("review_id", "value", "representative")


@query("u9_u10_upsert", f"WITH {RUNS_SQL} SELECT tenant_id, issue_fingerprint, arg_max(review_count, run_seq) AS review_count, max(run_seq) AS run_seq FROM runs GROUP BY ALL")
def u9(spark, d):
    r = runs(spark, d)
    return dedup.latest(r.where("run_seq < 2"), r.where("run_seq >= 2"), ["tenant_id", "issue_fingerprint"], "run_seq").select("tenant_id", "issue_fingerprint", "review_count", "run_seq")


@query("a7_daily", 'SELECT CAST(ts AS DATE) AS day, round(avg(value), 6) AS mean_value, count(*) AS n FROM events GROUP BY 1')
def a7(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("mean_value"), F.count(F.lit(1)).alias("n"))


@query("a33_monthly_usage", "SELECT user_id, strftime(ts, '%Y-%m') AS year_month, count(*) AS uploads FROM events GROUP BY ALL")
def a33(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("year_month")).agg(F.count(F.lit(1)).alias("uploads"))


@query("e9_rate_limit", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def e9(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.count(F.lit(1)).over(w).alias("in_window"))


@query("m11_json", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def m11(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
