"""Filters, features and rule scores of single reviews. Functions take and give columns or DataFrames; all are lazy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import text as X


def keep_v1(content: Column, rating: Column, min_len: int = 25) -> Column:
    """Is the review no noise: low rated, with a negative keyword, or neither short praise nor only praise?"""
    low = F.lower(content)
    negative, positive = X.has_any(low, lex.NEGATIVE_KEYWORDS), X.has_any(low, lex.POSITIVE_PATTERNS)
    high = X.yes(rating >= 4)
    return X.yes(rating <= 3) | negative | ~((X.yes(F.length(content) < min_len) & high) | (positive & ~negative & high))


def keep_v2(text: Column, rating: Column, is_actionable: Column) -> Column:
    """Scored reviews stay if actionable; the others unless they are short and rated 4 or more."""
    return F.coalesce(is_actionable, ~(X.yes(rating >= 4) & X.yes(F.length(text) < 25)))


def features(df: DataFrame, text: str = "content", rating: str = "rating") -> DataFrame:
    """``df`` with the feature columns of each text."""
    t = F.coalesce(F.col(text), F.lit(""))
    low, n = F.lower(t), F.length(t)
    words = X.tokens(t)
    df = df.withColumn("_w", words)
    w, wc = F.col("_w"), F.size("_w")
    per_char = lambda k: F.when(n > 0, k / n).otherwise(F.lit(0.0))
    df = df.select(
        "*",
        n.alias("length"),
        wc.alias("word_count"),
        F.when(wc > 0, F.aggregate(w, F.lit(0), lambda s, x: s + F.length(x)) / wc).otherwise(F.lit(0.0)).alias("avg_word_length"),
        F.size(F.filter(F.split(t, r"\."), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != "")).alias("sentence_count"),
        X.count_in(w, lex.POSITIVE_WORDS).alias("positive_words"),
        X.count_in(w, lex.NEGATIVE_WORDS).alias("negative_words"),
        X.count_in(w, lex.COMPLAINT_VERBS).alias("complaint_verbs"),
        (n - F.length(F.replace(t, F.lit("?"), F.lit("")))).alias("question_marks"),
        (n - F.length(F.replace(t, F.lit("!"), F.lit("")))).alias("exclamation_marks"),
        per_char(F.regexp_count(t, F.lit(r"\p{Lu}"))).alias("caps_ratio"),
        per_char(F.regexp_count(t, F.lit("[.,!?;:]"))).alias("punctuation_ratio"),
        X.has_any(low, lex.BUG_KEYWORDS).alias("has_bug_keywords"),
        X.has_any(low, lex.FEATURE_KEYWORDS).alias("has_feature_request"),
        X.has_any(low, lex.COMPARISONS).alias("has_comparison"),
        t.rlike(lex.DETAILS).alias("has_specific_details"),
        X.has_any(low, lex.CONCESSIONS).alias("has_concession"),
        X.count_of(low, lex.CONCESSIONS).alias("concession_count"),
        X.has_any(low, lex.MONETIZATION).alias("has_monetization_complaint"),
        X.has_any(low, lex.RETENTION).alias("has_retention_signal"),
        X.count_of(low, lex.FEATURE_REQUESTS).alias("feature_request_count"),
        F.coalesce(F.col(rating).cast("double"), F.lit(3.0)).alias("rating_value"),
    ).drop("_w")
    pos, neg, verbs, wc = F.col("positive_words"), F.col("negative_words"), F.col("complaint_verbs"), F.col("word_count")
    by_word = lambda k: F.when(wc > 0, k / wc).otherwise(F.lit(0.0))
    clamp = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    return df.select(
        "*",
        clamp(by_word(neg + verbs - pos)).alias("emotion_intensity"),
        F.when((pos > 0) & (neg > 0), by_word(F.least(pos, neg))).otherwise(F.lit(0.0)).alias("sentiment_contrast"),
        clamp(by_word(pos - neg)).alias("polarity"),
        ((pos > 0) & (neg > 0) & (F.least(pos, neg) > 0.3 * F.greatest(pos, neg))).alias("mixed_sentiment"),
    )


def rule_score(text: Column, rating: Column) -> Column:
    """Actionability of a review from rating, keywords, length and exclamation marks, in 0..1."""
    low, r = F.lower(text), F.coalesce(F.nullif(rating.cast("double"), F.lit(0.0)), F.lit(3.0))
    tenths = (
        F.when(r <= 2, 4).when(r <= 3, 2).otherwise(0)
        + F.when(X.has_any(low, lex.RULE_KEYWORDS), 3).otherwise(0)
        + F.when(F.length(text) >= 25, 2).otherwise(-1)
        + F.when(low.contains("!"), 1).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(10), tenths)) / F.lit(10.0)


def fallback_score(text: Column, rating: Column) -> Column:
    """The rule score of the untrained model: nothing is taken off short texts, and shouting counts."""
    low, r, n = F.lower(text), F.coalesce(F.nullif(rating.cast("double"), F.lit(0.0)), F.lit(3.0)), F.length(text)
    loud = low.contains("!") | X.yes(F.regexp_count(text, F.lit(r"\p{Lu}")) > 0.3 * n)
    tenths = F.when(r <= 2, 4).when(r <= 3, 2).otherwise(0) + F.when(X.has_any(low, lex.RULE_KEYWORDS), 3).otherwise(0) + F.when(n >= 25, 2).otherwise(0) + F.when(loud, 1).otherwise(0)
    return tenths / F.lit(10.0)


def hybrid_rule(f: DataFrame) -> tuple[Column, Column]:
    """(actionable, confidence) by the first rule that fits; ``f`` has the columns of ``features``."""
    c = F.col
    ladder = [
        ((c("rating_value") <= 2) & (c("complaint_verbs") > 0), True, 0.95),
        (c("has_bug_keywords") & c("has_specific_details"), True, 0.9),
        ((c("complaint_verbs") >= 2) & (c("negative_words") >= 3), True, 0.85),
        (c("mixed_sentiment"), True, 0.75),
        (c("has_feature_request") & c("has_specific_details"), True, 0.8),
        ((c("rating_value") >= 4) & (c("negative_words") == 0) & (c("word_count") < 10), False, 0.85),
        ((c("word_count") < 5) | (c("length") < 20), False, 0.8),
        (c("polarity") < -0.3, True, 0.6),
        (c("polarity") > 0.3, False, 0.6),
    ]
    verdict, sure = F.lit(True), F.lit(0.5)
    for cond, yes, p in reversed(ladder):
        verdict, sure = F.when(cond, F.lit(yes)).otherwise(verdict), F.when(cond, F.lit(p)).otherwise(sure)
    return verdict, sure


def fast_rule() -> Column:
    """The batch form of the rules; the rating is the review's rating."""
    c = F.col
    return (
        F.when((c("rating_value") <= 2) & (c("complaint_verbs") > 0), 1.0)
        .when(c("word_count") < 5, 0.0)
        .when(c("negative_words") >= 3, 0.9)
        .when((c("rating_value") >= 4) & (c("negative_words") == 0), 0.2)
        .otherwise(0.5)
    )


def auto_label(text: str = "content") -> Column:
    """Struct (label, confidence, reason) for training data; needs the columns of ``features``."""
    c, low = F.col, F.lower(F.col(text))
    out = lambda y, p, why: F.struct(F.lit(y).alias("label"), F.lit(p).alias("confidence"), F.lit(why).alias("reason"))
    return (
        F.when(F.trim(F.coalesce(c(text), F.lit(""))) == "", out(False, 1.0, "empty_review"))
        .when((c("rating_value") <= 2) & (c("complaint_verbs") >= 1), out(True, 0.95, "low_rating_with_complaints"))
        .when(c("has_bug_keywords") & c("has_specific_details"), out(True, 0.9, "bug_with_details"))
        .when((c("complaint_verbs") >= 2) & (c("negative_words") >= 3), out(True, 0.9, "multiple_complaints"))
        .when(c("has_specific_details") & (c("negative_words") >= 2), out(True, 0.85, "technical_issue_with_details"))
        .when(c("has_feature_request") & c("has_specific_details"), out(True, 0.8, "feature_request_with_details"))
        .when(c("mixed_sentiment"), out(True, 0.75, "mixed_sentiment"))
        .when(X.has_any(low, ["crash", "crashes", "crashing", "freeze", "not working", "cant open", "wont load"]), out(True, 0.85, "critical_error"))
        .when((c("word_count") < 3) | (c("length") < 15), out(False, 0.9, "too_short"))
        .when((c("rating_value") >= 4.5) & (c("negative_words") == 0) & (c("complaint_verbs") == 0), out(False, 0.85, "high_rating_no_negatives"))
        .when((c("positive_words") >= 3) & (c("negative_words") == 0) & (c("rating_value") >= 4), out(False, 0.8, "pure_praise"))
        .when((c("word_count") <= 5) & X.has_any(low, ["good", "nice", "ok", "fine", "thanks", "thank you"]), out(False, 0.8, "generic_positive"))
        .when(F.regexp_count(c(text), F.lit(r"\p{L}")) < 5, out(False, 0.9, "mostly_symbols"))
        .when(c("polarity") < -0.3, out(True, 0.65, "negative_sentiment"))
        .when((c("polarity") > 0.3) & (c("rating_value") >= 4), out(False, 0.65, "positive_sentiment"))
        .when((c("question_marks") > 0) & (c("negative_words") < 2), out(True, 0.5, "question_uncertain"))
        .otherwise(out(True, 0.5, "default_include"))
    )


def validated(df: DataFrame, text: str = "content", score: str = "rating", longest: int = 10_000) -> DataFrame:
    """Columns clean_content, clean_score, is_valid, warnings, corrections of each row."""
    t = F.trim(F.regexp_replace(F.col(text), r"^\s+|\s+$", ""))
    cut = F.substring(t, 1, longest)
    s = F.col(score).try_cast("int")
    warn = [
        F.when(F.col(text).isNull(), "null_content"),
        F.when(t == "", "empty_content"),
        F.when(F.length(t) > longest, "too_long"),
        F.when(X.emoji_runs(cut) > 0.5 * F.length(cut), "noise_heavy"),
        F.when(F.size(X.scripts(cut)) > 1, "mixed_language"),
        F.when((s < 1) | (s > 5), "score_out_of_range"),
        F.when(F.col(score).isNotNull() & s.isNull(), "invalid_score"),
    ]
    fixes = [F.when(F.length(t) > longest, "truncated"), F.when((s < 1) | (s > 5), "clamped_score"), F.when(s.isNull(), "default_score")]
    return df.select(
        "*",
        F.coalesce(cut, F.lit("")).alias("clean_content"),
        F.coalesce(F.greatest(F.lit(1), F.least(F.lit(5), s)), F.lit(3)).alias("clean_score"),
        X.yes(t != "").alias("is_valid"),
        F.array_compact(F.array(*warn)).alias("warnings"),
        F.array_compact(F.array(*fixes)).alias("corrections"),
    )


def adversarial(df: DataFrame, text: str = "content", score: str = "rating") -> DataFrame:
    """Columns fake_positive, sarcasm, spam (suspicions) and is_fake_positive, is_sarcastic, is_spam."""
    t, s = F.col(text), F.col(score)
    low, words = F.lower(t), X.tokens(t)
    hostile, marks = X.count_of(low, lex.HOSTILE), X.count_of(low, lex.SARCASM)
    fake = F.when(hostile >= 3, 4).otherwise(0) + F.when((marks > 0) & (hostile > 0), 3).otherwise(0) + F.when(low.rlike(lex.CONTRADICTION), 2).otherwise(0)
    shouts = F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))
    caps = F.regexp_count(t, F.lit(r"\p{Lu}")) > 0.3 * F.length(t)
    irony = F.when(marks > 0, F.least(F.lit(10), 3 + 2 * marks) + F.when(shouts >= 2, 1).otherwise(0) + F.when(caps, 1).otherwise(0)).otherwise(0)
    run = lambda s, x: F.when(x == s["word"], s["n"] + 1).otherwise(1)
    most = F.aggregate(
        F.array_sort("_w"),
        F.struct(F.lit("").alias("word"), F.lit(0).alias("n"), F.lit(0).alias("most")),
        lambda s, x: F.struct(x.alias("word"), run(s, x).alias("n"), F.greatest(s["most"], run(s, x)).alias("most")),
        lambda s: s["most"],
    )
    spam = sum((F.when(t.rlike(p), 3).otherwise(0) for p in lex.SPAM), F.lit(0)) + F.when(F.size("_w") < 5, 2).otherwise(0) + F.when(X.yes(most > 0.3 * F.size("_w")), 2).otherwise(0)
    out = df.withColumn("_w", words).select("*", F.when(X.yes(s >= 4), fake).otherwise(0).alias("_f"), F.when(X.yes(s <= 2), irony).otherwise(0).alias("_i"), spam.alias("_s"))
    return out.select(
        *df.columns,
        (F.col("_f") / 10.0).alias("fake_positive"),
        (F.col("_i") / 10.0).alias("sarcasm"),
        (F.col("_s") / 10.0).alias("spam"),
        (F.col("_f") >= 6).alias("is_fake_positive"),
        (F.col("_i") >= 5).alias("is_sarcastic"),
        (F.col("_s") >= 5).alias("is_spam"),
    )


def ensemble(df: DataFrame, inputs: list[str], label: str) -> DataFrame:
    """``df`` (rows of features) with score, uncertainty and confidence of 0.4 logistic regression + 0.6 boosted trees.

    Both are fitted on all rows whose ``label`` is not null, and score all rows.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    points = VectorAssembler(inputCols=[f"_{c}" for c in inputs], outputCol="_x").transform(df.withColumns({f"_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in inputs} | {"_y": F.col(label).cast("double")}))
    points = points.drop(*[f"_{c}" for c in inputs]).persist()
    common = {"featuresCol": "_scaled", "labelCol": "_y"}
    models = [
        StandardScaler(inputCol="_x", outputCol="_scaled", withMean=True),
        LogisticRegression(**common, regParam=1e-4, predictionCol="_p1", rawPredictionCol="_r1", probabilityCol="_online"),
        GBTClassifier(**common, maxIter=50, maxDepth=4, stepSize=0.1, subsamplingRate=0.8, seed=42, predictionCol="_p2").setRawPredictionCol("_r2").setProbabilityCol("_batch"),
    ]
    out = Pipeline(stages=models).fit(points.where("_y IS NOT NULL")).transform(points)
    out = out.withColumns({"_a": vector_to_array("_online")[1], "_b": vector_to_array("_batch")[1]})
    a, b = F.col("_a"), F.col("_b")
    return out.select(*df.columns, (0.4 * a + 0.6 * b).alias("score"), *[c.alias(n) for c, n in zip(doubt(a, b), ("uncertainty", "confidence"))])


def doubt(a: Column, b: Column) -> tuple[Column, Column]:
    """Uncertainty and confidence of two models' probabilities; mixed sentiment and costly signals add to the first."""
    boost = F.when(X.yes(F.col("has_concession") | (F.col("sentiment_contrast") > 0.05)), 0.15).otherwise(0.0) + F.when(X.yes(F.col("has_monetization_complaint") | F.col("has_retention_signal")), 0.1).otherwise(0.0)
    uncertainty = F.least(F.lit(1.0), F.least(F.lit(1.0), (a - b) * (a - b)) + boost)
    confidence = F.greatest(F.lit(0.3), F.least(F.lit(0.99), (1.0 - uncertainty) * 0.6 + (1.0 - F.abs(a - b)) * 0.4))
    return uncertainty, confidence
