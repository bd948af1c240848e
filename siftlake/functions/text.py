"""Column functions on review texts and cluster titles. All are lazy built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lex


def yes(cond: Column) -> Column:
    """A predicate in which null counts as false."""
    return F.coalesce(cond, F.lit(False))


def has_any(text: Column, phrases: list[str]) -> Column:
    """Does the text hold any of the phrases, as a literal substring? Null: no."""
    return yes(reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases]))


def count_of(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases occur in the text."""
    return reduce(lambda a, b: a + b, [yes(F.contains(text, F.lit(p))).cast("int") for p in phrases])


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def count_in(words: Column, lexicon: list[str]) -> Column:
    """How many of the words are in the lexicon."""
    return F.size(F.filter(words, lambda w: w.isin(*lexicon)))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def fingerprint(title: Column, keywords: Column) -> Column:
    """32 hex digits that stay the same for a re-worded title: a hash of the sorted set of its words and keywords."""
    words = F.array_except(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), F.array(*map(F.lit, lex.FINGERPRINT_FILLERS)))
    more = F.filter(F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.lower(F.trim(k))), lambda k: k != "")
    return F.substring(F.sha2(F.concat_ws("|", F.array_sort(F.array_union(words, more))), 256), 1, 32)


def version_in(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(text), r"v?(\d+\.\d+(?:\.\d+)?)", 0), F.lit(""))


def device_in(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(d)), F.lit(d.capitalize())) for d in lex.DEVICES])


def title_v1(text: Column, severity: Column) -> Column:
    low, tag = F.lower(text), F.concat(F.lit("["), F.upper(severity), F.lit("] "))
    body = (
        F.when(low.contains("crash"), F.lit("App crashes"))
        .when(low.contains("login"), F.lit("Login issues"))
        .when(low.contains("slow") | low.contains("lag"), F.lit("Performance issues"))
        .when(low.contains("subscription") | low.contains("payment"), F.lit("Payment/subscription issues"))
        .otherwise(F.concat(F.lit("Issue: "), F.substring(text, 1, 50), F.lit("...")))
    )
    return F.concat(tag, body)


def title_v2(text: Column) -> Column:
    return F.when(F.length(text) > 100, F.concat(F.substring(text, 1, 100), F.lit("..."))).otherwise(text)


def clean_title(title: Column) -> Column:
    return F.regexp_replace(title, r"(?i)^\[(CRITICAL|HIGH|MEDIUM|LOW)\]\s*(Issue:\s*)?", "")


def app_name(filename: Column) -> Column:
    stem = F.regexp_replace(F.regexp_replace(filename, r"(?<=.)\.[^.]*$", ""), r"[_\-\s]+", " ")
    return F.coalesce(F.nullif(F.initcap(F.trim(stem)), F.lit("")), F.lit("Unknown App"))


def platform_of(text: Column) -> Column:
    low = F.lower(text)
    droid, apple = low.rlike(r"\bandroid\b|\bplay.?store\b"), low.rlike(r"\bios\b|\biphone\b|\bipad\b|\bapp.?store\b")
    return F.when(droid & apple, "both").when(droid, "android").when(apple, "ios").otherwise("unknown")


def platform_of_devices(devices: Column) -> Column:
    low = F.transform(devices, lambda d: F.lower(F.trim(d)))
    has = lambda words: F.exists(low, lambda d: d.isin(*words))
    droid, apple = has(lex.ANDROID_WORDS), has(lex.IOS_WORDS)
    return F.when(yes(droid) & yes(apple), "both").when(yes(droid), "android").when(yes(apple), "ios").otherwise("unknown")


def cluster_type(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(low.rlike(p), F.lit(name)) for name, p in lex.CLUSTER_TYPES], F.lit("bug"))


def is_praise(title: Column, severity: Column) -> Column:
    t = clean_title(title)
    return F.when(t.rlike(lex.COMPLAINT_TITLE), False).when(t.rlike(lex.PRAISE_TITLE), True).otherwise(severity == "low")


def signal_strength(n: Column) -> Column:
    return F.when(n >= 500, "Dominant").when(n >= 100, "Very Strong").when(n >= 20, "Strong").when(n >= 5, "Moderate").otherwise("Weak")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two word arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def title_words(title: Column) -> Column:
    return F.array_except(F.array_distinct(tokens(title)), F.array(*map(F.lit, lex.TITLE_STOP)))


def scripts(text: Column) -> Column:
    """Names of the scripts in the text; 'english' if it has letters of none of them, else 'unknown'."""
    found = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in lex.SCRIPTS.items()]))
    return F.when(F.size(found) > 0, found).when(text.rlike(r"\p{L}"), F.array(F.lit("english"))).otherwise(F.array(F.lit("unknown")))


def emoji_runs(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(lex.EMOJI), F.lit(0)))


def redacted(url: Column) -> Column:
    return F.regexp_replace(url, r"://([^:/@]+):[^@]*@", "://$1:***@")


def label_of(value: Column) -> Column:
    low = F.lower(F.trim(value.cast("string")))
    return F.when(low.isin("1", "true", "yes", "actionable"), True).when(low.isin("0", "false", "no", "not actionable", "not"), False)


def bigrams(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
