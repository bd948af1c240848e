"""URL filter: allow and block rules by host and path, else an empirical-Bayes reputation of the host.

Labelled pages are counted per host, registered domain and public suffix. Each level's share of good pages is drawn
towards the level above it by a beta-binomial prior whose strength is estimated from the spread between its groups
(moments); a host is blocked if the upper bound of its posterior share stays under MIN_GOOD. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle

#: Rules (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Suffixes of two labels under which names are registered: these labels below a country's two letters.
TWO_LABEL_SUFFIX = r"^(ac|co|com|edu|go|gob|gov|ltd|mil|ne|net|nom|or|org|plc|sch)\.[a-z]{2}$"
MIN_GOOD = 0.5
Z = 1.645
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def domain_of(host: Column) -> Column:
    """The registered domain: two labels, or three under a suffix of two; without port or user."""
    bare = F.regexp_replace(host, r"^.*@|:\d*$", "")
    two = F.substring_index(bare, ".", -2)
    return F.when(two.rlike(TWO_LABEL_SUFFIX), F.substring_index(bare, ".", -3)).otherwise(two)


def suffix_of(domain: Column) -> Column:
    return F.when(F.instr(domain, ".") > 0, F.regexp_replace(domain, r"^[^.]*\.", "")).otherwise(domain)


def strength(groups: DataFrame) -> DataFrame:
    """One row: kappa, the prior's weight in pages, from the spread of k/n between groups (moments), within 1..1000."""
    p = F.col("k_all") / F.col("n_all")
    spread = F.col("kk") - 2 * p * F.col("k_all") + p * p * F.col("n_all")
    noise = p * (1 - p)
    rho = F.expr("0D") + (spread - noise * (F.col("m") - 1)) / F.when(noise * (F.col("n_all") - F.col("nn") / F.col("n_all") - (F.col("m") - 1)) > 0, noise * (F.col("n_all") - F.col("nn") / F.col("n_all") - (F.col("m") - 1)))
    tied = F.greatest(F.lit(0.001), F.least(F.lit(0.5), F.coalesce(rho, F.lit(0.001))))
    sums = groups.agg(F.sum("n").alias("n_all"), F.sum("k").alias("k_all"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count(F.lit(1)).alias("m"))
    return sums.select((1 / tied - 1).alias("kappa"), F.coalesce(p, F.lit(1.0)).alias("mean"))


def reputation(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """host, n, k, mean, upper of ``outcomes`` (host string, good boolean): the posterior share of good pages.

    Rows with a null or empty host or a null outcome take no part. The pages are read once, and the counts per host are
    written to the shared folder. The driver receives two numbers per level. No outcomes give an empty result.
    """
    hosts = outcomes.where("host != '' AND good IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("k"))
    hosts = settle(hosts, "host-counts").withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain")))
    level = {c: hosts.groupBy(*c).agg(F.sum("n").alias("n"), F.sum("k").alias("k")) for c in (("suffix",), ("domain", "suffix"))}
    (ks, mean), (kd, _), (kh, _) = (strength(x).first() for x in (level["suffix",], level["domain", "suffix"], hosts))
    suffixes = level["suffix",].select("suffix", ((F.col("k") + ks * mean) / (F.col("n") + ks)).alias("m_suffix"))
    domains = level["domain", "suffix"].join(suffixes, "suffix").select("domain", ((F.col("k") + kd * F.col("m_suffix")) / (F.col("n") + kd)).alias("m_domain"))
    a = F.col("k") + kh * F.col("m_domain")
    size = F.col("n") + kh
    share = a / size
    return hosts.join(domains, "domain").select("host", "n", "k", share.alias("mean"), (share + z * F.sqrt(share * (1 - share) / (size + 1))).alias("upper"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, min_good: float = MIN_GOOD) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url); ``outcomes``: page_id, good.

    A null url, or one without ``://``, has an empty host and path. Pages that no rule fits are blocked if their host's
    upper bound is below ``min_good``; a host without labelled pages is allowed. Rows with a null id are judged, but
    have no outcome. Repeated rows are judged alike. Other columns are ignored; an empty table gives an empty result.
    """
    seen = pages.select("page_id", host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    labelled = seen.select("page_id", "host").join(outcomes.select("page_id", "good"), "page_id")
    known = reputation(labelled).where(F.col("upper") < min_good).select("host", F.lit(True).alias("bad"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return seen.join(known, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bad"), F.lit("block")), F.lit("allow")).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: a page is good if the label of its id says quality 1 and not toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    outcomes = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), outcomes)


SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
y AS (SELECT doc_id AS page_id, min((quality = 1 AND toxic = 0)::INT) AS good FROM labels GROUP BY 1),
h0 AS (
  SELECT host, count(*)::DOUBLE AS n, sum(good)::DOUBLE AS k, regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') AS bare
  FROM p JOIN y USING (page_id) WHERE host <> '' AND good IS NOT NULL GROUP BY host),
h1 AS (
  SELECT *, CASE WHEN regexp_matches(array_to_string(string_split(bare, '.')[-2:], '.'), '^(ac|co|com|edu|go|gob|gov|ltd|mil|ne|net|nom|or|org|plc|sch)\.[a-z]{2}$')
                 THEN array_to_string(string_split(bare, '.')[-3:], '.') ELSE array_to_string(string_split(bare, '.')[-2:], '.') END AS domain FROM h0),
h AS (SELECT *, CASE WHEN contains(domain, '.') THEN regexp_replace(domain, '^[^.]*\.', '') ELSE domain END AS suffix FROM h1),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY 1),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY 1, 2),
a AS (
  SELECT l, sum(n) AS n_all, sum(k) AS k_all, sum(k * k / n) AS kk, sum(n * n) AS nn, count(*) AS m, sum(k) / sum(n) AS p
  FROM (SELECT 's' AS l, n, k FROM s UNION ALL SELECT 'd', n, k FROM d UNION ALL SELECT 'h', n, k FROM h) GROUP BY l),
r AS (
  SELECT l, p, 1 / greatest(0.001, least(0.5, coalesce((kk - 2 * p * k_all + p * p * n_all - p * (1 - p) * (m - 1))
         / CASE WHEN p * (1 - p) * (n_all - nn / n_all - (m - 1)) > 0 THEN p * (1 - p) * (n_all - nn / n_all - (m - 1)) END, 0.001))) - 1 AS kappa FROM a),
ms AS (SELECT suffix, (k + kappa * p) / (n + kappa) AS m_suffix FROM s, r WHERE l = 's'),
md AS (SELECT domain, (k + kappa * m_suffix) / (n + kappa) AS m_domain FROM d JOIN ms USING (suffix), r WHERE l = 'd'),
mh AS (SELECT host, (k + kappa * m_domain) / (n + kappa) AS mean, n + kappa AS size FROM h JOIN md USING (domain), r WHERE l = 'h'),
bad AS (SELECT host FROM mh WHERE mean + 1.645 * sqrt(mean * (1 - mean) / (size + 1)) < 0.5),
j AS (
  SELECT p.*, bad.host IS NOT NULL AS bad, host = 'com' OR ends_with(host, '.com') AS com, host = 'example.com' OR ends_with(host, '.example.com') AS ex,
         host = 'www.example.com' OR ends_with(host, '.www.example.com') AS www, host = 'net' OR ends_with(host, '.net') AS net
  FROM p LEFT JOIN bad USING (host)),
k AS (
  SELECT *, CASE WHEN www AND starts_with(path, '/en/') THEN 'www.example.com/en/' WHEN ex AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN net AND starts_with(path, '/fr/') THEN 'net/fr/' WHEN net AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN com AND starts_with(path, '/') THEN 'com/' END AS rule FROM j)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR bad THEN 'block' ELSE 'allow' END AS verdict FROM k
"""
