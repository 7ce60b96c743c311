"""URL filter: host rules, and beyond them an empirical-Bayes reputation of the host.

Labelled pages give each host a number of outcomes and of good ones. The share of good pages is shrunk through
beta-binomial priors: a suffix toward all pages, a registered domain toward its suffix, a host toward its domain. How strongly
each level holds its members together is estimated from the spread among them. A host stays while the lower bound of
its posterior reaches `min_good`; the bound is the normal one by the beta posterior's mean and variance, as SQL has no beta quantile.

User names and ports are no part of a domain, and a numeric address is its own domain and suffix. Under a country's two letters the labels of
SECOND make a suffix of two.

Defined cases: a null url, or one without "://", has an empty host and path, counts as no host's outcome and is allowed unless a rule says
otherwise; an id with several labels counts once, by the best; repeated rows are judged each. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, spread_join, written

#: Labels that stand before a country's.
SECOND = ("co", "com", "org", "net", "edu", "gov", "ac", "or", "ne", "go")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def bare(host: Column) -> Column:
    """Without user name and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def suffix_labels(host: Column) -> Column:
    """How many labels the suffix of a bare host has; null for numeric addresses."""
    last, two = F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)
    long = (F.length(last) == 2) & F.substring_index(two, ".", 1).isin(*SECOND) & (two != last)
    return F.when(host.rlike(r"^[0-9.]+$|^\["), None).when(long, 2).otherwise(1)


def suffix_of(host: Column) -> Column:
    """Of a bare host."""
    n = suffix_labels(host)
    return F.when(n.isNull(), host).when(n == 2, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain of a bare host: the suffix and one label before it."""
    n = suffix_labels(host)
    return F.when(n.isNull(), host).when(n == 2, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def ruled(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does. A rule is ("block" or "allow", "host/path")."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda x: len(x[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def strength(groups: DataFrame) -> float:
    """Pseudo-outcomes of a beta prior over the groups (n outcomes, k good), by moments of the beta-binomial.

    From the variance between groups against that within them; no sign of a spread gives a strong prior.
    """
    p = F.col("k") / F.col("n")
    r = groups.filter("n > 0").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("k") * p).alias("kp"), F.sum(F.col("k") * (1 - p)).alias("within")).first()
    if not r.m or r.m < 2 or r.n <= r.m:
        return 10.0
    mean = r.k / r.n
    between = (r.kp - r.n * mean * mean) / (r.m - 1)
    within = r.within / (r.n - r.m)
    size = (r.n - r.nn / r.n) / (r.m - 1)
    share = (between - within) / (between + (size - 1) * within) if between + (size - 1) * within > 0 else 0.0
    return min(1000.0, max(1.0, (1 - share) / share)) if share > 0 else 1000.0


def reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """host, p_good and good_from (its lower posterior bound). outcomes: host, good (1, 0 or null for no label)."""
    hosts = outcomes.filter("host <> ''").groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"))
    hosts = written(hosts.select("host", domain_of(bare(F.col("host"))).alias("domain"), suffix_of(bare(F.col("host"))).alias("suffix"), F.col("n").cast("double").alias("n"), F.col("k").cast("double").alias("k")), "host-outcomes")
    domains = written(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    mean = (total.k + 1) / (total.n + 2) if total.n else 1.0  # without any outcome there is nothing to hold against a host
    by_suffix, by_domain, by_host = strength(suffixes), strength(domains), strength(hosts)

    def shrunk(prior: Column, weight: float) -> Column:
        return (F.col("k") + weight * prior) / (F.col("n") + weight)

    suffixes = suffixes.select("suffix", shrunk(F.lit(mean), by_suffix).alias("suffix_good"))
    # half of all domains may share a suffix, and as many hosts a domain
    domains = spread_join(domains, suffixes, ["suffix"], F.xxhash64("domain")).select("domain", "suffix", shrunk(F.col("suffix_good"), by_domain).alias("domain_good"))
    hosts = spread_join(hosts, domains, ["domain", "suffix"], F.xxhash64("host")).select("host", "n", shrunk(F.col("domain_good"), by_host).alias("p_good"))
    spread = F.sqrt(F.col("p_good") * (1 - F.col("p_good")) / (F.col("n") + by_host + 1))
    return hosts.select("host", "p_good", F.greatest(F.lit(0.0), F.col("p_good") - z * spread).alias("good_from"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], min_good: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, good_from. labels: page_id, good (1 or 0)."""
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    good = labels.filter("page_id is not null").groupBy("page_id").agg(F.max("good").alias("good"))
    known = reputation(rows.select("page_id", "host").join(good, "page_id", "left"))
    rule, verdict = ruled(rules, F.col("host"), F.col("path"))
    judged = spread_join(rows, known, ["host"], F.xxhash64("page_id", "path"), "left")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("good_from") < min_good, "block").otherwise("allow")).alias("verdict"), "p_good", "good_from")
