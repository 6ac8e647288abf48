"""URL filters: rules first, else empirical-Bayes reputation of the host.

Labelled outcomes of pages are counted by host, registered domain and suffix.
From the corpus mean down, each level's rate is shrunk towards its parent's by
a beta-binomial prior whose strength is estimated by moments over all groups of
that level.  A host is blocked where the lower posterior bound of its rate of
bad pages is over ``limit``.

Defined results: a url that is null or has no ``://`` has an empty host and path
and is judged by the reputation of that empty host; hosts without labelled
pages take their domain's rate; null ids never have labels; a page with several
labels is bad if one of them says so; repeated rows get equal verdicts; without
any label the rate is 0 and the method allows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_join, lower_ascii, pick, scratch

LIMIT = 0.5
Z = 1.645
#: Suffixes of two labels that count as one (a parameter; extend for production lists).
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "org.uk")
#: Verdict and rule, as host and path prefix.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def bare_host(host: Column) -> Column:
    """Without user names and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*\z", "")


def domain_of(host: Column, two: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    bare = bare_host(host)
    n = F.when(F.substring_index(bare, ".", -2).isin(*two), 3).otherwise(2)
    return F.when(bare.rlike(r"^[0-9.]*\z"), bare).when(n == 3, F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))


def suffix_of(domain: Column, two: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    pair = F.substring_index(domain, ".", -2)
    return F.when(domain.rlike(r"^[0-9.]*\z"), F.lit("")).when(pair.isin(*two), pair).otherwise(F.substring_index(domain, ".", -1))


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict (of equal lengths the first listed); else null."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        at, slash, rest = text.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame) -> float:
    """Moment estimate of a prior's strength from (n, k, m) rows: one row to the driver."""
    m, n, k = F.col("m"), F.col("n"), F.col("k")
    over, under = groups.agg(F.sum((k - n * m) ** 2 - n * m * (1 - m)), F.sum(n * (n - 1) * m * (1 - m))).first()
    rho = min(0.999, max(0.001, over / under)) if under else 0.5
    return (1 - rho) / rho


def reputation(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, mean, lower, upper) of all hosts in ``pages`` (page_id, host) by ``labels`` (page_id, bad)."""
    known = labels.filter(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = pages.join(known, "page_id", "left").groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("k"))
    hosts = scratch(hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain"))), "hosts")
    domains = scratch(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = scratch(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "suffixes")
    n, k = suffixes.agg(F.sum("n"), F.sum("k")).first()
    prior = F.lit(k / n if n else 0.0)

    def shrunk(groups: DataFrame, parents: DataFrame | None, key: str | None) -> DataFrame:
        g = groups.withColumn("m", prior) if parents is None else bounded_join(groups, parents.select(key, F.col("mean").alias("m")), [key])
        s = _strength(g)
        a, all_ = F.col("k") + s * F.col("m"), F.col("n") + s
        return g.withColumn("mean", a / all_).withColumn("sd", F.sqrt((a / all_) * (1 - a / all_) / (all_ + 1))).drop("m")

    by_suffix = scratch(shrunk(suffixes, None, None), "suffixes")
    by_domain = scratch(shrunk(domains, by_suffix, "suffix"), "domains")
    by_host = shrunk(hosts, by_domain, "domain")
    return by_host.select("host", "mean", (F.col("mean") - Z * F.col("sd")).alias("lower"), (F.col("mean") + Z * F.col("sd")).alias("upper"))


def judge_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, limit: float = LIMIT) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``; ``labels`` is (page_id, bad 0/1)."""
    rows = pick(pages, page_id=id_col, url=url_col)
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = scratch(reputation(rows.select("page_id", "host"), labels), "reputation")
    out = bounded_join(rows, known.select("host", "lower"), ["host"])
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("lower") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("page_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"))
