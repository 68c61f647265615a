"""URL filters: explicit rules, and an empirical-Bayes reputation of hosts from labelled page outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import ascii_lower

#: Suffixes of two labels under which names are registered.
DOUBLE_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def rule_match(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """A struct (length, rule, verdict) of the longest rule that fits, or null. A rule is (verdict, host/path)."""
    found = []
    for verdict, rule in rules:
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        found.append(F.when(fits, F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.greatest(*found, F.lit(None).cast("struct<length:int,rule:string,verdict:string>"))


def host_levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host without its port."""
    labels = F.split(F.regexp_replace(host, ":[0-9]*$", ""), r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")
    double = two.isin(*DOUBLE_SUFFIXES)
    return F.when(double, three).otherwise(two), F.when(double, two).otherwise(F.element_at(labels, -1))


def concentration(groups: DataFrame, mean: str, least: float = 2.0, most: float = 1000.0) -> float:
    """Beta-binomial concentration of one level by the moments of its labelled groups around their parents' means.

    With X = sum of n (y/n - m)^2 / (m (1 - m)) over k groups with n labels each, E[X] = k + (N - k) rho; the
    concentration is (1 - rho) / rho, held between ``least`` and ``most``.
    """
    n, y, m = F.col("n").cast("double"), F.col("y").cast("double"), F.col(mean)
    row = (
        groups.filter("n > 0")
        .agg(F.sum(n * (y / n - m) * (y / n - m) / (m * (1 - m))).alias("x"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"))
        .first()
    )
    free = (row.total or 0) - row.k
    rho = (row.x - row.k) / free if free > 0 else 0.0
    rho = min(max(rho, 1 / (1 + most)), 1 / (1 + least))
    return (1 - rho) / rho


def host_reputation(outcomes: DataFrame, z: float = 1.645, most_bad: float = 0.3) -> DataFrame:
    """Posterior rate of bad pages of each host, shrunk to its registered domain, its suffix and the whole.

    In: host, bad (1, 0, or null for a page without a label). Out: host, domain, suffix, n (labels), y (bad ones), mean,
    sd, bound = mean - z sd of the host's beta posterior, and verdict: ``block`` if the bound is over ``most_bad``.

    Each level's posterior mean is the next level's prior mean; the prior's weight is estimated by moments over the
    level's groups. The whole starts from one good and one bad page. Hosts without labels have their domain's mean.
    An empty table gives an empty table.
    """
    domain, suffix = host_levels(F.col("host"))
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("y"))
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("y")).first()
    sums = [F.sum("n").alias("n"), F.sum("y").alias("y")]
    suffixes = hosts.groupBy("suffix").agg(*sums).withColumn("prior", F.lit((total.y + 1.0) / (total.n + 2.0)))
    weight = F.lit(concentration(suffixes, "prior"))
    mean = (F.col("y") + weight * F.col("prior")) / (F.col("n") + weight)
    suffixes = suffixes.select("suffix", mean.alias("prior"))
    domains = hosts.groupBy("domain", "suffix").agg(*sums).join(suffixes, "suffix")
    weight = F.lit(concentration(domains, "prior"))
    domains = domains.select("domain", ((F.col("y") + weight * F.col("prior")) / (F.col("n") + weight)).alias("prior"))
    hosts = hosts.join(domains, "domain")
    weight = F.lit(concentration(hosts, "prior"))
    hosts = hosts.withColumns({"_a": F.col("y") + weight * F.col("prior"), "_w": F.col("n") + weight})
    hosts = hosts.withColumn("mean", F.col("_a") / F.col("_w"))
    hosts = hosts.withColumn("sd", F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("_w") + 1)))
    hosts = hosts.withColumn("bound", F.col("mean") - z * F.col("sd"))
    verdict = F.when(F.col("bound") > most_bad, "block").otherwise("allow")
    return hosts.select("host", "domain", "suffix", "n", "y", "mean", "sd", "bound", verdict.alias("verdict"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], z: float = 1.645, most_bad: float = 0.3) -> DataFrame:
    """Judge each page's url: the longest rule that fits decides, else the reputation of its host.

    In: pages (page_id, url), labels (doc_id = page_id, quality, toxic); other columns are ignored. A labelled page
    is bad if its quality is 0 or it is toxic; a label with both null says nothing. Out: a row per page row with
    page_id, host, path, rule (null if none fits), verdict, and the reputation's mean and bound. Null urls and urls without
    :// have an empty host and path and are judged by the outcomes of such pages. Repeated labels of one page count
    once, the worse outcome winning; repeated page rows each count and each get a row. Rules are a short list, held in the plan.
    """
    host, path = url_parts(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    outcome = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")).groupBy("page_id").agg(F.max("bad").alias("bad"))
    known = parsed.select("page_id", "host").join(outcome, "page_id", "left")
    # counted by host and outcome before anything else, so a host with a third of all pages is a few rows
    reputation = host_reputation(known, z, most_bad).select("host", "mean", "bound", F.col("verdict").alias("_own"))
    found = parsed.withColumn("_r", rule_match(F.col("host"), F.col("path"), rules)).join(reputation, "host")
    return found.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", "_own").alias("verdict"), "mean", "bound")
