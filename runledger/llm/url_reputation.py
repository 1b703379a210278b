"""URL filtering by empirical-Bayes host reputation, with host and path rules before it.

Labelled outcomes are counted by host, registered domain and suffix. Each level's
rate is shrunk to its parent's by a beta-binomial prior whose strength is the
moment estimate from that level's own spread. A host is blocked where the lower
bound of its posterior bad rate passes the limit; hosts without labels have
their domain's, suffix's or the overall posterior.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import materialize

#: (host, path, verdict); a rule fits its host and all subdomains.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
# fixed values: suffixes of two labels
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "gov.uk", "net.au", "org.au", "org.uk")
Z = 1.6448536269514722
LIMIT = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEVELS = ("suffix", "domain", "host")


def url_host(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    bare = F.regexp_replace(host, r":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(bare, ".", -1))


def domain_of(host: Column) -> Column:
    bare = F.regexp_replace(host, r":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(bare, ".", -3)).otherwise(two)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does. Equal lengths go to the first in code point order."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _strength(level: DataFrame, parent: DataFrame, above: str) -> float:
    """The prior's strength for a level, from how its rates spread around their parents'."""
    p = parent.select(F.col("name").alias("above"), (F.col("bad") / F.col("n")).alias("m"), F.col("n").alias("pn"))
    both = level.join(p, level[above] == p.above)
    spread = both.where("m > 0 and m < 1").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("m"), 2) / (F.col("m") * (1 - F.col("m")))).alias("s"),
        (F.count("*") - F.countDistinct("above")).alias("free"),
        F.sum(F.col("n")).alias("total"),
        F.sum(F.col("n") * F.col("n") / F.col("pn")).alias("own"),
    )
    rho = (F.col("s") - F.col("free")) / (F.col("total") - F.col("own") - F.col("free"))
    usable = (F.col("free") > 0) & (F.col("total") - F.col("own") - F.col("free") > 0)
    rho = F.when(usable, F.least(F.greatest(rho, F.lit(0.001)), F.lit(0.999))).otherwise(F.lit(0.1))
    return spread.select((1 - rho) / rho).first()[0]


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """Posterior bad rate of every labelled host, domain and suffix and of all: ``level, name, alpha, beta, lower``.

    ``outcomes`` has ``host`` and ``bad`` (0 or 1), one row a labelled page; rows
    with a null take no part.
    """
    hosts = outcomes.where("host is not null and bad is not null").groupBy("host").agg(F.sum(F.col("bad").cast("long")).alias("bad"), F.count("*").alias("n"))
    hosts = materialize(hosts.select(F.col("host").alias("name"), domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "bad", "n"), "reputation-hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).withColumnRenamed("domain", "name")
    suffixes = domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).withColumnRenamed("suffix", "name").withColumn("all", F.lit(""))
    whole = suffixes.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).withColumn("name", F.lit(""))
    prior = whole.select("name", (F.col("bad") + 1.0).alias("alpha"), (F.col("n") - F.col("bad") + 1.0).alias("beta"))
    out = prior.select(F.lit("all").alias("level"), "name", "alpha", "beta")
    for level, rows, parent, above in (("suffix", suffixes, whole, "all"), ("domain", domains, suffixes, "suffix"), ("host", hosts, domains, "domain")):
        k = F.lit(_strength(rows, parent, above))
        mean = prior.select(F.col("name").alias("above"), (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("m"))
        prior = rows.join(mean, rows[above] == mean.above).select("name", (F.col("bad") + k * F.col("m")).alias("alpha"), (F.col("n") - F.col("bad") + k * (1 - F.col("m"))).alias("beta"))
        out = out.union(prior.select(F.lit(level).alias("level"), "name", "alpha", "beta"))
    total = F.col("alpha") + F.col("beta")
    return out.withColumn("lower", F.col("alpha") / total - Z * F.sqrt(F.col("alpha") * F.col("beta") / (total * total * (total + 1))))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, limit: float = LIMIT) -> DataFrame:
    """Verdict for every page: the longest fitting rule's, else ``block`` where the posterior bound of the bad rate is above ``limit``.

    ``pages`` has ``page_id`` and ``url``, ``labels`` has ``page_id`` and ``bad``.
    Returns ``page_id, host, path, rule, verdict, lower``. Null urls and urls
    without ``://`` have empty host and path and are judged as such; without
    any label the overall prior is even and nothing is blocked by it.
    """
    url = F.col("url").cast("string")
    parsed = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"))
    outcomes = parsed.select("page_id", "host").join(labels.select("page_id", "bad"), "page_id")
    table = materialize(host_reputation(outcomes), "reputation")
    # reputation is looked up once a distinct host, then joined: pages may be many more than hosts
    hosts = parsed.groupBy("host").agg(F.count("*").alias("_pages")).select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    for level in LEVELS:
        hosts = hosts.join(table.where(F.col("level") == level).select(F.col("name").alias(level), F.col("lower").alias(f"lower_{level}")), level, "left")
    overall = table.where("level = 'all'").first()["lower"]
    hosts = hosts.select("host", F.coalesce("lower_host", "lower_domain", "lower_suffix", F.lit(overall)).alias("lower"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("lower") > limit, "block").otherwise("allow")
    return parsed.join(hosts, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, judged).alias("verdict"), "lower")
