"""URL filter with an empirical-Bayes host reputation (operator 5). DataFrame operations only.

Labelled page outcomes are counted per host. A beta-binomial model shrinks them level by level: the suffix's rate
towards that of all labelled pages, the registered domain's towards its suffix, the host's towards its domain. A
level's prior strength is fitted to the spread of its groups' rates by the method of moments. A page without a
rule is blocked if the lower bound of its host's posterior exceeds the threshold.

Defined results: a null url, or one without ://, has an empty host and path, no rule, and takes the verdict of
its (empty) host like any other; repeated page_ids give a row each, and each labelled copy counts; labels without
a page, or with a null outcome, don't count; without labels the prior is 0 and all is allowed; further columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import Tables, heavy_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Rule (host and path) and verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

#: Public suffixes of two labels: second-level labels by country.
SUFFIXES = tuple(f"{second}.{country}" for country, seconds in {
    "uk": "co org ac gov ltd plc me net sch", "au": "com net org edu gov id", "nz": "co net org ac govt", "jp": "co ne or ac go ed", "br": "com net org gov edu",
    "in": "co net org gov ac", "za": "co net org gov ac", "cn": "com net org gov edu", "tr": "com net org gov edu", "mx": "com net org gob edu", "kr": "co ne or go ac",
    "tw": "com net org gov edu", "hk": "com net org gov edu", "sg": "com net org gov edu", "il": "co net org gov ac", "ar": "com net org gob edu", "pl": "com net org gov edu",
}.items() for second in seconds.split())


@dataclass(frozen=True)
class Model:
    """threshold: share of bad pages above which a host is blocked. z: standard deviations of the lower bound.

    weakest, strongest: limits of the fitted prior strengths, in pages. suffixes: public suffixes of two labels, under
    which a registered domain has three; any other last label is a suffix by itself.
    """

    threshold: float = 0.5
    z: float = 1.64
    weakest: float = 2.0
    strongest: float = 200.0
    suffixes: tuple[str, ...] = SUFFIXES


def parts(url: Column) -> tuple[Column, Column]:
    get = lambda n: F.coalesce(F.regexp_extract(url, URL, n), F.lit(""))
    return F.translate(get(1), UPPER, LOWER), get(2)


def suffix(host: Column, m: Model) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*m.suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain(host: Column, m: Model) -> Column:
    """The registered domain: one label more than the suffix."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*m.suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def ruled(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        at = rule.index("/")
        name, begins = rule[:at], rule[at:]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(begins)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def strength(groups: DataFrame, m: Model) -> float:
    """The prior strength that explains how far rates (bad of n) lie from mean."""
    t = groups.agg(
        F.sum("n").alias("pages"),
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("mean"), 2)).alias("spread"),
        F.sum(F.col("mean") * (1 - F.col("mean"))).alias("chance"),
        F.sum(F.col("n") * F.col("mean") * (1 - F.col("mean"))).alias("most"),
    )
    # E[spread] = chance + (most - chance) / (strength + 1)
    fitted = (F.col("most") - F.col("chance")) / F.nullif(F.col("spread") - F.col("chance"), F.lit(0.0)) - 1
    fitted = F.when(F.col("spread") <= F.col("chance"), m.strongest).otherwise(fitted)
    return t.select(F.greatest(F.lit(m.weakest), F.least(F.lit(m.strongest), F.round(F.coalesce(fitted, F.lit(m.strongest)), 6)))).first()[0]


def reputation(outcomes: DataFrame, m: Model) -> tuple[DataFrame, DataFrame, DataFrame, tuple[float, float]]:
    """Posteriors (a, b) of hosts, domains, suffixes and all, from outcomes(host, n, bad): one row a host.

    Only the strengths and the overall counts, a number each, pass through the driver.
    """
    hosts = outcomes.select("host", domain(F.col("host"), m).alias("domain"), suffix(F.col("host"), m).alias("suffix"), "n", "bad")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    n, bad = suffixes.agg(*sums).first()
    every = (bad or 0) + 0.5, (n or 0) - (bad or 0) + 0.5

    def level(groups: DataFrame, key: str) -> DataFrame:
        """groups have their parent's mean."""
        k = F.lit(strength(groups, m))
        a, b = k * F.col("mean") + F.col("bad"), k * (1 - F.col("mean")) + F.col("n") - F.col("bad")
        return groups.select(key, a.alias("a"), b.alias("b"), (a / (a + b)).alias("mean"))

    s = level(suffixes.withColumn("mean", F.lit(every[0] / (every[0] + every[1]))), "suffix")
    d = level(domains.join(s.select("suffix", "mean"), "suffix"), "domain")
    h = level(hosts.join(d.select("domain", "mean"), "domain"), "host")
    return h, d, s, every


def bound(a: Column, b: Column, m: Model) -> Column:
    """Lower bound of the posterior's mean."""
    n = a + b
    return a / n - m.z * F.sqrt(a * b / (n * n * (n + 1)))


def judge(pages: DataFrame, outcomes: DataFrame, rules: dict[str, str] = RULES, m: Model = Model(), key: str = "page_id", url: str = "url") -> DataFrame:
    """Key, host, path, rule, verdict and bad_bound of every page. outcomes(key, bad): labelled pages, bad 0 or 1."""
    host, path = parts(F.col(url))
    read = pages.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path"))
    labelled = outcomes.filter("bad is not null").groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("n"), F.sum("bad").cast("long").alias("bad"))
    tables = Tables(pages.sparkSession, "urls")
    # Distinct hosts with their pages; all levels work on these, far fewer than the pages.
    seen = read.join(labelled, "_key", "left").groupBy("host").agg(F.count("*").alias("w"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    seen = tables.keep(seen)
    h, d, s, every = reputation(seen.filter("n > 0"), m)
    post = lambda df, name, col: df.select(name, F.struct("a", "b").alias(col))
    own = seen.select("host", "w", domain(F.col("host"), m).alias("domain"), suffix(F.col("host"), m).alias("suffix"))
    own = own.join(post(s, "suffix", "_s"), "suffix", "left").join(post(d, "domain", "_d"), "domain", "left").join(post(h, "host", "_h"), "host", "left")
    p = F.coalesce("_h", "_d", "_s", F.struct(F.lit(every[0]).alias("a"), F.lit(every[1]).alias("b")))
    own = own.select("host", F.round(bound(p["a"], p["b"], m), 9).alias("bad_bound"), "w")
    own = tables.keep(own)
    out = heavy_join(read, own, "host", "w")
    rule = ruled(F.col("host"), F.col("path"), rules)
    verdict = F.when(F.col("bad_bound") > m.threshold, "block").otherwise("allow")
    chosen = F.coalesce(*[F.when(F.col("rule") == r, v) for r, v in rules.items()], verdict)
    return out.withColumn("rule", rule).select(F.col("_key").alias(key), "host", "path", "rule", chosen.alias("verdict"), "bad_bound")
