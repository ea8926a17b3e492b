"""URL filtering by rules and empirical-Bayes host reputation, in DataFrame functions only.

A host's share of good pages is shrunk towards its registered domain's, that
towards its suffix's, and that towards the share of all pages, by beta-binomial
priors whose strength is estimated at each level by the method of moments, from how
much units differ within their parent.  A host is blocked when even the upper bound
of its posterior (its mean and ``z`` standard deviations) lies under a floor.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hypnoframe.llm.store import settled


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + F.lit(1), F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


#: fixed values: second labels under which countries register names
SECOND = r"(^|\.)(ac|co|com|edu|gov|net|org)\.[a-z]{2}$"


def domain_of(host: Column) -> Column:
    """Registered domain: the suffix and the label before it."""
    return F.when(host.rlike(SECOND), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def suffix_of(host: Column) -> Column:
    """The last label, or the last two where a country registers under a second one (there is no public-suffix table here)."""
    return F.when(host.rlike(SECOND), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (ties: the first given) and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(str(r))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(str(r))).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def strength(units: DataFrame, fallback: float = 10.0) -> float:
    """Prior strength of units (parent, s good of n) around their parent's share, by beta-binomial moments.

    The squared differences from the parent's share, over what a binomial would give,
    are 1 + (n - 1) rho on average, rho the correlation within a unit; each unit
    counts by the part of the parent that is not its own.  Where no parent has two
    units and both outcomes, the strength is ``fallback``.
    """
    parents = units.groupBy("parent").agg(F.sum("s").alias("ps"), F.sum("n").alias("pn")).where("ps > 0 and ps < pn")
    p, rest = F.col("ps") / F.col("pn"), 1 - F.col("n") / F.col("pn")
    t = units.join(parents, "parent").agg(F.sum((F.col("s") - F.col("n") * p) ** 2 / (F.col("n") * p * (1 - p))).alias("x"), F.sum(rest).alias("free"), F.sum((F.col("n") - 1) * rest).alias("w")).first()
    if not t["w"]:
        return fallback
    rho = min(max((t["x"] - t["free"]) / t["w"], 1e-3), 0.999)
    return 1.0 / rho - 1.0


def reputations(outcomes: DataFrame, hosts: DataFrame, z: float = 1.645) -> DataFrame:
    """host, mean, upper: posterior mean of the share of good pages and its upper bound.

    ``outcomes``: host, good (0 or 1), a row per labelled page.  ``hosts``: host, one
    row each; hosts without outcomes have their domain's posterior as prior.
    """
    by_host = settled(outcomes.groupBy("host").agg(F.sum("good").cast("double").alias("s"), F.count("*").cast("double").alias("n")), "hosts")
    by_domain = by_host.groupBy(domain_of(F.col("host")).alias("domain")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    by_suffix = by_host.groupBy(suffix_of(F.col("host")).alias("suffix")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    total = by_suffix.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = total["s"] / total["n"] if total["n"] else 0.5
    k_suffix = strength(by_suffix.withColumn("parent", F.lit("")))
    k_domain = strength(by_domain.withColumn("parent", suffix_of(F.col("domain"))))
    k_host = strength(by_host.withColumn("parent", domain_of(F.col("host"))))
    suffix = by_suffix.select("suffix", ((F.col("s") + k_suffix * mean) / (F.col("n") + k_suffix)).alias("ms"))
    domain = by_domain.withColumn("suffix", suffix_of(F.col("domain"))).join(suffix, "suffix").select("domain", ((F.col("s") + k_domain * F.col("ms")) / (F.col("n") + k_domain)).alias("md"))
    known = hosts.join(by_host, "host", "left").select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("n", F.lit(0.0)).alias("n"))
    known = known.join(domain, "domain", "left").join(suffix, "suffix", "left").withColumn("prior", F.coalesce("md", "ms", F.lit(mean)))
    a, b = F.col("s") + k_host * F.col("prior"), F.col("n") - F.col("s") + k_host * (1 - F.col("prior"))
    post, total = a / (a + b), a + b
    return known.select("host", post.alias("mean"), (post + z * F.sqrt(post * (1 - post) / (total + 1))).alias("upper"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], floor: float = 0.5, z: float = 1.645, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col``, host, path, rule, verdict, mean, upper for every page row.

    ``outcomes``: url, good.  The rule's verdict goes first; without one, a page is
    blocked when its host's upper bound is under ``floor``.  Null urls and urls
    without ``://`` have an empty host and path, and are judged by the reputation
    of that empty host.  The reputations are a settled table, so its join to the
    pages is a broadcast below Spark's size limit and otherwise a sort-merge join
    whose hot hosts Spark splits.
    """
    host, path = split_url(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    seen = outcomes.select(split_url(F.col("url"))[0].alias("host"), F.col("good").cast("int").alias("good")).where("good is not null")
    known = settled(reputations(seen, parsed.select("host").distinct(), z), "reputations")
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = parsed.join(known, "host", "left").select("id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("upper") < floor, "block").otherwise("allow")).alias("verdict"), "mean", "upper")
    return judged.withColumnRenamed("id", id_col)
