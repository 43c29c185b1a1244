"""URL filtering by empirical-Bayes host reputation.

Labelled page outcomes are counted per host, and the counts are shrunk through
beta-binomial priors: suffix towards the whole web, registered domain towards its
suffix, host towards its domain. A page passes if the lower bound of its host's
posterior, a quantile of the beta distribution, reaches a threshold. Explicit allow and
block rules come first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from needledrop.llm.skew import look_up
from needledrop.scratch import materialise

#: Some public suffix rules of two labels. The public list of thousands, with its wildcards and exceptions,
#: is not in this repository; its rules go into ``suffixes``, as texts or as a table.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = "://([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, ADDRESS, 1), UPPER, LOWER), F.regexp_extract(url, ADDRESS, 2)


def suffix_rules(spark: SparkSession, suffixes: Sequence[str] | DataFrame) -> DataFrame:
    """(end, more, exception) of public suffix rules: of texts, or of a DataFrame's ``rule`` column.

    ``x`` makes the labels x a suffix, ``*.x`` any one label before them too, ``!x`` makes a name of what ``*`` would cover.
    """
    rules = suffixes if isinstance(suffixes, DataFrame) else spark.createDataFrame([(s,) for s in suffixes], "rule string")
    rule, wild, exception = F.lower(F.trim("rule")), F.col("rule").startswith("*."), F.col("rule").startswith("!")
    end = F.when(wild, F.substring(rule, 3, 1 << 20)).when(exception, F.substring(rule, 2, 1 << 20)).otherwise(rule)
    return rules.filter("rule is not null").select(end.alias("end"), F.when(wild, 1).when(exception, -1).otherwise(0).alias("more"), exception.alias("exception")).distinct()


def with_suffixes(hosts: DataFrame, suffixes: Sequence[str] | DataFrame = TWO_LABEL_SUFFIXES) -> DataFrame:
    """``hosts``, one row a ``host``, with its public suffix and registered domain: suffix and one label more.

    Every end of a host looks for its rules by a join. An exception wins, then the longest rule; without any, the last
    label is the suffix. A host that has no further label is its own domain.
    """
    rules = suffix_rules(hosts.sparkSession, suffixes)
    labels, n = F.split("host", r"\."), F.size(F.split("host", r"\."))
    ends = hosts.select("host", n.alias("n"), F.posexplode(F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))).alias("k", "end"))
    fits = ends.join(rules, "end").withColumn("labels", F.col("k") + 1 + F.col("more")).filter("labels between 1 and n")
    best = fits.groupBy("host").agg(F.max(F.struct("exception", "labels"))["labels"].alias("labels"))
    k = F.coalesce("labels", F.lit(1))
    last = lambda m: F.array_join(F.slice(labels, F.greatest(n - m + 1, F.lit(1)), m), ".")
    return hosts.join(best, "host", "left").withColumns({"suffix": last(k), "domain": last(k + 1)}).drop("labels")


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting (action, host, path) rule as text and its action; null where none fits."""
    text = action = None
    for act, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, rule_host + rule_path) if text is None else text.when(fits, rule_host + rule_path)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, action)


def _concentration(level: DataFrame) -> float:
    """Pseudo-observations of the prior, by the method of moments; ``level`` has n, k and the parent's mean."""
    p = F.least(F.greatest(F.col("parent"), F.lit(1e-6)), F.lit(1 - 1e-6))
    row = (
        level.filter("n > 0")
        .agg(
            F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - p, 2) / (p * (1 - p))).alias("spread"),
            F.count("*").alias("groups"),
            F.sum("n").alias("n"),
        )
        .first()
    )
    if not row["n"] or row["n"] <= row["groups"]:
        return 99.0
    rho = (row["spread"] - row["groups"]) / (row["n"] - row["groups"])
    return 1 / min(max(rho, 0.001), 0.5) - 1


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function for positive ``a`` and ``b``: its continued fraction, on the side where it converges fast."""
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    log_beta = np.array([math.lgamma(i) + math.lgamma(j) - math.lgamma(i + j) for i, j in zip(p.tolist(), q.tolist(), strict=True)])
    with np.errstate(divide="ignore"):
        front = np.exp(p * np.log(y) + q * np.log1p(-y) - log_beta) / p
    # d_2m = m (q - m) y / ((p + 2m - 1)(p + 2m)), d_2m+1 = -(p + m)(p + q + m) y / ((p + 2m)(p + 2m + 1)), by quotients of neighbours
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    out, m, change = d.copy(), 1, np.full_like(y, 2.0)
    while (np.abs(change - 1) > 1e-15).any() and m < 100_000:
        for step in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            change = c * d
            out = out * change
        m += 1
    return np.where(swap, 1 - front * out, front * out)


def beta_quantile(a: np.ndarray, b: np.ndarray, tail: float) -> np.ndarray:
    """Where the beta distribution has ``tail`` of its mass below, by halving; 0 without ``a``, else 1 without ``b``."""
    out, both = np.where(a <= 0, 0.0, 1.0), (a > 0) & (b > 0)
    a, b = a[both], b[both]
    low, high = np.zeros(len(a)), np.ones(len(a))
    for _ in range(45):
        middle = (low + high) / 2
        below = incomplete_beta(a, b, middle) <= tail
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    out[both] = high
    return out


def lower_bound(a: Column, b: Column, tail: float) -> Column:
    """``beta_quantile`` as a column: hosts of the same counts are computed once a batch."""

    @F.pandas_udf("double")
    def quantile(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs, index = np.unique(np.column_stack([a.to_numpy(float), b.to_numpy(float)]), axis=0, return_inverse=True)
        return pd.Series(beta_quantile(pairs[:, 0], pairs[:, 1], tail)[index.ravel()])

    return quantile(a, b)


def host_reputation(pages: DataFrame, outcomes: DataFrame, tail: float = 0.05, suffixes: Sequence[str] | DataFrame = TWO_LABEL_SUFFIXES) -> DataFrame:
    """One row per host of ``pages`` (page_id, url): counts, shrunk mean and the posterior's ``tail`` quantile as lower bound.

    ``outcomes`` has page_id and good (boolean); several outcomes of a page all count, null
    outcomes and outcomes of unknown pages do not. With no outcome at all the mean is 0.5.
    """
    host, _ = url_parts(F.col("url"))
    located = pages.select("page_id", host.alias("host"))
    judged = outcomes.filter("page_id is not null and good is not null").groupBy("page_id").agg(F.count("*").alias("n"), F.count_if("good").alias("k"))
    counted = located.join(judged, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    hosts = materialise(with_suffixes(materialise(counted), suffixes).select("host", "n", "k", "suffix", "domain"))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    by_suffix = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = by_suffix.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    base = whole["k"] / whole["n"] if whole["n"] else 0.5

    by_suffix = by_suffix.withColumn("parent", F.lit(base))
    s = _concentration(by_suffix)
    means = by_suffix.select("suffix", ((F.col("k") + s * F.col("parent")) / (F.col("n") + s)).alias("parent"))
    domains = domains.join(means, "suffix")
    s = _concentration(domains)
    means = domains.select("domain", ((F.col("k") + s * F.col("parent")) / (F.col("n") + s)).alias("parent"))
    hosts = materialise(hosts.join(means, "domain"))
    s = _concentration(hosts)
    shaped = hosts.select("host", "domain", "suffix", "n", "k", (F.col("k") + s * F.col("parent")).alias("a"), (F.col("n") - F.col("k") + s * (1 - F.col("parent"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    return shaped.select("host", "domain", "suffix", "n", "k", (a / (a + b)).alias("mean"), lower_bound(a, b, tail).alias("bound"))


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = (), threshold: float = 0.5, tail: float = 0.05, suffixes: Sequence[str] | DataFrame = TWO_LABEL_SUFFIXES,
) -> DataFrame:
    """Judge every page: page_id, host, path, rule, verdict, mean and bound of its host.

    The longest rule that fits decides; else the host passes if at most ``tail`` of its posterior lies
    below ``threshold``. Null urls have an empty host, which is judged like any other; repeated
    rows give repeated results; an empty table gives none; further columns are ignored.
    """
    host, path = url_parts(F.col("url"))
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    located = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = materialise(host_reputation(pages.select("page_id", "url"), outcomes, tail, suffixes).select("host", "mean", "bound"))
    # the pages of a host that has a large part of all are not sent to one task
    return look_up(located, known, "host").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(action, F.when(F.col("found.bound") >= threshold, "allow").otherwise("block")).alias("verdict"),
        "found.mean", "found.bound",
    )
