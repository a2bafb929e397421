"""URL filter: explicit rules first, then a hierarchical empirical-Bayes host reputation.

Labelled page outcomes (1 bad, 0 good, null unlabelled) are counted by host, registered domain and
suffix. Every level has a beta-binomial prior: its mean is the posterior mean of the level above; its strength
joins the spread of that level's groups, fitted by moments, with how well the level above is known. A host
is blocked when the lower bound of its posterior bad rate passes a threshold.

Everything is DataFrame operations; counts are pre-aggregated before any shuffle, and the
join back to the pages is :func:`probitas.llm.common.lookup_join`, which no hot host can skew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from probitas.llm.common import lookup_join, lower_ascii, materialize


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str     # fits this host and all of its subdomains
    path: str     # fits paths that start with this

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Reputation:
    threshold: float = 0.5     # block when the posterior bound of the bad rate is above this
    z: float = 1.645           # posterior standard deviations between mean and bound
    root_strength: float = 2.0     # pseudo-pages of the uniform prior over the whole table
    min_strength: float = 1.0      # limits of the fitted prior strengths, in pseudo-pages
    max_strength: float = 10_000.0
    # Suffix rules: a suffix, ``*.`` and one (any label before it belongs to the suffix), or ``!`` and an exception from
    # such a rule, whose first label does not. Without a rule the last label is the suffix. See read_suffix_rules.
    long_suffixes: tuple[str, ...] = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp")


ADDRESS = "[address]"  # stands for the suffix of hosts that are addresses; no name has brackets


def read_suffix_rules(spark: SparkSession, path: str, most: int = 100_000) -> tuple[str, ...]:
    """The rules of a list of public suffixes: one per line, up to the first blank; comment lines begin with ``//``.

    The list is a parameter, so it does not grow with the data; one of over ``most`` rules is refused.
    """
    line = F.regexp_extract("value", r"^\s*(\S+)", 1)
    rules = [r[0] for r in spark.read.text(path).select(lower_ascii(line)).where((line != "") & ~line.startswith("//")).limit(most + 1).collect()]
    if len(rules) > most:
        raise ValueError(f"more than {most} suffix rules in {path}")
    return tuple(rules)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as struct(rule, verdict), null if none fits. The rules are a short
    parameter list, compiled into one expression, longest first (ties: block before allow)."""
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(ranked):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def host_group(host: Column) -> Column:
    """The host whose reputation a page shares: without user part, port and a last dot."""
    bare = F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", "")
    return F.regexp_replace(bare, r"\.$", "")


def domain_and_suffix(host: Column, cfg: Reputation) -> Column:
    """struct(domain, suffix): the suffix by the longest rule, the domain one label longer (a bare suffix is its own).
    An address is its own domain, and all addresses share a suffix."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    tails = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(labels, i + 1, n - i), "."))  # longest first
    plain = [r for r in cfg.long_suffixes if r[:1] not in "*!"]
    wild, saved = ([r[k:] for r in cfg.long_suffixes if r.startswith(mark)] for k, mark in ((2, "*."), (1, "!")))
    first = F.array_min(F.transform(tails, lambda t, i: F.when(t.isin(saved), i + 1).when(
        t.isin(plain) | F.coalesce(F.get(tails, i + 1).isin(wild), F.lit(False)), i)))
    at = F.coalesce(first, n - 1)
    address = host.rlike(r"^(\d{1,3}(\.\d{1,3}){3}|\[.*\])$")
    return F.struct(F.when(address, host).otherwise(F.coalesce(F.get(tails, at - 1), host)).alias("domain"),
                    F.when(address, F.lit(ADDRESS)).otherwise(F.get(tails, at)).alias("suffix"))


def _spread(counts: DataFrame) -> DataFrame:
    """The sums from which a level's prior strength is fitted: one row."""
    lab = counts.where(F.col("n") > 0)
    return lab.agg(F.count("*").alias("k"), F.sum("n").alias("s0"), F.sum("x").alias("s1"),
                   F.sum(F.col("x") * F.col("x") / F.col("n")).alias("s2"), F.sum(F.col("n") * F.col("n")).alias("nn"))


def prior_strength(row: Row, cfg: Reputation) -> float:
    """Strength of a level's beta prior from the intra-group correlation (analysis of variance)."""
    k, s0, s1, s2, nn = (row[c] or 0 for c in ("k", "s0", "s1", "s2", "nn"))
    if k < 2 or s0 <= k:
        return cfg.min_strength
    between, within = (s2 - s1 * s1 / s0) / (k - 1), (s1 - s2) / (s0 - k)
    size = (s0 - nn / s0) / (k - 1)
    spread = between + (size - 1) * within
    rho = (between - within) / spread if spread > 0 else 0.0
    if rho <= 0:
        return cfg.max_strength
    return min(cfg.max_strength, max(cfg.min_strength, (1 - rho) / rho))


def host_reputation(pages: DataFrame, host_col: str, outcome_col: str, cfg: Reputation = Reputation()) -> DataFrame:
    """One row per host: host, pages, n, x (labelled, bad), a, b (posterior), mean, bound, blocked."""
    hosts = materialize(
        pages.groupBy(F.col(host_col).alias("host"))
        .agg(F.count("*").alias("pages"), F.count(outcome_col).alias("n"),
             F.coalesce(F.sum(F.col(outcome_col).cast("long")), F.lit(0)).alias("x"))
        .withColumn("__names", domain_and_suffix(F.col("host"), cfg)).select("host", "pages", "n", "x", "__names.*"), "hosts")
    total = lambda df, key: df.groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("n", "x", "pages")])
    domains = total(hosts, ["domain", "suffix"])
    suffixes = total(hosts, ["suffix"])
    # Three strengths and the root's counts are single rows, so they become literals.
    kh, kd, ks = (prior_strength(_spread(t).first(), cfg) for t in (hosts, domains, suffixes))
    root = hosts.agg(F.sum("n").alias("n"), F.sum("x").alias("x")).first()
    root_mean = ((root["x"] or 0) + cfg.root_strength / 2) / ((root["n"] or 0) + cfg.root_strength)

    # A group's posterior is Beta(x + m * k, n - x + (1 - m) * k): m is the mean of the level above and k
    # joins that level's own spread with what is known of its mean (their variances add).
    joined = lambda k, known: k * known / (k + known)
    mean = lambda m, k: (F.col("x") + m * k) / (F.col("n") + k)
    m, k = F.lit(root_mean), F.lit(joined(ks, (root["n"] or 0) + cfg.root_strength))
    suffixes = suffixes.select("suffix", mean(m, k).alias("__m"), (F.col("n") + k).alias("__known"), F.col("pages").alias("__p"))
    domains = lookup_join(domains, suffixes, "suffix", "__p")
    m, k = F.col("__m"), joined(F.lit(kd), F.col("__known"))
    domains = domains.select("domain", mean(m, k).alias("__m"), (F.col("n") + k).alias("__known"), F.col("pages").alias("__p"))
    out = lookup_join(hosts, domains, "domain", "__p")
    m, k = F.col("__m"), joined(F.lit(kh), F.col("__known"))
    a, b = F.col("x") + m * k, F.col("n") - F.col("x") + (1 - m) * k
    out = out.select("host", "pages", "n", "x", a.alias("a"), b.alias("b"))
    s = F.col("a") + F.col("b")
    centre, sd = F.col("a") / s, F.sqrt(F.col("a") * F.col("b") / (s * s * (s + 1)))
    return (out.withColumn("mean", centre).withColumn("bound", centre - cfg.z * sd)
            .withColumn("blocked", F.col("bound") > cfg.threshold))


def judge_urls(pages: DataFrame, rules: list[Rule], cfg: Reputation = Reputation(), url_col: str = "url",
               outcome: Column | None = None) -> DataFrame:
    """Judge every row: its columns plus host, path, rule, verdict (allow or block), mean, bound.

    ``outcome`` labels pages (1 bad, 0 good, null unlabelled). By default the rules are the labels: a page that
    a rule blocks is bad, one that a rule allows is good, and the rest is judged by its host's reputation.

    Pages of a host share its reputation whatever their port or user part; addresses are their own domains.

    Defined cases: a null url, or one without ``://``, has an empty host and path and the reputation of the
    empty host; without any label nothing is blocked but by rules; repeated rows are judged alike; an
    empty table gives an empty result; input columns named like an added one are replaced by it.
    """
    added = ("host", "path", "rule", "verdict", "mean", "bound")
    base = pages.select([F.col(c) for c in pages.columns if c not in added or c == url_col])
    url = F.col(url_col)
    base = (base.withColumn("__host", url_host(url)).withColumn("__path", url_path(url))
            .withColumn("__rule", matching_rule(F.col("__host"), F.col("__path"), rules)))
    by_rule = F.when(F.col("__rule.verdict") == "block", 1).when(F.col("__rule.verdict") == "allow", 0)
    base = base.withColumn("__bad", (outcome if outcome is not None else by_rule).cast("int"))
    base = base.withColumn("__group", host_group(F.col("__host")))
    hosts = host_reputation(base, "__group", "__bad", cfg).select(
        F.col("host").alias("__group"), "pages", "mean", "bound", "blocked")
    out = lookup_join(base, hosts, "__group", "pages")
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("blocked"), "block").otherwise("allow"))
    return out.select(*[F.col(c) for c in base.columns if not c.startswith("__")], F.col("__host").alias("host"),
                      F.col("__path").alias("path"), F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), "mean", "bound")
