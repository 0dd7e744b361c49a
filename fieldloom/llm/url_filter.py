"""URL filters: rules on host and path, and empirical-Bayes host reputation for pages without a rule.

Labelled page outcomes are counted per host. Beta-binomial priors shrink a host's share of good
pages to its registered domain's, that to its suffix's, and that to the share over all; each
level's prior strength comes from the spread between its groups beyond chance (method of
moments). A page without a rule is blocked if the lower bound of its host's share lies below a
floor: if the beta posterior gives shares below the floor a chance above RISK.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import discarding, materialize
from .special import beta_below


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed: the rules of the registered query.
RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)
#: Labels that registries of countries set before their code of two letters, as in co.uk: with it they are a suffix, where the caller has no table of suffixes.
SECOND = ("ac", "asn", "co", "com", "edu", "gen", "go", "gob", "gouv", "gov", "govt", "id", "ltd", "me", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch", "web")
PRIOR = 0.9  # the share of good pages before any is seen, worth one page
#: Prior strengths lie between the first two; a host is good enough if its share is below FLOOR with a chance of RISK at most.
WEAKEST, STRONGEST, FLOOR, RISK = 2.0, 200.0, 0.5, 0.05

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first :// up to / ? # or the end, A-Z lower-cased; path from there up to ? # or the end. Null, or no ://: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null. A rule fits its host and all subdomains, on paths that start with its own."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def domains_of(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """(host, domain, suffix) of distinct hosts: the longest suffix of the table that is a proper end of the host, else its last label; the domain has one label more.

    suffixes: (suffix), a table of any size; where none is given, a label of SECOND and a country's two letters are a suffix. A host of one label, or an address in figures, is its own domain and suffix.
    """
    labels = F.split("host", r"\.")
    figures = F.col("host").rlike(r"^[0-9.]+$|:|^\[") | (F.size(labels) < 2)
    end = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    if suffixes is None:
        two = (F.size(labels) > 2) & F.element_at(labels, -1).rlike("^[a-z]{2}$") & F.get(labels, F.size(labels) - 2).isin(*SECOND)
        n = F.when(two, 2).otherwise(1)
        return hosts.select("host", F.when(figures, F.col("host")).otherwise(end(n + 1)).alias("domain"), F.when(figures, F.col("host")).otherwise(end(n)).alias("suffix"))
    ends = hosts.filter(~figures).select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.struct(n.alias("n"), end(n).alias("suffix")))).alias("x"))
    known = ends.select("host", "x.*").join(suffixes.select("suffix").distinct(), "suffix", "left_semi").groupBy("host").agg(F.max("n").alias("n"))
    n = F.coalesce("n", F.lit(1))
    return hosts.join(known, "host", "left").select("host", F.when(figures, F.col("host")).otherwise(end(n + 1)).alias("domain"), F.when(figures, F.col("host")).otherwise(end(n)).alias("suffix"))


def prior_strength(groups: DataFrame, parent_mean: Column) -> float:
    """M of Beta(M m, M (1 - m)) over groups (n, good), m their parent's mean: from the intra-class correlation that the spread shows."""
    p = F.col("good") / F.col("n")
    row = groups.filter("n > 0").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.sum(F.col("n") * (p - parent_mean) * (p - parent_mean)).alias("between"), F.sum(F.col("n") * p * (1 - p)).alias("within"),
    ).first()
    if not row.k or row.k < 2 or row.n <= row.k:
        return STRONGEST
    typical = (row.n - row.n2 / row.n) / (row.k - 1)
    between, within = row.between / (row.k - 1), row.within / (row.n - row.k)
    rho = (between - within) / (between + (typical - 1) * within) if between + (typical - 1) * within > 0 else 0.0
    return min(STRONGEST, max(WEAKEST, (1 - rho) / rho)) if rho > 0 else STRONGEST


def reputation(pages: DataFrame, outcomes: DataFrame, floor: float = FLOOR, suffixes: DataFrame | None = None) -> DataFrame:
    """(host, mean, strength, sure) of every host of pages (page_id, host): the posterior's mean and strength, and its chance of a share of floor or more; outcomes: (page_id, good 0/1)."""
    with discarding(pages.sparkSession):
        return _reputation(pages, outcomes, floor, suffixes)


def _reputation(pages: DataFrame, outcomes: DataFrame, floor: float, suffixes: DataFrame | None) -> DataFrame:
    one = outcomes.filter(F.col("page_id").isNotNull() & F.col("good").isNotNull()).groupBy("page_id").agg(F.min("good").cast("long").alias("good"))
    labelled = pages.join(one, "page_id").groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    names = materialize(pages.select("host").distinct(), "host-names")
    hosts = domains_of(names, suffixes).join(labelled, "host", "left").select("host", "domain", "suffix", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("good", F.lit(0)).alias("good"))
    hosts = materialize(hosts, "hosts")
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mean = ((total.good or 0) + PRIOR) / ((total.n or 0) + 1)

    def shrunk(groups: DataFrame, prior: Column) -> DataFrame:
        m = prior_strength(groups, prior)
        return groups.withColumn("mean", (F.col("good") + m * prior) / (F.col("n") + m)).withColumn("strength", F.col("n") + F.lit(m))

    suffixes = materialize(shrunk(suffixes, F.lit(mean)), "suffixes").select("suffix", F.col("mean").alias("above"))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    domains = materialize(shrunk(materialize(domains, "domains").join(suffixes, "suffix"), F.col("above")), "domains").select("domain", F.col("mean").alias("above"))
    leaves = shrunk(materialize(hosts.join(domains, "domain"), "leaves"), F.col("above"))
    sure = 1 - beta_below(F.col("mean") * F.col("strength"), (1 - F.col("mean")) * F.col("strength"), floor)
    return materialize(leaves.select("host", "mean", "strength", sure.alias("sure")), "reputation", outer=True)


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple[UrlRule, ...] = RULES, floor: float = FLOOR, suffixes: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, reputation) of every page row; reputation is the chance that the host's share of good pages is floor or more.

    Null or malformed urls: empty host and path, judged as the host ''. Null page_id: judged,
    never labelled. Repeated rows: a row each; a page labelled good and bad counts as bad. Empty
    outcomes: every host has the mean PRIOR and the greatest strength, so nothing without a rule is blocked. Other columns
    are ignored.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    known = reputation(own.select("page_id", "host"), outcomes, floor, suffixes)
    ruled = own.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("sure") < 1 - RISK, "block").otherwise("allow")
    # a host of very many pages is a hot key of one side only
    return ruled.join(known, "host").select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), method).alias("verdict"), F.col("sure").alias("reputation"))
