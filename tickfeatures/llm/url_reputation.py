"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes (1 good, 0 bad) are counted by host. A host's rate is shrunk
through beta-binomial priors: the table's rate is the prior of a suffix, a suffix's
posterior mean that of a registered domain, a domain's that of a host. A suffix is the
longest of a bounded table of public suffixes that a host ends in (rules like ``co.uk``, or
``*.ck`` for any label before), else its last label; the registered domain has one label more. The strength of the prior on each level (pseudo pages) comes from all groups of
the level by the method of moments (``_strength``). A host's posterior is Beta(a, b),
a = strength * prior + good, b = strength * (1 - prior) + bad; its mean is the prior of
the level below. The verdict is ``allow`` when the posterior's lower bound, mean -
``Z`` * standard deviation, is at least ``THRESHOLD``, else ``block``.

Explicit rules come first: a rule is a host and a path prefix, like ``net/es/``; it fits
its host and all subdomains if the path starts with the rule's; the longest wins (ties:
the lesser string).

For this grouping alone a host loses its user information, port and trailing dots, and a
numeric address is its own domain below one suffix of all addresses; rules and the returned
host see it as it is written.

Hosts are read from the text after the first ``://`` up to ``/``, ``?``, ``#`` or the
end, A-Z lower-cased; the path goes on to ``?``, ``#`` or the end. A null url, or one
without ``://``, has an empty host and path; the empty host is a host like any other.
A host without labelled pages has its domain's posterior mean as prior (or the suffix's,
or the table's; 0.5 without any label). Null labels are no labels; a page_id with several
labels counts each. Repeated pages each get a row; a null page_id stays null.

An empty table gives no rows; further columns are not read, whatever their names. A very
long url is one row like any other.

The counts by site (the host without user information and port) are written once, to the
session's checkpoint folder, so that the levels and their strengths read a table of sites and
not the pages again. Only counts are shuffled, combined before the shuffle, so a host with a third of all
pages is one partial row per task. Pages join the verdicts by site (a skewed
equi-join that adaptive execution splits); no collect, no broadcast of unbounded data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

Z = 1.645
THRESHOLD = 0.8
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0
MAX_SUFFIXES = 20_000  # the table becomes a literal set of the plan

# fixed values: registries that sell names below a second label; give a whole list as a parameter
SUFFIXES = (
    "ac.jp", "ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za",
    "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.hk", "com.mx", "com.my", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn",
    "edu.au", "gov.au", "gov.br", "gov.uk", "ltd.uk", "me.uk", "ne.jp", "net.au", "net.br", "or.jp", "or.kr", "org.au", "org.br", "org.nz", "org.uk", "org.za",
    "*.ck", "*.er", "*.kh", "*.np",
)
ADDRESS = "[address]"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def site_of(host: Column) -> Column:
    """A host without user information, port and trailing dots."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r"\.*(:[0-9]*)?\z", "")


def suffix_and_domain(site: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """The public suffix and the registered domain of a site; a site that is a suffix is its
    own domain, an address (four numbers, or in brackets) a domain of the suffix ``ADDRESS``."""
    if len(suffixes) > MAX_SUFFIXES:
        raise ValueError(f"more than {MAX_SUFFIXES} suffixes")
    rules: dict[int, tuple[list[str], list[str]]] = {}
    for rule in sorted(set(suffixes)):
        plain, wild = rules.setdefault(rule.count(".") + 1, ([], []))
        (wild if rule.startswith("*.") else plain).append(rule.removeprefix("*."))
    labels = F.lit(1)
    for n, (plain, wild) in sorted(rules.items()):
        fits = F.substring_index(site, ".", -n).isin(plain) | F.substring_index(site, ".", 1 - n).isin(wild) if wild else F.substring_index(site, ".", -n).isin(plain)
        labels = F.when(fits & (F.size(F.split(site, r"\.")) >= n), F.lit(n)).otherwise(labels)
    parts = F.split(site, r"\.")

    def last(n: Column) -> Column:
        return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - n + 1), n), ".")

    address = site.rlike(r"\A([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])\z")
    return F.when(address, F.lit(ADDRESS)).otherwise(last(labels)), F.when(address, site).otherwise(last(labels + 1))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule string (null if none); rules are (verdict, ``host/path``)."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _strength(groups: DataFrame) -> DataFrame:
    """One row: the pseudo pages of the prior, from ``n, good, parent`` rows.

    For beta-binomial groups the expected squared error is E (rate - p)^2 =
    p(1-p) (1/n + (1 - 1/n) / (strength + 1)), solved for the strength with both sides
    summed with weights n."""
    p = F.col("parent")
    rate = F.try_divide("good", "n")
    sums = groups.where("n > 0").agg(
        F.sum(F.col("n") * (rate - p) * (rate - p)).alias("observed"),
        F.sum(p * (1 - p)).alias("sampling"),
        F.sum((F.col("n") - 1) * p * (1 - p)).alias("spread"),
    )
    ratio = F.try_divide(F.col("spread"), F.col("observed") - F.col("sampling")) - 1
    inside = F.when(F.col("observed") <= F.col("sampling"), F.lit(MAX_STRENGTH)).otherwise(F.least(F.lit(MAX_STRENGTH), F.greatest(F.lit(MIN_STRENGTH), ratio)))
    return sums.select(F.coalesce(inside, F.lit(MIN_STRENGTH)).alias("strength"))


def _shrunk(groups: DataFrame) -> DataFrame:
    """``groups`` (n, good, parent) with ``strength`` and the posterior ``mean``."""
    mean = (F.col("strength") * F.col("parent") + F.col("good")) / (F.col("strength") + F.col("n"))
    return groups.crossJoin(F.broadcast(_strength(groups))).withColumn("mean", mean)  # one row


def site_levels(pages: DataFrame, outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """``site, n_pages, n, good, domain, suffix`` for every site of ``pages``, written once."""
    sites = pages.select("page_id", site_of(host_of(F.col("url"))).alias("site"))
    seen = sites.groupBy("site").agg(F.count("*").alias("n_pages"))
    labelled = outcomes.where("outcome is not null and page_id is not null").groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.col("outcome").cast("bigint")).alias("good"))
    counted = sites.join(labelled, "page_id").groupBy("site").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffix, domain = suffix_and_domain(F.col("site"), suffixes)
    return materialize(seen.join(counted, "site", "left").select(
        "site", "n_pages", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("good", F.lit(0)).alias("good"), domain.alias("domain"), suffix.alias("suffix")))


def site_reputation(pages: DataFrame, outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """``site, n_pages, n_labelled, n_good, prior, mean, lower`` for every site of
    ``pages`` (page_id, url); ``outcomes``: page_id, outcome (0/1)."""
    level = site_levels(pages, outcomes, suffixes)
    domains = level.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    below = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    table = below.agg(F.coalesce(F.try_divide(F.sum("good"), F.sum("n")), F.lit(0.5)).alias("parent"))
    suffix_mean = _shrunk(below.crossJoin(F.broadcast(table))).select("suffix", F.col("mean").alias("parent"))  # one row
    domain_in = materialize(domains.join(suffix_mean, "suffix"))
    domain_mean = _shrunk(domain_in).select("domain", "suffix", F.col("mean").alias("parent"))
    posterior = _shrunk(materialize(level.join(domain_mean, ["domain", "suffix"])))
    total = F.col("strength") + F.col("n")
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (total + 1))
    return posterior.select(
        "site", "n_pages", F.col("n").alias("n_labelled"), F.col("good").alias("n_good"), F.col("parent").alias("prior"), "mean", (F.col("mean") - Z * deviation).alias("lower")
    )


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], threshold: float = THRESHOLD, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Per page: ``page_id, host, path, rule, verdict`` and the site's reputation."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("site", site_of(F.col("host")))
    verdicts = {rule: verdict for verdict, rule in rules}
    named = F.lit(None).cast("string")
    for rule, verdict in verdicts.items():
        named = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(named)
    learnt = F.when(F.col("lower") >= threshold, "allow").otherwise("block")
    return rows.join(site_reputation(pages, outcomes, suffixes), "site").select(
        "page_id", "host", "path", "rule", F.coalesce(named, learnt).alias("verdict"), "n_labelled", "n_good", F.round("mean", 9).alias("mean"), F.round("lower", 9).alias("lower")
    )
