"""URL filters: rules first, then the empirical-Bayes reputation of the host.

Labelled page outcomes are counted by host, registered domain and suffix. Each level's good rate gets a
beta prior centred at its parent's posterior mean, the root's at the overall rate; the prior's weight is
fitted at each level by moments. A host without labels backs off: its mean is its domain's, of an unlabelled
domain the suffix's, of an unlabelled suffix the overall rate, with the host level's prior weight. A page
without a rule is blocked if even the upper bound of its host's posterior good rate stays below the
threshold, so sparse hosts are not blocked on little evidence.
"""

from __future__ import annotations

from contextlib import suppress
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylark.llm.common import ascii_lower, join_checked, staged

#: The public suffix list (publicsuffix.org, MPL 2.0), its private section too.
SUFFIX_LIST = Path(__file__).with_name("public_suffix_list.dat")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@cache
def suffix_rules() -> frozenset[str]:
    """The rules of the list as written, and those of other alphabets in ASCII (xn--) too."""
    rules = {x.split()[0] for x in SUFFIX_LIST.read_text("utf-8").splitlines() if x.strip() and not x.startswith("//")}
    plain = set()
    for x in rules:
        mark = x[: len(x) - len(x.lstrip("!*."))]
        with suppress(UnicodeError):
            plain.add(mark + x[len(mark) :].encode("idna").decode())
    return frozenset(rules | plain)


def split_host(host: str, rules: frozenset[str]) -> tuple[str, str]:
    """(domain, suffix). The suffix is by the longest rule that fits, * standing for a label; one with !
    wins and its suffix is a label less; without any rule it is the last label. The domain has a label
    more than the suffix, where there is one."""
    labels = host.split(".")
    n = 1
    for i in range(len(labels)):
        rest = ".".join(labels[i:])
        if "!" + rest in rules:
            n = len(labels) - i - 1
            break
        if rest in rules or ".".join(["*", *labels[i + 1 :]]) in rules:
            n = len(labels) - i
            break
    return ".".join(labels[-n - 1 :]), ".".join(labels[-n:])


def domain_and_suffix(host: Column) -> Column:
    """struct(domain, suffix). The list travels with the function: executors read no file."""
    rules = suffix_rules()
    return F.udf(lambda x: split_host(x, rules), "domain string, suffix string")(host)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does. rules: (verdict,
    host/path) pairs; a rule fits its host and the host's subdomains if the path starts with its own."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        made = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _weight(levels: DataFrame, parent: str) -> float:
    """The prior's weight, by moments: what the rates of groups of two pages or more vary around
    their parent beyond binomial noise."""
    p = F.col(parent)
    r = levels.where("n >= 2").agg(F.sum(F.pow(F.col("good") / F.col("n") - p, 2) * F.col("n")).alias("s"), F.sum(p * (1 - p)).alias("noise"), F.sum(p * (1 - p) * (F.col("n") - 1)).alias("more")).first()
    if not r["more"]:
        return 10.0
    rho = (r["s"] - r["noise"]) / r["more"]
    return float(min(max(1 / rho - 1 if rho > 0 else 1000.0, 1.0), 1000.0))


def host_reputation(labelled: DataFrame, z: float = 2.0, hosts: DataFrame | None = None) -> tuple[DataFrame, float]:
    """(host, domain, suffix, n, mean, low, high) for each host of labelled (host, good 0 or 1) and of
    hosts (host, may repeat), and the overall rate. mean is the posterior's, low and high lie z of its
    standard deviations away. Hosts without labels have n = 0, so each level's mean is its parent's."""
    counted = labelled.where("host is not null and good is not null").select("host", F.lit(1).alias("n"), "good")
    if hosts is not None:
        counted = counted.unionByName(hosts.where("host is not null").select("host", F.lit(0).alias("n"), F.lit(0).alias("good")))
    base = counted.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    base = staged(base.withColumn("parts", domain_and_suffix(F.col("host"))).select("host", "n", "good", "parts.domain", "parts.suffix"))
    total = base.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = ((total["good"] or 0) + 1.0) / ((total["n"] or 0) + 2.0)

    def shrunk(df: DataFrame, parent: Column, out: str) -> DataFrame:
        df = df.withColumn("parent_mean", parent)
        w = _weight(df, "parent_mean")
        return df.withColumn("weight", F.lit(w)).withColumn(out, (F.col("good") + w * F.col("parent_mean")) / (F.col("n") + w))

    suffix = shrunk(base.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), F.lit(overall), "suffix_mean")
    domain = base.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    domain = shrunk(join_checked(domain, suffix.select("suffix", "suffix_mean"), ["suffix"]), F.col("suffix_mean"), "domain_mean")
    host = shrunk(join_checked(base, domain.select("domain", "suffix", "domain_mean"), ["domain", "suffix"]), F.col("domain_mean"), "mean")
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("weight") + 1))
    return host.select("host", "domain", "suffix", "n", "mean", (F.col("mean") - z * sd).alias("low"), (F.col("mean") + z * sd).alias("high")), overall


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", outcome_id: str = "doc_id", threshold: float = 0.5, z: float = 2.0) -> DataFrame:
    """(page_id, host, path, rule, verdict, reputation) for each row of pages.

    outcomes has outcome_id and good (0 or 1), of some pages. A null url, or one without ://, has an
    empty host and path; it is allowed. Hosts without labelled pages are judged by their domain, suffix or
    the overall rate. Ids may be null or repeat and rows stay as many as they are; an id labelled twice
    counts each label. With no outcomes at all only rules block. Other columns are ignored. reputation is
    the host's posterior mean."""
    url = F.col(url_col).cast("string")
    base = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    labels = outcomes.select(F.col(outcome_id).alias("page_id"), F.col("good"))
    named = base.where("host <> ''").select("page_id", "host")
    known = named.join(labels, "page_id").select("host", "good")
    host, overall = host_reputation(known, z, named.select("host"))
    out = join_checked(base, host.select("host", "mean", "high"), ["host"])
    fit = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("high") < threshold, "block").otherwise("allow")
    return out.withColumn("fit", fit).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), own).alias("verdict"), F.coalesce("mean", F.lit(overall)).alias("reputation"))
