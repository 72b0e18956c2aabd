"""URL filters: rules first, then host reputation by empirical Bayes.

Hosts, registered domains and suffixes form a tree. The share of good outcomes of a
host has a beta prior around the posterior mean of its registered domain, that one
around its suffix, and a suffix around all outcomes. The strength of each prior is
estimated from how much shares differ beyond what chance explains (moments of the
beta-binomial). A page whose host is surely bad, with the upper bound of the posterior
below ``GOOD_FROM``, is blocked; hosts without outcomes fall back on their priors.

Outcomes are labelled urls; ``judge`` uses those that rules decide, since a
rule is a person's label for the pages it covers.

Everything is DataFrame expressions: outcomes are counted for each host before any
join, so a host that has a third of all pages is a row like others, and rules (a
bounded list) are a literal.

Edge cases: a null url or one without ``://`` has empty host and path, matches no
rule and is judged as the host ""; a null page_id is a value like another; equal
rows get equal verdicts; without outcomes all is allowed; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A host is blocked when its share of good outcomes is below this with the given certainty.
GOOD_FROM, DEVIATIONS = 0.5, 1.645
#: Most rules of a list: they are part of the plan.
MAX_RULES = 1000

#: Common suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "com.br", "co.in", "co.za", "com.mx", "com.cn"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


def rule(verdict: str, text: str) -> Rule:
    """From a verdict and text like ``example.org/en/``."""
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(raw, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct (text, verdict); null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def suffix_of(host: Column) -> Column:
    bare = F.regexp_replace(host, r":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    return F.when(two.isin(TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(bare, ".", -1))


def domain_of(host: Column) -> Column:
    bare = F.regexp_replace(host, r":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    return F.when(two.isin(TWO_LABEL_SUFFIXES), F.substring_index(bare, ".", -3)).otherwise(two)


def _shrunk(units: DataFrame, mean: Column) -> DataFrame:
    """Add ``prior`` and ``strength`` to rows with outcomes n, good: one strength for all rows."""
    rows = units.withColumn("prior", mean)
    chance = F.col("prior") * (1 - F.col("prior"))
    share = F.try_divide(F.col("good"), F.col("n"))
    beyond = F.sum(F.col("n") * (share - F.col("prior")) * (share - F.col("prior")) - chance)
    excess = F.try_divide(beyond, F.sum((F.col("n") - 1) * chance))
    # Between about a hundred outcomes' worth of prior and a third of one.
    alike = F.least(F.greatest(F.coalesce(excess, F.lit(0.5)), F.lit(0.01)), F.lit(0.75))
    strength = rows.where("n > 0").agg((1 / alike - 1).alias("strength"))
    return rows.crossJoin(F.broadcast(strength))  # a single row


def reputations(hosts: DataFrame) -> DataFrame:
    """(host, n, good) for each host, n may be 0 -> also posterior mean and its upper bound."""
    hosts = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    overall = suffixes.agg(((F.sum("good") + 1) / (F.sum("n") + 2)).alias("overall"))
    posterior = (F.col("good") + F.col("strength") * F.col("prior")) / (F.col("n") + F.col("strength"))
    suffixes = _shrunk(suffixes.crossJoin(F.broadcast(overall)), F.col("overall")).select("suffix", posterior.alias("suffix_mean"))
    domains = _shrunk(domains.join(suffixes, "suffix"), F.col("suffix_mean")).select("domain", posterior.alias("domain_mean"))
    out = _shrunk(hosts.join(domains, "domain"), F.col("domain_mean"))
    spread = F.sqrt(posterior * (1 - posterior) / (F.col("n") + F.col("strength") + 1))
    return out.select("host", "n", "good", posterior.alias("reputation"), (posterior + DEVIATIONS * spread).alias("upper"))


def parsed(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, host, path, rule, ruled) for each row of ``pages`` (page_id, url)."""
    rows = pages.select(F.col("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hit = matching_rule(F.col("host"), F.col("path"), rules)
    return rows.withColumn("hit", hit).select("page_id", "host", "path", F.col("hit.text").alias("rule"), F.col("hit.verdict").alias("ruled"))


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, host, path, rule, verdict, reputation, upper) for each row of ``pages``."""
    rows = parsed(pages, rules)
    hosts = rows.groupBy("host").agg(F.count("ruled").alias("n"), F.count(F.when(F.col("ruled") == "allow", 1)).alias("good"))
    known = reputations(hosts).select(F.col("host").alias("of"), "reputation", "upper")
    verdict = F.coalesce("ruled", F.when(F.col("upper") < GOOD_FROM, "block").otherwise("allow"))
    joined = rows.join(known, rows["host"] == known["of"], "left")
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("reputation", 6).alias("reputation"), F.round("upper", 6).alias("upper"))


def kept(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, host, path) of the pages that are allowed."""
    return judge(pages, rules).where("verdict = 'allow'").select("page_id", "host", "path")
