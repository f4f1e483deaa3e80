"""URL filters: a list of host and path rules, and for other pages the reputation of their host.

Reputation is empirical Bayes on labelled page outcomes (bad or not).  Outcomes are counted by host,
registered domain and suffix.  At each level the bad rates of the members scatter about their parents'
rate as a beta-binomial whose concentration is estimated from all members by moments; a member's rate
is shrunk towards its parent's by that much: the suffix towards the whole, the domain towards its
suffix, the host towards its domain.  A host is blocked if the lower bound of its posterior rate (mean
less `z` standard deviations of the beta posterior) is over `most_bad`; a host without labelled pages
has its domain's rate and the full scatter of hosts about it, so doubt lets pages pass.

Counting goes by partial sums, so a hot host is no hot task.  The table of hosts is joined to pages only
for blocked hosts; it is broadcast while it has at most `small_hosts` rows, else joined by shuffle.

Nulls: a null url, or one without `://`, has empty host and path, no rule and no reputation: it is
allowed.  A null page_id stays null.  Hosts are compared as they stand, ports included.  Repeated rows get
repeated verdicts; of several labels of a page any bad one counts.  An empty table gives an empty one,
no labels give no blocked host; extra columns are ignored.  Rules of one length, of which one url can
fit two only if host and path divide differently: the earlier in the list wins.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Public suffixes of two labels (fixed values); any other suffix is the last label.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "co.jp", "co.nz", "com.br", "co.za", "co.in", "com.cn")
SMALL_HOSTS = 200_000
LEVELS = ("suffix", "domain", "host")


def host_of(url: Column) -> Column:
    """After the first `://` up to a slash, question mark, hash or the end; A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*LONG_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The suffix with one label before it; the host itself where it has no more."""
    return F.when(F.substring_index(host, ".", -2).isin(*LONG_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    by_length = sorted(rules, key=lambda r: -len(r[1]))
    for what, text in reversed(by_length):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def document_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, n, bad): pages whose path ends in the number of a labelled document, low quality or toxic being bad."""
    number = F.regexp_extract(path_of(pages["url"]), r"/([0-9]{1,18})(?:\.html)?/?$", 1)
    met = pages.select(host_of(pages["url"]).alias("host"), F.nullif(number, F.lit("")).cast("long").alias("doc")).where("doc IS NOT NULL")
    met = met.groupBy("host", "doc").agg(F.count(F.lit(1)).alias("n"))
    is_bad = F.when((labels["quality"] == 0) | (labels["toxic"] == 1), 1).when(labels["quality"].isNotNull() | labels["toxic"].isNotNull(), 0)
    judged = labels.select(labels["doc_id"].cast("long").alias("doc"), is_bad.alias("bad")).where("doc IS NOT NULL AND bad IS NOT NULL").groupBy("doc").agg(F.max("bad").alias("bad"))
    return met.join(judged, "doc").groupBy("host").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("bad")).alias("bad"))


def reputation(hosts: DataFrame, outcomes: DataFrame, least: float = 2.0, most: float = 1000.0) -> DataFrame:
    """(host, n, bad, mean, deviation) of every host, by shrinking from the whole down to the host.

    outcomes: (host, n, bad) with counts.  The concentration of each level lies between `least` and `most`.
    """
    counted = hosts.where("host <> ''").select("host").distinct().join(outcomes, "host", "left").fillna(0, ["n", "bad"])
    counted = staged(counted.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}), "hosts")
    whole = counted.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("above"))
    level = counted.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(F.broadcast(whole))
    for name in LEVELS:
        if name == "domain":
            level = counted.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(level.select("suffix", F.col("mean").alias("above")), "suffix")
        if name == "host":
            level = counted.select("host", "domain", "suffix", "n", "bad").join(level.select("domain", "suffix", F.col("mean").alias("above")), ["domain", "suffix"])
        n, bad, m = F.col("n"), F.col("bad"), F.col("above")
        # Var(bad) = n m (1 - m) (1 + (n - 1) r), with r = 1 / (concentration + 1).
        spread, room = F.sum((bad - n * m) * (bad - n * m) - n * m * (1 - m)), F.sum(n * (n - 1) * m * (1 - m))
        r = F.try_divide(spread, room)
        fitted = level.agg(F.when(r > 0, F.least(F.lit(most), F.greatest(F.lit(least), 1 / r - 1))).otherwise(F.lit(most)).alias("k"))
        level = level.join(F.broadcast(fitted)).withColumn("mean", (F.col("k") * m + bad) / (F.col("k") + n))
        if name != "host":
            level = staged(level, f"by-{name}")
    a = F.col("k") + F.col("n")
    return level.select("host", "n", "bad", "mean", F.sqrt(F.col("mean") * (1 - F.col("mean")) / (a + 1)).alias("deviation"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, most_bad: float = 0.5, z: float = 1.645, small_hosts: int = SMALL_HOSTS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page."""
    each = pages.select("page_id", host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    each = each.withColumns({"rule": rule, "said": verdict})
    known = reputation(each.select("host"), outcomes)
    blocked = staged(known.where(F.col("mean") - z * F.col("deviation") > most_bad).select("host", F.lit(True).alias("bad_host")), "blocked-hosts")
    if blocked.limit(small_hosts + 1).count() <= small_hosts:
        blocked = F.broadcast(blocked)
    own = F.coalesce(F.col("said"), F.when(F.col("bad_host"), "block").otherwise("allow"))
    return each.join(blocked, "host", "left").select("page_id", "host", "path", "rule", own.alias("verdict"))
