"""URL filter by empirical-Bayes host reputation.

A page's labelled outcome is bad (1) or good (0).  The rate of bad pages is
estimated level by level: all pages, suffix (last label of the host, or one of
``SUFFIXES``), registered domain (suffix and the label before it), host; a port
counts for the host alone.  At each level a group's rate has a
beta prior whose mean is its parent's posterior mean and whose weight is fitted
by the method of moments over the level's groups (the intra-group correlation
rho of the beta-binomial; weight = 1 / rho - 1).  A host with few labels is thus
drawn to its domain, a domain to its suffix.  A page is blocked when the lower
bound of its host's posterior rate, mean - Z standard deviations, exceeds
``MAX_BAD``.  Rules on host and path come first; the longest that fits wins.

All of it is DataFrame aggregation and joins; counts are summed map-side before
any shuffle, so a host with a third of all pages is one row per task.

Defined results: a url that is null or has no ``://`` has an empty host and
path; an empty host is a group like any other; without any label all rates are
unknown and the method allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelake.llm.common import store

MAX_BAD = 0.25
# fixed values: suffixes of several labels; below others the last label is the suffix
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "co.kr", "co.in", "co.za",
            "com.br", "com.cn", "com.mx", "com.ar", "com.tr", "github.io", "gitlab.io", "blogspot.com", "wordpress.com", "herokuapp.com",
            "netlify.app", "vercel.app", "pages.dev")
Z = 1.645
# fixed values: (host, path prefix, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def url_parts(url):
    """(host, path) columns of a url column."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    folded = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(folded, F.lit("")), F.coalesce(path, F.lit(""))


def rule_column(host, path, rules):
    """The longest rule that fits (host and path as written), else null, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _level(groups: DataFrame, parents: DataFrame | None, own: str, parent: str | None, overall: float) -> DataFrame:
    """Posterior (alpha, beta) of every group; ``groups``: own, parent, bad, n."""
    if parents is None:
        g = groups.withColumn("m", F.lit(overall))
    else:
        g = groups.join(parents.select(F.col("name").alias(parent), F.col("mean").alias("m")), parent, "left")
    g = store(g, f"level-{own}")
    v = F.col("m") * (1 - F.col("m"))
    s = g.agg(F.sum(F.pow(F.col("bad") - F.col("n") * F.col("m"), 2) - F.col("n") * v).alias("extra"),
              F.sum(F.col("n") * (F.col("n") - 1) * v).alias("room")).first()
    rho = (s["extra"] / s["room"]) if s["room"] else 0.5
    weight = 1 / min(max(rho, 0.001), 0.9) - 1
    a, b = F.col("m") * weight + F.col("bad"), (1 - F.col("m")) * weight + F.col("n") - F.col("bad")
    mean = a / (a + b)
    return g.select(F.col(own).alias("name"), mean.alias("mean"),
                    F.sqrt(mean * (1 - mean) / (a + b + 1)).alias("sd"))


def site_parts(host, suffixes=SUFFIXES):
    """(suffix, registered domain) columns of a host column; a port is no part of
    either, and a host that is a suffix is its own domain."""
    name = F.regexp_replace(host, r":[0-9]*$", "")
    label, size = F.split(name, r"\."), F.lit(1)
    for s in sorted(suffixes, key=lambda s: s.count(".")):
        size = F.when((name == s) | F.endswith(name, F.lit("." + s)), F.lit(s.count(".") + 1)).otherwise(size)

    def last(n):
        n = F.least(n, F.size(label))
        return F.array_join(F.slice(label, -n, n), ".")

    return last(size), last(size + 1)


def host_reputation(hosts: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """host, bad_rate, bad_low from (host, bad, n) counts, one row per host
    (n 0 where no page of the host is labelled)."""
    suffix, domain = site_parts(F.col("host"), suffixes)
    h = store(hosts.select("host", suffix.alias("suffix"), domain.alias("domain"), "bad", "n"), "hosts")
    total = h.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    if not total["n"]:
        return h.select("host", F.lit(None).cast("double").alias("bad_rate"), F.lit(None).cast("double").alias("bad_low"))
    # a half on both sides keeps the overall rate off 0 and 1
    overall = (total["bad"] + 0.5) / (total["n"] + 1)
    by_suffix = _level(h.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")), None, "suffix", None, overall)
    by_suffix = store(by_suffix, "suffixes")
    by_domain = _level(h.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")),
                       by_suffix, "domain", "suffix", overall)
    by_domain = store(by_domain, "domains")
    by_host = _level(h.select("host", "domain", "bad", "n"), by_domain, "host", "domain", overall)
    return by_host.select(F.col("name").alias("host"), F.col("mean").alias("bad_rate"), (F.col("mean") - Z * F.col("sd")).alias("bad_low"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, max_bad: float = MAX_BAD, suffixes=SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate; ``outcomes``: page_id, bad (0/1)."""
    host, path = url_parts(F.col("url"))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    seen = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    known = p.select("page_id", "host").join(seen, "page_id", "left")
    counts = known.groupBy("host").agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("bad").alias("n"))
    rep = store(host_reputation(counts, suffixes), "reputation")
    name, verdict = rule_column(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_low") > max_bad, F.lit("block")).otherwise(F.lit("allow"))
    return p.join(rep, "host", "left").select("page_id", "host", "path", name.alias("rule"),
                                              F.coalesce(verdict, own).alias("verdict"), "bad_rate")


def page_outcomes(labels: DataFrame) -> DataFrame:
    """The document labels of the same number: bad if toxic or of low quality."""
    return labels.select(F.col("doc_id").cast("long").alias("page_id"),
                         ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
