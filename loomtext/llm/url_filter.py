"""URL filter: explicit host and path rules, then host reputation by empirical Bayes. Native DataFrame functions only.

Reputation: labelled pages are counted by host, registered domain and public suffix. Each level's rate of good pages is
shrunk towards the level above with a beta-binomial prior, whose strength comes from the spread of the rates at that
level (method of moments). A page is blocked where even the upper bound of its host's posterior is below the threshold,
by default the good rate of all labelled pages: hosts that are credibly worse than the whole.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Suffixes of more than one label under which names are registered, the default of a parameter that takes a table of them.
#: Any other suffix is a host's last label. Fixed values.
SUFFIXES = (
    "ac.at", "ac.be", "ac.id", "ac.il", "ac.in", "ac.jp", "ac.kr", "ac.nz", "ac.th", "ac.uk", "ac.za", "asn.au", "blogspot.com", "co.at", "co.id", "co.il",
    "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.bd", "com.br", "com.cn", "com.co", "com.eg", "com.hk",
    "com.mx", "com.my", "com.ng", "com.pe", "com.ph", "com.pk", "com.pl", "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.ve", "com.vn", "edu.au", "edu.br",
    "edu.cn", "edu.hk", "edu.tw", "github.io", "gitlab.io", "go.jp", "go.kr", "gob.ar", "gob.mx", "gouv.fr", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "gov.za",
    "herokuapp.com", "ltd.uk", "me.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "net.uk", "netlify.app", "or.at", "or.jp", "or.kr", "org.au", "org.br", "org.cn",
    "org.hk", "org.mx", "org.nz", "org.tw", "org.uk", "org.za", "pages.dev", "plc.uk", "sch.uk", "vercel.app", "wordpress.com",
)
#: Most labels of a suffix.
LABELS = 4
#: Rules go into the plan as literals: at most so many.
MOST_RULES = 500
#: Bounds of a prior's strength, in pages.
STRENGTH = (2.0, 200.0)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty where it is null or has no "://"."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Mapping[str, str]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule is host + "/" + rest of the path prefix."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    rule = verdict = F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), r)):
        at, rest = text.split("/", 1)
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, rules[text]).otherwise(verdict)
    return rule, verdict


def with_domains(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """hosts (host, once each) with domain and suffix. suffixes: (suffix) of more than one label.

    A user name and a port do not count. An address of numbers, one in brackets and a host without a dot are their own
    domain and suffix. The longest listed suffix counts, else the last label; the domain has one label more, if there is one.
    """
    bare = F.regexp_replace(F.regexp_replace("host", "^[^@]*@", ""), r":\d*$", "")
    labels = F.split("_bare", r"\.")
    last = lambda k: F.array_join(F.slice(labels, -k, k), ".")
    rows = hosts.withColumn("_bare", bare).withColumn("_n", F.size(labels))
    rows = rows.withColumn("_n", F.when(F.col("_bare").rlike(r"^(\d{1,3}(\.\d{1,3}){3}|\[.*\])$"), 1).otherwise(F.col("_n")))
    listed = suffixes.select(F.col("suffix").alias("_s")).distinct()
    cuts = rows.filter("_n > 1").select("host", F.explode(F.array(*(F.when(F.col("_n") >= k, F.struct(F.lit(k).alias("k"), last(k).alias("_s"))) for k in range(2, LABELS + 1)))).alias("x")).select("host", "x.*").filter("_s is not null")
    longest = cuts.join(listed, "_s", "left_semi").groupBy("host").agg(F.max("k").alias("_k"))
    rows = rows.join(longest, "host", "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    cut = lambda k: F.when(F.col("_n") == 1, F.col("_bare")).otherwise(F.array_join(F.slice(labels, -k, k), "."))
    return rows.withColumns({"suffix": cut(F.col("_k")), "domain": cut(F.least(F.col("_k") + 1, F.col("_n")))}).drop("_bare", "_n", "_k")


def strength(rates: DataFrame, good: str, n: str, prior: str) -> float:
    """Prior strength by moments: how much the groups' rates spread around their priors beyond binomial noise."""
    p, q = F.col(prior), F.col(good) / F.col(n)
    row = rates.filter(F.col(n) > 1).agg(F.sum(n).alias("n"), F.sum(F.col(n) * (q - p) ** 2).alias("s"), F.sum(p * (1 - p)).alias("v"), F.sum(F.col(n) * p * (1 - p)).alias("w")).first()
    if not row["n"] or not row["w"]:
        return STRENGTH[1]
    # E[s] = v + (w - v) * rho with rho = 1 / (strength + 1)
    rho = max(1e-9, (row["s"] - row["v"]) / max(row["w"] - row["v"], 1e-9))
    return min(max(1 / rho - 1, STRENGTH[0]), STRENGTH[1])


def overall(hosts: DataFrame) -> float:
    """The good rate of all labelled pages, with one page more of either kind."""
    good, n = hosts.agg(F.sum("n_good"), F.sum("n_labelled")).first()
    return ((good or 0) + 1) / ((n or 0) + 2)


def reputation(hosts: DataFrame, top: float) -> DataFrame:
    """From (host, domain, suffix, n_labelled, n_good) by host: the same with posterior a, b of the good rate, shrunk from
    `top` down."""

    def level(key: str) -> DataFrame:
        return hosts.groupBy(key).agg(F.sum("n_good").alias(f"{key}_good"), F.sum("n_labelled").alias(f"{key}_n"))

    suffixes = level("suffix").withColumn("prior", F.lit(top))
    k = strength(suffixes, "suffix_good", "suffix_n", "prior")
    suffixes = suffixes.withColumn("suffix_rate", (F.col("suffix_good") + k * top) / (F.col("suffix_n") + k)).drop("prior")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n_good").alias("domain_good"), F.sum("n_labelled").alias("domain_n")).join(suffixes, "suffix")
    k = strength(domains, "domain_good", "domain_n", "suffix_rate")
    domains = domains.withColumn("domain_rate", (F.col("domain_good") + k * F.col("suffix_rate")) / (F.col("domain_n") + k))
    scored = hosts.join(domains.select("domain", "suffix", "domain_rate"), ["domain", "suffix"])
    k = strength(scored, "n_good", "n_labelled", "domain_rate")
    return scored.withColumns({"a": F.col("n_good") + k * F.col("domain_rate"), "b": F.col("n_labelled") - F.col("n_good") + k * (1 - F.col("domain_rate"))})


def judge(pages: DataFrame, labels: DataFrame, rules: Mapping[str, str], threshold: float | None = None, z: float = 1.645, suffixes: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, good_mean, good_upper (of the host's posterior).

    labels: (page_id, good boolean); a page labelled more than once counts each time, labels with nulls do not count.
    A page with a null id has no labels; with a null url it has an empty host, which is judged as any other. Repeated
    rows are judged each; an empty table gives no rows; other columns may have any name. suffixes: (suffix), SUFFIXES
    if not given. Pages of a host are counted before the shuffle, and the join back is by host with one row on the other
    side, so a hot host is split by adaptive execution. The counts are stored, so the pages are read twice.
    """
    host, path = url_parts(F.col(url_col))
    parsed = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    marks = labels.filter("page_id is not null and good is not null").groupBy("page_id").agg(F.count("*").alias("m"), F.sum(F.col("good").cast("long")).alias("g"))
    counts = parsed.select("page_id", "host").join(marks, "page_id", "left").groupBy("host").agg(F.count("*").alias("n_pages"), F.coalesce(F.sum("m"), F.lit(0)).alias("n_labelled"), F.coalesce(F.sum("g"), F.lit(0)).alias("n_good"))
    if suffixes is None:
        suffixes = pages.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, SUFFIXES))).alias("suffix"))
    hosts = stored(with_domains(counts, suffixes), "hosts")
    top = overall(hosts)
    mean = F.col("a") / (F.col("a") + F.col("b"))
    spread = F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1))
    known = reputation(hosts, top).select("host", mean.alias("good_mean"), (mean + z * spread).alias("good_upper"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("good_upper") < (top if threshold is None else threshold), "block").otherwise("allow")
    return parsed.join(known, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "good_mean", "good_upper")
