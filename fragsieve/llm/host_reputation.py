"""URL verdicts by rules and, where none fits, by the host's reputation; DataFrame functions only.

Outcomes of labelled pages (1: bad; without labels, the rules' own verdicts) are
summed by host, registered domain and suffix. From the whole down to the host, a level's share is the mean of
a beta distribution whose prior has the share of the level above and a strength
fitted to the spread between the level's groups (method of moments). A host is
blocked if the lower posterior bound of its share is above a limit. The bound is a
normal approximation: the mean less ``z`` standard deviations of the beta posterior.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Suffixes of several labels, under which a registered domain has one more (fixed values; a parameter, which takes a whole public list).
SUFFIXES = ["co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.nz", "co.za"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path; both empty for null and for urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substr(__url, instr(__url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct ``size, rule, verdict`` of the longest rule that fits, or null. ``rules``: verdict and host with path, a short list."""
    fits = []
    for verdict, rule in rules:
        at = rule.index("/")
        name, start = rule[:at], rule[at:]
        fit = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size: int, rule: string, verdict: string>")


def levels(host: Column, suffixes: list[str] = SUFFIXES) -> tuple[Column, Column]:
    """Suffix (the longest listed one that the host ends in, or else its last label) and registered domain (one label more)."""
    listed: dict[int, set[str]] = {}
    for s in suffixes:
        listed.setdefault(s.count(".") + 1, set()).add(s)
    suffix, domain = F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)
    for n in sorted(listed):
        end = F.substring_index(host, ".", -n)
        known = end.isin(sorted(listed[n]))
        suffix, domain = F.when(known, end).otherwise(suffix), F.when(known, F.substring_index(host, ".", -n - 1)).otherwise(domain)
    return suffix, domain


def strength(groups: DataFrame, least: float = 1.0, most: float = 1000.0) -> DataFrame:
    """One row ``m``: the strength of the prior that the spread of the shares ``bad / n`` between groups suggests."""
    total = groups.agg(F.sum("bad").cast("double").alias("b"), F.sum("n").cast("double").alias("t"), F.count("*").alias("k"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("spread"))
    p = F.col("b") / F.col("t")
    between = (F.col("spread") - F.col("t") * p * p - (F.col("k") - 1) * p * (1 - p)) / (F.col("t") - F.col("squares") / F.col("t"))
    known = (F.col("k") > 1) & (F.col("t") > F.col("squares") / F.col("t"))
    m = F.when(known & (between > 0), F.least(F.lit(most), F.greatest(F.lit(least), p * (1 - p) / between - 1))).otherwise(F.lit(most))
    return total.select(F.when(F.col("t") > 0, m).otherwise(F.lit(most)).alias("m"))


def reputations(hosts: DataFrame, z: float = 1.64, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """``host, bound``: lower posterior bound of the share of blocked pages, for every row of ``host, n, bad`` (n may be 0)."""
    suffix, domain = levels(F.col("host"), suffixes)
    rows = hosts.select("host", "n", "bad", suffix.alias("suffix"), domain.alias("domain"))
    seen = rows.where("n > 0")
    whole = rows.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("n"), F.lit(0)) + 2.0)).alias("p0"))
    by_suffix = rows.groupBy("suffix").agg(F.sum("n").alias("ns"), F.sum("bad").alias("bs"))
    by_domain = rows.groupBy("domain", "suffix").agg(F.sum("n").alias("nd"), F.sum("bad").alias("bd"))
    sums = lambda key: strength(seen.groupBy(key).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    one = lambda d, name: d.withColumnRenamed("m", name)
    # Each of these is one row.
    scalars = whole.join(F.broadcast(one(sums("suffix"), "m1"))).join(F.broadcast(one(sums("domain"), "m2"))).join(F.broadcast(one(sums("host"), "m3")))
    domains = (
        by_domain.join(by_suffix, "suffix").join(F.broadcast(scalars))
        .withColumn("ps", (F.col("bs") + F.col("m1") * F.col("p0")) / (F.col("ns") + F.col("m1")))
        .select("domain", "m3", ((F.col("bd") + F.col("m2") * F.col("ps")) / (F.col("nd") + F.col("m2"))).alias("pd"))
    )
    a, total = F.col("bad") + F.col("m3") * F.col("pd"), F.col("n") + F.col("m3")
    mean = a / total
    return rows.join(domains, "domain").select("host", (mean - z * F.sqrt(mean * (1 - mean) / (total + 1))).alias("bound"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], limit: float = 0.5, z: float = 1.64, bound: int = 100_000, id_col: str = "page_id", url_col: str = "url", outcomes: DataFrame | None = None, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``.

    ``verdict`` is that of the longest rule that fits host (or a parent of it) and
    path; else ``block`` if the host's lower bound is above ``limit``, else
    ``allow``. The labelled outcomes are those of ``outcomes`` (a url column of the
    same name, ``bad`` 0 or 1; other values and urls without a host are ignored),
    whose pages need not be among ``pages``, or where it isn't given the rules' verdicts over the same pages.
    ``suffixes``: those of several labels.
    Null urls and urls without ``://`` have an empty host and path, and are judged
    by the reputation of the empty host; equal rows get equal verdicts; an empty
    table gives no rows; other columns are ignored. Up to ``bound`` hosts are
    broadcast; beyond, hosts are joined by a shuffle whose skew Spark splits.
    """
    split = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("__url"))
    host, path = host_and_path(F.col("__url"))
    split = split.select("page_id", host.alias("host"), path.alias("path"))
    judged = split.withColumn("best", best_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("__verdict"))
    if outcomes is None:
        labelled = judged.select("host", F.when(F.col("__verdict") == "block", 1).when(F.col("__verdict").isNotNull(), 0).alias("bad"))
    else:
        others = outcomes.select(outcomes[url_col].cast("string").alias("__url"), outcomes["bad"].cast("int").alias("bad")).where("bad IN (0, 1)")
        labelled = judged.select("host", F.lit(None).cast("int").alias("bad")).unionByName(others.select(host.alias("host"), "bad").where("host <> ''"))
    hosts = labelled.groupBy("host").agg(F.count("bad").alias("n"), F.count(F.when(F.col("bad") == 1, 1)).alias("bad"))
    known = reputations(hosts, z, suffixes)
    known = F.broadcast(known) if hosts.count() <= bound else known
    by_host = F.when(F.col("bound") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return judged.join(known, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("__verdict", by_host).alias("verdict"))
