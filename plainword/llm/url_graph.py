"""URL filters: path rules, then trust and distrust that spread along links between hosts.

A rule decides the pages it fits. Every other page gets the verdict of its host: trust starts at hosts with allowed pages and follows links
(personalised PageRank); distrust starts at hosts with blocked pages and follows links backwards, to those who link to them. A seed's
weight is the share of its pages that rules allow or block. A host is blocked if its distrust exceeds its trust by
what ``threshold`` of its pages blocked would give it; so hosts without links and rules stay allowed.

Links are absolute ``href`` targets; those within a host don't count. Null urls, and urls without ``://``, have an empty host and path and are allowed.
Pages with equal ids or urls are judged one by one. An empty table gives an empty result. Only the id, url and html columns are read, so other names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

# Fixed values: (rule, verdict).
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?i)\bhref\s{0,8}=\s{0,8}["']?(?:https?:)?//([^/?#"'\s<>]+)"""


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules: list[tuple[str, str]], value) -> Column:
    """``value(rule, verdict)`` of the longest rule that fits, else null."""
    case = F
    for rule, verdict in sorted(rules, key=lambda x: (-len(x[0]), x[0])):
        name, _, rest = rule.partition("/")
        case = case.when(((host == name) | host.endswith("." + name)) & path.startswith("/" + rest), F.lit(value(rule, verdict)))
    return case.otherwise(F.lit(None).cast("string"))


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, n: links between different hosts, counted once a page."""
    to = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(HREF), F.lit(1)), lambda x: F.translate(x, _UPPER, _LOWER)))
    each = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(to).alias("dst"))
    return each.filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(seeds: DataFrame, edges: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """host, score. seeds: host, seed; edges: src, dst, n. score = (1 - damping) * seed + damping * what linking hosts pass on, by share of links.

    Waves go out from the seeds until the mass of the last one is under ``tolerance`` of what went out: a wave has at most ``damping`` of the mass before, so
    that takes log(tolerance) / log(damping) rounds at most, whatever the graph. The scores are the sums of the waves.
    Seeds aren't scaled to a sum of 1, so a host's score doesn't depend on how many others are seeds. What reaches a host without links isn't
    passed on; sending it back to the seeds would only scale all scores alike."""
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    share = saved(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")), "host-shares")
    wave = saved(seeds.filter("seed > 0").select("host", ((1 - damping) * F.col("seed")).alias("score")), "host-wave")
    every, least = wave, None
    while True:
        mass = wave.agg(F.sum("score")).first()[0] or 0.0
        least = mass * tolerance if least is None else least
        if mass <= least or mass == 0:
            return every.groupBy("host").agg(F.sum("score").alias("score"))
        passed = share.join(wave, share.src == wave.host).select(F.col("dst").alias("host"), (damping * F.col("share") * F.col("score")).alias("score"))
        wave = saved(passed.groupBy("host").agg(F.sum("score").alias("score")), "host-wave")
        every = every.unionByName(wave)


def host_verdicts(judged: DataFrame, links: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, threshold: float = 0.5) -> DataFrame:
    """host, trust, distrust, host_verdict. judged: host, fixed (verdict of a rule or null), one row a page."""
    share = lambda v: F.avg(F.when(F.col("fixed") == v, 1.0).otherwise(0.0))
    hosts = saved(judged.groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")), "hosts")
    links = saved(links, "host-links")
    trust = spread(hosts.select("host", F.col("allowed").alias("seed")), links, damping, tolerance)
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = spread(hosts.select("host", F.col("blocked").alias("seed")), back, damping, tolerance)
    both = hosts.select("host").join(trust.withColumnRenamed("score", "trust"), "host", "left").join(distrust.withColumnRenamed("score", "distrust"), "host", "left").fillna(0.0, ["trust", "distrust"])
    over = F.col("distrust") - F.col("trust") > threshold * (1 - damping)
    return both.withColumn("host_verdict", F.when(over, F.lit("block")).otherwise(F.lit("allow")))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **settings) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust."""
    split = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    h, p = F.col("host"), F.col("path")
    ruled = split.select("page_id", "host", "path", fitting(h, p, rules, lambda r, v: r).alias("rule"), fitting(h, p, rules, lambda r, v: v).alias("fixed"))
    scores = host_verdicts(ruled.select("host", "fixed"), host_links(pages, url_col, html_col), **settings)
    return ruled.join(scores, "host").select("page_id", "host", "path", "rule", F.coalesce("fixed", "host_verdict").alias("verdict"), "trust", "distrust")
