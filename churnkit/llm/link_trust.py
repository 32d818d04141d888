"""Operator 10: URL filter by rules and by trust that spreads over links, in DataFrame functions only.

*Rules.* A rule (host, path) fits its host and all subdomains if the url's path
starts with the rule's. The longest fitting rule wins. Rules are a short list
given by the caller and become one expression.

*Links.* Every href or src of a page that names another host is an edge between
hosts. Trust is personalised PageRank from the hosts that rules allow; distrust
is the same on reversed edges from the hosts that rules block, so a host that
links to blocked hosts is distrusted. Seeds weigh as many as their pages of that
verdict. A host is blocked when its distrust is above ``threshold`` times the
sum of both; a host that neither reaches is allowed. The method's verdict counts
for urls without a rule.

Edges are counted once per pair of hosts before any step, so a host with a third
of all pages or links is one row (or its number of neighbours) and not a hot key.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: from there up to ``?``, ``#`` or the end.

Cases: a null url, or one without ``://``, has an empty host and path, no rule,
and is allowed; null html has no links; null ids are kept; repeated rows are
judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import staged

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^/?#"'\s>]*)"""

#: (host, path, verdict)
Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty for null and for a url without "://"."""
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def judged_by_rules(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """``urls`` (host, path, ...) with rule and rule_verdict of the longest rule that fits, else null; "org/" is
    the host org with the path "/"."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1]), reverse=True):
        fits = ((F.col("host") == h.lower()) | F.col("host").endswith("." + h.lower())) & F.col("path").startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return urls.withColumn("rule", none if rule is None else rule).withColumn("rule_verdict", none if verdict is None else verdict)


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target, n): links from pages of one host to another host."""
    linked = pages.select(host_and_path(F.col(url_col))[0].alias("source"),
                          F.explode(F.array_distinct(F.regexp_extract_all(F.col(html_col), F.lit(_LINK), 1))).alias("link"))
    target = F.translate(F.regexp_extract("link", r"//([^/?#]*)$", 1), _UPPER, _LOWER)
    return (linked.select("source", target.alias("target")).where("source <> '' and target <> '' and source <> target")
            .groupBy("source", "target").agg(F.count("*").alias("n")))


def personalised_rank(edges: DataFrame, seeds: DataFrame, damping: float, rounds: int, checkpoint_every: int) -> DataFrame:
    """(host, rank) of personalised PageRank over (source, target, share); a step without a link ends the walk.

    ``seeds``: (host, weight), weights that add up to 1.
    """
    start = seeds.select("host", (F.col("weight") * (1 - damping)).alias("rank"))
    if edges.isEmpty():
        return start                                   # every round would give this again
    rank = seeds.select("host", F.col("weight").alias("rank"))
    for k in range(rounds):
        moved = (rank.join(edges, rank["host"] == edges["source"])
                 .select(F.col("target").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank")))
        rank = moved.union(start).groupBy("host").agg(F.sum("rank").alias("rank"))
        if k % checkpoint_every == checkpoint_every - 1 and k < rounds - 1:
            rank = staged(rank, "rank")
    return rank


def trust(hosts: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20, checkpoint_every: int = 4) -> DataFrame:
    """(host, trust, distrust) of every host that a seed reaches, from (host, rule_verdict, n) and (source, target, n)."""
    spread = {}
    for verdict, name, forward in (("allow", "trust", True), ("block", "distrust", False)):
        seeds = hosts.where(F.col("rule_verdict") == verdict).select("host", F.col("n").alias("seed"))
        total = seeds.agg(F.sum("seed")).scalar()
        seeds = seeds.select("host", (F.col("seed") / total).alias("weight"))
        one, two = ("source", "target") if forward else ("target", "source")
        out = edges.groupBy(one).agg(F.sum("n").alias("out"))
        steps = edges.join(out, one).select(F.col(one).alias("source"), F.col(two).alias("target"), (F.col("n") / F.col("out")).alias("share"))
        spread[name] = personalised_rank(staged(steps, f"{name}-steps"), staged(seeds, f"{name}-seeds"), damping, rounds, checkpoint_every).withColumnRenamed("rank", name)
    both = spread["trust"].join(spread["distrust"], "host", "full_outer")
    return both.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def filter_urls(pages: DataFrame, rules: list[Rule], threshold: float = 0.75, *, damping: float = 0.85, rounds: int = 20,
                id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust (of its host)."""
    host, path = host_and_path(F.col(url_col))
    urls = judged_by_rules(pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")), rules)
    hosts = staged(urls.where("host <> ''").groupBy("host", "rule_verdict").agg(F.count("*").alias("n")), "hosts")
    scores = trust(hosts, staged(host_edges(pages, url_col, html_col), "host-edges"), damping, rounds)
    scores = staged(scores, "host-scores")
    zero = F.lit(0.0)
    own = (F.when(F.coalesce("distrust", zero) > threshold * (F.coalesce("trust", zero) + F.coalesce("distrust", zero)), "block")
           .otherwise("allow"))
    return (urls.join(scores, "host", "left").withColumn("verdict", F.coalesce("rule_verdict", own))
            .select("page_id", "host", "path", "rule", "verdict", F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust")))
