"""URL filters: rules by host and path, and trust that spreads over the link graph.

Where no rule fits, the host decides. Hosts are nodes, links between pages of
different hosts are edges, weighted by their number and summed before anything
else. Trust is a personalised PageRank from trusted hosts along the links;
distrust is the same from blocked hosts against them, so a host that links to
blocked hosts is distrusted. Seeds have a mass of one each, whatever their
number. Such a score is shared out among all linkers of a host, so it falls with
in-degrees and orders hosts, but has no bound. Verdicts come from two shares of
a host's own links: that of its links out which lead, damped at each step, to a
blocked seed, and that of its links in which come from a trusted one. A seed has
a share of one. A host is blocked where the first reaches ``led_share`` and
outweighs the second, however many others link to the same seeds.

Seeds come from the rules that judge a whole host, and from words in host names
that only unwanted hosts have; hosts that are only linked to are seeds as well.

Everything is joins and sums on edges and hosts; a host's links are summed into
one row for each other host, so one host with most pages isn't a hot key past
that sum. An iteration stops early when no host's score changes any more.

Edge cases: a null url, or one without ``://``, has an empty host and path, no
rule, and the verdict of an unknown host, allow; null html has no links; links
within a host don't count; repeated rows count again as links and are each
judged, whatever their order; urls and pages of any length are read whole; an
empty table gives an empty table; other columns aren't read, so only the id's
name can clash with a result's, and it comes first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed by the contract.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


@dataclass(frozen=True)
class Propagation:
    """damping: of both walks; rounds: at most; still: the largest change of a host's score that ends them; led_share: the
    share of links out that lead to blocked seeds from which a host is blocked; balance: links in from trusted ones count so many times against it; words: parts of host names that make a blocked seed."""

    damping: float = 0.85
    rounds: int = 20
    still: float = 1e-6
    led_share: float = 0.25
    balance: float = 0.5
    words: tuple[str, ...] = ("casino", "bet", "bets", "betting", "poker", "pills", "pharma", "viagra", "porn", "xxx", "adult", "sex", "spam", "malware", "phishing", "warez", "ads", "adserver", "clickbait")


def host_of(url: Column) -> Column:
    lower = F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, or null. A rule: the host up to its first ``/``, and the path from there."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def link_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """src, dst, weight: links from each host's pages to each other host."""
    links = F.regexp_extract_all(F.col(html_col), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?(//[^"'\s>]+)"""), F.lit(1))
    rows = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(links).alias("link"))
    rows = rows.select("src", host_of(F.concat(F.lit(":"), "link")).alias("dst")).filter("src <> '' and dst <> '' and src <> dst")
    return rows.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def walk(edges: DataFrame, seeds: DataFrame, how: Propagation) -> DataFrame:
    """host, score: personalised PageRank along ``edges`` (src, dst, weight) from ``seeds`` (host), a mass of one each."""
    total = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    shares = common.checkpointed(edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    start = common.checkpointed(seeds.select("host", F.lit(1 - how.damping).alias("score")))
    score = start
    step = lambda score: score.join(shares, score["host"] == shares["src"]).groupBy(F.col("dst").alias("host")).agg((F.lit(how.damping) * F.sum(F.col("score") * F.col("share"))).alias("score"))
    return rounds(start, lambda score: step(score).union(start).groupBy("host").agg(F.sum("score").alias("score")), how)


def leads(edges: DataFrame, seeds: DataFrame, how: Propagation) -> DataFrame:
    """host, score: the chance that a walk from the host along ``edges`` (src, dst, weight), damped at each step, meets one of ``seeds`` (host)."""
    total = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    open_ends = edges.join(total, "src").join(seeds.select(F.col("host").alias("src")), "src", "left_anti")
    shares = common.checkpointed(open_ends.select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    start = common.checkpointed(seeds.select("host", F.lit(1.0).alias("score")))
    step = lambda score: score.join(shares, score["host"] == shares["dst"]).groupBy(F.col("src").alias("host")).agg((F.lit(how.damping) * F.sum(F.col("score") * F.col("share"))).alias("score"))
    return rounds(start, lambda score: step(score).union(start), how)


def rounds(start: DataFrame, step: Callable[[DataFrame], DataFrame], how: Propagation) -> DataFrame:
    """host, score after the steps that it takes until scores stand still."""
    score = start
    for _ in range(how.rounds):
        new = common.checkpointed(step(score))
        change = new.join(score.withColumnRenamed("score", "was"), "host", "left").agg(F.max(F.abs(F.col("score") - F.coalesce("was", F.lit(0.0))))).first()[0]
        score = new
        if (change or 0.0) <= how.still:
            break
    return score


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...], how: Propagation = Propagation(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, host, path, rule, verdict of each row, with the host's trust and distrust."""
    kinds = {rule: kind for kind, rule in rules}
    judged = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    allowed = F.col("rule").isin([r for r, k in kinds.items() if k == "allow"])
    by_rule = F.when(allowed, "allow").when(F.col("rule").isNotNull(), "block")

    hosts = common.checkpointed(judged.filter("host <> ''").select("host").distinct())
    whole = tuple((kind, rule) for kind, rule in rules if rule.partition("/")[2] == "")
    by_host = rule_of(F.col("host"), F.lit("/"), whole)
    named = F.col("host").rlike(rf"(^|[.-])({'|'.join(how.words)})([.-]|$)")
    bad = named | F.coalesce(by_host.isin([r for k, r in whole if k == "block"]), F.lit(False))
    good = ~bad & F.coalesce(by_host.isin([r for k, r in whole if k == "allow"]), F.lit(False))
    edges = common.checkpointed(link_edges(pages, url_col, html_col))
    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    known = common.checkpointed(hosts.union(edges.select("src")).union(edges.select("dst")).distinct())
    trusted, unwanted = known.filter(good), known.filter(bad)
    found = {"trust": walk(edges, trusted, how), "distrust": walk(against, unwanted, how), "led": leads(edges, unwanted, how), "backed": leads(against, trusted, how)}

    scores = hosts
    for name, score in found.items():
        scores = scores.join(score.withColumnRenamed("score", name), "host", "left")
    # written out, so the join below has plain exchanges on both sides and a host with most pages can be split
    scores = common.checkpointed(scores.select("host", *(F.coalesce(x, F.lit(0.0)).alias(x) for x in found)))
    rows = judged.join(scores, "host", "left").withColumns({x: F.coalesce(x, F.lit(0.0)) for x in found})
    blocked = (F.col("led") >= how.led_share) & (F.col("led") > how.balance * F.col("backed"))
    return rows.select(id_col, "host", "path", "rule", F.coalesce(by_rule, F.when(blocked, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")


def op5_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge_urls(common.table(spark, sf_dir, "pages"), RULES)
