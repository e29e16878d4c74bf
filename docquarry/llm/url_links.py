"""URL filters: rules first, then link-graph propagation from the hosts that the rules trust or block.

Trust is a personalised PageRank that starts from the hosts' share of allowed pages and follows links between hosts;
distrust starts from their share of blocked pages and follows the links backwards, to hosts that link to blocked ones.
Both are power iterations over one edge table (distrust's edges are reversed copies), unscaled: a host's own share
counts whole.  Either way a link weighs its share of the linking host's links: so a host's distrust is what its own links
lead to, however many others link to the same blocked host.  Everything is DataFrame work; links are counted per pair of hosts before they are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import drop_stash, stash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A link with a host of its own: absolute or protocol-relative.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
#: Share of its mass that a host passes on, the distrust from which a host is blocked, the step at which ranks stand still,
#: and what they may still lack then, with some room: the sum of all steps to come is under 0.85 / 0.15 of the last.
DAMPING, THRESHOLD, STEP, SLACK = 0.85, 0.5, 1e-8, 1e-7
#: Rounds of a job.
FOLD = 12


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; '' for null and where there is no ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """Behind the host up to ? # or the end; '' for null and where there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; rules: (`host/path`, allow or block), a short list in the program's hands."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, say in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n): pages of host src with a link to another host dst; null html has no links, pages without a host none either."""
    links = pages.select(url_host(F.col(url)).alias("src"), F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))).alias("to"))
    pairs = links.where("src != ''").select("src", F.explode("to").alias("dst")).select("src", lower_ascii(F.col("dst")).alias("dst"))
    return pairs.where("src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust, distrust) and edges (src, dst, n); hosts without mass are left out.

    A round is one join and one grouping over both kinds.  Each host has, beside its links, a row to itself that carries on what it has, so a
    round reads the ranks once and FOLD rounds are one job; only then ranks are written, and those before them deleted.  Links pass on what moved in
    the round before and nothing else.  It ends when all that moved in a round is at most STEP: the sum over the hosts for trust, each host's own for
    distrust, whose steps shrink by `damping` each round.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    share = (damping * F.col("n") / F.col("total")).alias("share")
    links = edges.join(out, "src").select("src", "dst", share)
    forward, backward = links.select(F.lit(0).alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "share"), links.select(F.lit(1).alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "share")
    both = forward.unionByName(backward)
    ranks = seeds.select("host", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("trust").alias("rank")), F.struct(F.lit(1).alias("kind"), F.col("distrust").alias("rank")))).alias("x"))
    ranks = stash(ranks.select("x.kind", "host", "x.rank", F.col("x.rank").alias("step")).where("rank > 0"), "ranks")
    if not edges.take(1):
        return _by_host(ranks)
    hosts = both.select("kind", "host").unionByName(both.select("kind", F.col("to").alias("host"))).unionByName(ranks.select("kind", "host")).distinct()
    flows = stash(both.unionByName(hosts.select("kind", "host", F.col("host").alias("to"), F.lit(None).cast("double").alias("share"))), "flows")
    own, left = F.col("share").isNull(), 1.0
    while left > STEP:
        before = ranks
        for _ in range(FOLD):
            moved = ranks.join(flows, ["kind", "host"]).where(own | (F.col("step") > 0))
            moved = moved.select("kind", F.col("to").alias("host"), F.when(own, F.col("rank")).otherwise(F.col("step") * F.col("share")).alias("rank"), F.when(own, 0.0).otherwise(F.col("step") * F.col("share")).alias("step"))
            ranks = moved.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("step").alias("step"))
        ranks = stash(ranks, "ranks")
        drop_stash(before)
        row = ranks.agg(F.sum(F.when(F.col("kind") == 0, F.col("step"))), F.max(F.when(F.col("kind") == 1, F.col("step")))).first()
        left = max(x or 0.0 for x in row)
    drop_stash(flows)
    return _by_host(ranks)


def _by_host(ranks: DataFrame) -> DataFrame:
    at = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))
    return ranks.groupBy("host").agg(at(0).alias("trust"), at(1).alias("distrust"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], page_id: str = "page_id", url: str = "url", html: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust), a row per row of pages.

    verdict is the rule's; without a rule, block where the host's distrust is at least the threshold and above its
    trust, both within SLACK, else allow.  Null urls and urls without :// have an empty host and path and are allowed.  Repeated rows and repeated
    ids are judged each for itself; a host's shares count its rows.
    """
    host, path = url_host(F.col(url)), url_path(F.col(url))
    base = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    base = base.select("*", rule.alias("rule"), said.alias("said"))
    share = lambda v: F.avg(F.when(F.col("said") == v, 1.0).otherwise(0.0))
    seeds = base.where("host != ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = propagate(seeds, host_edges(pages, url, html))
    method = F.when((F.col("distrust") >= threshold - SLACK) & (F.col("distrust") > F.col("trust") + SLACK), F.lit("block")).otherwise(F.lit("allow"))
    joined = base.join(scores, "host", "left").na.fill(0.0, ["trust", "distrust"])
    return joined.select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "trust", "distrust")
