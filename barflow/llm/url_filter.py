"""URL verdicts: rules by host and path, and link-graph propagation for what no rule fits.

Hosts are nodes. Trust is a personalised PageRank whose restarts go to hosts with pages
that a rule allows; distrust is one on the reversed edges, from hosts with pages that a
rule blocks, so it reaches those who link to them. Both run as one iteration over stacked
edges, aggregated to host pairs first. A host is blocked where distrust is over a given
share of both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

#: Fixed values: (rule, verdict).
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: Rounds go on until ``CUT_EVERY`` of them move at most ``TOLERANCE`` of a side's weight.
DAMPING, TOLERANCE, CUT_EVERY, BLOCK_SHARE = 0.85, 1e-3, 5, 0.75
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next slash, question mark, hash or end, with A to Z lower-cased."""
    return F.translate(F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"(?s)^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What stands between the host and the next question mark, hash or end."""
    return F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. ``rules`` is a short list that is part of the plan."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        site, slash, rest = rule.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html", domain_edges: bool = True) -> DataFrame:
    """(src, dst, weight, links) between different hosts; ``links`` counts the hyperlinks from one's pages to the other.

    With ``domain_edges``, a host and its parent domain (of three labels or more) count
    as linked both ways with weight 1, so what is known of a site reaches its subdomains;
    such an edge alone has no ``links``.
    """
    found = F.regexp_extract_all(
        F.coalesce(html_col, F.lit("")), F.lit(r"""(?is)\b(?:href|src)\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""), F.lit(1)
    )
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.array_distinct(found)).alias("link"))
    links = links.select("src", host_of(F.concat(F.when(F.col("link").startswith("//"), "http:").otherwise(""), "link")).alias("dst"))
    edges = links.filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    edges = edges.withColumn("links", F.col("weight").cast("long"))
    if not domain_edges:
        return edges
    hosts = pages.select(host_of(F.col(url_col)).alias("host")).distinct()
    up = hosts.select("host", F.regexp_extract("host", r"^[^.]+\.((?:[^.]+\.){2,}[^.]+)$", 1).alias("parent")).filter("parent <> ''")
    both = up.select(F.explode(F.array(
        F.struct("host", "parent"), F.struct(F.col("parent").alias("host"), F.col("host").alias("parent"))
    )).alias("e"))
    both = both.select(F.col("e.host").alias("src"), F.col("e.parent").alias("dst"), F.lit(1.0).alias("weight"), F.lit(0).cast("long").alias("links"))
    return edges.union(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.sum("links").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) after personalised PageRank from seeds (host, trusted, blocked).

    Seed weights are shares of all judged pages, so the two scores of a host compare. What
    a host without out-edges would pass on goes back to the seeds of its side. At the
    fixpoint that is the same as dropping it and scaling the side to its seeds' weight, so
    it is done once, at the end; leaves then do not decide how trust and distrust compare.
    Each ``CUT_EVERY`` rounds at least halve what is left to move, so the rounds end.
    """
    flows = edges.select(F.lit("t").alias("kind"), "src", "dst", "weight").union(
        edges.select(F.lit("d"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    out = flows.groupBy("kind", "src").agg(F.sum("weight").alias("out"))
    flows = cut(flows.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("out")).alias("share")))
    stacked = seeds.select(
        F.explode(F.array(
            F.struct(F.lit("t").alias("kind"), "host", F.col("trusted").cast("double").alias("seed")),
            F.struct(F.lit("d").alias("kind"), "host", F.col("blocked").cast("double").alias("seed")),
        )).alias("s")
    ).select("s.*").filter("seed > 0")
    given = {r["kind"]: r["seed"] for r in stacked.groupBy("kind").agg(F.sum("seed").alias("seed")).collect()}
    total = float(sum(given.values()) or 1)
    restart = cut(stacked.select("kind", "host", (F.col("seed") / F.lit(total)).alias("seed")))
    weight = {kind: n / total for kind, n in given.items()}
    score, held, moving = restart.select("kind", "host", F.col("seed").alias("score")), None, True
    while moving:
        start = score
        for _ in range(CUT_EVERY):
            passed = score.withColumnRenamed("host", "src").join(flows, ["kind", "src"]).select(
                "kind", F.col("dst").alias("host"), (F.lit(DAMPING) * F.col("score") * F.col("share")).alias("score")
            )
            again = restart.select("kind", "host", (F.lit(1 - DAMPING) * F.col("seed")).alias("score"))
            score = passed.union(again).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        score = cut(score)
        change = score.withColumn("was", F.lit(0.0)).union(start.select("kind", "host", F.lit(0.0), "score")).groupBy("kind", "host").agg(
            F.sum("score").alias("score"), F.sum(F.col("score") - F.col("was")).alias("change")
        )
        sides = change.groupBy("kind").agg(F.sum("score").alias("score"), F.sum(F.abs("change")).alias("change")).collect()
        moving = any(r["change"] > tolerance * weight[r["kind"]] for r in sides)
        if held is not None:
            discard(held)
        held = score
    discard(flows, restart)
    scale = {r["kind"]: weight[r["kind"]] / r["score"] for r in sides}
    side = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score") * scale.get(kind, 1.0)).otherwise(0.0))
    return score.groupBy("host").agg(side("t").alias("trust"), side("d").alias("distrust"))


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    block_share: float = BLOCK_SHARE,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """One row per page: id, host, path, the longest rule that fits (else null) and the verdict.

    Without a rule, the host's scores decide; a host that neither trust nor distrust
    reaches is allowed. A null url, or one without ``://``, has an empty host and path and
    is allowed; null html has no links. Repeated pages each get a row and count as often
    as they occur. Extra columns are not read. ``edge_source`` says what the host's scores
    may rest on: links, if a hyperlink joins it with another host, domains, if only its
    parent or a subdomain does, else null.
    """
    url = F.col(url_col)
    parts = pages.select(F.col(id_col).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    parts = cut(parts.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)))
    count = lambda v: F.sum((F.col("_rule.verdict") == v).cast("int"))
    seeds = parts.filter("host <> '' and _rule is not null").groupBy("host").agg(
        count("allow").alias("trusted"), count("block").alias("blocked")
    )
    edges, seeds = cut(host_edges(pages, url_col, html_col)), cut(seeds)
    scores = propagate(edges, seeds)
    ends = cut(edges.select(F.explode(F.array("src", "dst")).alias("host"), "links").groupBy("host").agg(
        F.when(F.max("links") > 0, "links").otherwise("domains").alias("edge_source")
    ))
    share = F.col("distrust") / (F.col("trust") + F.col("distrust"))
    named = cut(scores.select("host", "trust", "distrust", (share > block_share).alias("_blocked")))
    discard(edges, seeds, scores)
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_blocked"), "block"), F.lit("allow"))
    return parts.join(named, "host", "left").join(ends, "host", "left").select(
        F.col("_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"), "edge_source",
    )
