"""URL filters: rules by host and path, and link-graph propagation for hosts that no rule names.

Trust starts from hosts with allowed pages and follows links (personalised PageRank); distrust starts from hosts
with blocked pages and follows links backwards, to those who link to them. Both are followed until they have converged. What reaches hosts without links
onwards goes back to the seeds, so that either kind sums to 1. A host's share of distrust in both is held against a threshold.
Scores, edges and pages stay in Spark; the edges of a pair of hosts are one row, so that a hot host is small before it is joined, and a host's edges
are spread over many tasks where they meet its score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Workspace, attached, lower_ascii, staged

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: STEPS is of the SQL alone, which stops there; propagated() goes on until it has converged.
DAMPING, STEPS, CUT_EVERY = 0.85, 40, 4
#: Converged: in CUT_EVERY steps no host's score grew by more than this share of itself, and none was reached anew.
TOLERANCE = 1e-6
#: Distrust / (trust + distrust) of a host from which on it is blocked.
THRESHOLD = 0.5
#: What holds no links, and the links of a elements that name a host; one without a scheme has its page's.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)"
HREF = r"""(?i)<a\s(?:[^<>]*?[\s"'])?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none does. A rule list is code, not data."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at = rule.find("/") if "/" in rule else len(rule)
        own, start = rule[:at], rule[at:]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts in the pages' html outside of comments and scripts, counted per pair."""
    shown = F.regexp_replace("html", HIDDEN, " ")
    to = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(shown, F.lit(HREF), F.lit(1))).alias("href"))
    pairs = to.select("src", host_of(F.concat(F.lit(":"), F.col("href"))).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagated(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust), converged, each summing to 1 or 0. ``seeds``: host, trust, distrust, each summing to 1 or 0; ``edges``: src, dst, n.

    Both run at once, trust on the edges and distrust on the reversed ones. Scores start low and only grow, at a rate that falls by ``damping`` a step,
    so a host's growth relative to its score tells how far it has come, however small the score. A host without links onwards sends nothing; that its score goes back to
    the seeds only raises all scores of a kind alike, so it's done once, at the end.
    """
    with Workspace(seeds.sparkSession, "propagation") as work:
        both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
        both = work.staged(both, "edges")
        out = both.groupBy("kind", "src").agg(F.sum("n").alias("total"))
        start = work.staged(seeds.select("host", F.expr("stack(2, 'trust', trust, 'distrust', distrust) as (kind, score)")).where("score > 0"), "seeds")
        scores = start
        if not both.isEmpty():
            weighted = work.staged(attached(both, out, ["kind", "src"], "dst").select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("share")), "weighted")
            again = scores = start.withColumn("score", F.col("score") * (1 - damping))
            grown = 1.0
            while grown > tolerance:
                before = scores.select("kind", "host", F.col("score").alias("old"))
                for _ in range(CUT_EVERY):
                    sent = attached(weighted, scores.withColumnRenamed("host", "src"), ["kind", "src"], "dst").select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
                    scores = sent.unionByName(again.select("kind", "host", "score")).groupBy("kind", "host").agg(F.sum("score").alias("score"))
                scores = work.staged(scores, "scores")
                growth = (F.col("score") - F.coalesce(F.col("old"), F.lit(0.0))) / F.col("score")
                grown = scores.join(before, ["kind", "host"], "left").agg(F.max(growth)).first()[0] or 0.0
        totals = {r["kind"]: r["score"] for r in scores.groupBy("kind").agg(F.sum("score").alias("score")).collect()}
        kind = lambda k: F.sum(F.when(F.col("kind") == k, F.col("score") / totals.get(k, 1.0)).otherwise(0.0)).alias(k)
        return staged(scores.groupBy("host").agg(kind("trust"), kind("distrust")), "host-scores")


def filtered(pages: DataFrame, rules: list[tuple[str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, one row per row of ``pages``.

    A page that a rule fits has its verdict. Else its host's share of distrust decides; a host that neither kind of score reaches is allowed, so
    is a page without host. Null urls have empty host and path; null html has no links, html of any length is searched whole. Ties are blocked. Repeated rows are
    judged alike, and their links count each. Other columns are left out, whatever their names; an empty table gives no rows.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("hit", matched(F.col("host"), F.col("path"), rules))
    share = lambda v: F.avg(F.when(F.col("hit.verdict") == v, 1.0).otherwise(0.0))
    seeds = judged.where("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")).where("allowed + blocked > 0")
    sums = seeds.agg(F.sum("allowed"), F.sum("blocked")).first()
    norm = lambda c, total: (F.col(c) / total if total else F.lit(0.0))
    known = propagated(seeds.select("host", norm("allowed", sums[0]).alias("trust"), norm("blocked", sums[1]).alias("distrust")), links(pages))
    hosts = known.select(F.col("host").alias("of"), (F.col("distrust") >= threshold * (F.col("trust") + F.col("distrust"))).alias("bad"))
    joined = judged.join(hosts, F.col("host") == F.col("of"), "left")
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("bad"), "block"), F.lit("allow"))
    return joined.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"))
