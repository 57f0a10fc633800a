"""URL verdicts by rules and by trust over the host graph (operator 6), in DataFrame functions only.

A rule is ``host/path``: it fits its host and all subdomains of it where the
URL's path starts with the rule's; the longest rule wins.  Pages that a rule
allows give their host trust, pages that a rule blocks give it distrust.  Trust
follows links from host to host, distrust follows them backwards, both as
personalised PageRank of ROUNDS rounds, whatever the size of the table: hosts up
to that many links away are reached, and at most ``DAMPING ** (ROUNDS + 1)`` of
the seeds' sum, under 5e-5, is left unspread.  A page without a rule is blocked where its host's
distrust exceeds ``ratio`` times its trust, and allowed otherwise.

A URL that is null or has no ``://`` has an empty host and path; no rule fits it
and it is allowed.  Pages may repeat.  An empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from newsgrid.llm.common import materialise

DAMPING = 0.85
ROUNDS = 60
FOLD_ROUNDS = 10


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty where there is no scheme."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(raw) + 1), "^[^?#]*", 0)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), path


def fits(host: Column, path: Column, rule: str) -> Column:
    name, _, start = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)


def rule_of(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """The longest rule that fits, else null."""
    longest = sorted(rules, key=lambda r: (-len(r), r))
    return F.coalesce(*[F.when(fits(host, path, r), F.lit(r)) for r in longest],
                      F.lit(None).cast("string"))


def link_hosts(html: Column) -> Column:
    """Hosts that a page's absolute links name, as an array."""
    links = F.regexp_extract_all(
        html, F.lit(r"""(?i)\shref\s*=\s*["']?\s*(?:https?:)?//([^\s"'<>/?#]++)"""), 1)
    return F.transform(links, lambda x: F.translate(x, string.ascii_uppercase,
                                                    string.ascii_lowercase))


def host_edges(pages: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``n``: links between different hosts, counted before any shuffle."""
    return (pages.filter(F.col("host") != "")
            .select(F.col("host").alias("src"), F.explode(link_hosts(F.col("html"))).alias("dst"))
            .filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n")))


def propagate(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Personalised PageRank of ``seeds`` (``host``, ``trust``, ``distrust``).

    Columns as in ``seeds``.  Trust is shared out over links from a host,
    distrust over links to it.  What a host without links holds goes no further.
    """
    def shares(of: str, to: str, kind: str) -> DataFrame:
        degree = edges.groupBy(of).agg(F.sum("n").alias("all"))
        return edges.join(degree, of).select(
            F.lit(kind).alias("kind"), F.col(of).alias("host"), F.col(to).alias("next"),
            (F.col("n") / F.col("all")).alias("share"))

    spread = materialise(shares("src", "dst", "trust").unionByName(shares("dst", "src", "distrust")),
                         "host-shares")
    start = seeds.selectExpr("host", "stack(2, 'trust', trust, 'distrust', distrust) AS (kind, seed)")
    start = materialise(start.filter("seed > 0").withColumn("seed", F.col("seed") * (1 - DAMPING)),
                        "host-seeds")
    rank = start.select("kind", "host", F.col("seed").alias("score"))
    step = rank                                   # what arrived in the last round
    for rounds in range(1, ROUNDS + 1):
        step = materialise(
            step.join(spread, ["kind", "host"])
            .groupBy("kind", F.col("next").alias("host"))
            .agg(F.sum(F.col("score") * F.col("share") * DAMPING).alias("score")), "host-step")
        if step.isEmpty():                        # nothing moves any more
            break
        rank = rank.unionByName(step)
        if rounds % FOLD_ROUNDS == 0:
            rank = materialise(rank.groupBy("kind", "host").agg(F.sum("score").alias("score")),
                               "host-rank")
    return rank.groupBy("host").agg(
        *[F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k)
          for k in ("trust", "distrust")])


def judge_urls(pages: DataFrame, allow: Sequence[str], block: Sequence[str], ratio: float = 2.0,
               url: str = "url", html: str = "html", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """``keep`` with ``host``, ``path``, ``rule`` and ``verdict`` of every page."""
    outputs = ("host", "path", "rule", "verdict")
    keep = [c for c in keep if c not in outputs]
    host, path = split_url(pages[url])
    found = pages.select(*keep, host.alias("host"), path.alias("path"), pages[html].alias("html"))
    found = found.withColumn("rule", rule_of(F.col("host"), F.col("path"), [*allow, *block]))
    found = found.withColumn("verdict", F.when(F.col("rule").isin(*block), "block")
                             .when(F.col("rule").isNotNull(), "allow"))
    seeds = (found.filter("rule IS NOT NULL").groupBy("host")
             .agg(*[F.count_if(F.col("verdict") == v).cast("double").alias(k)
                    for k, v in (("trust", "allow"), ("distrust", "block"))]))
    scores = propagate(materialise(host_edges(found), "host-edges"), seeds)
    blocked = scores.filter(F.col("distrust") > ratio * F.col("trust")).select(
        "host", F.lit(True).alias("_blocked"))
    plain = found.drop("html")
    # Only pages without a rule need their host's score.
    judged = plain.filter("rule IS NULL").join(blocked, "host", "left").select(
        *keep, "host", "path", "rule",
        F.when(F.col("_blocked"), "block").otherwise("allow").alias("verdict"))
    return plain.filter("rule IS NOT NULL").select(*keep, "host", "path", "rule", "verdict") \
        .unionByName(judged)
