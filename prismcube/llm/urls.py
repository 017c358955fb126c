"""URL filters: rules first, then link-graph propagation over hosts.

A rule (action, host, path) fits a url whose host is the rule's or below it and whose path starts with the rule's; the
longest rule wins (of equally long ones the first). Hosts whose pages rules allow are trusted seeds, hosts whose pages
rules block are distrusted seeds, each by the share of its pages. Trust flows along links (personalised PageRank from
the trusted seeds), distrust flows against them (to those who link to distrusted hosts). Edges are the links between
different hosts, weighted by the number of pages, and a host's tie to its parent domain where that is a host, too. A
page without a rule is blocked if its host's distrust exceeds the host's trust by THRESHOLD: as much as a host has of
whose pages rules block half.

Defined results: null urls and urls without "://" have empty host and path, fit no rule and are allowed; hosts without
links or seeds are allowed; null or empty html has no links; repeated rows are judged alike and count as pages each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismcube.llm.common import stored

#: Rounds at least, and rounds between looks at what is left.
DAMPING, ROUNDS, EACH = 0.85, 12, 4
#: What any host's score may lack at most when the rounds end.
TOLERANCE = 1e-10
THRESHOLD = (1 - DAMPING) / 2
#: Scores are compared after rounding, so that the order of sums doesn't matter.
DIGITS = 9


class Rule(NamedTuple):
    action: str
    host: str
    path: str

    @classmethod
    def of(cls, action: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(action, host, slash + path)


def lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def parsed(pages: DataFrame, url: str) -> DataFrame:
    """Adds host and path."""
    u = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    rest = F.regexp_extract(u, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": lower(host), "path": path})


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The winning rule as struct(action, rule), or null; one expression, so no rows move."""
    best = F.lit(None).cast("struct<action:string,rule:string>")
    for r in sorted(reversed(rules), key=lambda r: len(r.host) + len(r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        best = F.when(fits, F.struct(F.lit(r.action).alias("action"), F.lit(r.host + r.path).alias("rule"))).otherwise(best)
    return best


def host_edges(pages: DataFrame, html: str) -> DataFrame:
    """src, dst, n: pages of one host that link to another, and ties to parent domains. pages: host and html."""
    links = F.regexp_extract_all(F.coalesce(F.col(f"`{html}`"), F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1))
    to = F.transform(links, lambda x: lower(F.regexp_extract(x, r"^[^/]*//([^/?#]*)", 1)))
    out = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.array_distinct(to)).alias("dst"))
    linked = out.where("dst <> '' and dst <> src").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("n"))
    hosts = pages.where("host <> ''").select("host").union(linked.select("dst")).distinct()
    child = hosts.select("host", F.expr("substring(host, instr(host, '.') + 1)").alias("parent")).where("instr(host, '.') > 0 and instr(parent, '.') > 0")
    tie = child.join(hosts.select(F.col("host").alias("parent")), "parent")
    ties = tie.select(F.col("host").alias("src"), F.col("parent").alias("dst")).union(tie.select("parent", "host")).withColumn("n", F.lit(1.0))
    return linked.union(ties).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """host, trust, distrust, each within TOLERANCE. seeds: host, good, bad; edges: src, dst, n.

    A round moves only what the last one added. Shares that leave a host sum to 1 at most, so all that later rounds can
    add anywhere is DAMPING / (1 - DAMPING) of the sum that the last one added.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("into"))
    each = edges.join(out, "src").join(into, "dst")
    forward = each.select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("out")).alias("t"), F.lit(0.0).alias("d"))
    back = each.select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("n") / F.col("into")).alias("d"))
    flows = stored(forward.union(back).groupBy("host", "to").agg(F.sum("t").alias("t"), F.sum("d").alias("d")), "flows")
    first = [((1 - DAMPING) * F.col("good")).alias("trust"), ((1 - DAMPING) * F.col("bad")).alias("distrust")]
    now = stored(seeds.select("host", *first).select("host", "trust", "distrust", F.col("trust").alias("t1"), F.col("distrust").alias("d1")), "seeds")
    rounds, none = 0, F.lit(0.0)
    while True:
        moved = flows.join(now, "host").select(F.col("to").alias("host"), none.alias("trust"), none.alias("distrust"), (DAMPING * F.col("t") * F.col("t1")).alias("t1"), (DAMPING * F.col("d") * F.col("d1")).alias("d1"))
        held = now.select("host", "trust", "distrust", none.alias("t1"), none.alias("d1"))
        now = held.union(moved).groupBy("host").agg((F.sum("trust") + F.sum("t1")).alias("trust"), (F.sum("distrust") + F.sum("d1")).alias("distrust"), F.sum("t1").alias("t1"), F.sum("d1").alias("d1"))
        rounds += 1
        if rounds % EACH == 0:
            now = stored(now, "scores")
            left = now.agg(F.greatest(F.sum("t1"), F.sum("d1"))).first()[0] or 0.0
            if rounds >= ROUNDS and left * DAMPING / (1 - DAMPING) <= TOLERANCE:
                return now.select("host", "trust", "distrust")


def judge(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict of every row; see the module's text."""
    seen = parsed(pages.select(F.col(f"`{key}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html")), "url")
    seen = seen.withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    share = lambda action: F.avg(F.when(F.col("found.action") == action, 1.0).otherwise(0.0))
    seeds = seen.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"))
    score = propagate(seeds, stored(host_edges(seen.select("host", "html"), "html"), "edges"))
    bad = score.where(F.round(F.col("distrust") - F.col("trust") - THRESHOLD, DIGITS) >= 0).select("host", F.lit("block").alias("own"))
    out = seen.select("page_id", "host", "path", "found").join(bad, "host", "left")
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.action", "own", F.lit("allow")).alias("verdict"))
