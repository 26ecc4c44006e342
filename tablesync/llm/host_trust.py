"""URL verdicts from rules and, where no rule fits, from trust and distrust along host links.

Hosts are nodes; the links in their pages to other hosts, counted per pair of hosts, are edges.
Trust is a personalised PageRank that starts from hosts with allowed pages and follows the
links; distrust starts from hosts with blocked pages and goes against them: who links to
blocked hosts is suspect. Both run together as joins and map-side combined sums over the host
graph, one written table per round. A host with more distrust than trust is blocked, any
other allowed; so are hosts that neither reaches.

The rounds go on until the scores have settled and no host was reached for the first time: about 90
rounds at a damping of 0.85, more only in graphs with longer shortest paths. Scores are
compared by their ratio, so that the size of the graph does not matter; a path of some 4,000 links
leaves too little for a double.

* NULL urls and urls without ``://``: host and path are empty, no rule fits, the verdict is that of
  the empty host, which neither reaches: allow. NULL html has no links.
* Repeated rows each get their verdict and count as often in their host's seeds.
* An empty table gives an empty result. Only id, url and html are read; no column can clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.llm.work import stored

DAMPING = 0.85
#: Summed change of all scores, of 2 in all, at which the rounds end, once they reach no further host.
SETTLED = 1e-6
#: Share by which distrust has to exceed trust; sums in another order agree far within it.
MARGIN = 1e-9

LINK = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]++)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    """What follows the first ``://``; NULL without one."""
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    host = F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits; NULL if none does."""
    choices = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in sorted(rules, key=lambda r: -len(r.text))
    ]
    return F.coalesce(*choices)


def links(pages: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``weight`` between different hosts, from rows of ``host`` and ``html``."""
    found = F.filter(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda h: h.contains("//"))
    # A link that starts with // keeps its page's scheme.
    whole = F.transform(found, lambda h: F.when(h.startswith("//"), F.concat(F.lit("http:"), h)).otherwise(h))
    hosts = F.filter(F.array_distinct(F.transform(whole, host_of)), lambda h: h != "")
    edges = pages.filter((F.col("host") != "") & F.col("html").contains("//")).select(
        F.col("host").alias("src"), F.explode(hosts).alias("dst")
    )
    return edges.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """``host``, ``trust``, ``distrust`` from ``host, allowed, blocked`` and ``src, dst, weight``."""
    both = edges.select(F.lit(True).alias("trusts"), "src", "dst", "weight").union(
        edges.select(F.lit(False), F.col("dst"), F.col("src"), F.col("weight"))
    )
    out = stored(both.groupBy("trusts", "src").agg(F.sum("weight").alias("total")), "links_out")
    both = both.join(out, ["trusts", "src"])
    steps = stored(both.select("trusts", "src", "dst", (F.col("weight") / F.col("total")).alias("share")), "steps")

    kinds = F.explode(
        F.array(
            F.struct(F.lit(True).alias("trusts"), F.col("allowed").alias("mass")),
            F.struct(F.lit(False).alias("trusts"), F.col("blocked").alias("mass")),
        )
    ).alias("kind")
    start = seeds.select("host", kinds).select("host", "kind.*").filter("mass > 0")
    sums = {r["trusts"]: r["mass"] for r in start.groupBy("trusts").agg(F.sum("mass").alias("mass")).collect()}

    def of_kind(values: dict) -> Column:
        return F.when(F.col("trusts"), F.lit(float(values.get(True, 0)))).otherwise(F.lit(float(values.get(False, 0))))

    start = stored(start.select("trusts", "host", (F.col("mass") / of_kind(sums)).alias("start")), "start")
    now = start.withColumnRenamed("start", "score")
    reached, linked = 0, bool(steps.head(1))
    while linked:
        moved = now.join(steps, (now["trusts"] == steps["trusts"]) & (now["host"] == steps["src"]))
        moved = moved.select(now["trusts"], "dst", (DAMPING * F.col("score") * F.col("share")).alias("moved"))
        moved = stored(moved.groupBy("trusts", F.col("dst").alias("host")).agg(F.sum("moved").alias("moved")), "moved")
        kept = {r["trusts"]: 1 - r["moved"] for r in moved.groupBy("trusts").agg(F.sum("moved").alias("moved")).collect()}
        back = {kind: kept.get(kind, 1.0) for kind in sums}
        # What no link carries on goes back to the seeds.
        parts = moved.select("trusts", "host", F.col("moved").alias("part"), F.lit(0.0).alias("old"))
        parts = parts.union(start.select("trusts", "host", F.col("start") * of_kind(back), F.lit(0.0)))
        parts = parts.union(now.select("trusts", "host", F.lit(0.0), F.col("score")))
        next_ = parts.groupBy("trusts", "host").agg(F.sum("part").alias("score"), F.sum("old").alias("old"))
        next_ = stored(next_, "scores")
        last = next_.agg(F.sum(F.abs(F.col("score") - F.col("old"))).alias("change"), F.count_if(F.col("score") > 0).alias("reached")).first()
        now = next_.drop("old")
        linked = (last["change"] or 0.0) >= SETTLED or last["reached"] > reached
        reached = last["reached"]
    trust = F.sum(F.when(F.col("trusts"), F.col("score")).otherwise(0.0)).alias("trust")
    distrust = F.sum(F.when(F.col("trusts"), 0.0).otherwise(F.col("score"))).alias("distrust")
    return now.groupBy("host").agg(trust, distrust)


def judge(
    pages: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` for every row."""
    own = pages.select(
        F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("html")
    )
    ruled = own.withColumn("fit", fitting(rules, F.col("host"), F.col("path")))
    verdict = F.col("fit.verdict")
    seeds = ruled.groupBy("host").agg(
        F.avg(F.when(verdict == "allow", 1.0).otherwise(0.0)).alias("allowed"),
        F.avg(F.when(verdict == "block", 1.0).otherwise(0.0)).alias("blocked"),
    )
    scores = propagate(stored(seeds, "seeds"), stored(links(own), "links"))
    worse = F.col("distrust") > F.col("trust") * (1 + MARGIN)
    hosts = stored(scores.select("host", F.when(worse, "block").otherwise("allow").alias("by_host")), "hosts")
    final = F.coalesce("fit.verdict", "by_host", F.lit("allow")).alias("verdict")
    return ruled.drop("html").join(hosts, "host", "left").select("page_id", "host", "path", F.col("fit.rule").alias("rule"), final)
