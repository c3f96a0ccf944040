"""A whole audit over captures: routes with depths and options, every rule family, the report tables, and comparisons of saved reports."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.dates import iso_now
from quarry.functions.html import SIGNALS
from quarry.functions.urls import normalize_url, origin
from quarry.operators import crawl
from quarry.operators.shared import cut
from quarry.plans import compare, contracts as redirects, post, rules
from quarry.sinks.redaction import redacted
from quarry.sources import saved_reports
from quarry.sources.captures import CONTENT, HOP, extract

POLICIES = compare.POLICIES
#: Columns an inventory may add to captures, with what holds when it does not.
OPTIONAL = {
    "in_sitemap": ("boolean", False), "in_build": ("boolean", False), "exempt": ("boolean", False), "render_mode": ("string", None),
    "rendered": (f"struct<completion:string,status:int,signals:{SIGNALS},content:{CONTENT}>", None),
}


@dataclass
class Audit:
    routes: DataFrame
    agents: DataFrame
    edges: DataFrame
    findings: DataFrame
    checks: DataFrame | None
    run: dict

    def summary(self) -> dict:
        return post.summarize(self.routes, self.findings).first().asDict()


def from_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) as complete captures of the default agent; of rows with one address the least page_id, rows without address go."""
    first = pages.where("url is not null").groupBy("url").agg(F.min("page_id").alias("page_id"))
    c = extract(pages.select("page_id", "url", "html").join(first, ["url", "page_id"], "left_semi").dropDuplicates(["url"]))
    return c.selectExpr(
        "url", "'default' AS agent", "0 AS agent_ord", "'complete' AS completion", "200 AS status", "url AS final_url", "'text/html' AS content_type",
        f"CAST(array() AS array<{HOP}>) AS redirects", "signals", "content", "CAST(NULL AS DOUBLE) AS duration_ms", "CAST(NULL AS STRING) AS error",
    )


def links(primary: DataFrame) -> DataFrame:
    """(src, dst): links within the site of complete successful pages, by normalized address."""
    open_pages = primary.where("completion = 'complete' and status between 200 and 299")
    e = open_pages.select(F.col("url").alias("src"), F.col("final_url").alias("base"), F.explode("signals.links").alias("l"))
    e = e.select("src", normalize_url(F.col("l.resolved_url"), F.col("base")).alias("dst")).where("dst is not null")
    return e.where((origin(F.col("src")) == origin(F.col("dst"))) & ~F.col("dst").rlike(r"^https?://[^/]*/cdn-cgi/l/email-protection")).distinct()


def routes_of(captures: DataFrame, edges: DataFrame, seeds: list[str], options: dict, sitemap: DataFrame | None = None, exempt: DataFrame | None = None) -> DataFrame:
    """Enriched primary captures in route order: depth (unreachable last), then address. The order comes from a range
    partitioned sort, so numbers have gaps and no task sees all rows."""
    r = captures.where("agent_ord = 0")
    for name, (kind, value) in OPTIONAL.items():
        if name not in r.columns:
            r = r.withColumn(name, F.lit(value).cast(kind))
    for name, listed in (("in_sitemap", sitemap), ("exempt", exempt)):
        if listed is not None:
            hit = listed.select("url").distinct().withColumn("__hit", F.lit(True))
            r = r.join(hit, "url", "left").withColumn(name, F.coalesce("__hit", name)).drop("__hit")
    start = captures.sparkSession.createDataFrame([(s,) for s in seeds], "url string")
    r = r.drop("depth", "ord").join(crawl.depths(r.select("url"), edges, start), "url")
    placed = r.orderBy(F.when(F.col("depth") < 0, F.lit(2**31 - 1)).otherwise(F.col("depth")), "url").withColumn("ord", F.monotonically_increasing_id())
    # ord stands before the wide columns: behind them, Spark 4.1 drops it from under the rules' generators.
    placed = placed.select("url", "ord", *[k for k in placed.columns if k not in ("url", "ord")])
    return cut(rules.enrich(cut(placed), options))


def run(captures: DataFrame, base_url: str, options: dict | None = None, edges: DataFrame | None = None, sitemap: DataFrame | None = None, contracts: DataFrame | None = None, unmatched: DataFrame | None = None, runs: DataFrame | None = None, seeds: list[str] | None = None, truncated: bool = False, config: dict | None = None) -> Audit:
    """captures(`captures.CAPTURE`), one row per address and agent -> routes, findings and contract checks.

    edges(src, dst) default to the captured links; contracts as `contracts.CONTRACT`; runs as `rules.inventory_rules` takes it.
    An empty table of captures gives an audit without findings.
    """
    options = options or {}
    edges = cut(links(captures.where("agent_ord = 0")) if edges is None else edges.select("src", "dst").distinct())
    exempt = None if contracts is None else contracts.select(F.col("from").alias("url"))
    routes = routes_of(captures, edges, seeds or [base_url], options, sitemap, exempt)
    agents = captures.where("agent_ord > 0")
    parts = [rules.page_rules(routes), rules.agent_rules(routes, agents), rules.time_rules(routes, options), rules.graph_rules(routes, edges, base_url, truncated), rules.group_rules(routes), rules.soft_404_rules(routes)]
    checks = None
    if runs is not None:
        parts.append(rules.inventory_rules(runs))
    if contracts is not None:
        found, checks = redirects.audit(contracts, routes, unmatched)
        parts.append(found)
    findings = cut(post.finish(reduce(DataFrame.union, parts), options))
    # Agents are few; in their order, as the first one leads.
    names = [r.agent for r in captures.groupBy("agent").agg(F.min("agent_ord").alias("at")).orderBy("at", "agent").collect()]
    settings = compare.policies({"base_url": base_url, "audit": options, **(config or {})}, names)
    return Audit(routes, agents, edges, findings, checks, settings | {"truncated": truncated, "generated_at": iso_now()})


def save(audit: Audit, path: str, secrets: tuple[str, ...] = ()) -> None:
    """The report as tables under path: run, findings, routes (the compared fields), agents; redacted as written."""
    spark = audit.findings.sparkSession
    spark.createDataFrame([(json.dumps(audit.run, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/run")
    redacted(audit.findings, secrets).write.parquet(f"{path}/findings")
    redacted(compare.profile(audit.routes), secrets).write.parquet(f"{path}/routes")
    redacted(compare.profile(rules.enrich_captures(audit.agents)), secrets).write.parquet(f"{path}/agents")


def load(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame, DataFrame]:
    """(run, findings, routes, agents) of a saved report: a folder of `save`, or a JSON report."""
    if path.endswith(".json"):
        run, findings, captures = saved_reports.read(spark, path)
        shots = rules.enrich_captures(captures)
        return run, findings, compare.profile(shots.where("agent_ord = 0")), compare.profile(shots.where("agent_ord > 0"))
    meta = json.loads(spark.read.text(f"{path}/run").first().value)
    return meta, *(spark.read.parquet(f"{path}/{t}") for t in ("findings", "routes", "agents"))


def diff(spark: SparkSession, before: str, after: str) -> DataFrame:
    """All changes of routes, further agents and findings between two saved reports."""
    (_, bf, br, ba), (_, af, ar, aa) = load(spark, before), load(spark, after)
    common = br.select("url").join(ar.select("url"), "url")
    agents = compare.agent_changes(ba.join(common, "url", "left_semi"), aa.join(common, "url", "left_semi"))
    return cut(compare.route_changes(br, ar).union(agents).union(compare.finding_changes(bf, af)))
