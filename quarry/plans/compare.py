"""Two audits compared: routes, agents and findings, and the report of what is new or worse."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.post import rank

FIELDS = ("status", "final_url", "indexability", "canonical", "title", "robots", "render_mode")


def profile(captures: DataFrame) -> DataFrame:
    """The compared fields of enriched captures (render_mode where the routes carry one)."""
    robots = F.array_join(F.array_sort(F.transform("signals.robots", lambda r: F.concat(r["audience"], F.lit(":"), r["value"]))), ", ")
    mode = F.col("render_mode") if "render_mode" in captures.columns else F.lit(None).cast("string")
    keep = [c for c in ("agent", "agent_ord") if c in captures.columns]
    raw = F.get("signals.canonicals", 0)["value"]
    return captures.select("url", *keep, "completion", "status", "final_url", "indexability", F.coalesce("snapshot_canonical", raw).alias("canonical"), F.get("signals.titles", 0)["value"].alias("title"), F.when(F.size("signals.robots") > 0, robots).alias("robots"), mode.alias("render_mode"))


def _status_severity(b: Column, a: Column) -> Column:
    return F.when(a.isNull() | (a >= 400), "error").when(b.isNull() | (b >= 400), "info").otherwise("warning")


def _change(when: Column, kind: str, code: str | Column, severity: Column | str, before: Column | None = None, after: Column | None = None) -> Column:
    text = lambda v: v if isinstance(v, Column) else F.lit(v)
    none = F.lit(None).cast("string")
    return F.when(when, F.struct(text(kind).alias("kind"), text(code).alias("code"), text(severity).alias("severity"), (none if before is None else before.cast("string")).alias("before"), (none if after is None else after.cast("string")).alias("after")))


def _explode(rows: DataFrame, changes: list[Column]) -> DataFrame:
    return rows.select("url", F.explode(F.filter(F.array(*changes), lambda c: c.isNotNull())).alias("c")).select("url", "c.*")


def _sides(before: DataFrame, after: DataFrame, keys: list[str], fields) -> DataFrame:
    side = lambda f, p: f.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in fields], F.lit(True).alias(f"in_{p}"))
    return side(before, "b").join(side(after, "a"), keys, "full_outer")


def _severity(field: str, b: Column, a: Column) -> Column:
    if field == "status":
        return _status_severity(b, a)
    if field == "indexability":
        return F.when(a == "indexable", "info").otherwise("error")
    return F.lit("info" if field == "title" else "warning")


def route_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """url, kind, code, severity, before, after over two profiles; one full outer join on the address."""
    j = _sides(before, after, ["url"], FIELDS)
    added, gone, both = F.col("in_b").isNull(), F.col("in_a").isNull(), F.col("in_a") & F.col("in_b")
    changes = [
        _change(added, "added", "route-added", F.when(F.col("a_status") >= 400, "error").otherwise("info"), None, F.col("a_status")),
        _change(gone, "removed", "route-removed", F.when(F.col("b_indexability") == "indexable", "warning").otherwise("info"), F.col("b_status")),
    ]
    for f in FIELDS:
        b, a = F.col(f"b_{f}"), F.col(f"a_{f}")
        changes.append(_change(both & ~b.eqNullSafe(a), "changed", f.replace("_", "-") + "-changed", _severity(f, b, a), b, a))
    return _explode(j, changes)


def agent_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """The same for the captures of secondary agents (url, agent, ...) of routes in both."""
    routes = before.select("url").distinct().join(after.select("url").distinct(), "url")
    fields = ("completion", *FIELDS[:-1])
    j = _sides(before.where("agent_ord > 0"), after.where("agent_ord > 0"), ["url", "agent"], fields).join(routes, "url", "left_semi")
    both = F.col("in_a") & F.col("in_b")
    changes = [
        _change(F.col("in_b").isNull(), "added", F.concat(F.lit("agent-snapshot-added:"), F.col("agent")), "info"),
        _change(F.col("in_a").isNull(), "removed", F.concat(F.lit("agent-snapshot-removed:"), F.col("agent")), "warning"),
    ]
    for f in fields:
        b, a = F.col(f"b_{f}"), F.col(f"a_{f}")
        severity = F.when(a == "complete", "info").otherwise("error") if f == "completion" else _severity(f, b, a)
        changes.append(_change(both & ~b.eqNullSafe(a), "changed", F.concat(F.lit("agent-" + f.replace("_", "-") + "-changed:"), F.col("agent")), severity, b, a))
    return _explode(j, changes)


def identified(findings: DataFrame) -> DataFrame:
    """One finding per code, address and related addresses: the last."""
    k = F.array_join(F.array_sort("related"), "\x1f")
    last = F.struct("severity", "message", "related", "evidence", "seq").alias("f")
    return findings.withColumn("k", k).groupBy("code", "url", "k").agg(F.max_by(last, F.col("seq")).alias("f")).select("code", "url", "k", "f.*")


def finding_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    j = _sides(identified(before), identified(after), ["code", "url", "k"], ("severity",))
    b, a = F.col("b_severity"), F.col("a_severity")
    return _explode(j.withColumnRenamed("code", "name"), [
        _change(F.col("in_b").isNull(), "added", F.concat(F.lit("finding-added:"), F.col("name")), a, None, a),
        _change(F.col("in_a").isNull(), "removed", F.concat(F.lit("finding-resolved:"), F.col("name")), "info", b),
        _change(F.col("in_a") & F.col("in_b") & (a != b), "changed", F.concat(F.lit("finding-severity:"), F.col("name")), a, b, a),
    ])


def summarize(changes: DataFrame) -> DataFrame:
    return changes.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("added", "removed", "changed")], *[F.count_if(F.col("severity") == s).alias(n) for s, n in (("error", "errors"), ("warning", "warnings"), ("info", "info"))])


def changed_only(current: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new or worsened findings with `change`, one row of counts)."""
    c, b = identified(current).withColumn("rank", rank()), identified(baseline).withColumn("was", rank()).select("code", "url", "k", "was")
    j = c.join(b, ["code", "url", "k"], "full_outer")
    change = F.when(F.col("rank").isNull(), "resolved").when(F.col("was").isNull(), "new").when(F.col("rank") < F.col("was"), "worsened").otherwise("unchanged")
    j = j.withColumn("change", change)
    kept = j.where("change in ('new', 'worsened')").select("url", "code", "severity", "message", "related", "evidence", "seq", "change")
    return kept, j.agg(*[F.count_if(F.col("change") == x).alias(x) for x in ("new", "worsened", "resolved", "unchanged")])


#: Settings of a run that must agree before two runs are compared.
POLICIES = """base_url max_pages max_depth query respect_robots agents seeds sitemap_mode sitemap_urls include exclude timeout_ms max_bytes
max_redirects delay_ms honour_delay rendered rendered_concurrency rendered_timeout_ms rendered_settle_ms header_names url_lists redirects options""".split()
#: What a run that does not say so has.
UNSAID = {"delay_ms": 0, "honour_delay": True}


def policies(config: dict, agents: list[str]) -> dict:
    """The compared settings of a configuration (`sources.configuration`)."""
    limits, rendered = config.get("limits", {}), config.get("rendered", {})
    return {
        "base_url": config.get("base_url"), **{k: limits.get(k) for k in ("max_pages", "max_depth", "timeout_ms", "max_bytes", "max_redirects")},
        "delay_ms": limits.get("delay_ms", 0), "honour_delay": limits.get("honour_delay", True), "query": config.get("query"),
        "respect_robots": config.get("respect_robots"), "agents": agents, "seeds": config.get("seeds"), "sitemap_mode": "explicit" if config.get("sitemaps") else "auto",
        "sitemap_urls": config.get("sitemaps") or [], "include": config.get("include"), "exclude": config.get("exclude"), "rendered": rendered.get("enabled", False),
        "rendered_concurrency": rendered.get("concurrency"), "rendered_timeout_ms": rendered.get("timeout_ms"), "rendered_settle_ms": rendered.get("settle_ms"),
        "header_names": sorted(k.lower() for k in config.get("headers", {})), "url_lists": len(config.get("url_lists", [])), "redirects": config.get("redirects", []),
        "options": config.get("audit", {}),
    }


def assert_comparable(current: dict, baseline: dict, policies: list[str]) -> None:
    """Reject a filtered or truncated baseline and differing policies (compared as canonical JSON)."""
    for name, run in (("baseline", baseline), ("current run", current)):
        if run.get("truncated"):
            raise ValueError(f"the {name} is truncated")
    if baseline.get("comparison"):
        raise ValueError("the baseline holds changed findings only")
    plain = lambda v: {k: plain(x) for k, x in v.items() if x is not None} if isinstance(v, dict) else v
    same = lambda run, p: json.dumps(plain(run.get(p, UNSAID.get(p))), sort_keys=True)
    if unlike := [p for p in policies if same(current, p) != same(baseline, p)]:
        raise ValueError("the runs differ in: " + ", ".join(unlike))
