"""Commands: check, next, diff, explain, init. Exit status 0, 1 when findings reach the threshold, 2 on an error.

Tables are paths that Spark reads: captures (`sources.captures.CAPTURE`) or raw pages (page_id, url, html); reports are folders written by
`check --report`, or JSON reports (`diff`, `--baseline`). `next` is `check` with the inventory of a framework's build.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.functions.urls import normalize_url
from quarry.plans import audit, compare, contracts, handbook, post
from quarry.sinks import redaction, reports
from quarry.sources import builds, configuration

FORMATS = ("terminal", "json", "csv", "sarif", "junit", "markdown", "html")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry")
    commands = p.add_subparsers(dest="command", required=True)
    c = commands.add_parser("check", help="audit captured pages")
    n = commands.add_parser("next", help="audit captured pages and the routes of a framework's build")
    n.add_argument("--root", default=".", help="the project")
    n.add_argument("--build-directory", default=".next", help="the build below it")
    for x in (c, n):
        _audit_arguments(x)
    d = commands.add_parser("diff", help="compare two reports")
    d.add_argument("before")
    d.add_argument("after")
    for s, formats in ((c, FORMATS), (n, FORMATS), (d, ("terminal", "json"))):
        s.add_argument("--format", choices=formats, default="terminal")
        s.add_argument("--output", help="file; standard output otherwise")
        s.add_argument("--fail-on", choices=(*post.SEVERITIES, "never"), default="error")
    e = commands.add_parser("explain", help="what a finding means")
    e.add_argument("code")
    i = commands.add_parser("init", help="write a configuration file")
    i.add_argument("base_url")
    i.add_argument("--path", default="quarry.json")
    return p


def _audit_arguments(c: argparse.ArgumentParser) -> None:
    source = c.add_mutually_exclusive_group(required=True)
    source.add_argument("--captures")
    source.add_argument("--pages")
    c.add_argument("--base-url")
    c.add_argument("--config")
    c.add_argument("--links", help="table (src, dst); captured links otherwise")
    c.add_argument("--sitemap", help="table (url)")
    c.add_argument("--contracts", help="table of redirect contracts")
    c.add_argument("--report", help="folder for the report's tables")
    c.add_argument("--baseline", help="report to compare with; only new or worse findings are shown")


def output(text: str, path: str | None) -> None:
    if path is None:
        sys.stdout.write(text)
    else:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)


def inventory(spark: SparkSession, a: argparse.Namespace, config: dict, captures) -> tuple:
    """(captures with the build's marks, contracts, unmatched patterns, inventory rows) of the configuration and, for `next`, of the build."""
    base = config["base_url"]
    declared = contracts.resolve(config["redirects"], base, config["limits"]["max_redirects"])
    exact = [(r["from"], r["to"], r["status"], r["max_hops"], "exact", "config", None, k) for k, r in enumerate(declared) if r["kind"] == "exact"]
    table = spark.createDataFrame(exact, contracts.CONTRACT)
    build = builds.read_build(a.root, a.build_directory, config["build"].get("samples")) if a.command == "next" else None
    runs = None
    if build is not None:
        routes = builds.strongest(spark, build)
        routes = routes.select(normalize_url(F.col("pathname"), F.lit(base)).alias("url"), F.lit(True).alias("in_build"), "render_mode").dropDuplicates(["url"])
        captures = captures.drop("in_build", "render_mode").join(routes, "url", "full_outer")
        # a route of the build that was not captured is a route all the same
        captures = captures.withColumns({"agent_ord": F.coalesce("agent_ord", F.lit(0)), "agent": F.coalesce("agent", F.lit("default")), "in_build": F.coalesce("in_build", F.lit(False))})
        table, skipped = contracts.collect(table, contracts.built(builds.redirects(spark, build), base))
        warnings = build["warnings"] + ([f"{n} redirects of the build are no contracts"] if (n := skipped.first().skipped) else [])
        row = (base, 0, False, 0, None, False, [], [], warnings, [f"{p} has no sample" for p in build["unresolved"]])
        runs = spark.createDataFrame([row], "url string, ord int, truncated boolean, delay_ms long, robots_delay_seconds double, clamped boolean, sitemap_warnings array<string>, robots_warnings array<string>, build_warnings array<string>, unresolved_patterns array<string>")
    patterns = [r for r in declared if r["kind"] == "pattern"]
    unmatched = None
    if patterns:
        found, unmatched = contracts.expand(patterns, captures.select("url").distinct())
        table = table.unionByName(found)
    return captures, table, unmatched, runs


def check(spark: SparkSession, a: argparse.Namespace) -> int:
    config = configuration.load(a.config, {"base_url": a.base_url} if a.base_url else {})
    secrets = tuple(config["headers"].values())
    captures = spark.read.parquet(a.captures) if a.captures else audit.from_pages(spark.read.parquet(a.pages))
    extra = {k: spark.read.parquet(v) for k, v in (("edges", a.links), ("sitemap", a.sitemap)) if v}
    base = config["base_url"]
    seeds = [base.rstrip("/") + s if s.startswith("/") else s for s in config["seeds"]]
    # One cut of the captures: reading pages parses their HTML.
    captures, table, unmatched, runs = inventory(spark, a, config, audit.cut(captures))
    if a.contracts:
        table = table.unionByName(spark.read.parquet(a.contracts))
    if config["redirects"] or a.contracts or a.command == "next":
        extra |= {"contracts": table, "unmatched": unmatched}
    found = audit.run(audit.cut(captures), base, config["audit"], seeds=seeds, runs=runs, config=config, **extra)
    shown = found.findings
    if a.baseline:
        meta, before, _, _ = audit.load(spark, a.baseline)
        compare.assert_comparable(found.run, meta, audit.POLICIES)
        shown = compare.changed_only(shown, before)[0].drop("change")
    if a.report:
        audit.save(found, a.report, secrets)
    clean = redaction.redacted(shown, secrets)
    summary = post.summarize(found.routes, shown).first().asDict()
    routes = found.routes.select("url", "depth", "completion", "status", "indexability")
    checks = None if found.checks is None else redaction.redacted(found.checks, secrets)
    output(reports.render(a.format, summary, redaction.redacted(routes, secrets), redaction.redacted(found.edges, secrets), clean, checks), a.output)
    return int(a.fail_on != "never" and post.fails(shown, a.fail_on))


def diff(spark: SparkSession, a: argparse.Namespace) -> int:
    changes = audit.diff(spark, a.before, a.after)
    counts = compare.summarize(changes).first().asDict()
    output((reports.diff_json if a.format == "json" else reports.diff_terminal)(counts, changes), a.output)
    return int(a.fail_on != "never" and post.fails(changes, a.fail_on))


def explain(code: str) -> int:
    row = reports.explain(code, handbook.RULES)
    if row is None:
        raise ValueError(f"no such finding: {code}")
    output(f"{code} ({row[1]})\n{row[2]}\n", None)
    return 0


def init(base_url: str, path: str) -> int:
    if os.path.exists(path):
        raise ValueError(f"{path} exists")
    text = json.dumps({"base_url": base_url, "seeds": ["/"], "audit": {}}, indent=2) + "\n"
    with open(path, "x", encoding="utf-8") as f:
        f.write(text)
    configuration.load(path)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        if a.command == "explain":
            return explain(a.code)
        if a.command == "init":
            return init(a.base_url, a.path)
        spark = spark or SparkSession.builder.appName("quarry").getOrCreate()
        return {"check": check, "next": check, "diff": diff}[a.command](spark, a)
    except Exception as e:  # noqa: BLE001  every failure of a command is status 2
        print(f"error: {reports._printable(e)}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
