"""Report formats. JSON, CSV, SARIF and JUnit hold every row, fetched partition by partition and joined to one text in the driver; documents for readers are made from bounded results."""

from __future__ import annotations

import html
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.post import ordered, rank

ROWS, NODES, LINKS = 200, 120, 500
TITLES = {"error": "error", "warning": "warning", "info": "note"}


def stable_json(value) -> str:
    """Sorted keys, non-finite numbers as null, a final newline."""

    def clean(v):
        if isinstance(v, float) and v != v or v in (float("inf"), float("-inf")):
            return None
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items() if x is not None}
        return [clean(x) for x in v] if isinstance(v, (list, tuple)) else v

    return json.dumps(clean(value), sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def evidence_text(evidence: Column) -> Column:
    """name=value pairs by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(evidence)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "; ")


def csv_rows(findings: DataFrame) -> DataFrame:
    """Flat rows; a cell that a spreadsheet would take for a formula gets a leading quote."""
    safe = lambda c: F.when(c.rlike(r"^[\s]*[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
    cells = {"severity": F.col("severity"), "code": F.col("code"), "url": F.coalesce("url", F.lit("")), "message": F.col("message"), "related_urls": F.array_join("related", " "), "evidence": evidence_text(F.col("evidence"))}
    return findings.select(*[safe(v).alias(k) for k, v in cells.items()])


def csv_line(rows: DataFrame) -> DataFrame:
    """One RFC 4180 line per row."""
    cell = lambda c: F.when(F.col(c).rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))).otherwise(F.col(c))
    return rows.select(F.concat_ws(",", *[cell(c) for c in rows.columns]).alias("line"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """code, level, results: one rule per code with its highest severity."""
    names = F.array(*[F.lit(v) for v in TITLES.values()])
    return findings.groupBy("code").agg(F.get(names, F.min(rank())).alias("level"), F.count("*").alias("results"))


def sarif(findings: DataFrame) -> str:
    rules = [{"id": r.code, "name": r.code.replace("-", " ").title().replace(" ", ""), "defaultConfiguration": {"level": r.level}} for r in sarif_rules(findings).orderBy("code").collect()]
    at = {r["id"]: k for k, r in enumerate(rules)}
    results = [
        {"ruleId": f.code, "ruleIndex": at[f.code], "level": TITLES[f.severity], "message": {"text": f.message}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": f.url}}}] if f.url else [], "properties": dict(f.evidence or {})}
        for f in findings.orderBy("code", "url", "message").toLocalIterator()
    ]
    return stable_json({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": "quarry", "rules": rules}}, "results": results}]})


def markdown_cell(text) -> str:
    """One inert table cell: no markup, no line breaks."""
    text = re.sub(r"[\x00-\x1f\x7f-\x9f]", " ", str(text if text is not None else ""))
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return re.sub(r"\s+", " ", re.sub(r"([-\\`*_\[\]{}()#+!|~=])", r"\\\1", text)).strip()


def markdown(summary: dict, findings: DataFrame, limit: int = ROWS) -> str:
    """A summary and at most `limit` rows in report order, with the number left out."""
    total = findings.count()
    rows = ordered(findings).limit(limit).collect()
    out = ["# Site audit", "", "| Count | Value |", "| --- | ---: |", *[f"| {k} | {v} |" for k, v in summary.items()], "", "| Severity | Code | URL | Message |", "| --- | --- | --- | --- |"]
    out += [f"| {r.severity} | {r.code} | {markdown_cell(r.url)} | {markdown_cell(r.message)} |" for r in rows]
    if total > len(rows):
        out += ["", f"{total - len(rows)} further findings."]
    return "\n".join(out) + "\n"


def xml_text(text) -> str:
    text = re.sub(r"[^\t\n\r\x20-퟿-�\U00010000-\U0010FFFF]", "�", str(text or ""))
    return html.escape(text, quote=True)


def junit(findings: DataFrame) -> str:
    """One case per finding; errors and warnings fail; an empty report is one passing case."""
    cases, failures = [], 0
    for r in ordered(findings).toLocalIterator():
        failures += r.severity != "info"
        body = f'<failure type="{r.severity}" message="{xml_text(r.message)}"/>' if r.severity != "info" else ""
        cases.append(f'<testcase classname="{xml_text(r.code)}" name="{xml_text(r.url)}">{body}</testcase>')
    cases = cases or ['<testcase classname="audit" name="no findings"></testcase>']
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<testsuites><testsuite name="audit" tests="{len(cases)}" failures="{failures}">{"".join(cases)}</testsuite></testsuites>\n'


def _printable(text) -> str:
    """Control characters written out, so that captured text cannot drive a terminal."""
    return re.sub(r"[\x00-\x1f\x7f-\x9f]", lambda m: f"\\x{ord(m[0]):02x}", str(text or ""))


def terminal(summary: dict, findings: DataFrame, limit: int = 50, color: bool = False) -> str:
    paint = {"error": "31", "warning": "33", "info": "36"}
    total = findings.count()
    out = ["  ".join(f"{k} {v}" for k, v in summary.items())]
    agents = agent_differences(findings).first()
    if agents.differences:
        out.append(f"{agents.differences} differences between agents on {agents.routes} routes")
    for r in findings.orderBy(rank(), "code", "url", "message").limit(limit).collect():
        label = f"\x1b[{paint[r.severity]}m{r.severity}\x1b[0m" if color else r.severity
        out.append(f"{label}  {r.code}  {_printable(r.url)}  {_printable(r.message)}")
    if total > limit:
        out.append(f"... and {total - limit} more")
    return "\n".join(out) + "\n"


def graph_nodes(routes: DataFrame, nodes: int = NODES) -> DataFrame:
    """The drawn routes: least depth first (unreachable last), with their place in the depth's column."""
    from pyspark.sql.window import Window

    deep = F.when(F.col("depth") < 0, 1 << 30).otherwise(F.col("depth"))
    top = routes.select("url", "depth", deep.alias("d")).orderBy("d", "url").limit(nodes)
    return top.withColumn("row", F.row_number().over(Window.partitionBy("d").orderBy("url")) - 1).drop("d")


def graph_links(edges: DataFrame, nodes: DataFrame, links: int = LINKS) -> DataFrame:
    small = F.broadcast(nodes.select("url"))
    e = edges.join(small.withColumnRenamed("url", "src"), "src", "left_semi").join(small.withColumnRenamed("url", "dst"), "dst", "left_semi")
    return e.select("src", "dst").orderBy("src", "dst").limit(links)


def route_rows(routes: DataFrame, edges: DataFrame, findings: DataFrame) -> DataFrame:
    """url, depth, completion, status, indexability, inbound, outbound, findings, highest severity of every route; one grouping a count, joined by address."""
    inbound = edges.groupBy(F.col("dst").alias("url")).agg(F.count_distinct("src").alias("inbound"))
    outbound = edges.groupBy(F.col("src").alias("url")).agg(F.count_distinct("dst").alias("outbound"))
    names = F.array(*[F.lit(x) for x in TITLES])
    worst = findings.where("url is not null").groupBy("url").agg(F.count("*").alias("findings"), F.get(names, F.min(rank())).alias("severity"))
    keep = [c for c in ("completion", "status", "indexability") if c in routes.columns]
    r = routes.select("url", "depth", *keep).join(inbound, "url", "left").join(outbound, "url", "left").join(worst, "url", "left")
    return r.select("url", "depth", *keep, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("inbound", "outbound", "findings")], "severity")


def agent_differences(findings: DataFrame) -> DataFrame:
    """One row: differences between agents, and the routes that have one."""
    f = findings.where(F.col("code").startswith("agent-"))
    return f.agg(F.count("*").alias("differences"), F.count_distinct("url").alias("routes"))


#: Sections of the rule reference by finding code; agent- codes belong to the first one, the others to page-signals.
SECTIONS = {
    "fetch-and-delivery": "route-not-fetched robots-blocked incomplete-fetch missing-http-response not-found server-error unexpected-status redirected-route slow-route slow-redirect non-html-route rendered-capture-incomplete rendered-status-mismatch",
    "redirect-contracts": "expected-redirect-missing redirect-status-mismatch redirect-target-mismatch redirect-chain redirect-target-unhealthy redirect-contract-unchecked redirect-pattern-unmatched",
    "inventory-and-limits": "sitemap-warning robots-warning crawl-policy next-discovery-warning next-dynamic-route-needs-sample page-budget-reached",
    "sitemaps-canonicals-and-hreflang": "not-in-sitemap sitemap-redirect sitemap-broken-url sitemap-noindex sitemap-robots-blocked non-self-canonical canonical-target-unseen broken-canonical-target redirecting-canonical-target noindex-canonical-target duplicate-canonical-target hreflang-target-unseen hreflang-target-noindex hreflang-missing-return-link",
    "site-graph": "deep-route orphan-route dead-end-route broken-internal-link redirecting-internal-link internal-link-to-noindex route-case-or-slash-variant duplicate-title-across-routes duplicate-description-across-routes duplicate-content-across-routes",
    "structured-data-and-social-metadata": "invalid-json-ld json-ld-missing-context json-ld-missing-type duplicate-json-ld conflicting-json-ld-id rendered-only-json-ld rendered-only-og missing-og-title missing-og-description missing-og-image",
}


def section(code: Column) -> Column:
    """The section of the rule reference that explains a code."""
    out = F.when(code.startswith("agent-"), "fetch-and-delivery")
    for name, codes in SECTIONS.items():
        out = out.when(code.isin(*codes.split()), name)
    return out.otherwise("page-signals")


def page(summary: dict, routes: DataFrame, edges: DataFrame, findings: DataFrame, checks: DataFrame | None = None, truncated: bool = False, limit: int = ROWS) -> str:
    """A self-contained HTML document: counts, completeness, link graph, redirect contracts, agents, routes and findings, at most `limit` rows a table with the number left out."""
    e = lambda t: html.escape(str(t if t is not None else "–"), quote=True)

    def listed(name: str, heads: str, rows: DataFrame, cells) -> str:
        total = rows.count()
        body = "".join(f"<tr>{''.join(f'<td>{e(c)}</td>' for c in cells(r))}</tr>" for r in rows.limit(limit).collect())
        left = f"<p>{total - limit} further rows.</p>" if total > limit else ""
        return f"<section><h2>{e(name)}</h2><table><thead><tr>{''.join(f'<th>{h}</th>' for h in heads.split(','))}</tr></thead><tbody>{body}</tbody></table>{left}</section>" if total else ""

    nodes = graph_nodes(routes).collect()
    place = {n.url: (40 + 160 * max(0, n.depth if n.depth >= 0 else 1 + max((m.depth for m in nodes), default=0)), 30 + 28 * n.row) for n in nodes}
    lines = [f'<line x1="{place[x.src][0]}" y1="{place[x.src][1]}" x2="{place[x.dst][0]}" y2="{place[x.dst][1]}"/>' for x in graph_links(edges, graph_nodes(routes)).collect()]
    dots = [f'<circle cx="{x}" cy="{y}" r="4"><title>{e(u)}</title></circle>' for u, (x, y) in place.items()]
    size = max((x for x, _ in place.values()), default=0) + 60, max((y for _, y in place.values()), default=0) + 30
    cards = "".join(f"<div><b>{e(v)}</b> {e(k)}</div>" for k, v in summary.items())
    notes = ["Collection stopped at a limit: what is not reported is not thereby healthy."] if truncated else []
    if "completion" in routes.columns:
        notes += [f"{r.routes} routes with incomplete evidence: {r.completion}." for r in incomplete(routes).orderBy("completion").collect()]
    banner = f"<aside><h2>Incomplete evidence</h2>{''.join(f'<p>{e(n)}</p>' for n in notes)}</aside>" if notes else ""
    tables = []
    if checks is not None:
        tables.append(listed("Redirect contracts", "Source,Expected,Target,Pattern,Result,Findings", checks.orderBy("from"), lambda r: (r["from"], r.status, r.to, r.declared_pattern, r.outcome, ", ".join(r.codes))))
    differing = findings.where(F.col("code").startswith("agent-"))
    tables.append(listed("Agent differences", "Severity,Route,Difference,Message", ordered(differing), lambda r: (r.severity, r.url, r.code, r.message)))
    deep = F.when(F.col("depth") < 0, 1 << 30).otherwise(F.col("depth"))
    tables.append(listed("Routes", "Route,Depth,Evidence,Status,Indexing,In,Out,Findings,Severity", route_rows(routes, edges, findings).orderBy(deep, "url"), lambda r: (r.url, "unreachable" if r.depth < 0 else r.depth, r.asDict().get("completion"), r.asDict().get("status"), r.asDict().get("indexability"), r.inbound, r.outbound, r.findings, r.severity)))
    shown = ordered(findings).withColumn("section", section(F.col("code"))).withColumn("facts", evidence_text(F.col("evidence")))
    tables.append(listed("Findings", "Severity,Code,Section,Route,Message,Related,Evidence", shown, lambda r: (r.severity, r.code, r.section, r.url or "site-wide", r.message, " ".join(sorted(r.related or [])), r.facts)))
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Site audit</title><style>line{{stroke:#bbb}}td{{padding:2px 8px}}</style></head><body><h1>Site audit</h1>{cards}{banner}<svg width="{size[0]}" height="{size[1]}">{"".join(lines)}{"".join(dots)}</svg>{"".join(tables)}</body></html>\n'


def incomplete(captures: DataFrame) -> DataFrame:
    """completion, routes: how many routes have an incomplete capture, by reason."""
    c = captures.where("completion != 'complete'").groupBy("completion").agg(F.count_distinct("url").alias("routes"))
    return c.select("completion", "routes")


def diff_changes(changes: DataFrame) -> DataFrame:
    """Changes of two runs in report order: severity, address, code."""
    return changes.orderBy(rank(), *[F.coalesce(F.col(c), F.lit("")).cast("string collate UNICODE") for c in ("url", "code")])


def _change_message(c) -> str:
    if c.kind == "changed":
        return f"{c.before if c.before is not None else 'none'} -> {c.after if c.after is not None else 'none'}"
    value = c.after if c.kind == "added" else c.before
    return c.kind if value is None else f"{c.kind}: {value}"


def diff_json(counts: dict, changes: DataFrame) -> str:
    """The counts of two runs' changes and the changes, absent values left out."""
    rows = [c.asDict() for c in diff_changes(changes).toLocalIterator()]
    return stable_json({"summary": counts, "changes": rows})


def diff_terminal(counts: dict, changes: DataFrame, limit: int = 1000) -> str:
    """Counts (as `compare.summarize` gives them), then one block a change, at most `limit`, with the number left out."""
    out = ["Comparison of two audits", *("  ".join(f"{counts[k]} {k}" for k in line) for line in (("added", "removed", "changed"), ("errors", "warnings", "info")))]
    total = sum(counts[k] for k in ("added", "removed", "changed"))
    out += [] if total else ["", "Nothing changed."]
    for c in diff_changes(changes).limit(limit).collect():
        out += ["", f"[{c.severity.upper()}] {c.code}" + (f"  {_printable(c.url)}" if c.url else ""), _printable(_change_message(c))]
    if total > limit:
        out += ["", f"... and {total - limit} more"]
    return "\n".join(out) + "\n"


def render(kind: str, summary: dict, routes: DataFrame, edges: DataFrame, findings: DataFrame, checks: DataFrame | None = None, truncated: bool = False) -> str:
    if kind == "json":
        rows = [r.asDict(recursive=True) for r in ordered(findings).drop("seq").toLocalIterator()]
        return stable_json({"schemaVersion": "5", "summary": summary, "findings": rows})
    if kind == "csv":
        return "severity,code,url,message,related_urls,evidence\n" + "".join(r.line + "\n" for r in csv_line(csv_rows(ordered(findings))).toLocalIterator())
    one = {"sarif": lambda: sarif(findings), "junit": lambda: junit(findings), "markdown": lambda: markdown(summary, findings), "terminal": lambda: terminal(summary, findings), "html": lambda: page(summary, routes, edges, findings, checks, truncated)}
    return one[kind]()


def explain(code: str, table: list[tuple[str, str, str]]) -> tuple[str, str, str] | None:
    """The row of (code or family with *, severity, text) for a code; an exact row beats a family."""
    fits = [r for r in table if r[0] == code] or [r for r in table if "*" in r[0] and re.fullmatch(".*".join(map(re.escape, r[0].split("*"))), code)]
    return fits[0] if fits else None
