"""Captures that each show one rare finding, and queries over sources, sinks and comparisons, with their DuckDB equivalents.

Every page's page_id modulo KINDS picks a kind; the page is sound but for that kind's change. The expected findings of a kind stand in
EXPECTED, so the SQL joins pages with a small table and shares nothing with the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.html import SIGNALS
from quarry.operators import candidates, crawl, robots
from quarry.plans import contracts, rules
from quarry.plans.derived import _block, _text
from quarry.sinks import reports
from quarry.sources import builds, captures, robots_txt, sitemaps, url_lists

BASE = "https://rare.test/r/"
KINDS = 40
OPTIONS = {"require_open_graph": True, "require_og_image": True, "max_redirect_hop_ms": 500, "max_response_ms": 1000}
#: kind: (family, code, severity) ...
EXPECTED = {
    1: [("page", "route-not-fetched", "info")],
    2: [("page", "unexpected-status", "warning")],
    3: [("page", "duplicate-title", "warning")],
    4: [("page", "conflicting-title", "warning")],
    5: [("page", "duplicate-description", "warning")],
    6: [("page", "conflicting-description", "warning")],
    7: [("page", "duplicate-canonical", "warning")],
    8: [("page", "conflicting-canonical", "warning")],
    9: [("page", "duplicate-robots", "warning")],
    10: [("page", "conflicting-robots", "warning")],
    11: [("page", "duplicate-hreflang", "warning")],
    12: [("page", "json-ld-missing-type", "warning")],
    13: [("page", "missing-og-image", "warning")],
    14: [("page", "empty-ssr-shell", "warning"), ("page", "missing-title", "error"), ("page", "missing-h1", "warning")],
    15: [("page", "rendered-only-title", "error"), ("page", "missing-title", "error")],
    16: [("page", "rendered-only-canonical", "error"), ("page", "missing-canonical", "error")],
    17: [("page", "rendered-only-h1", "warning"), ("page", "missing-h1", "warning")],
    18: [("page", "rendered-only-json-ld", "warning")],
    19: [("page", "rendered-only-og", "warning"), ("page", "missing-og-title", "error"), ("page", "missing-og-description", "warning"), ("page", "missing-og-image", "warning")],
    20: [("agents", "agent-incomplete-fetch", "warning"), ("agents", "agent-fetch-mismatch", "error")],
    21: [("agents", "agent-redirect-mismatch", "warning")],
    22: [("agents", "agent-content-type-mismatch", "warning")],
    23: [("agents", "agent-description-mismatch", "warning")],
    24: [("agents", "agent-canonical-mismatch", "warning")],
    25: [("graph", "hreflang-target-unseen", "warning")],
    26: [("groups", "route-case-or-slash-variant", "warning")],
    27: [("times", "slow-redirect", "warning"), ("page", "redirected-route", "warning"), ("graph", "sitemap-redirect", "error"), ("graph", "redirecting-canonical-target", "warning"), ("graph", "redirecting-internal-link", "warning")],
    28: [("page", "invalid-hreflang", "warning")],
    29: [("page", "robots-blocked", "info"), ("graph", "sitemap-robots-blocked", "error")],
    30: [("page", "incomplete-fetch", "warning")],
    31: [("page", "multiple-h1", "warning")],
    32: [("page", "rendered-status-mismatch", "warning")],
    33: [("graph", "dead-end-route", "info")],
    34: [("times", "slow-route", "warning")],
    35: [("agents", "agent-title-mismatch", "warning")],
    36: [("agents", "agent-status-mismatch", "error")],
    37: [("page", "duplicate-json-ld", "warning")],
    38: [("page", "invalid-json-ld", "warning")],
}


def _captures(pages: DataFrame) -> DataFrame:
    """pages(id, k, url): sound captures with the kind's change."""
    one = lambda value: f"array({_text(value)})"
    two = lambda a, b: f"array({_text(a)}, {_text(b)})"
    none = f"slice(array({_text('url')}), 2, 1)"
    meta = lambda kind, same, other, own, absent=(): f"CASE k WHEN {kind} THEN {two(own, own)} WHEN {kind + 1} THEN {two(own, other)} {' '.join(f'WHEN {a} THEN {none}' for a in absent)} ELSE {one(own)} END"
    robot = lambda v: f"named_struct('value', {v}, 'location', 'head', 'audience', 'robots', 'source', 'meta')"
    language = lambda lang, to: f"named_struct('language', {lang}, 'href', {to}, 'resolved_url', {to})"
    social = ", ".join(f"named_struct('property', 'og:{p}', 'value', 'v', 'location', 'head')" for p in ("title", "description", "image"))
    block = lambda types, sha, valid="true": _block(types, "array('#' || url)", sha, "schema.org", valid)
    typed, bare, bad = block("array('Thing')", "s0"), block("slice(array(''), 2, 1)", "s1"), block("slice(array(''), 2, 1)", "s2", "false")
    empty = lambda x: f"slice(array({x}), 2, 1)"
    other = f"'{BASE}unseen/' || id"
    signals = f"""CAST(named_struct(
      'titles', {meta(3, 3, "'Other'", "'Title ' || url", (14, 15))},
      'descriptions', {meta(5, 5, "'Other'", "'About ' || url")},
      'canonicals', {meta(7, 7, "'/elsewhere'", "url", (16,))},
      'robots', CASE k WHEN 9 THEN array({robot("'index'")}, {robot("'INDEX'")}) WHEN 10 THEN array({robot("'index'")}, {robot("'follow'")}) ELSE {empty(robot("'index'"))} END,
      'h1s', CASE k WHEN 14 THEN {none} WHEN 17 THEN {none} WHEN 31 THEN {two("'a'", "'b'")} ELSE {one("'Heading'")} END,
      'links', slice(array(named_struct('href', '', 'resolved_url', '', 'text', '', 'rel', array(''), 'nofollow', false)), 2, 1),
      'hreflangs', CASE k WHEN 11 THEN array({language("'fr'", 'url')}, {language("'FR'", 'url')}) WHEN 25 THEN array({language("'de'", other)}) WHEN 28 THEN array({language("'english'", 'url')}) ELSE {empty(language("'fr'", 'url'))} END,
      'social', CASE k WHEN 13 THEN slice(array({social}), 1, 2) WHEN 19 THEN slice(array({social}), 4, 1) ELSE array({social}) END,
      'structured_data', CASE k WHEN 12 THEN array({bare}) WHEN 18 THEN {empty(typed)} WHEN 37 THEN array({typed}, {typed}) WHEN 38 THEN array({typed}, {bad}) ELSE array({typed}) END,
      'html_lang', 'en', 'base_href', CAST(NULL AS STRING), 'content_text', '') AS {SIGNALS})"""
    hop = "named_struct('url', url, 'status', 302, 'location', url || '#moved', 'duration_ms', 500.0 + k + id)"
    content = f"CAST(named_struct('characters', IF(k = 14, 10, 200), 'words', 30, 'sha256', url, 'simhash', xxhash64(url)) AS {captures.CONTENT})"
    return pages.selectExpr(
        "id", "k", "url", "id AS ord", "'default' AS agent", "0 AS agent_ord",
        "CASE k WHEN 1 THEN NULL WHEN 29 THEN 'robots-blocked' WHEN 30 THEN 'max-bytes-exceeded' ELSE 'complete' END AS completion",
        "CASE k WHEN 1 THEN NULL WHEN 2 THEN 304 WHEN 29 THEN NULL ELSE 200 END AS status", "url AS final_url", "'text/html' AS content_type",
        f"CAST(IF(k = 27, array({hop}), slice(array({hop}), 2, 1)) AS array<{captures.HOP}>) AS redirects", f"{signals} AS signals", f"{content} AS content",
        "IF(k = 34, 1000.6 + id, 10.0) AS duration_ms", "CAST(NULL AS STRING) AS error", "true AS in_sitemap", "false AS in_build", "false AS exempt", "CAST(NULL AS STRING) AS render_mode", "0 AS depth",
    )


def _pages(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/pages.parquet").where("page_id is not null").select(F.col("page_id").alias("id")).distinct()
    return p.selectExpr("id", f"id % {KINDS} AS k", f"concat('{BASE}', id) AS url")


def tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(routes, agents, edges) of the variants."""
    p = _pages(spark, d)
    twin = p.where("k = 26").selectExpr("id", "k", "url || '/' AS url")
    plain = _captures(p.union(twin))
    sound = _captures(p.selectExpr("id", "0 AS k", "url")).select("id", F.col("signals").alias("full"), F.col("content").alias("whole"))
    shown = F.col("k").between(15, 19) | (F.col("k") == 32)
    rendered = F.struct(F.lit("complete").alias("completion"), F.when(F.col("k") == 32, 201).otherwise(200).alias("status"), F.col("full").alias("signals"), F.col("whole").alias("content"))
    routes = plain.join(sound, "id").withColumn("rendered", F.when(shown, rendered)).drop("full", "whole", "k")
    a = p.where("k in (20, 21, 22, 23, 24, 35, 36)")
    own = _captures(a.selectExpr("id", "0 AS k", "url")).drop("k").join(a.select("id", "k"), "id")
    change = lambda name, value: F.transform(F.col(f"signals.{name}"), lambda x: F.struct(F.lit(value).alias("value"), x["location"].alias("location")))
    own = own.withColumn("completion", F.when(F.col("k") == 20, "robots-blocked").otherwise(F.col("completion")))
    own = own.withColumn("final_url", F.when(F.col("k") == 21, F.concat("url", F.lit("/elsewhere"))).otherwise(F.col("final_url")))
    own = own.withColumn("content_type", F.when(F.col("k") == 22, "text/html; charset=x").otherwise(F.col("content_type")))
    own = own.withColumn("status", F.when(F.col("k") == 36, 404).otherwise(F.col("status")))
    for k, name in ((23, "descriptions"), (24, "canonicals"), (35, "titles")):
        own = own.withColumn("signals", F.when(F.col("k") == k, F.col("signals").withField(name, change(name, "/changed"))).otherwise(F.col("signals")))
    agents = own.withColumn("agent", F.lit("googlebot")).withColumn("agent_ord", F.lit(1)).drop("k")
    edges = p.where("k != 33").select(F.col("url").alias("src"), F.col("url").alias("dst")).union(twin.select(F.col("url").alias("src"), F.col("url").alias("dst")))
    return routes, agents, edges


def _routes(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    from quarry.operators.shared import cut

    routes, agents, edges = tables(spark, d)
    return cut(rules.enrich(routes, OPTIONS)), agents, edges


def _keys(f: DataFrame) -> DataFrame:
    return f.select("url", "code", "severity")


def rare_page_findings(spark, d):
    return _keys(rules.page_rules(_routes(spark, d)[0]))


def rare_agent_findings(spark, d):
    routes, agents, _ = _routes(spark, d)
    return _keys(rules.agent_rules(routes, agents))


def rare_graph_findings(spark, d):
    routes, _, edges = _routes(spark, d)
    return _keys(rules.graph_rules(routes, edges, BASE + "0"))


def rare_group_findings(spark, d):
    return _keys(rules.group_rules(_routes(spark, d)[0]))


def rare_time_findings(spark, d):
    f = rules.time_rules(_routes(spark, d)[0], OPTIONS)
    return f.select("url", "code", "severity", "message", F.array_join("related", " ").alias("related"), reports.evidence_text(F.col("evidence")).alias("evidence"))


def inventory_findings(spark, d):
    """Every page stands for a run of its own."""
    p = _pages(spark, d)
    runs = p.selectExpr(
        "url", "id AS ord", "id % 2 = 0 AS truncated", "id * 10 AS delay_ms", "IF(id % 3 = 0, CAST(id AS DOUBLE), NULL) AS robots_delay_seconds", "id % 6 = 0 AS clamped",
        "IF(id % 5 = 0, array('a', 'b'), slice(array(''), 2, 1)) AS sitemap_warnings", "IF(id % 7 = 0, array('c'), slice(array(''), 2, 1)) AS robots_warnings",
        "IF(id % 11 = 0, array('d'), slice(array(''), 2, 1)) AS build_warnings", "IF(id % 4 = 0, array('/x/[id]'), slice(array(''), 2, 1)) AS unresolved_patterns",
    )
    return rules.inventory_rules(runs).select("url", "code", "severity", "message")


def pattern_findings(spark, d):
    """A pattern for every page, of which those of odd pages match nothing."""
    routes, _, _ = _routes(spark, d)
    lost = _pages(spark, d).where("id % 2 = 1").selectExpr("url || '/*' AS declared_pattern", "CAST(id AS INT) AS ord")
    f, _ = contracts.audit(spark.createDataFrame([], contracts.CONTRACT), routes, lost)
    return _keys(f)


# --- sources ------------------------------------------------------------------------------------------------------


def robots_parsed(spark, d):
    text = "concat('# robots of ', id, '\\r\\nDisallow: /early\\nUser-agent: bot', id % 3, ' # why\\nUser-Agent: other\\nDisallow: /p/', id, '\\nAllow:\\nCrawl-delay: ', id % 7, '\\nRequest-rate: 1/', id % 5 + 1, '\\nUser-agent: *\\nAllow: /q', id, '$\\nSitemap: /s', id, '.xml#f\\nOdd: x')"
    f = _pages(spark, d).selectExpr("concat('https://r', id, '.test') AS origin", "concat('https://r', id, '.test/robots.txt') AS url", "CASE id % 5 WHEN 3 THEN 404 WHEN 4 THEN 503 ELSE 200 END AS status", f"CAST({text} AS BINARY) AS content", "IF(id % 10 = 7, 'timeout', NULL) AS error")
    r = robots_txt.read(f)
    rows = robots_txt.rules(r).select("origin", F.col("group_ord").cast("long").alias("group_ord"), F.array_join("agents", " ").alias("agents"), "delay", "directive", "pattern")
    facts = r.select("origin", "state", "reason", F.array_join("robots.sitemaps", " ").alias("sitemaps"), F.size("robots.warnings").cast("long").alias("warnings"))
    return facts.join(rows, "origin", "left")


def robots_pacing(spark, d):
    delays = _pages(spark, d).selectExpr("concat('https://r', id, '.test') AS origin", "IF(id % 4 = 0, NULL, CAST(id % 23 AS DOUBLE) / 1.5D) AS delay")
    return robots.pacing(delays, 2500)


def robots_elsewhere(spark, d):
    u = _pages(spark, d).selectExpr("concat('https://', IF(id % 2 = 0, 'own', 'other'), '.test/p/', id) AS url")
    table = spark.createDataFrame([("https://own.test", 0, ["*"], None, "disallow", "/p/1")], "origin string, group_ord int, agents array<string>, delay double, directive string, pattern string")
    return robots.decide(u, table, spark.createDataFrame([("https://own.test", "available")], "origin string, state string"), "Agent")


def sitemap_parsed(spark, d):
    xml = "concat('<s:urlset xmlns:s=\"http://www.sitemaps.org/schemas/sitemap/0.9\" xmlns:x=\"http://www.w3.org/1999/xhtml\"><s:url><s:loc> /a/', id, '?x=1&amp;y=2 </s:loc><s:lastmod>2024-01-0', id % 9 + 1, '</s:lastmod><x:link rel=\"alternate\" hreflang=\"fr\" href=\"/fr/', id, '\"/></s:url><s:url><s:loc>mailto:x</s:loc></s:url>', IF(id % 4 = 0, '<s:url><s:loc>https://o.test/z</s:loc></s:url>', ''), '</s:urlset>', IF(id % 9 = 5, '<', ''))"
    f = _pages(spark, d).selectExpr("concat('https://m', id, '.test/sitemap.xml') AS url", f"{xml} AS xml")
    p = sitemaps.parsed(f).select(F.col("url").alias("sitemap"), "p.kind", F.size("p.warnings").cast("long").alias("warnings"), F.explode_outer("p.entries").alias("e"))
    return p.select("sitemap", "kind", "warnings", F.col("e.url").alias("url"), "e.last_modified", F.get("e.alternates", F.lit(0))["resolved_url"].alias("alternate"))


def sitemap_followed(spark, d):
    """An index of all pages' sitemaps in tens, below one root; every tenth entry is given twice."""
    p = _pages(spark, d).where("id < 700")
    leaf = p.selectExpr("concat('https://t.test/leaf', id, '.xml') AS url", "concat('<urlset><url><loc>/e', id - IF(id % 10 = 1, 1, 0), '</loc><lastmod>', id, '</lastmod></url></urlset>') AS xml")
    mid = p.groupBy(F.floor(F.col("id") / 10).alias("t")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: F.concat(F.lit("<sitemap><loc>/leaf"), i.cast("string"), F.lit(".xml</loc></sitemap>"))), "").alias("x"))
    mid = mid.select(F.concat(F.lit("https://t.test/mid"), F.col("t").cast("string"), F.lit(".xml")).alias("url"), F.concat(F.lit("<sitemapindex>"), "x", F.lit("<sitemap><loc>/root.xml</loc></sitemap></sitemapindex>")).alias("xml"))
    start = mid.select("url", F.regexp_extract("url", r"mid(\d+)", 1).cast("int").alias("ord"))
    got, entries, _ = sitemaps.follow(start, leaf.union(mid), most=10_000)
    return entries.select("url", "last_modified")


_LINES = "CASE id % 7 WHEN 0 THEN concat('/l/', id, '?b=2&a=', id) WHEN 1 THEN concat('  https://list.test/l/', id - 1, '?a=', id - 1, '&b=2#x ') WHEN 2 THEN 'mailto:a@b.c' WHEN 3 THEN 'https://u:p@list.test/' WHEN 4 THEN concat('https://far.test/', id) WHEN 5 THEN '# note' ELSE '' END"


def _lists(spark, d):
    return url_lists.load(_pages(spark, d).selectExpr("concat('list', id % 2) AS source", "CAST(id + 1 AS INT) AS line", f"{_LINES} AS text"), "https://list.test/")


def list_entries(spark, d):
    return _lists(spark, d)[0].select("url", "source", F.col("line").cast("long").alias("line"))


def list_diagnostics(spark, d):
    return _lists(spark, d)[1].select("source", F.col("line").cast("long").alias("line"), "code", "severity")


def list_counts(spark, d):
    return _lists(spark, d)[2]


def response_chains(spark, d):
    """Responses of all pages: most redirect to the next one until a page whose id ends in 7."""
    p = _pages(spark, d)
    r = p.selectExpr(
        "concat('https://', IF(id % 3 = 0, 'a', 'b'), '.test/', id) AS url", "CASE WHEN id % 10 = 7 THEN 200 WHEN id % 10 = 3 THEN 302 WHEN id % 20 = 5 THEN 301 ELSE 308 END AS status",
        "CASE WHEN id % 20 = 5 THEN IF(id % 40 = 5, NULL, 'ftp://x/') ELSE concat('//', IF((id + 1) % 3 = 0, 'a', 'b'), '.test/', id + 1) END AS location", "CAST(id % 50 AS DOUBLE) AS duration_ms",
    )
    c = captures.follow_redirects(r.select("url"), r, 4, "https://a.test")
    return c.select("url", "final_url", "status", F.size("redirects").cast("long").alias("hops"), "completion", F.col("headers_sent").cast("long").alias("headers_sent"))


def response_bodies(spark, d):
    body = "CASE id % 3 WHEN 0 THEN CAST(concat('caf', unhex('C3A9'), id) AS BINARY) WHEN 1 THEN concat(CAST('caf' AS BINARY), unhex('E9')) ELSE concat(unhex('EFBBBF'), CAST(concat('x', id) AS BINARY)) END".replace("concat('caf', unhex('C3A9'), id)", "concat('café', id)")
    f = _pages(spark, d).selectExpr("id", f"{body} AS content", "CASE id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'text/html; charset=\"ISO-8859-1\"' ELSE 'text/html;charset=nonsense' END AS type")
    b = captures.body_prefix(F.col("content"), 6)
    return f.select("id", captures.decoded(F.col("content"), F.col("type")).alias("text"), b["bytes_read"].cast("long").alias("bytes_read"), b["sha256"].alias("sha256"), b["exceeded"].alias("exceeded"))


def response_headers(spark, d):
    f = _pages(spark, d).selectExpr("id", "map('X-Api-Key', 'k', 'Location', concat('/n?token=t&id=', id), 'Link', concat('<https://u:p@h.test/', id, '>; rel=next'), 'Refresh', concat('5; url=/r?secret=s&i=', id), 'Server', 's') AS h")
    h = captures.sanitized_headers(F.col("h"))
    return f.select("id", *[h[k].alias(k.lower().replace("-", "_")) for k in ("X-Api-Key", "Location", "Link", "Refresh", "Server")])


def build_inventory(spark, d):
    """A build manifest made of all page ids."""
    ids = [r.id for r in _pages(spark, d).where("id < 300").select("id").orderBy("id").collect()]
    import json

    pages = {f"/b/{i}": {"initialRevalidateSeconds": False if i % 3 == 0 else 60, **({"experimentalPPR": True} if i % 10 == 0 else {})} for i in ids if i % 2 == 0}
    found = builds.discover({"prerender-manifest.json": json.dumps({"routes": pages}), "routes-manifest.json": json.dumps({"staticRoutes": [{"page": f"/b/{i}"} for i in ids], "dynamicRoutes": [{"page": f"/d/{i}/[slug]"} for i in ids if i % 25 == 0], "redirects": [{"source": f"/o/{i % 40}", "destination": f"/n/{i % 80}", "permanent": i % 2 == 0} for i in ids]}), "app-paths-manifest.json": json.dumps({f"/(group)/@slot/app/{i}/page": "x" for i in ids} | {f"/api/{i}/route": "x" for i in ids})})
    return spark, found, ids


def build_routes(spark, d):
    spark, found, _ = build_inventory(spark, d)
    return builds.strongest(spark, found).select("pathname", "render_mode", "revalidate_seconds", "source_manifest")


def build_redirects(spark, d):
    spark, found, _ = build_inventory(spark, d)
    return builds.redirects(spark, found).select("source", "destination", "status")


def build_contracts(spark, d):
    """Contracts from a build's redirects and a configuration: unlike targets for a source drop it."""
    p = _pages(spark, d)
    found = p.selectExpr("concat('/s/', id % 60) AS source", "concat('/t/', IF(id % 60 < 20, id, id % 60)) AS destination", "IF(id % 9 = 0, 399, 301) AS status", "id % 13 = 0 AS conditional")
    own = spark.createDataFrame([("https://site.test/s/1", "https://site.test/own", 301, 1, "exact", "config", None, 0)], contracts.CONTRACT)
    rows, skipped = contracts.collect(own, contracts.built(found, "https://site.test/"))
    return rows.select("from", "to", "status", "source").withColumn("skipped", F.lit(skipped.first().skipped))


# --- sinks --------------------------------------------------------------------------------------------------------


def _findings(spark, d):
    routes, agents, edges = _routes(spark, d)
    return routes, edges, rules.page_rules(routes).union(rules.agent_rules(routes, agents))


def finding_sections(spark, d):
    _, _, f = _findings(spark, d)
    return f.select("code", reports.section(F.col("code")).alias("section")).groupBy("code", "section").agg(F.count("*").alias("findings"))


def agent_differences(spark, d):
    return reports.agent_differences(_findings(spark, d)[2])


def route_rows(spark, d):
    routes, edges, f = _findings(spark, d)
    return reports.route_rows(routes, edges, f).select("url", "inbound", "outbound", "findings", "severity")


def graph_drawing(spark, d):
    from quarry.plans import derived

    r, e = derived.routes(spark, d).select("url", "depth"), derived.edges(spark, d)
    nodes = reports.graph_nodes(r)
    links = reports.graph_links(e, nodes)
    return nodes.select("url", F.col("row").cast("long").alias("place"), F.lit(None).cast("string").alias("dst")).union(links.select("src", F.lit(None).cast("long"), "dst"))


def csv_lines(spark, d):
    _, _, f = _findings(spark, d)
    return reports.csv_line(reports.csv_rows(f.where("code in ('duplicate-title', 'redirected-route', 'agent-title-mismatch')").select("url", "code", "severity", F.lit('=1+"a", b').alias("message"), F.array().cast("array<string>").alias("related"), F.create_map().cast("map<string,string>").alias("evidence"))))


def candidate_kinds(spark, d):
    """U1 and U2 over five inventories: which kinds name an address."""
    p = _pages(spark, d)
    row = lambda kind, keep: p.where(keep).selectExpr("concat('https://site.test/c/', id % 100) AS reference", "0 AS depth", f"'{kind}' AS kind", "CAST(NULL AS STRING) AS source", "CAST(NULL AS STRING) AS detail", "1 AS priority", "false AS in_sitemap", "CAST(NULL AS STRING) AS render_mode", "id AS seq")
    rows = candidates.union_inventories(*(row(k, w) for k, w in (("seed", "id = 0"), ("sitemap", "id % 2 = 0"), ("next-build", "id % 3 = 0"), ("url-list", "id % 5 = 0"), ("redirect-contract", "id % 7 = 0"))))
    m = candidates.merge(rows, "https://site.test/")
    return m.select("url", F.array_join(F.transform("sources", lambda s: s["kind"]), " ").alias("kinds"))


def chain_depths(spark, d):
    """Depths along one chain of the first pages, a level a page."""
    p = _pages(spark, d).where("id < 12")
    nodes = p.select("url")
    e = p.selectExpr("url AS src", f"concat('{BASE}', id + 1) AS dst")
    return crawl.depths(nodes, e, spark.createDataFrame([(BASE + "0",)], "url string")).select("url", F.col("depth").cast("long").alias("depth"))


NAMES = """rare_page_findings rare_agent_findings rare_graph_findings rare_group_findings rare_time_findings inventory_findings pattern_findings robots_parsed
robots_pacing robots_elsewhere sitemap_parsed sitemap_followed list_entries list_diagnostics list_counts response_chains response_bodies response_headers
build_routes build_redirects build_contracts finding_sections agent_differences route_rows graph_drawing csv_lines candidate_kinds chain_depths""".split()


# --- the same in SQL ----------------------------------------------------------------------------------------------

_P = f"p AS (SELECT DISTINCT page_id AS id, page_id % {KINDS} AS k, '{BASE}' || page_id AS url FROM pages WHERE page_id IS NOT NULL)"


def _expected(*families: str) -> str:
    rows = ", ".join(f"({k}, '{f}', '{c}', '{s}')" for k, found in EXPECTED.items() for f, c, s in found if f in families)
    return f"{_P}, x(k, family, code, severity) AS (VALUES {rows}), f AS (SELECT url, code, severity, family FROM p JOIN x USING (k))"


_LISTED = f"""{_P}, l AS (SELECT 'list' || id % 2 AS source, id + 1 AS line, id, id % 7 AS m FROM p),
e AS (SELECT 'https://list.test/l/' || (id - m) || '?a=' || (id - m) || '&b=2' AS url, source, line FROM l WHERE m IN (0, 1)),
g AS (SELECT source, line, CASE m WHEN 2 THEN 'unsupported-protocol' WHEN 3 THEN 'credentials-not-allowed' ELSE 'off-origin' END AS code, CASE m WHEN 4 THEN 'warning' ELSE 'error' END AS severity FROM l WHERE m IN (2, 3, 4))"""
_CHAINS = f"""{_P}, r AS (SELECT id, 'https://' || CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END || '.test/' || id AS url,
  CASE WHEN id % 10 = 7 THEN 200 WHEN id % 10 = 3 THEN 302 WHEN id % 20 = 5 THEN 301 ELSE 308 END AS status, id % 10 = 7 OR id % 20 = 5 AS ends, id % 3 = 0 AS own FROM p),
w(start, id, hops, sent) AS (SELECT url, id, 0, own::INT FROM r
  UNION ALL SELECT w.start, w.id + 1, hops + 1, sent + ((w.id + 1) % 3 = 0)::INT FROM w JOIN r ON r.id = w.id WHERE NOT r.ends AND hops < 4)
"""
_BUILD = f"{_P}, b AS (SELECT id FROM p WHERE id < 300)"
ORACLES = {
    "rare_page_findings": f"WITH {_expected('page')} SELECT url, code, severity FROM f",
    "rare_agent_findings": f"WITH {_expected('agents')} SELECT url, code, severity FROM f",
    "rare_graph_findings": f"WITH {_expected('graph')} SELECT url, code, severity FROM f",
    "rare_group_findings": f"WITH {_expected('groups')} SELECT url, code, severity FROM f",
    "rare_time_findings": f"""WITH {_P} SELECT url, 'slow-redirect' AS code, 'warning' AS severity, 'A redirect with HTTP 302 took ' || (500 + k + id) || ' ms; its budget is 500 ms.' AS message,
  url || '#moved' AS related, 'budgetMs=500; durationMs=' || (500 + k + id) || '; status=302' AS evidence FROM p WHERE k = 27
UNION ALL SELECT url, 'slow-route', 'warning', 'The page took ' || (1001 + id) || ' ms; its budget is 1000 ms.', '', 'budgetMs=1000; durationMs=' || (1001 + id) FROM p WHERE k = 34""",
    "inventory_findings": f"""WITH {_P} SELECT url, 'crawl-policy' AS code, CASE WHEN id % 6 = 0 THEN 'warning' ELSE 'info' END AS severity, 'Robots rules set the pace of the crawl.' AS message FROM p WHERE id % 3 = 0
UNION ALL SELECT url, 'page-budget-reached', 'warning', 'The crawl stopped at its budget.' FROM p WHERE id % 2 = 0
UNION ALL SELECT url, 'sitemap-warning', 'warning', unnest(['a', 'b']) FROM p WHERE id % 5 = 0 UNION ALL SELECT url, 'robots-warning', 'warning', 'c' FROM p WHERE id % 7 = 0
UNION ALL SELECT url, 'next-discovery-warning', 'warning', 'd' FROM p WHERE id % 11 = 0 UNION ALL SELECT url, 'next-dynamic-route-needs-sample', 'info', '/x/[id]' FROM p WHERE id % 4 = 0""",
    "pattern_findings": f"WITH {_P} SELECT url || '/*' AS url, 'redirect-pattern-unmatched' AS code, 'info' AS severity FROM p WHERE id % 2 = 1",
    "robots_parsed": f"""WITH {_P}, o AS (SELECT 'https://r' || id || '.test' AS origin, id, CASE WHEN id % 10 = 7 THEN 'unavailable' WHEN id % 5 = 3 THEN 'missing' WHEN id % 5 = 4 THEN 'unavailable' ELSE 'available' END AS state,
  CASE WHEN id % 10 = 7 THEN 'timeout' WHEN id % 5 = 4 THEN 'http-error' END AS reason FROM p),
g AS (SELECT origin, 0::BIGINT AS group_ord, 'bot' || id % 3 || ' other' AS agents, greatest(id % 7, id % 5 + 1)::DOUBLE AS delay, 'disallow' AS directive, '/p/' || id AS pattern FROM o WHERE state = 'available'
  UNION ALL SELECT origin, 1, '*', NULL, 'allow', '/q' || id || '$' FROM o WHERE state = 'available')
SELECT o.origin, state, reason, CASE WHEN state = 'available' THEN origin || '/s' || id || '.xml' ELSE '' END AS sitemaps, CASE WHEN state = 'available' THEN 2 ELSE 0 END::BIGINT AS warnings, group_ord, agents, delay, directive, pattern FROM o LEFT JOIN g USING (origin)""",
    "robots_pacing": f"WITH {_P}, q AS (SELECT id, CASE WHEN id % 4 <> 0 THEN (id % 23)::DOUBLE / 1.5::DOUBLE END AS s, coalesce(ceil((id % 23)::DOUBLE / 1.5::DOUBLE * 1000) FILTER (id % 4 <> 0), 0)::BIGINT AS w FROM p GROUP BY id) SELECT 'https://r' || id || '.test' AS origin, greatest(2500, least(w, 10000)) AS delay_ms, s AS robots_delay_seconds, w > greatest(2500, least(w, 10000)) AS clamped FROM q".replace("coalesce(ceil((id % 23)::DOUBLE / 1.5::DOUBLE * 1000) FILTER (id % 4 <> 0), 0)", "CASE WHEN id % 4 <> 0 THEN ceil((id % 23)::DOUBLE / 1.5::DOUBLE * 1000) ELSE 0 END").replace(" GROUP BY id", ""),
    "robots_elsewhere": f"WITH {_P} SELECT 'https://' || CASE WHEN id % 2 = 0 THEN 'own' ELSE 'other' END || '.test/p/' || id AS url, id % 2 = 1 OR NOT id::VARCHAR LIKE '1%' AS allowed FROM p",
    "sitemap_parsed": f"""WITH {_P}, s AS (SELECT id, 'https://m' || id || '.test' AS o, id % 9 <> 5 AS ok FROM p)
SELECT o || '/sitemap.xml' AS sitemap, CASE WHEN ok THEN 'urlset' ELSE 'invalid' END AS kind, 1::BIGINT AS warnings, CASE WHEN ok THEN o || '/a/' || id || '?x=1&y=2' END AS url, CASE WHEN ok THEN '2024-01-0' || (id % 9 + 1) END AS last_modified, CASE WHEN ok THEN o || '/fr/' || id END AS alternate FROM s
UNION ALL SELECT o || '/sitemap.xml', 'urlset', 1, 'https://o.test/z', NULL, NULL FROM s WHERE ok AND id % 4 = 0""",
    "sitemap_followed": f"WITH {_P}, q AS (SELECT id, id - (id % 10 = 1)::INT AS e FROM p WHERE id < 700) SELECT 'https://t.test/e' || e AS url, min(id)::VARCHAR AS last_modified FROM q GROUP BY e",
    "list_entries": f"WITH {_LISTED} SELECT url, min({{'s': source, 'l': line}}).s AS source, min({{'s': source, 'l': line}}).l AS line FROM e GROUP BY url",
    "list_diagnostics": f"WITH {_LISTED} SELECT source, line, code, severity FROM g",
    "list_counts": f"WITH {_LISTED} SELECT source, count(DISTINCT url) AS accepted, count(*) FILTER (code IS NOT NULL) AS rejected FROM (SELECT source, url, NULL AS code FROM e UNION ALL SELECT source, NULL, code FROM g) GROUP BY source",
    "response_chains": f"""WITH RECURSIVE {_CHAINS}, z AS (SELECT start, arg_max(id, hops) AS id, max(hops) AS hops, arg_max(sent, hops) AS sent FROM w GROUP BY start)
SELECT start AS url, 'https://' || CASE WHEN z.id % 3 = 0 THEN 'a' ELSE 'b' END || '.test/' || z.id AS final_url, status, (hops + CASE WHEN r.id IS NOT NULL AND NOT ends THEN 1 ELSE 0 END)::BIGINT AS hops,
  CASE WHEN r.id IS NULL THEN 'network-error' WHEN status = 200 THEN 'complete' ELSE 'invalid-response' END AS completion, sent::BIGINT AS headers_sent FROM z LEFT JOIN r ON r.id = z.id""",
    "response_bodies": f"""WITH {_P} SELECT id, CASE id % 3 WHEN 0 THEN 'café' || id WHEN 1 THEN 'café' ELSE 'x' || id END AS text, CASE id % 3 WHEN 0 THEN 6 WHEN 1 THEN 4 ELSE least(6, 4 + length(id::VARCHAR)) END::BIGINT AS bytes_read,
  sha256(CASE id % 3 WHEN 0 THEN encode('café' || substr(id::VARCHAR, 1, 1)) WHEN 1 THEN 'caf\\xE9'::BLOB ELSE '\\xEF\\xBB\\xBF'::BLOB || encode(substr('x' || id, 1, 3)) END) AS sha256,
  CASE id % 3 WHEN 0 THEN length(id::VARCHAR) > 1 WHEN 1 THEN false ELSE length(id::VARCHAR) > 2 END AS exceeded FROM p""",
    "response_headers": f"WITH {_P} SELECT id, '[redacted]' AS x_api_key, '/n?token=%5Bredacted%5D&id=' || id AS location, '<https://redacted:redacted@h.test/' || id || '>; rel=next' AS link, '5; url=/r?secret=%5Bredacted%5D&i=' || id AS refresh, 's' AS server FROM p",
    "build_routes": f"""WITH {_BUILD} SELECT '/b/' || id AS pathname, CASE WHEN id % 2 = 1 THEN 'dynamic' WHEN id % 10 = 0 THEN 'unknown' WHEN id % 3 = 0 THEN 'static' ELSE 'isr' END AS render_mode,
  CASE WHEN id % 2 = 0 AND id % 3 <> 0 THEN 60.0 END::DOUBLE AS revalidate_seconds, CASE WHEN id % 2 = 0 THEN 'prerender-manifest.json' ELSE 'routes-manifest.json' END AS source_manifest FROM b
UNION ALL SELECT '/app/' || id, 'dynamic', NULL, 'app-paths-manifest.json' FROM b""",
    "build_redirects": f"WITH {_BUILD} SELECT DISTINCT '/o/' || id % 40 AS source, '/n/' || id % 80 AS destination, CASE WHEN id % 2 = 0 THEN 308 ELSE 307 END AS status FROM b",
    "build_contracts": f"""WITH {_P}, r AS (SELECT 'https://site.test/s/' || id % 60 AS "from", 'https://site.test/t/' || CASE WHEN id % 60 < 20 THEN id ELSE id % 60 END AS "to", id % 9 <> 0 AND id % 13 <> 0 AS ok, id % 60 = 1 AS own FROM p),
g AS (SELECT "from", min("to") AS "to", count(*) AS n, count(DISTINCT "to") AS kinds FROM r WHERE ok AND NOT own GROUP BY "from"),
s AS (SELECT coalesce((SELECT sum(n) FROM g WHERE kinds > 1), 0) + (SELECT count(*) FROM r WHERE NOT ok) AS skipped)
SELECT "from", "to", 301 AS status, 'build' AS source, (SELECT skipped FROM s)::BIGINT AS skipped FROM g WHERE kinds = 1 UNION ALL SELECT 'https://site.test/s/1', 'https://site.test/own', 301, 'config', (SELECT skipped FROM s)::BIGINT""",
    "finding_sections": f"WITH {_expected('page', 'agents')} SELECT code, CASE WHEN code LIKE 'agent-%' OR code IN ('route-not-fetched', 'robots-blocked', 'incomplete-fetch', 'unexpected-status', 'redirected-route', 'rendered-status-mismatch') THEN 'fetch-and-delivery' WHEN code LIKE '%json-ld%' OR code LIKE '%-og-%' OR code LIKE '%-og' THEN 'structured-data-and-social-metadata' ELSE 'page-signals' END AS section, count(*) AS findings FROM f GROUP BY code",
    "agent_differences": f"WITH {_expected('agents')} SELECT count(*) AS differences, count(DISTINCT url) AS routes FROM f",
    "route_rows": f"""WITH {_expected('page', 'agents')}, u AS (SELECT url, k FROM p UNION ALL SELECT url || '/', 26 FROM p WHERE k = 26),
c AS (SELECT url, count(*) AS n, min(CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END) AS r FROM f GROUP BY url)
SELECT u.url, (k <> 33)::BIGINT AS inbound, (k <> 33)::BIGINT AS outbound, coalesce(n, 0) AS findings, CASE r WHEN 0 THEN 'error' WHEN 1 THEN 'warning' WHEN 2 THEN 'info' END AS severity FROM u LEFT JOIN c USING (url)""",
    "csv_lines": f"WITH {_expected('page', 'agents')} SELECT severity || ',' || code || ',' || url || ',\"''=1+\"\"a\"\", b\",,' AS line FROM f WHERE code IN ('duplicate-title', 'redirected-route', 'agent-title-mismatch')",
    "candidate_kinds": f"""WITH {_P}, r AS (SELECT id % 100 AS c, unnest(list_filter([CASE WHEN id = 0 THEN 'seed' END, CASE WHEN id % 2 = 0 THEN 'sitemap' END, CASE WHEN id % 3 = 0 THEN 'next-build' END, CASE WHEN id % 5 = 0 THEN 'url-list' END, CASE WHEN id % 7 = 0 THEN 'redirect-contract' END], lambda x: x IS NOT NULL)) AS kind FROM p)
SELECT 'https://site.test/c/' || c AS url, string_agg(DISTINCT kind, ' ' ORDER BY kind) AS kinds FROM r GROUP BY c""",
    "chain_depths": f"WITH {_P} SELECT url, CASE WHEN (SELECT count(*) FROM p q WHERE q.id <= p.id) = id + 1 THEN id ELSE -1 END AS depth FROM p WHERE id < 12",
}


def oracles() -> dict[str, str]:
    from quarry.plans.oracles import WITH

    drawing = WITH + """, d AS (SELECT url, id, CASE WHEN depth < 0 THEN 1 << 30 ELSE depth END AS dd FROM f), t AS (SELECT * FROM d ORDER BY dd, url LIMIT 120),
l AS (SELECT s.url AS src, g.url AS dst FROM e JOIN t s ON s.id = e.src JOIN t g ON g.id = e.dst ORDER BY 1, 2 LIMIT 500)
SELECT url, row_number() OVER (PARTITION BY dd ORDER BY url) - 1 AS place, NULL::VARCHAR AS dst FROM t UNION ALL SELECT src, NULL, dst FROM l"""
    return ORACLES | {"graph_drawing": drawing}


def queries():
    return {n: globals()[n] for n in NAMES}
