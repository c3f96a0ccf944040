"""Named queries of the audit engine and their DuckDB equivalents.

Each callable takes (spark, sf_dir). Extraction, text and captured_ queries read real pages and documents; the others read the
synthetic views of `derived`. The SQL restates the rules directly, with no code shared beyond the views' text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text, urls
from quarry.operators import candidates, crawl, near, robots
from quarry.operators.shared import cut
from quarry.plans import audit, compare, contracts, derived, post, rules, variants
from quarry.sinks import reports
from quarry.sources import captures

OPTIONS = {
    "require_sitemap_coverage": True, "require_open_graph": True, "max_depth": 4, "max_response_ms": 1500, "max_redirect_hop_ms": 500,
    "severities": {"dead-end-route": "off", "multiple-h1": "info"},
    "paths": [
        {"include": ["/p/1*"], "max_response_ms": 800, "severities": {"missing-title": "warning", "multiple-h1": "error"}},
        {"include": ["/p/2**"], "exclude": ["/p/2?"], "require_h1": False, "severities": {"duplicate-title-across-routes": "error"}},
    ],
}


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return captures.extract(spark.read.parquet(f"{d}/pages.parquet"))


def _routes(spark: SparkSession, d: str) -> DataFrame:
    """The audit base: derived columns and options computed once, then read by every rule."""
    return cut(rules.enrich(derived.routes(spark, d), OPTIONS))


def _keys(findings: DataFrame) -> DataFrame:
    return findings.select("url", "code", "severity")


# --- extraction and text -----------------------------------------------------------------------------------------


def page_signals(spark, d):
    s = _pages(spark, d)
    return s.select("page_id", F.col("signals.titles")[0]["value"].alias("title"), F.size("signals.h1s").cast("long").alias("h1s"), F.size("signals.links").cast("long").alias("links"), F.col("signals.html_lang").alias("lang"))


def page_links(spark, d):
    s = _pages(spark, d).select("page_id", F.posexplode("signals.links").alias("position", "l"))
    return s.select("page_id", F.col("position").cast("long").alias("position"), F.col("l.href").alias("href"), F.col("l.text").alias("label"))


def resolved_links(spark, d):
    """Every link of every page, of whatever form."""
    s = _pages(spark, d).select("page_id", F.explode("signals.links").alias("l"))
    return s.groupBy(F.col("l.resolved_url").alias("url")).agg(F.count("*").alias("links"), F.count_distinct("page_id").alias("pages"))


def duplicate_titles(spark, d):
    t = F.lower(text.collapse(F.col("signals.titles")[0]["value"]))
    g = _pages(spark, d).select("page_id", t.alias("title")).where("title != ''").groupBy("title")
    return g.agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page")).where("pages >= 2")


def content_fingerprint(spark, d):
    e = _documents(spark, d).select("doc_id", text.evidence(F.col("text")).alias("e"))
    return e.select("doc_id", F.col("e.characters").cast("long").alias("characters"), F.col("e.words").cast("long").alias("words"), "e.sha256")


def duplicate_content(spark, d):
    n = _documents(spark, d).select("doc_id", text.normalized(F.col("text")).alias("t"))
    n = n.select("doc_id", F.sha2("t", 256).alias("sha256"), F.size(text.words(F.col("t"))).alias("words")).where("words >= 20")
    return n.groupBy("sha256").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc")).where("documents >= 2")


def simhash(spark, d):
    e = _documents(spark, d).select("doc_id", text.evidence(F.col("text")).alias("e"))
    return e.select("doc_id", text.simhash_hex(F.col("e.simhash")).alias("simhash"))


def near_duplicates(spark, d):
    e = cut(_documents(spark, d).select("doc_id", text.evidence(F.col("text")).alias("e")).select("doc_id", "e.simhash", "e.words", "e.characters"))
    return near.pairs(e.where("words >= 15"), "doc_id").select("a", "b", F.col("distance").cast("long").alias("distance"))


def url_variants(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url")
    twins = p.select("page_id", F.explode(F.array(F.col("url"), F.when(F.col("page_id") % 5 == 0, F.regexp_replace("url", r"^(https?://[^/]+)(/[^?]*)", "$1$2/")))).alias("url")).where("url is not null")
    return twins.groupBy(urls.variant_key(F.col("url")).alias("signature")).agg(F.count_distinct("url").alias("urls")).where("urls >= 2")


def url_normalization(spark, d):
    """Every page's address, whatever its form: as it is, and from a spelling with capitals, dot segments and a fragment."""
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url")
    parts = lambda k: F.regexp_extract("url", "^(https?://[^/?#]+)([^#]*)", k)
    messy = F.when(parts(1) == "", F.col("url")).otherwise(F.concat(F.upper(parts(1)), F.lit("/x/../."), parts(2), F.lit("#part")))
    return p.select("page_id", urls.normalize_url(F.col("url"), F.col("url")).alias("url"), urls.normalize_url(messy, F.col("url")).alias("respelled"), urls.normalize_url(messy, F.col("url"), "drop").alias("bare"))


def redaction(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.concat(F.lit("https://user:pw@host.test/p/"), F.col("page_id"), F.lit("?token=abc&page="), F.col("page_id")).alias("url"))
    return p.select("page_id", urls.redact_url(F.col("url")).alias("url"), urls.redact_error_text(F.concat(F.lit("failed: "), F.col("url"), F.lit(", key s3cret.")), ("s3cret",)).alias("message"))


# --- rules over the synthetic audit ---------------------------------------------------------------------------------


def page_findings(spark, d):
    return _keys(rules.page_rules(_routes(spark, d)))


def agent_findings(spark, d):
    return _keys(rules.agent_rules(_routes(spark, d), derived.agents(spark, d)))


def graph_findings(spark, d):
    f = rules.graph_rules(_routes(spark, d), derived.edges(spark, d), derived.BASE + "0")
    return _keys(post.deduplicate(f))


def group_findings(spark, d):
    return rules.group_rules(_routes(spark, d)).select("url", "code", "severity", (F.size("related") + 1).cast("long").alias("routes"))


def group_members(spark, d):
    return rules.group_members(_routes(spark, d)).select("code", "representative", "url", "routes")


def time_findings(spark, d):
    return _keys(rules.time_rules(_routes(spark, d), OPTIONS))


def soft_404_findings(spark, d):
    return rules.soft_404_rules(_routes(spark, d)).select("url", "code", "severity", F.col("related")[0].alias("reference"))


def indexability(spark, d):
    return _routes(spark, d).select("url", "indexability")


def _all(spark, d) -> DataFrame:
    r = _routes(spark, d)
    parts = [rules.page_rules(r), rules.agent_rules(r, derived.agents(spark, d)), rules.time_rules(r, OPTIONS), rules.graph_rules(r, derived.edges(spark, d), derived.BASE + "0"), rules.group_rules(r), rules.soft_404_rules(r)]
    return reduce(DataFrame.union, parts)


def findings_ordered(spark, d):
    return post.ordered(cut(post.finish(_all(spark, d), OPTIONS))).select("severity", "url", "code", "message", "related", reports.evidence_text(F.col("evidence")).alias("evidence"))


def finding_counts(spark, d):
    return post.finish(_all(spark, d), OPTIONS).groupBy("code", "severity").agg(F.count("*").alias("findings"))


def scoped_severity(spark, d):
    r = _routes(spark, d)
    return _keys(post.finish(rules.page_rules(r).union(rules.group_rules(r)), OPTIONS))


def summary(spark, d):
    r = _routes(spark, d)
    f = post.deduplicate(rules.graph_rules(r, derived.edges(spark, d), derived.BASE + "0"))
    return post.summarize(r, f)


def sarif_rules(spark, d):
    return reports.sarif_rules(post.finish(_all(spark, d), OPTIONS)).select("code", "level", "results")


def csv_rows(spark, d):
    return reports.csv_rows(rules.time_rules(_routes(spark, d), OPTIONS)).select("severity", "code", "url", "related_urls", "evidence")


def incomplete_reasons(spark, d):
    return reports.incomplete(derived.routes(spark, d))


# --- rules over the real pages; statuses, redirects, sitemaps and times, which pages do not hold, stay in the synthetic audit ---


def _captured(spark, d) -> DataFrame:
    """The audit base of the whole pages table, as `audit.from_pages` captures it; these rules read no depths, so no links."""
    shots = cut(audit.from_pages(spark.read.parquet(f"{d}/pages.parquet")))
    return audit.routes_of(shots, spark.createDataFrame([], "src string, dst string"), [], OPTIONS)


def captured_page_findings(spark, d):
    return _keys(rules.page_rules(_captured(spark, d)))


def captured_group_findings(spark, d):
    return rules.group_rules(_captured(spark, d)).select("url", "code", "severity", (F.size("related") + 1).cast("long").alias("routes"))


def captured_soft_404_findings(spark, d):
    return rules.soft_404_rules(_captured(spark, d)).select("url", "code", "severity", F.get("related", F.lit(0)).alias("reference"))


# --- graph, robots, candidates, contracts, comparison -----------------------------------------------------------------


def crawl_depth(spark, d):
    nodes = derived.facts(spark, d).select("url")
    seeds = spark.createDataFrame([(derived.BASE + "0",)], "url string")
    return crawl.depths(nodes, derived.edges(spark, d), seeds).select("url", F.col("depth").cast("long").alias("depth"))


def bounded_crawl(spark, d):
    seeds = spark.createDataFrame([(derived.BASE + "0", 0, 0)], "url string, depth int, priority int")
    shots = derived.facts(spark, d).select("url", "completion", "status")
    seen, _, _ = crawl.crawl(seeds, shots, derived.edges(spark, d), 40, 6)
    return seen.select("url", F.col("depth").cast("long").alias("depth"))


_RULES = (("*", "disallow", "/p/1*3"), ("*", "allow", "/p/1"), ("*", "disallow", "/p/2$"), ("googlebot", "disallow", "/p/4"), ("googlebot", "allow", "/p/44"), ("googlebot", "disallow", "/p/*7$"))


def robots_decision(spark, d):
    rows = [("https://site.test", k, [a], None, w, p) for k, (a, w, p) in enumerate(_RULES)]
    table = spark.createDataFrame(rows, "origin string, group_ord int, agents array<string>, delay double, directive string, pattern string")
    state = spark.createDataFrame([("https://site.test", "available")], "origin string, state string")
    u = derived.facts(spark, d).select("url")
    out = [robots.decide(u, table, state, a).select("url", F.lit(a).alias("agent"), "allowed") for a in ("Googlebot/2.1", "Other")]
    return out[0].union(out[1])


def candidate_merge(spark, d):
    f = derived.facts(spark, d)
    row = lambda ref, depth, kind, keep, mode="CAST(NULL AS STRING)", site="false": f.where(keep).selectExpr(f"{ref} AS reference", f"{depth} AS depth", f"'{kind}' AS kind", "CAST(NULL AS STRING) AS source", f"concat('{kind}', CAST(id % 3 AS STRING)) AS detail", "1 AS priority", f"{site} AS in_sitemap", f"{mode} AS render_mode", "id AS seq")
    rows = candidates.union_inventories(
        row("concat('/p/x/../', CAST(id AS STRING), '#frag')", "0", "sitemap", "id % 2 = 0", site="true"),
        row("concat('https://SITE.test:443/p/', CAST(id % 50 AS STRING))", "1", "build", "id % 3 = 0", "CAST(IF(id % 2 = 0, 'static', 'isr') AS STRING)"),
        row("concat('https://other.test/p/', CAST(id AS STRING))", "0", "list", "id % 5 = 0"),
        row("concat('/p/', CAST(id AS STRING), '?b=2&a=', CAST(id AS STRING))", "2", "list", "id % 7 = 0"),
    )
    m = candidates.merge(rows, "https://site.test/", exclude=["/p/3*"])
    return m.select("url", F.col("depth").cast("long").alias("depth"), F.size("sources").cast("long").alias("sources"), "in_sitemap", "render_mode")


def _contracts(spark, d):
    f = derived.facts(spark, d).where("id % 17 in (9, 3)")
    return f.selectExpr("url AS `from`", "concat('https://site.test/p/', CAST(IF(id % 4 = 0, (id + 3) % n, (id + 1) % n) AS STRING)) AS `to`", "CAST(IF(id % 5 = 0, 308, 301) AS INT) AS status", "CAST(IF(id % 6 = 0, 0, 1) AS INT) AS max_hops", "'exact' AS kind", "'config' AS source", "CAST(NULL AS STRING) AS declared_pattern", "CAST(id AS INT) AS ord")


def redirect_contracts(spark, d):
    f, _ = contracts.audit(_contracts(spark, d), _routes(spark, d))
    return _keys(f)


def contract_outcomes(spark, d):
    _, checks = contracts.audit(_contracts(spark, d), _routes(spark, d))
    return contracts.outcomes(checks)


def redirect_patterns(spark, d):
    patterns = [{"from": "https://site.test/p/*/*", "to": "https://site.test/q/*/*", "status": 301}, {"from": "https://site.test/p/*", "to": "https://site.test/new/*", "status": 301}, {"from": "https://site.test/docs/**", "to": "https://site.test/d/**", "status": 308}]
    found, lost = contracts.expand(patterns, derived.facts(spark, d).select("url"))
    return found.select("from", "to", "declared_pattern").union(lost.select(F.lit(None).cast("string"), F.lit(None).cast("string"), "declared_pattern"))


def report_diff(spark, d):
    b, c = (compare.profile(rules.enrich_captures(x)) for x in (derived.baseline(spark, d), derived.current(spark, d)))
    return compare.route_changes(b, c)


def _two(spark, d):
    b, c = (cut(rules.enrich(x, OPTIONS)) for x in (derived.baseline(spark, d), derived.current(spark, d)))
    harder = F.when((F.col("code") == "missing-description") & F.endswith(F.col("url"), F.lit("5")), "error").otherwise(F.col("severity"))
    return rules.page_rules(b), rules.page_rules(c).withColumn("severity", harder)


def finding_diff(spark, d):
    b, c = _two(spark, d)
    return compare.finding_changes(b, c).select("url", "kind", "code", "severity")


def changed_only(spark, d):
    b, c = _two(spark, d)
    return compare.changed_only(c, b)[0].select("url", "code", "severity", "change")


def changed_counts(spark, d):
    b, c = _two(spark, d)
    return compare.changed_only(c, b)[1]


def events_first_wins(spark, d):
    """First occurrence per key, as inventories merge, over the events table."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.min(F.struct("ts", "event_id"))["event_id"].alias("event_id"))


_NAMES = """page_signals page_links resolved_links duplicate_titles content_fingerprint duplicate_content simhash near_duplicates
url_variants url_normalization redaction page_findings agent_findings graph_findings group_findings group_members time_findings soft_404_findings
indexability findings_ordered finding_counts scoped_severity summary sarif_rules csv_rows incomplete_reasons crawl_depth bounded_crawl
robots_decision candidate_merge redirect_contracts contract_outcomes redirect_patterns report_diff finding_diff changed_only changed_counts
events_first_wins
captured_page_findings captured_group_findings captured_soft_404_findings""".split()


def queries():
    return {n: globals()[n] for n in _NAMES} | variants.queries()


def oracle_sql():
    from quarry.plans.oracles import ORACLES

    return dict(ORACLES) | variants.oracles()
