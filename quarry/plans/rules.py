"""The finding catalogue: every rule family is a function from tables to rows of findings.

Tables: routes (one row per address with its primary capture; see `enrich`), agents (captures of further agents), edges
(src, dst), rendered captures (inside routes). Findings: url, code, severity, message, related, evidence, seq. `seq` reproduces the order of
evaluation (family, route, place), since de-duplication keeps the last. Flat rules of a route are one array of
candidates, filtered and exploded: one scan for all of them, no join, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.text import bands, collapse, hamming
from quarry.functions.urls import normalize_url, origin, variant_key
from quarry.operators.scopes import effective

FAMILIES = {name: k for k, name in enumerate(("inventory", "contracts", "page", "agents", "times", "graph", "groups", "soft404"))}
COLUMNS = ["url", "code", "severity", "message", "related", "evidence", "seq"]
RANK = {"error": 0, "warning": 1, "info": 2}
#: Fixed value: media types of HTML.
HTML_TYPE = r"(?i)^(text/html|application/xhtml\+xml)\b"
#: Fixed value: what a not-found page's title or heading says.
NOT_FOUND = r"(?i)(?:^|\b)(?:404|page not found|not found|does not exist)(?:\b|$)"
DEFAULTS = {
    "require_title": True, "require_description": True, "require_canonical": True, "require_h1": True, "require_sitemap_coverage": False,
    "require_open_graph": False, "require_og_image": False, "max_depth": 4, "max_response_ms": None, "max_redirect_hop_ms": None, "severities": {}, "paths": [],
}
_STRINGS, _EVIDENCE = "array<string>", "map<string,string>"


def finding(when: Column, code: str | Column, severity: str | Column, message: str | Column, place: int = 0, related: Column | None = None, **evidence) -> Column:
    """A finding if `when` holds, else null."""
    text = lambda v: v if isinstance(v, Column) else F.lit(v)
    facts = [x for k, v in evidence.items() for x in (F.lit(k), text(v).cast("string"))]
    row = F.struct(
        text(code).alias("code"), text(severity).alias("severity"), text(message).alias("message"),
        (related if related is not None else F.array().cast(_STRINGS)).cast(_STRINGS).alias("related"),
        (F.create_map(*facts) if facts else F.create_map().cast(_EVIDENCE)).cast(_EVIDENCE).alias("evidence"),
        F.lit(place).alias("place"),
    )
    return F.when(when, row)


def seq(family: str, place: Column | None = None) -> Column:
    return F.struct(F.lit(FAMILIES[family]).alias("family"), F.col("ord").cast("long").alias("ord"), (F.lit(0) if place is None else place).cast("long").alias("place"))


def emit(rows: DataFrame, family: str, *candidates: Column, place: Column | None = None) -> DataFrame:
    """The candidates that are findings, one row each."""
    f = rows.select("url", "ord", F.explode(F.filter(F.array(*candidates), lambda x: x.isNotNull())).alias("f"), *([place.alias("__at")] if place is not None else []))
    at = F.col("f.place") if place is None else F.col("__at") * 1000 + F.col("f.place")
    return f.select("url", "f.code", "f.severity", "f.message", "f.related", "f.evidence", seq(family, at).alias("seq"))


def directives(robots: Column, agent: Column) -> Column:
    """Robots tokens that hold for the agent; none means noindex and nofollow, and a negative removes its positive."""
    mine = F.filter(robots, lambda r: (r["audience"] == "robots") | (F.lower(agent).isin("googlebot", "bingbot") & (r["audience"] == F.lower(agent))))
    tokens = F.flatten(F.transform(mine, lambda r: F.split(F.lower(r["value"]), "[;,]")))
    tokens = F.filter(F.transform(tokens, lambda t: F.split(collapse(t), " ", 2)[0]), lambda t: t != "")
    tokens = F.when(F.array_contains(tokens, "none"), F.concat(tokens, F.array(F.lit("noindex"), F.lit("nofollow")))).otherwise(tokens)
    for no, yes in (("noindex", "index"), ("nofollow", "follow")):
        tokens = F.when(F.array_contains(tokens, no), F.array_remove(tokens, yes)).otherwise(tokens)
    return F.array_sort(F.array_distinct(tokens))


def indexability(completion: Column, hops: Column, status: Column, content_type: Column, tokens: Column) -> Column:
    sure = (completion == "complete") & (hops == 0) & status.between(200, 299) & (content_type.isNull() | content_type.rlike(HTML_TYPE))
    return F.when(~F.coalesce(sure, F.lit(False)), "unknown").when(F.array_contains(tokens, "noindex"), "noindex").otherwise("indexable")


def _present(signals: Column) -> Column:
    return F.filter(F.transform(signals, lambda s: collapse(s["value"])), lambda v: v != "")


def enrich_captures(captures: DataFrame, agent: str = "agent") -> DataFrame:
    """captures with hops, tokens, indexability, canonical_url, ok."""
    c = captures.withColumn("hops", F.size("redirects"))
    c = c.withColumn("tokens", directives(F.col("signals.robots"), F.col(agent)))
    c = c.withColumn("indexability", indexability(F.col("completion"), F.col("hops"), F.col("status"), F.col("content_type"), F.col("tokens")))
    first = F.get("signals.canonicals", 0)["value"]
    c = c.withColumn("snapshot_canonical", F.when(first.isNotNull(), normalize_url(first, F.col("final_url"))))
    c = c.withColumn("canonical_url", F.when(F.col("completion") == "complete", F.col("snapshot_canonical")))
    ok = (F.col("completion") == "complete") & F.col("status").between(200, 299) & (F.col("hops") == 0) & (F.col("content_type").isNull() | F.col("content_type").rlike(HTML_TYPE))
    return c.withColumn("ok", F.coalesce(ok, F.lit(False)))


def enrich(routes: DataFrame, options: dict | None = None) -> DataFrame:
    """routes with the derived columns and effective options that every rule reads; compute once and persist for a full audit."""
    return effective(enrich_captures(routes), DEFAULTS | (options or {}))


def page_rules(routes: DataFrame) -> DataFrame:
    """State, metadata, structured data, social and rendered rules of every route."""
    c, s, n = F.col("completion"), F.col("status"), F.col("hops")
    has = c.isNotNull()
    blocked, partial = c == "robots-blocked", has & ~c.isin("complete", "robots-blocked")
    go = has & (c == "complete") & s.isNotNull() & ~F.col("exempt")
    good = go & s.between(200, 299)
    state = [
        finding(~has, "route-not-fetched", "info", "No capture of the route exists."),
        finding(blocked, "robots-blocked", "info", "Robots rules keep the route from being fetched."),
        finding(partial, "incomplete-fetch", F.when(c == "max-bytes-exceeded", "warning").otherwise("error"), F.concat(F.lit("The capture did not complete: "), c), error=F.coalesce("error", c)),
        finding(has & ~blocked & s.isNull(), "missing-http-response", "error", "The capture has no HTTP status.", 1, completion=c),
        finding(go & (s >= 500), "server-error", "error", F.concat(F.lit("The server answered with HTTP "), s), status=s),
        finding(go & s.between(400, 499), "not-found", "error", F.concat(F.lit("The route answered with HTTP "), s), status=s),
        finding(go & ((s < 200) | s.between(300, 399)), "unexpected-status", "warning", F.concat(F.lit("The route answered with HTTP "), s), status=s),
        finding(good & (n > 0), "redirected-route", "warning", "The route redirects.", related=F.array("final_url"), hops=n),
        finding(good & (n == 0) & ~F.col("ok"), "non-html-route", "info", "The route is not an HTML page.", contentType=F.col("content_type")),
    ]
    ok = go & F.col("ok")
    sig = lambda k: F.col(f"signals.{k}")
    absent = lambda k: F.size(sig(k)) == 0
    meta = [
        finding(ok & F.col("require_title") & absent("titles"), "missing-title", "error", "The page has no title.", 10),
        finding(ok & F.col("require_description") & absent("descriptions"), "missing-description", "warning", "The page has no description.", 11),
        finding(ok & F.col("require_canonical") & absent("canonicals"), "missing-canonical", "error", "The page has no canonical address.", 12),
        finding(ok & F.col("require_h1") & absent("h1s"), "missing-h1", "warning", "The page has no main heading.", 13),
    ]
    canonicals = F.transform(sig("canonicals"), lambda x: F.struct(x["value"].alias("value")))
    robots = F.transform(sig("robots"), lambda r: F.struct(F.lower(F.concat(r["audience"], F.lit(":"), r["value"])).alias("value")))
    for k, (code, label, values) in enumerate((("title", "titles", _present(sig("titles"))), ("description", "descriptions", _present(sig("descriptions"))), ("canonical", "canonical addresses", _present(canonicals)), ("robots", "robots directives", _present(robots)))):
        several, kinds = F.size(values) >= 2, F.size(F.array_distinct(values))
        meta.append(finding(ok & several & (kinds == 1), f"duplicate-{code}", "warning", f"The page repeats its {label}.", 20 + k, count=F.size(values), distinctValues=kinds))
        meta.append(finding(ok & several & (kinds > 1), f"conflicting-{code}", "warning", f"The page has conflicting {label}.", 20 + k, count=F.size(values), distinctValues=kinds))
    meta += [
        finding(ok & (F.size(sig("h1s")) > 1), "multiple-h1", "warning", "The page has several main headings.", 30, count=F.size(sig("h1s"))),
        finding(ok & F.array_contains("tokens", "noindex"), "noindex", "info", "The page asks not to be indexed.", 31),
    ]
    social = lambda p: F.exists(sig("social"), lambda x: (x["property"] == p) & (F.trim(x["value"]) != ""))
    meta += [
        finding(ok & F.col("require_open_graph") & ~social("og:title"), "missing-og-title", "error", "The page has no og:title.", 60),
        finding(ok & F.col("require_open_graph") & ~social("og:description"), "missing-og-description", "warning", "The page has no og:description.", 61),
        finding(ok & F.col("require_og_image") & ~social("og:image"), "missing-og-image", "warning", "The page has no og:image.", 62),
    ]
    r = lambda k: F.col(f"rendered.{k}")
    raw_chars, seen_chars = F.coalesce(F.col("content.characters"), F.lit(0)), F.coalesce(r("content.characters"), F.lit(0))
    shown = F.col("rendered").isNotNull()
    full = ok & shown & (r("completion") == "complete")
    differs = ~r("status").eqNullSafe(s)
    live = full & F.coalesce(r("status").between(200, 299), F.lit(False))
    typed = lambda col: F.exists(col, lambda b: b["valid"] & (F.size(b["types"]) > 0))
    only = lambda k: absent(k) & (F.size(r(f"signals.{k}")) > 0)
    rendered = [
        finding(ok & ~shown & (raw_chars <= 20) & absent("titles") & absent("h1s"), "empty-ssr-shell", "warning", "The served HTML holds almost no content.", 70, characters=raw_chars),
        finding(ok & shown & (r("completion") != "complete"), "rendered-capture-incomplete", "warning", F.concat(F.lit("The rendered capture did not complete: "), r("completion")), 71),
        finding(full & differs, "rendered-status-mismatch", F.when(F.coalesce(r("status").between(200, 299), F.lit(False)) != s.between(200, 299), "error").otherwise("warning"), "Raw and rendered statuses differ.", 72, raw=s, rendered=r("status")),
        finding(live & (raw_chars < 80) & (seen_chars >= F.greatest(F.lit(200), 3 * raw_chars)), "client-only-content", "error", "The content appears only after rendering.", 73, raw=raw_chars, rendered=seen_chars),
        finding(live & only("titles"), "rendered-only-title", "error", "The title appears only after rendering.", 74),
        finding(live & only("canonicals"), "rendered-only-canonical", "error", "The canonical address appears only after rendering.", 75),
        finding(live & only("h1s"), "rendered-only-h1", "warning", "The main heading appears only after rendering.", 76),
        finding(live & ~typed(sig("structured_data")) & typed(r("signals.structured_data")), "rendered-only-json-ld", "warning", "Structured data appears only after rendering.", 77),
        finding(live & only("social"), "rendered-only-og", "warning", "Social tags appear only after rendering.", 78),
    ]
    flat = emit(routes, "page", *state, *meta, *rendered)
    pages = routes.where(ok)
    return flat.union(hreflang_rules(pages)).union(json_ld_rules(pages))


def hreflang_rules(pages: DataFrame) -> DataFrame:
    a = pages.select("url", "ord", F.posexplode("signals.hreflangs").alias("p", "h"))
    lang = F.lower(F.col("h.language"))
    bad = finding((lang != "x-default") & ~lang.rlike(r"^[a-z]{2,3}(-[a-z0-9]{2,8})*$"), "invalid-hreflang", "warning", F.concat(F.lit("Not a language code: "), F.col("h.language")), 40)
    twice = a.groupBy("url", "ord", lang.alias("lang")).agg(F.count("*").alias("n"), F.max("p").alias("p"))
    again = finding(F.col("n") >= 2, "duplicate-hreflang", "warning", F.concat(F.lit("Language given more than once: "), F.col("lang")), 41, count=F.col("n"))
    return emit(a, "page", bad, place=F.col("p")).union(emit(twice, "page", again, place=F.col("p")))


def json_ld_rules(pages: DataFrame) -> DataFrame:
    """Per block, and against earlier blocks of the page."""
    b = pages.select("url", "ord", F.posexplode("signals.structured_data").alias("p", "b"))
    first = F.min(F.when(F.col("b.valid"), F.col("p"))).over(Window.partitionBy("url", "b.sha256"))
    b = b.withColumn("twin", first)
    own = b.select("url", "p", F.explode(F.array_distinct("b.ids")).alias("id"), F.col("b.sha256").alias("sha"), F.col("b.valid").alias("v")).where("v")
    holder = F.first(F.struct("p", "sha")).over(Window.partitionBy("url", "id").orderBy("p"))
    clash = own.withColumn("h", holder).where("h.p < p and h.sha != sha").groupBy("url", "p").agg(F.min("id").alias("clash"))
    b = b.join(clash, ["url", "p"], "left")
    valid = F.col("b.valid")
    return emit(
        b, "page",
        finding(~valid, "invalid-json-ld", "warning", "A structured data block cannot be read.", 50, error=F.col("b.error")),
        finding(valid & (F.col("b.context") == "missing"), "json-ld-missing-context", "warning", "A structured data block has no context.", 51),
        finding(valid & (F.size("b.types") == 0), "json-ld-missing-type", "warning", "A structured data block has no type.", 52),
        finding(valid & (F.col("twin") < F.col("p")), "duplicate-json-ld", "warning", "A structured data block is repeated.", 53, block=F.col("p"), first=F.col("twin")),
        finding(F.col("clash").isNotNull(), "conflicting-json-ld-id", "warning", F.concat(F.lit("Blocks differ for the id "), F.col("clash")), 54, block=F.col("p")),
        place=F.col("p"),
    )


def agent_rules(routes: DataFrame, agents: DataFrame) -> DataFrame:
    """Captures of further agents (url, agent, agent_ord, capture columns) against the primary one."""
    cols = ["completion", "status", "final_url", "content_type", "redirects", "signals", "hops", "tokens", "indexability", "snapshot_canonical"]
    p = routes.select("url", "ord", *[F.col(c).alias(f"p_{c}") for c in cols])
    j = p.join(enrich_captures(agents).select("url", F.col("agent").alias("who"), "agent_ord", *cols), "url")
    c, pc, s, ps = F.col("completion"), F.col("p_completion"), F.col("status"), F.col("p_status")
    both = (c == "complete") & (pc == "complete")
    healthy = lambda x: F.coalesce(x.between(200, 399), F.lit(False))
    html = lambda pre: (F.col(f"{pre}status").between(200, 299)) & (F.col(f"{pre}content_type").isNull() | F.col(f"{pre}content_type").rlike(HTML_TYPE))
    same = both & html("") & html("p_")
    chain = lambda x: F.array_join(F.transform(x, lambda h: F.concat_ws(" ", h["status"].cast("string"), h["location"])), "|")
    one = lambda pre, k: collapse(F.get(F.col(f"{pre}signals.{k}"), 0)["value"])
    unlike = lambda a, b: ~a.eqNullSafe(b)
    say = lambda text: F.concat(F.lit(f"{text} for agent "), F.col("who"))
    return emit(
        j, "agents",
        finding(c != "complete", "agent-incomplete-fetch", F.when(c.isin("max-bytes-exceeded", "robots-blocked"), "warning").otherwise("error"), say("Incomplete capture"), 0, completion=c),
        finding(c != pc, "agent-fetch-mismatch", F.when((c == "robots-blocked") != (pc == "robots-blocked"), "error").otherwise("warning"), say("Another outcome of the fetch"), 1, primary=pc, secondary=c),
        finding(both & unlike(s, ps), "agent-status-mismatch", F.when(healthy(s) != healthy(ps), "error").otherwise("warning"), say("Another status"), 2, primary=ps, secondary=s),
        finding(both & (unlike(F.col("final_url"), F.col("p_final_url")) | (chain(F.col("redirects")) != chain(F.col("p_redirects")))), "agent-redirect-mismatch", "warning", say("Other redirects"), 3, primary=F.col("p_final_url"), secondary=F.col("final_url")),
        finding(both & unlike(F.lower("content_type"), F.lower("p_content_type")), "agent-content-type-mismatch", "warning", say("Another content type"), 4),
        finding(same & unlike(one("", "titles"), one("p_", "titles")), "agent-title-mismatch", "warning", say("Another title"), 5),
        finding(same & unlike(one("", "descriptions"), one("p_", "descriptions")), "agent-description-mismatch", "warning", say("Another description"), 6),
        finding(same & unlike(F.col("snapshot_canonical"), F.col("p_snapshot_canonical")), "agent-canonical-mismatch", "warning", say("Another canonical address"), 7),
        finding(same & (F.col("tokens") != F.col("p_tokens")), "agent-robots-mismatch", F.when(F.col("indexability") != F.col("p_indexability"), "error").otherwise("warning"), say("Other robots directives"), 8),
        place=F.col("agent_ord"),
    )


def graph_rules(routes: DataFrame, edges: DataFrame, base_url: str | None = None, truncated: bool = False) -> DataFrame:
    """Depth, sitemap, canonical, link and hreflang rules; runs for every route, contract sources included."""
    out = edges.select(F.col("src").alias("url")).distinct().withColumn("linked", F.lit(True))
    r = routes.join(out, "url", "left")
    index, done = F.col("indexability") == "indexable", F.col("completion") == "complete"
    unseen = "info" if truncated else "warning"
    flat = emit(
        r, "graph",
        finding((F.col("depth") >= 0) & (F.col("depth") > F.col("max_depth")) & index, "deep-route", "warning", "The page is many links away from the start.", 0, depth=F.col("depth")),
        finding((F.col("depth") < 0) & (F.col("url") != F.lit(base_url or "")) & (F.col("in_sitemap") | F.col("in_build")) & index, "orphan-route", "warning", "No path of links leads to the page.", 1),
        finding(F.col("linked").isNull() & index, "dead-end-route", "info", "The page links to no other.", 2),
        finding(F.col("require_sitemap_coverage") & index & ~F.col("in_sitemap"), "not-in-sitemap", "warning", "No sitemap lists the page.", 3),
        finding(F.col("in_sitemap") & done & (F.col("hops") > 0), "sitemap-redirect", "error", "A sitemap lists a redirect.", 4, related=F.array("final_url")),
        finding(F.col("in_sitemap") & done & (F.col("status") >= 400), "sitemap-broken-url", "error", "A sitemap lists a broken page.", 5, status=F.col("status")),
        finding(F.col("in_sitemap") & (F.col("indexability") == "noindex"), "sitemap-noindex", "error", "A sitemap lists a page kept from the index.", 6),
        finding(F.col("in_sitemap") & (F.col("completion") == "robots-blocked"), "sitemap-robots-blocked", "error", "A sitemap lists a page that robots rules block.", 7),
        finding(F.col("canonical_url") != F.regexp_replace("final_url", "#.*$", ""), "non-self-canonical", "warning", "The canonical address is another page.", 8, related=F.array("canonical_url")),
    )
    target = routes.select(
        F.col("url").alias("dst"), F.col("completion").alias("t_completion"), F.col("status").alias("t_status"), F.col("hops").alias("t_hops"),
        F.col("indexability").alias("t_indexability"), F.col("final_url").alias("t_final"), F.lit(True).alias("known"),
    )
    t_done = F.col("t_completion") == "complete"
    there, new = F.col("known").isNotNull(), F.array("dst")
    canonical = routes.where("canonical_url is not null").select("url", "ord", F.col("canonical_url").alias("dst")).where(origin(F.col("dst")) == origin(F.col("url")))
    canonical = canonical.join(target, "dst", "left")
    canon = emit(
        canonical, "graph",
        finding(~there, "canonical-target-unseen", unseen, "The canonical target is not among the routes.", 10, new),
        finding(there & t_done & (F.col("t_status") >= 400), "broken-canonical-target", "error", "The canonical target is broken.", 11, new, status=F.col("t_status")),
        finding(there & t_done & (F.col("t_hops") > 0), "redirecting-canonical-target", "warning", "The canonical target redirects.", 12, new),
        finding(there & (F.col("t_indexability") == "noindex"), "noindex-canonical-target", "error", "The canonical target is kept from the index.", 13, new),
    )
    # The narrow edge list meets only the targets that are broken, moved or kept from the index: a page that all others link to is out before the join.
    broken = t_done & (F.col("t_status") >= 400)
    moved = t_done & (F.col("t_hops") > 0)
    bad = target.where(broken | moved | (F.col("t_indexability") == "noindex"))
    link = edges.select("src", "dst").join(bad, "dst").join(routes.select(F.col("url").alias("src"), F.col("url"), "ord"), "src")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    link = link.withColumn("nth", rank)
    links = emit(
        link, "graph",
        finding(broken, "broken-internal-link", "error", F.concat(F.lit("A link leads to HTTP "), F.col("t_status")), 20, new, status=F.col("t_status")),
        finding(~F.coalesce(broken, F.lit(False)) & moved, "redirecting-internal-link", "warning", "A link leads to a redirect.", 20, new),
        finding(~F.coalesce(broken, F.lit(False)) & ~F.coalesce(moved, F.lit(False)) & (F.col("t_indexability") == "noindex"), "internal-link-to-noindex", "warning", "A link leads to a page kept from the index.", 20, new),
        place=F.col("nth"),
    )
    alt = routes.where("completion = 'complete'").select("url", "ord", F.posexplode("signals.hreflangs").alias("p", "h")).select("url", "ord", "p", F.regexp_replace("h.resolved_url", "#.*$", "").alias("dst"))
    near = alt.where("dst is not null").where(origin(F.col("dst")) == origin(F.col("url"))).join(target, "dst", "left")
    back = alt.select(F.col("url").alias("dst"), F.col("dst").alias("url")).distinct().withColumn("returned", F.lit(True))
    near = near.join(back, ["dst", "url"], "left")
    alternates = emit(
        near, "graph",
        finding(~there, "hreflang-target-unseen", unseen, "A language alternate is not among the routes.", 30, new),
        finding(there & (F.col("t_indexability") == "noindex"), "hreflang-target-noindex", "error", "A language alternate is kept from the index.", 31, new),
        finding(there & t_done & F.col("returned").isNull() & (F.col("dst") != F.col("url")), "hreflang-missing-return-link", "warning", "A language alternate does not lead back.", 32, new),
        place=F.col("p"),
    )
    return flat.union(canon).union(links).union(alternates)


#: Kinds of groups: code and message.
GROUPS = (
    ("duplicate-canonical-target", "Several pages share a canonical address."),
    ("duplicate-title-across-routes", "Several pages share a title."),
    ("duplicate-description-across-routes", "Several pages share a description."),
    ("duplicate-content-across-routes", "Several pages have the same content."),
    ("route-case-or-slash-variant", "Addresses differ only by case or a trailing slash."),
)


def _group_keys(routes: DataFrame) -> DataFrame:
    """url, ord, kind (place in GROUPS), key of every route and kind that has a key."""
    first = lambda k: F.lower(collapse(F.get(F.col(f"signals.{k}"), 0)["value"]))
    index = F.col("indexability") == "indexable"
    keys = (
        F.when(index, F.col("canonical_url")), F.when(index, F.nullif(first("titles"), F.lit(""))), F.when(index, F.nullif(first("descriptions"), F.lit(""))),
        F.when(index & (F.col("content.words") >= 20), F.col("content.sha256")), variant_key(F.col("url")),
    )
    keyed = routes.select("url", "ord", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), key.alias("key")) for k, key in enumerate(keys)])).alias("g"))
    return keyed.select("url", "ord", "g.kind", "g.key").where("key is not null")


def group_members(routes: DataFrame) -> DataFrame:
    """code, representative, url, routes: one row a member of a group of two or more. The representative (the first route) and the size come from partial
    aggregates, so no row or task holds a whole group; `group_rules` lists the members in one row, as a report shows them."""
    keyed = _group_keys(routes)
    groups = keyed.groupBy("kind", "key").agg(F.min(F.struct("ord", "url"))["url"].alias("representative"), F.count("*").alias("routes")).where("routes >= 2")
    code = F.get(F.array(*[F.lit(c) for c, _ in GROUPS]), F.col("kind"))
    return keyed.join(groups, ["kind", "key"]).select(code.alias("code"), "representative", "url", "routes")


def group_rules(routes: DataFrame) -> DataFrame:
    """Routes that share a canonical, title, description, content or differ only by case or slash. Keys are counted by partial aggregates first, so only routes of real groups are gathered."""
    keyed = _group_keys(routes)
    shared = keyed.groupBy("kind", "key").count().where("count >= 2").drop("count")
    groups = keyed.join(shared, ["kind", "key"]).groupBy("kind", "key").agg(F.array_sort(F.collect_list(F.struct("ord", "url"))).alias("m"))
    g = groups.select("kind", F.col("m")[0]["url"].alias("url"), F.col("m")[0]["ord"].alias("ord"), F.transform("m", lambda x: x["url"]).alias("urls"))
    rest = F.slice("urls", 2, F.greatest(F.size("urls") - 1, F.lit(1)))
    return emit(g, "groups", *[finding(F.col("kind") == k, code, "warning", text, k, rest, routes=F.size("urls")) for k, (code, text) in enumerate(GROUPS)])


def time_rules(routes: DataFrame, options: dict | None = None) -> DataFrame:
    """Slow routes, and slow redirect hops by the scope of the hop's own address."""
    options = DEFAULTS | (options or {})
    ms = lambda c: F.round(c).cast("long").cast("string")
    spent = F.col("duration_ms")
    slow = finding(
        (F.col("completion") == "complete") & (spent > F.col("max_response_ms")), "slow-route", "warning",
        F.concat(F.lit("The page took "), ms(spent), F.lit(" ms; its budget is "), F.col("max_response_ms").cast("string"), F.lit(" ms.")), 1000,
        durationMs=ms(spent), budgetMs=F.col("max_response_ms"),
    )
    hop = routes.select("ord", F.posexplode("redirects").alias("p", "h")).select("ord", "p", F.col("h.url").alias("url"), F.col("h.duration_ms").alias("ms"), F.col("h.status").alias("status"), F.col("h.location").alias("location"))
    hop = effective(hop, options)
    budget = F.col("max_redirect_hop_ms")
    late = finding(
        F.col("ms") > budget, "slow-redirect", "warning",
        F.concat(F.lit("A redirect with HTTP "), F.col("status").cast("string"), F.lit(" took "), ms(F.col("ms")), F.lit(" ms; its budget is "), budget.cast("string"), F.lit(" ms.")), 0,
        F.array("location"), durationMs=ms(F.col("ms")), budgetMs=budget, status=F.col("status"),
    )
    return emit(hop, "times", late, place=F.col("p")).union(emit(routes, "times", slow, place=F.lit(1 << 20)))


def soft_404_rules(routes: DataFrame) -> DataFrame:
    """Successful pages that equal or resemble a captured 404 or 410 page (the first matching one by route order), or look like one.

    Equal digests join directly; resembling ones meet in keys of three of the 64-bit hash's six blocks, which loses none within
    distance 3. Reference pages that share digest, hash and length are one candidate (the first), so copies do not multiply.
    """
    c = F.col("content")
    p = routes.select("url", "ord", "status", "completion", "ok", c["sha256"].alias("sha"), c["simhash"].alias("sim"), c["words"].alias("words"), c["characters"].alias("chars"))
    refs = p.where("completion = 'complete' and status in (404, 410) and words >= 8")
    refs = refs.groupBy(F.col("sha").alias("r_sha"), F.col("sim").alias("r_sim"), F.col("chars").alias("r_chars")).agg(F.min(F.struct("ord", "url", "status")).alias("ref"))
    pages = p.where("ok and words >= 8")
    exact = pages.join(refs.groupBy("r_sha").agg(F.min_by(F.struct("ref", "r_sim"), "ref").alias("m")), F.col("sha") == F.col("r_sha")).select("url", "ord", F.col("m.ref").alias("ref"), F.lit(True).alias("same"), hamming(F.col("sim"), F.col("m.r_sim")).alias("d"))
    a = pages.where("words >= 15").withColumn("b", F.explode(bands(F.col("sim"))))
    b = refs.withColumn("b", F.explode(bands(F.col("r_sim"))))
    ratio = F.col("chars") / F.greatest(F.lit(1), F.col("r_chars"))
    close = a.join(b, "b").where((hamming(F.col("sim"), F.col("r_sim")) <= 3) & ratio.between(0.75, 1.25) & (F.col("sha") != F.col("r_sha")))
    near = close.select("url", "ord", "ref", F.lit(False).alias("same"), hamming(F.col("sim"), F.col("r_sim")).alias("d"))
    hit = exact.union(near).groupBy("url").agg(F.min_by(F.struct("ref", "same", "d"), "ref").alias("m"))
    r = routes.where("ok").join(hit, "url", "left")
    title = F.concat_ws(" ", F.get("signals.titles", 0)["value"], F.get("signals.h1s", 0)["value"])
    looks = title.rlike(NOT_FOUND) & (F.coalesce(c["characters"], F.lit(0)) <= 2000)
    found, ref = F.col("m").isNotNull(), F.array("m.ref.url")
    return emit(
        r, "soft404",
        finding(found & F.col("m.same"), "soft-404", "error", "The page equals a captured not-found page.", 0, ref, status=F.col("status"), referenceStatus=F.col("m.ref.status"), simhashDistance=F.col("m.d")),
        finding(found & ~F.col("m.same"), "possible-soft-404", "warning", "The page nearly equals a captured not-found page.", 0, ref, status=F.col("status"), referenceStatus=F.col("m.ref.status"), simhashDistance=F.col("m.d")),
        finding(~found & looks, "possible-soft-404", "warning", "The page's title or heading reads like a not-found page.", 0, status=F.col("status")),
    )


def inventory_rules(runs: DataFrame) -> DataFrame:
    """runs(url, ord, truncated, delay_ms, robots_delay_seconds, clamped, sitemap_warnings, robots_warnings, build_warnings, unresolved_patterns)."""
    flat = emit(
        runs, "inventory",
        finding(F.col("robots_delay_seconds").isNotNull(), "crawl-policy", F.when(F.col("clamped"), "warning").otherwise("info"), "Robots rules set the pace of the crawl.", 0, delayMs=F.col("delay_ms"), robotsDelaySeconds=F.col("robots_delay_seconds")),
        finding(F.col("truncated"), "page-budget-reached", "warning", "The crawl stopped at its budget.", 9),
    )
    for k, (column, code, severity) in enumerate((("sitemap_warnings", "sitemap-warning", "warning"), ("robots_warnings", "robots-warning", "warning"), ("build_warnings", "next-discovery-warning", "warning"), ("unresolved_patterns", "next-dynamic-route-needs-sample", "info"))):
        rows = runs.select("url", "ord", F.posexplode(column).alias("p", "text"))
        flat = flat.union(emit(rows, "inventory", finding(F.lit(True), code, severity, F.col("text"), k + 1), place=F.col("p")))
    return flat
