"""Expectations of the audit functions and sources, and the queries against DuckDB."""

import os

import pytest

from quarry.functions import html, patterns, urls
from quarry.operators import crawl
from quarry.plans import catalogue, compare
from quarry.sinks import reports
from quarry.sources import builds, configuration, robots_txt, sitemaps, url_lists

TINY = "/root/testdata/sf0.001"


def test_urls():
    assert urls.normalize("../guide?b=2&a=1#part", "https://example.test:443/docs/page") == "https://example.test/guide?b=2&a=1"
    assert urls.normalize_candidate(" /a/../b?z=2&a=1#section ", "https://EXAMPLE.com:443/base", "drop") == "https://example.com/b"
    assert urls.normalize_candidate("/b?z=2&a=1#section", "https://EXAMPLE.com:443/base") == "https://example.com/b?a=1&z=2"
    assert all(urls.normalize_candidate(x, "https://example.com/") is None for x in ("mailto:a@b.c", "https://u:p@example.com/", "/a\nb"))
    assert urls.redact("https://a:b@x.test/p?token=1&x=2") == "https://redacted:redacted@x.test/p?token=%5Bredacted%5D&x=2"


@pytest.mark.parametrize(("pattern", "path", "captures"), [("/docs/**", "/docs/a/", ("a/",)), ("/docs/**", "/docs/", ("",)), ("/blog/old/*", "/blog/old/hello", ("hello",)), ("/blog/old/*", "/blog/old/a/b", None), ("/blog/old/*", "/blog/old", None)])
def test_redirect_patterns(pattern, path, captures):
    import re

    m = re.match(patterns.redirect_source("https://example.test" + pattern)[1], path)
    assert (m and m.groups()) == captures


def test_headers_and_pages():
    got = [(r["audience"], r["value"]) for r in html.robots_header("noarchive, googlebot: noindex, nofollow, bingbot: max-snippet: 0, noimageindex")]
    assert got == [("robots", "noarchive"), ("googlebot", "noindex"), ("googlebot", "nofollow"), ("bingbot", "max-snippet: 0"), ("bingbot", "noimageindex")]
    p = html.parse_page('<title></title><meta name=description content=""><link rel=canonical href=""><h1></h1><a href="/x" aria-label="L"><script>1</script></a><template><template></template><a href=q>z</a></template>', "https://e.t/a")
    assert [len(p[k]) for k in ("titles", "descriptions", "canonicals", "h1s", "links")] == [1] * 5 and p["links"][0]["text"] == "L"
    a, b, c = (html.json_ld(x) for x in ('{"@type": ["Product", "Thing"], "offers": {"@type": "Offer"}}', '{"@type":["Product","Thing"],"offers":{"@type":"Offer"}}', '{"@type": ["Product ", "Thing"]}'))
    assert a["types"] == ["Product", "Thing"] and a["sha256"] == b["sha256"] != c["sha256"] and not html.json_ld("[1]")["valid"]


def test_robots_text():
    r = robots_txt.parse("﻿User-agent: a # x\nUser-agent: b\nDisallow: /p\nCrawl-delay: 2\nUser-agent: *\nAllow: /\nRequest-rate: 1/10\nSitemap: /s.xml#f\nOdd: 1", "https://e.t/robots.txt")
    assert [(g["agents"], g["delay"]) for g in r["groups"]] == [(["a", "b"], 2.0), (["*"], 10.0)] and r["sitemaps"] == ["https://e.t/s.xml"] and len(r["warnings"]) == 1
    assert robots_txt.parse_delay("request-rate", "6/m") == 10
    assert [robots_txt.availability(*a) for a in ((404, None, None), (503, None, None), (200, b"\xff", None), (None, None, "timeout"), (200, b"", None))] == [("missing", None), ("unavailable", "http-error"), ("unavailable", "parse-error"), ("unavailable", "timeout"), ("available", None)]


def test_sitemaps_follow_an_index_with_a_loop(spark):
    index = "<sitemapindex><sitemap><loc>https://e.t/b.xml</loc></sitemap><sitemap><loc>https://e.t/a.xml</loc></sitemap></sitemapindex>"
    leaf = '<u:urlset xmlns:u="http://www.sitemaps.org/schemas/sitemap/0.9"><u:url><u:loc>https://e.t/x?one=1&amp;two=2</u:loc></u:url><u:url><u:loc>mailto:x</u:loc></u:url></u:urlset>'
    files = spark.createDataFrame([("https://e.t/a.xml", index), ("https://e.t/b.xml", leaf)], "url string, xml string")
    got, entries, warnings = sitemaps.follow(spark.createDataFrame([("https://e.t/a.xml", 0)], "url string, ord int"), files)
    assert got.count() == 2 and [r.url for r in entries.collect()] == ["https://e.t/x?one=1&two=2"] and warnings.count() == 1


def test_url_lists(spark):
    lines = ["# note", "", "/a?b=2&a=1", "https://e.t/a?a=1&b=2", "mailto:x@y", "https://u:p@e.t/", "https://other.test/", "http://[bad"]
    rows = spark.createDataFrame([("f", k + 1, t) for k, t in enumerate(lines)], "source string, line int, text string")
    entries, diagnostics, counts = url_lists.load(rows, "https://e.t/")
    assert [(r.url, r.line) for r in entries.collect()] == [("https://e.t/a?a=1&b=2", 3)]
    assert {r.line: r.code for r in diagnostics.collect()} == {5: "unsupported-protocol", 6: "credentials-not-allowed", 7: "off-origin", 8: "invalid-entry"}
    assert [(r.accepted, r.rejected) for r in counts.collect()] == [(1, 4)]


def test_builds(spark):
    found = builds.discover({"prerender-manifest.json": '{"routes": {"/": {"initialRevalidateSeconds": false}, "/isr": {"initialRevalidateSeconds": 60}}}', "routes-manifest.json": '{"staticRoutes": [{"page": "/isr"}, {"page": "/about"}], "dynamicRoutes": [{"page": "/shop/[id]"}], "redirects": [{"source": "/o", "destination": "/n", "permanent": true}]}', "pages-manifest.json": "[]"})
    assert {r.pathname: r.render_mode for r in builds.strongest(spark, found).collect()} == {"/": "static", "/isr": "isr", "/about": "dynamic"}
    assert found["patterns"] == ["/shop/[id]"] and len(found["warnings"]) == 1 and builds.redirects(spark, found).first().status == 308
    assert builds.apply_samples(["/shop/[id]"], {"/shop/[id]": [{"id": "a b"}, "/nope"]}) == ([("/shop/a%20b", "/shop/[id]")], [], ["/shop/[id]: sample does not fit"])


def test_crawl_budgets_and_depths(spark):
    e = "https://e.t/"
    links = spark.createDataFrame([(e, e + x) for x in "abc"] + [(e + "a", e + "d")], "src string, dst string")
    shots = spark.createDataFrame([(e + x, "complete", 200) for x in ("", *"abcd")], "url string, completion string, status int")
    seed = spark.createDataFrame([(e, 0, 0)], "url string, depth int, priority int")
    seen, out, cut = crawl.crawl(seed, shots, links, 2, 8)
    assert seen.count() == 2 and out.where(f"src = '{e}'").count() == 3 and cut
    seen, out, cut = crawl.crawl(seed, shots, links, 9, 0)
    assert seen.count() == 1 and out.count() == 3 and cut
    nodes = spark.createDataFrame([(e + x,) for x in ("", *"abcd", "orphan")], "url string")
    assert {r.url[len(e) :]: r.depth for r in crawl.depths(nodes, links, seed).collect()} == {"": 0, "a": 1, "b": 1, "c": 1, "d": 2, "orphan": -1}


def test_configuration():
    c = configuration.load(overrides={"base_url": "https://e.t/", "limits": {"max_pages": 5}, "headers": {"X": "${KEY}"}}, environment={"KEY": "v"})
    assert c["limits"]["max_pages"] == 5 and c["limits"]["max_depth"] == 8 and c["headers"] == {"X": "v"}
    for bad in ({"base_url": "ftp://x"}, {"base_url": "https://e.t/", "odd": 1}, {"base_url": "https://e.t/", "limits": {"odd": 1}}):
        with pytest.raises(ValueError, match="."):
            configuration.load(overrides=bad)
    assert configuration.milliseconds("1.5s") == 1500 and configuration.bytes_of("2kb") == 2048


def test_comparability_and_sinks(spark):
    compare.assert_comparable({"audit": {"a": 1, "b": 2}}, {"audit": {"b": 2, "a": 1}}, ["audit"])
    with pytest.raises(ValueError, match="audit"):
        compare.assert_comparable({"audit": 1}, {"audit": 2}, ["audit"])
    rows = [("https://e.t/", "missing-title", "error", '=cmd, "x"', [], {"b": "2", "a": "1"}, (2, 0, 0))]
    f = spark.createDataFrame(rows, "url string, code string, severity string, message string, related array<string>, evidence map<string,string>, seq struct<family:int,ord:long,place:long>")
    assert reports.csv_line(reports.csv_rows(f)).first().line == 'error,missing-title,https://e.t/,"\'=cmd, ""x""",,a=1; b=2'
    routes = spark.createDataFrame([("https://e.t/", 0)], "url string, depth int")
    links = spark.createDataFrame([("https://e.t/", "https://e.t/")], "src string, dst string")
    for kind in ("json", "csv", "sarif", "junit", "markdown", "terminal", "html"):
        assert "missing-title" in reports.render(kind, {"errors": 1}, routes, links, f)


@pytest.mark.skipif(not os.path.isdir(TINY), reason="no test tables")
@pytest.mark.parametrize("name", "page_signals page_links content_fingerprint simhash page_findings agent_findings graph_findings group_findings time_findings soft_404_findings scoped_severity robots_decision candidate_merge redirect_contracts report_diff changed_only rare_page_findings rare_agent_findings rare_graph_findings rare_time_findings inventory_findings robots_parsed sitemap_parsed list_entries response_chains response_bodies build_contracts route_rows csv_lines".split())
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "documents", "events"):
        con.execute(f"create view {t} as select * from '{TINY}/{t}.parquet'")
    got = catalogue.queries()[name](spark, TINY).toPandas()
    want = con.execute(catalogue.oracle_sql()[name]).df()[list(got.columns)]
    clean = lambda d: sorted(str([None if x is None or type(x).__name__ == "NAType" or x != x else x if isinstance(x, str) else float(x) for x in r]) for r in d.itertuples(index=False))
    assert clean(got) == clean(want)


def test_crawl_against_a_plain_queue(spark):
    import random

    draw = random.Random(5)
    hosts = ["https://a.test/", "https://b.test/", "https://c.test/"]
    edges = sorted({(h + str(draw.randrange(40)), draw.choice([h, h, h, hosts[0]]) + str(draw.randrange(40))) for h in hosts for _ in range(120)})
    seeds = [(h + str(k), k % 3, 0) for h in hosts for k in range(4)] + [("https://c.test/" + str(k), 1, 1) for k in range(20, 29)]
    shots = [(h + str(k), "complete" if k % 9 else "timeout", 404 if k % 11 == 5 else 200) for h in hosts for k in range(40)]
    site = lambda u: u.rsplit("/", 1)[0]
    fetched = {u for u, done, status in shots if done == "complete" and status == 200}
    usable = [(s, t) for s, t in edges if s in fetched and site(s) == site(t)]
    for pages, deep in ((12, 3), (100, 2), (5, 9)):
        known, over = {}, False
        for u, d, _ in sorted(seeds, key=lambda r: (r[1], r[2], r[0])):
            room = d <= deep and sum(site(k) == site(u) for k in known) < pages
            over |= not room
            known |= {u: d} if room else {}
        done, out = set(), set()
        while len(done) < len(known):
            low = min(d for u, d in known.items() if u not in done)
            level = {u for u, d in known.items() if d == low} - done
            found = [(s, t) for s, t in usable if s in level]
            done |= level
            out |= set(found)
            for via, t in sorted((min(s for s, y in found if y == x), x) for x in {t for _, t in found}):
                if t in known:
                    known[t] = min(known[t], low + 1)
                elif low + 1 <= deep and sum(site(k) == site(t) for k in known) < pages:
                    known[t] = low + 1
                else:
                    over = True
        seen, outbound, cut = crawl.crawl(spark.createDataFrame(seeds, "url string, depth int, priority int"), spark.createDataFrame(shots, "url string, completion string, status int"), spark.createDataFrame(edges, "src string, dst string"), pages, deep)
        assert {r.url: r.depth for r in seen.collect()} == known
        assert {(r.src, r.dst) for r in outbound.collect()} == out
        assert cut == over


def test_depths_end_at_an_empty_level_or_fail(spark):
    chain = spark.createDataFrame([(f"p{i}", f"p{i + 1}") for i in range(6)], "src string, dst string")
    nodes = spark.createDataFrame([(f"p{i}",) for i in range(7)] + [("orphan",)], "url string")
    seed = spark.createDataFrame([("p0",)], "url string")
    want = {f"p{i}": i for i in range(7)} | {"orphan": -1}
    assert {r.url: r.depth for r in crawl.depths(nodes, chain, seed, bound=6).collect()} == want
    with pytest.raises(ValueError, match="more than 3 links"):
        crawl.depths(nodes, chain, seed, bound=3)


def test_depths_have_no_bound_of_their_own(spark, monkeypatch):
    assert crawl.depths.__defaults__ == (None,)
    monkeypatch.setattr(crawl, "_MERGE", 2)
    chain = spark.createDataFrame([(i, i + 1) for i in range(9)], "src long, dst long")
    nodes = spark.range(10).withColumnRenamed("id", "url")
    seed = spark.createDataFrame([(0,)], "url long")
    assert {r.url: r.depth for r in crawl.depths(nodes, chain, seed).collect()} == {i: i for i in range(10)}


def test_links_and_addresses_of_every_form_are_counted(spark, tmp_path):
    from collections import Counter
    from urllib.parse import urljoin

    hrefs = ["/a", "/a/b", "rel", "../up", "?q=1", "https://other-host.test:8080/x", "/a", "/p%20q"]
    pages = [(1, "https://my-host.test:8080/d/e?utm_source=feed#part"), (2, "https://b.test/d/"), (3, "https://b.test/caf%C3%A9?a_b=1")]
    html = "<html><body>" + "".join(f'<a href="{h}">x</a>' for h in hrefs) + "</body></html>"
    spark.createDataFrame([(i, u, html) for i, u in pages], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = Counter(urljoin(u, h) for _, u in pages for h in hrefs)
    got = {r.url: r.links for r in catalogue.queries()["resolved_links"](spark, str(tmp_path)).collect()}
    assert got == want
    rows = {r.page_id: (r.url, r.bare) for r in catalogue.queries()["url_normalization"](spark, str(tmp_path)).collect()}
    assert rows == {1: ("https://my-host.test:8080/d/e?utm_source=feed", "https://my-host.test:8080/d/e"), 2: ("https://b.test/d/",) * 2, 3: ("https://b.test/caf%C3%A9?a_b=1", "https://b.test/caf%C3%A9")}


def test_rules_read_the_html_of_pages(spark, tmp_path):
    words = " ".join(f"word{k}" for k in range(40))
    page = lambda head, body: f"<html lang='en'><head>{head}</head><body>{body}</body></html>"
    pages = [
        (1, "https://a.test/1", page("", f"<h1>One</h1><p>{words}</p>")),
        (2, "https://a.test/2", page("<title>Same title</title>", "<h1>A</h1><h1>B</h1><p>first text of its own</p>")),
        (3, "https://a.test/3", page("<title>Same title</title><meta name='robots' content='noindex'>", "<h1>C</h1>")),
        (4, "https://a.test/4", page("<title>Same title</title>", "<h1>D</h1><p>second text of its own</p>")),
        (5, "https://a.test/5", page("<title>Page not found</title>", "<h1>Page not found</h1>")),
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    q = catalogue.queries()
    got = {(r.url[-1], r.code) for r in q["captured_page_findings"](spark, str(tmp_path)).collect()}
    assert {u for u, c in got if c == "missing-title"} == {"1"} and {u for u, c in got if c == "multiple-h1"} == {"2"} and ("3", "noindex") in got
    groups = {(r.code, r.routes) for r in q["captured_group_findings"](spark, str(tmp_path)).collect()}
    assert any("duplicate-title" in c and n == 2 for c, n in groups), groups
    assert "https://a.test/5" in {r.url for r in q["captured_soft_404_findings"](spark, str(tmp_path)).collect()}
