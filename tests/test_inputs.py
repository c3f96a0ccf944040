"""Contracts, saved reports, builds, responses, sitemaps with limits, dates, and the next command."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.__main__ import main
from quarry.functions import dates, text
from quarry.plans import audit, compare, contracts
from quarry.sinks import reports
from quarry.sources import builds, captures, configuration, saved_reports, sitemaps, url_lists

SITE = "https://shop.test/"


@pytest.mark.parametrize(
    ("rows", "error"),
    [
        ([{"from": "/a", "to": "/b", "status": 301}], None),
        ([{"from": "/a/*", "to": "/b/*", "status": 308, "samples": ["/a/x", "/a/x"]}], None),
        ([{"from": "https://other.test/a", "to": "/b", "status": 301}], "another site"),
        ([{"from": "/a", "to": "/a", "status": 301}], "itself"),
        ([{"from": "/a*b", "to": "/c", "status": 301}], "whole segment"),
        ([{"from": "/a/*", "to": "/b/*/*", "status": 301}], "wildcards"),
        ([{"from": "/a", "to": "/b", "status": 301, "samples": ["/a"]}], "patterns"),
        ([{"from": "/a/*", "to": "/b", "status": 301, "samples": ["/z"]}], "does not match"),
        ([{"from": "/a/*", "to": "/b", "status": 301, "samples": ["https://x.test/a/b"]}], "another site"),
        ([{"from": "/a", "to": "/b", "status": 301, "max_hops": 9}], "max_redirects"),
        ([{"from": "/a", "to": "/b", "status": 301}, {"from": "/a", "to": "/c", "status": 301}], "otherwise"),
        ([{"from": "https://u:p@shop.test/a", "to": "/b", "status": 301}], "credentials"),
    ],
)
def test_redirect_contracts_are_checked(rows, error):
    if error is None:
        assert contracts.resolve(rows, SITE)[0]["from"].startswith(SITE)
    else:
        with pytest.raises(ValueError, match=error):
            contracts.resolve(rows, SITE)


def test_samples_join_the_addresses_of_a_pattern(spark):
    [p] = contracts.resolve([{"from": "/old/*", "to": "/new/*", "status": 301, "samples": ["/old/only-sample"]}], SITE)
    urls = spark.createDataFrame([(SITE + "old/a",), (SITE + "x",)], "url string")
    found, lost = contracts.expand([p], urls)
    assert {(r["from"], r.to) for r in found.collect()} == {(SITE + "old/a", SITE + "new/a"), (SITE + "old/only-sample", SITE + "new/only-sample")} and lost.isEmpty()


def _report(**change):
    signals = {k: [] for k in ("titles", "descriptions", "canonicals", "robots", "h1s", "links", "hreflangs")} | {"titles": [{"value": "T", "location": "head"}]}
    shot = {"requestedUrl": SITE, "finalUrl": SITE, "agent": {"key": "default", "label": "d", "userAgent": "u"}, "status": 200, "contentType": "text/html", "headers": {}, "redirects": [], "signals": signals, "bytesRead": 3, "content": {"characters": 1, "words": 1, "sha256": "a" * 64, "simhash": "f" * 16}, "durationMs": 5, "completion": "complete"}
    return {
        "schemaVersion": "5", "toolVersion": "1", "generatedAt": "2024-05-01T10:00:00.000Z", "durationMs": 1, "baseUrl": SITE, "truncated": False,
        "config": {"maxPages": 5, "maxDepth": 2, "agents": ["default"], "respectRobots": True, "queryPolicy": "keep"}, "sitemap": {"requested": [], "fetched": [], "entries": [], "warnings": []},
        "routes": [{"url": SITE, "depth": 0, "sources": [{"kind": "seed"}], "snapshots": [shot], "inbound": [], "outbound": []}],
        "findings": [{"code": "missing-h1", "severity": "warning", "message": "m", "url": SITE, "evidence": {"n": 1, "b": True}}],
        "summary": {k: 0 for k in "routes fetched indexable errors warnings info brokenLinks redirects noindex maxDepth".split()},
    } | change


def test_json_reports_are_checked_and_compared(spark, tmp_path, capsys):
    assert saved_reports.problems(_report()) == []
    for change, where in (({"schemaVersion": "9"}, "schemaVersion"), ({"generatedAt": "yesterday"}, "generatedAt"), ({"routes": [{"url": "x"}]}, "routes.0.url"), ({"findings": [{"code": "", "severity": "bad", "message": 1}]}, "severity")):
        assert any(where in p for p in saved_reports.problems(_report(**change)))
    old, new = str(tmp_path / "old.json"), str(tmp_path / "new.json")
    later = json.loads(json.dumps(_report(findings=[])))
    later["routes"][0]["snapshots"][0]["signals"]["titles"][0]["value"] = "Other"
    for path, value in ((old, _report()), (new, later)):
        with open(path, "w") as f:
            json.dump(value, f)
    run, findings, routes, agents = audit.load(spark, old)
    assert run["max_pages"] == 5 and findings.first().evidence == {"n": "1", "b": "true"} and routes.first().indexability == "indexable" and agents.isEmpty()
    assert main(["diff", old, new, "--format", "json", "--fail-on", "never"], spark) == 0
    assert {c["code"] for c in json.loads(capsys.readouterr().out)["changes"]} == {"title-changed", "finding-resolved:missing-h1"}
    (tmp_path / "bad.json").write_text("{")
    assert main(["diff", str(tmp_path / "bad.json"), new], spark) == 2 and "not JSON" in capsys.readouterr().err


def test_policies_of_two_runs(spark):
    config = configuration.load(overrides={"base_url": SITE})
    one, two = compare.policies(config, ["default"]), compare.policies(config | {"include": ["/x"]}, ["default"])
    compare.assert_comparable(one, {k: v for k, v in one.items() if k not in compare.UNSAID}, compare.POLICIES)
    assert set(compare.POLICIES) == set(one) and len(one) == 24
    with pytest.raises(ValueError, match="include"):
        compare.assert_comparable(one, two, compare.POLICIES)
    for bad in ({"require_titel": True}, {"paths": [{"odd": 1}]}, {"severities": {"x": "fatal"}}, {"max_depth": -1}):
        with pytest.raises(ValueError, match="audit"):
            configuration.load(overrides={"base_url": SITE, "audit": bad})


def test_a_build_folder_and_the_next_command(spark, tmp_path, capsys):
    build = tmp_path / "site" / ".next"
    (build / "diagnostics").mkdir(parents=True)
    (build / "BUILD_ID").write_text(" abc \n")
    (build / "diagnostics" / "framework.json").write_text('{"name": "Next.js", "version": "15.1.0"}')
    (build / "routes-manifest.json").write_text(json.dumps({"staticRoutes": [{"page": "/"}, {"page": "/lost"}], "dynamicRoutes": [{"page": "/shop/[id]"}], "redirects": [{"source": "/o", "destination": "/", "permanent": True}, {"source": "/o/:x", "destination": "/", "permanent": True}]}))
    found = builds.read_build(str(tmp_path / "site"), samples={"/shop/[id]": ["a b", "/nope", {"id": "c"}]})
    assert (found["build_id"], found["version"], found["unresolved"]) == ("abc", "15.1.0", []) and [r[0] for r in found["routes"]] == ["/", "/lost", "/shop/a%20b", "/shop/c"] and len(found["warnings"]) == 1
    (tmp_path / "node_modules" / "next").mkdir(parents=True)
    (tmp_path / "node_modules" / "next" / "package.json").write_text('{"version": "14.0.1"}')
    assert builds.framework_version(str(tmp_path / "site" / "deep"), str(tmp_path / "none")) == "14.0.1" and builds.build_id(str(tmp_path)) is None
    pages = [(1, SITE, "<title>T</title><h1>x</h1>"), (2, SITE + "a", "<title>U</title>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    assert main(["next", "--pages", str(tmp_path / "pages"), "--base-url", SITE, "--root", str(tmp_path / "site"), "--format", "json", "--fail-on", "never"], spark) == 0
    got = {(f.get("url"), f["code"]) for f in json.loads(capsys.readouterr().out)["findings"]}
    assert {(SITE + "lost", "route-not-fetched"), (SITE, "next-dynamic-route-needs-sample"), (SITE + "o", "redirect-contract-unchecked"), (SITE, "next-discovery-warning")} <= got


@pytest.mark.parametrize(("pattern", "path", "fits"), [("/a/[x]", "/a/b/", True), ("/a/[x]", "/a/b?c", False), ("/a/[...x]", "/a/b/c", True), ("/a/[[...x]]", "/a", True), ("/a/[...x]", "/a", False), ("/", "/", True)])
def test_build_patterns(pattern, path, fits):
    import re

    assert bool(re.match(builds.build_route(pattern), path)) == fits


def test_response_headers_and_charsets():
    assert captures.safe_header("Refresh", "0; URL='/p?token=x'") == "0; URL='/p?token=%5Bredacted%5D'"
    assert captures.safe_header("X-Session-Id", "1") == "[redacted]" and captures.safe_header("Server", "https://u:p@x.test/") == "https://u:p@x.test/"


def test_limits_of_lists_and_sitemaps_are_told(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(url_lists, "LIMIT", 10)
    (tmp_path / "big.txt").write_text("/one\n/two\n/three\n")
    (tmp_path / "ok.txt").write_text("/one\n")
    entries, diagnostics, counts = url_lists.load(url_lists.read_files(spark, [str(tmp_path / "big.txt"), str(tmp_path / "ok.txt")]), SITE)
    assert [r.url for r in entries.collect()] == [SITE + "one"] and [(r.source, r.code) for r in diagnostics.collect()] == [("big.txt", "source-too-large")]
    assert {(r.source, r.accepted, r.rejected) for r in counts.collect()} == {("big.txt", 0, 1), ("ok.txt", 1, 0)}
    index = lambda *to: "<sitemapindex>" + "".join(f"<sitemap><loc>{SITE}{t}</loc></sitemap>" for t in to) + "</sitemapindex>"
    leaf = "<urlset>" + "".join(f"<url><loc>{SITE}{k}</loc></url>" for k in range(5)) + "</urlset>"
    files = spark.createDataFrame([(SITE + "0", index("1", "leaf")), (SITE + "1", index("2")), (SITE + "2", index("3")), (SITE + "3", leaf), (SITE + "leaf", leaf)], "url string, xml string")
    start = spark.createDataFrame([(SITE + "0", 0)], "url string, ord int")
    got, entries, warnings = sitemaps.follow(start, files, depth=2, entries=3)
    told = [r.warning for r in warnings.collect()]
    assert got.count() == 4 and entries.count() == 3 and any("too deep" in w and w.endswith("3") for w in told) and any("3 entries" in w for w in told)
    assert any("2 files" in r.warning for r in sitemaps.follow(start, files, most=2)[2].collect())


def test_cells_orders_dates_and_the_html_report(spark):
    assert reports.markdown_cell("a|b (c) <d> & [e]\n-f") == "a\\|b \\(c\\) &lt;d&gt; &amp; \\[e\\] \\-f"
    changes = spark.createDataFrame([("b", "added", "x", "error", None, None), ("a", "removed", "y", "error", None, None), ("c", "added", "z", "info", None, None)], "url string, kind string, code string, severity string, before string, after string")
    assert [r.url for r in reports.diff_changes(changes).collect()] == ["a", "b", "c"]
    times = spark.createDataFrame([(dates.iso_now(),), ("2024-02-30T00:00:00Z",), ("2024-02-03",), ("2024-02-03T10:11:12.5Z",)], "t string")
    assert [r.ok for r in times.select(dates.is_iso(F.col("t")).alias("ok")).collect()] == [True, False, False, True]
    routes = spark.createDataFrame([(SITE, 0, "complete", 200, "indexable"), (SITE + "a", -1, "timeout", None, "unknown")], "url string, depth int, completion string, status int, indexability string")
    links = spark.createDataFrame([(SITE, SITE + "a")], "src string, dst string")
    f = spark.createDataFrame([(SITE, "agent-title-mismatch", "warning", "m", [], {"k": "v"}, (0, 0, 0)), (None, "crawl-policy", "info", "<b>", [], {}, (0, 0, 0))], saved_reports.FINDING)
    checks = spark.createDataFrame([("f", "t", 301, "exact", None, ["redirect-chain"], "failed")], "`from` string, `to` string, status int, kind string, declared_pattern string, codes array<string>, outcome string")
    page = reports.page({"errors": 0}, routes, links, f, checks, truncated=True)
    assert all(x in page for x in ("Redirect contracts", "Agent differences", "Incomplete evidence", "timeout", "unreachable", "site-wide", "&lt;b&gt;", "redirect-chain", "inventory-and-limits"))
    assert "1 differences between agents on 1 routes" in reports.terminal({"errors": 0}, f)


def test_similarity_by_its_definition():
    import hashlib

    words = "the quick brown fox jumps over the lazy dog the end".split()
    sums = [0] * 64
    for w in words:
        bits = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big")
        for b in range(64):
            sums[b] += 1 if bits >> (63 - b) & 1 else -1
    want = sum(1 << (63 - b) for b in range(64) if sums[b] >= 0)
    s = text.Similarity(keep=3)
    assert all(s.hash(words) % (1 << 64) == want for _ in range(3)) and s.hash([]) == 0
    assert text._evidence_of("Ａ  b😀　B")[:2] == (7, 3)


def test_keys_of_three_blocks_lose_no_pair_within_distance_three(spark):
    import random

    r = random.Random(1)
    pairs = []
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), 3):
            b ^= 1 << bit
        pairs.append((a - (1 << 63), b - (1 << 63)))
    df = spark.createDataFrame(pairs, "a long, b long")
    assert df.where(F.arrays_overlap(text.bands(F.col("a")), text.bands(F.col("b")))).count() == 300
