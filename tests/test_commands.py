"""Whole audits through the commands: pages in, report tables and texts out, comparison, exit status."""

import json

from quarry.__main__ import main
from quarry.plans import audit, handbook
from quarry.sources.captures import CAPTURE

SITE = "https://site.test"


def _page(title, *to):
    """A page with links; without a title it has neither title nor heading."""
    head = f"<title>{title}</title>" if title else ""
    return f"<html lang=en><head>{head}</head><body>" + head.replace("title", "h1") + "".join(f'<a href="{t}">{t}</a>' for t in to) + "</body></html>"


def _pages(spark, path, second="Second"):
    rows = [(1, f"{SITE}/", _page("First", "/a", "/b#x", "https://other.test/")), (2, f"{SITE}/a", _page(second, "/b")), (3, f"{SITE}/b", _page("Third", "/")), (4, f"{SITE}/lost", ""), (5, f"{SITE}/lost", "<p>later row</p>"), (6, None, "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(path)


def test_pages_become_captures_links_and_depths(spark, tmp_path):
    _pages(spark, str(tmp_path / "pages"))
    c = audit.from_pages(spark.read.parquet(str(tmp_path / "pages")))
    assert c.count() == 4
    a = audit.run(c, f"{SITE}/")
    assert {(e.src[17:], e.dst[17:]) for e in a.edges.collect()} == {("/", "/a"), ("/", "/b"), ("/a", "/b"), ("/b", "/")}
    rows = sorted(a.routes.select("url", "depth", "ord").collect(), key=lambda r: r.ord)
    assert [(r.url[17:], r.depth) for r in rows] == [("/", 0), ("/a", 1), ("/b", 1), ("/lost", -1)]
    codes = {(f.url[17:], f.code) for f in a.findings.collect()}
    assert ("/lost", "missing-title") in codes and ("/a", "missing-title") not in codes and ("/lost", "dead-end-route") in codes


def test_check_report_baseline_and_diff(spark, tmp_path, capsys):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    _pages(spark, str(tmp_path / "p1"))
    _pages(spark, str(tmp_path / "p2"), second="")
    common = ["--base-url", f"{SITE}/", "--format", "json"]
    assert main(["check", "--pages", str(tmp_path / "p1"), *common, "--report", old], spark) == 1
    first = json.loads(capsys.readouterr().out)
    assert first["summary"]["routes"] == 4 and first["findings"]
    assert main(["check", "--pages", str(tmp_path / "p2"), *common, "--report", new, "--baseline", old, "--fail-on", "never"], spark) == 0
    fresh = json.loads(capsys.readouterr().out)["findings"]
    assert fresh and {f["url"] for f in fresh} == {f"{SITE}/a"}
    assert main(["diff", old, new, "--format", "json", "--fail-on", "never"], spark) == 0
    changes = json.loads(capsys.readouterr().out)["changes"]
    assert {"title-changed"} < {c["code"] for c in changes} and {c.get("url") for c in changes} == {f"{SITE}/a"}
    assert main(["diff", old, old, "--fail-on", "info"], spark) == 0 and "Nothing changed." in capsys.readouterr().out
    # Another policy cannot be compared.
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"base_url": f"{SITE}/", "audit": {"require_title": False}}))
    assert main(["check", "--pages", str(tmp_path / "p1"), "--config", str(config), "--baseline", old], spark) == 2
    assert "options" in capsys.readouterr().err


def test_an_empty_site(spark):
    a = audit.run(spark.createDataFrame([], CAPTURE), f"{SITE}/")
    assert a.findings.collect() == [] and a.summary()["routes"] == 0


def test_explain_init_and_errors(tmp_path, capsys):
    assert main(["explain", "missing-title"]) == 0 and "no title" in capsys.readouterr().out
    assert main(["explain", "conflicting-canonical"]) == 0 and main(["explain", "nonsense"]) == 2
    path = str(tmp_path / "c.json")
    assert main(["init", SITE, "--path", path]) == 0 and main(["init", SITE, "--path", path]) == 2
    assert main(["check"]) == 2 and main(["--help"]) == 0
    assert len({r[0] for r in handbook.RULES}) == len(handbook.RULES)
