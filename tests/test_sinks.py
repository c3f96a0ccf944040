"""Redaction of whole tables and the sinks of comparisons."""

import json

from quarry.plans import compare
from quarry.sinks import redaction, reports


def test_tables_of_any_shape_are_redacted(spark):
    schema = "id int, url string, headers map<string,string>, s struct<canonicals:array<struct<value:string>>,links:array<struct<href:string,rel:array<string>>>,social:array<struct<property:string,value:string>>>, detail string"
    rows = [
        (1, "https://u:p@a.test/?token=x&q=1", {"via": "https://a.test/?api_key=9"}, ([("/c?token=x",)], [("/l?token=x&b=2", ["hunter2"])], [("og:image", "/i?token=x"), ("og:title", "/i?token=x")]), "/home/me/site/build/a.json"),
        (2, None, None, None, None),
        (3, "plain", {}, ([], None, []), "/home/me/site/other hunter2"),
        (4, "https://b.test/", {"k": None}, (None, [(None, None)], None), ""),
    ]
    got = redaction.redacted(spark.createDataFrame(rows, schema).coalesce(1), ("hunter2", ""), ("/home/me/site", "/home/me/site/build"))
    assert [f.dataType for f in got.schema] == [f.dataType for f in spark.createDataFrame([], schema).schema]
    a, b, c, d = sorted(got.collect())
    assert a.url == "https://redacted:redacted@a.test/?token=%5Bredacted%5D&q=1" and a.headers == {"via": "https://a.test/?api_key=%5Bredacted%5D"}
    assert a.s.canonicals[0].value == "/c?token=%5Bredacted%5D" and a.s.links[0].href == "/l?token=%5Bredacted%5D&b=2" and a.s.links[0].rel == ["[redacted]"]
    assert [x.value for x in a.s.social] == ["/i?token=%5Bredacted%5D", "/i?token=x"] and a.detail == "./a.json"
    assert tuple(b) == (2, None, None, None, None)
    assert c.headers == {} and c.s.links is None and c.s.social == [] and c.detail == "./other [redacted]"
    assert d.headers == {"k": None} and d.s.canonicals is None and d.s.links[0].href is None and d.detail == ""


def test_redaction_of_an_empty_table(spark):
    assert redaction.redacted(spark.createDataFrame([], "a string, b array<string>")).collect() == []


def test_comparison_sinks(spark):
    rows = [("https://e.t/a", "changed", "title-changed", "info", "old", None), ("https://e.t/b", "added", "route-added", "error", None, "404"), ("https://e.t/\x1b[2J", "removed", "route-removed", "warning", "200", None)]
    changes = spark.createDataFrame(rows, "url string, kind string, code string, severity string, before string, after string")
    counts = compare.summarize(changes).first().asDict()
    text = reports.diff_terminal(counts, changes)
    assert text.splitlines()[1:5] == ["1 added  1 removed  1 changed", "1 errors  1 warnings  1 info", "", "[ERROR] route-added  https://e.t/b"]
    assert "old -> none" in text and "\x1b" not in text and "2 more" in reports.diff_terminal(counts, changes, limit=1)
    got = json.loads(reports.diff_json(counts, changes))
    assert [c["code"] for c in got["changes"]] == ["route-added", "route-removed", "title-changed"] and got["summary"] == counts and "after" not in got["changes"][1]
    none = changes.limit(0)
    assert "Nothing changed." in reports.diff_terminal(compare.summarize(none).first().asDict(), none)


def test_machine_readable_reports_hold_every_row(spark):
    n = 100_001
    f = spark.range(n).selectExpr("concat('https://e.t/', id) AS url", "'missing-title' AS code", "IF(id = 0, 'info', 'error') AS severity", "'m' AS message", "CAST(array() AS array<string>) AS related", "map('a', '1') AS evidence", "CAST(NULL AS struct<family:int,ord:long,place:long>) AS seq")
    render = lambda kind: reports.render(kind, {}, None, None, f)
    assert len({x["url"] for x in json.loads(render("json"))["findings"]}) == n
    assert len(set(render("csv").splitlines()[1:])) == n
    assert len(json.loads(render("sarif"))["runs"][0]["results"]) == n
    text = render("junit")
    assert f'tests="{n}" failures="{n - 1}"' in text and text.count("<testcase ") == n
    changes = f.selectExpr("url", "'added' AS kind", "code", "severity", "CAST(NULL AS string) AS before", "'1' AS after")
    assert len(json.loads(reports.diff_json({}, changes))["changes"]) == n
