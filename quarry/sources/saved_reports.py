"""JSON reports of versions 1 to 5, read by the driver (one report is one file), checked, and turned into tables."""

from __future__ import annotations

import json
import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from quarry.sources.captures import CAPTURE

FINDING = "url string, code string, severity string, message string, related array<string>, evidence map<string,string>, seq struct<family:int,ord:long,place:long>"


def _natural(v) -> bool:
    return isinstance(v, int) and not isinstance(v, bool) and v >= 0


def _number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool) and v >= 0


def _time(v) -> bool:
    try:
        return isinstance(v, str) and v.endswith("Z") and "T" in v and datetime.fromisoformat(v) is not None
    except ValueError:
        return False


def _text(v) -> bool:
    return isinstance(v, str)


def _word(v) -> bool:
    return isinstance(v, str) and v != ""


def _bool(v) -> bool:
    return isinstance(v, bool)


def _address(v) -> bool:
    return isinstance(v, str) and re.match(r"https?://[^/?#\s]+", v) is not None


def _digest(length: int):
    return lambda v: isinstance(v, str) and re.fullmatch(rf"[0-9a-fA-F]{{{length}}}", v) is not None


def one_of(*values):
    return lambda v: v in values


def _scalar(v) -> bool:
    return isinstance(v, (str, int, float, bool))


# A shape is a test, a dict of fields (a name with ? may be absent), [shape] for a list, {"*": shape} for any names.
_META = {"value": _text}
_SIGNALS = {
    "titles": [_META], "descriptions": [_META], "canonicals": [_META], "h1s": [_META], "robots": [{"value": _text, "audience?": _text}],
    "links": [{"href": _text, "resolvedUrl?": _address, "text": _text, "rel": [_text], "nofollow": _bool}],
    "hreflangs": [{"language": _text, "href": _text, "resolvedUrl?": _address}], "social?": [{"property": _word, "value": _text, "location": one_of("head", "body")}],
    "structuredData?": [{"types": [_text], "ids": [_text], "sha256": _digest(64), "context": one_of("schema.org", "other", "missing"), "valid": _bool, "error?": _text}],
    "htmlLang?": _text, "baseHref?": _text,
}
_CONTENT = {"characters": _natural, "words": _natural, "sha256": _digest(64), "simhash": _digest(16)}
_HOP = {"url": _address, "status": _natural, "location": _address, "durationMs": _number}
STATES = ("complete", "max-bytes-exceeded", "timeout", "network-error", "invalid-response", "robots-blocked")
_SNAPSHOT = {
    "requestedUrl": _address, "finalUrl": _address, "agent": {"key": _word, "label": _text, "userAgent": _text}, "status?": _natural, "contentType?": _text,
    "headers": {"*": _text}, "redirects": [_HOP], "signals": _SIGNALS, "bytesRead": _natural, "bodySha256?": _text, "content?": _CONTENT,
    "durationMs": _number, "completion": one_of(*STATES), "error?": _text,
}
SHAPE = {
    "schemaVersion": one_of("1", "2", "3", "4", "5"), "toolVersion": _word, "generatedAt": _time, "durationMs": _number, "baseUrl": _address, "truncated": _bool,
    "config": {
        "maxPages": _natural, "maxDepth": _natural, "agents": [_word], "respectRobots": _bool, "queryPolicy": one_of("drop", "keep"), "seeds?": [_address],
        "sitemapMode?": one_of("auto", "explicit"), "sitemapUrls?": [_address], "include?": [_text], "exclude?": [_text], "timeoutMs?": _natural, "maxBytes?": _natural,
        "maxRedirects?": _natural, "delayMs?": _natural, "honorCrawlDelay?": _bool, "rendered?": _bool, "renderedConcurrency?": _natural, "renderedTimeoutMs?": _natural,
        "renderedSettleMs?": _natural, "headerNames?": [_word], "urlListFiles?": _natural,
    },
    "sitemap": {"requested": [_address], "fetched": [_address], "entries": [{"url": _address, "sitemapUrl": _address}], "warnings": [_text]},
    "routes": [{"url": _address, "depth": lambda v: isinstance(v, int) and v >= -1, "sources": [{"kind": _word}], "snapshots": [_SNAPSHOT], "inbound": [_address], "outbound": [_address]}],
    "findings": [{"code": _word, "severity": one_of("error", "warning", "info"), "message": _text, "url?": _address, "relatedUrls?": [_address], "evidence?": {"*": _scalar}}],
    "summary": {k: _natural for k in "routes fetched indexable errors warnings info brokenLinks redirects noindex maxDepth".split()},
    "comparison?": {"mode": one_of("changed-only"), "baselineGeneratedAt": _time, "newFindings": _natural, "worsenedFindings": _natural, "resolvedFindings": _natural, "unchangedFindings": _natural},
}


def problems(value, shape=SHAPE, at: str = "report") -> list[str]:
    """Where a value departs from a shape."""
    if callable(shape):
        return [] if shape(value) else [f"{at}: not valid"]
    if isinstance(shape, list):
        return [x for k, v in enumerate(value) for x in problems(v, shape[0], f"{at}.{k}")] if isinstance(value, list) else [f"{at}: not a list"]
    if not isinstance(value, dict):
        return [f"{at}: not an object"]
    if "*" in shape:
        return [x for k, v in value.items() for x in problems(v, shape["*"], f"{at}.{k}")]
    out = []
    for name, inner in shape.items():
        key = name.removesuffix("?")
        if key in value:
            out += problems(value[key], inner, f"{at}.{key}")
        elif key == name:
            out.append(f"{at}.{key}: missing")
    return out


def parse(text: str, path: str = "report") -> dict:
    try:
        value = json.loads(text)
    except ValueError:
        raise ValueError(f"{path}: not JSON") from None
    if found := problems(value):
        raise ValueError(f"{path}: " + "; ".join(found[:20]) + (f"; and {len(found) - 20} more" if len(found) > 20 else ""))
    return value


def _signals(s: dict) -> dict:
    meta = lambda k: [{"value": x["value"], "location": x.get("location")} for x in s[k]]
    return {
        "titles": meta("titles"), "descriptions": meta("descriptions"), "canonicals": meta("canonicals"), "h1s": meta("h1s"),
        "robots": [{"value": x["value"], "location": x.get("location"), "audience": x.get("audience", "robots"), "source": x.get("source")} for x in s["robots"]],
        "links": [{"href": x["href"], "resolved_url": x.get("resolvedUrl"), "text": x["text"], "rel": x["rel"], "nofollow": x["nofollow"]} for x in s["links"]],
        "hreflangs": [{"language": x["language"], "href": x["href"], "resolved_url": x.get("resolvedUrl")} for x in s["hreflangs"]],
        "social": [{k: x[k] for k in ("property", "value", "location")} for x in s.get("social", [])],
        "structured_data": [{"types": x["types"], "ids": x["ids"], "sha256": x["sha256"], "context": x["context"], "valid": x["valid"], "error": x.get("error")} for x in s.get("structuredData", [])],
        "html_lang": s.get("htmlLang"), "base_href": s.get("baseHref"), "content_text": None,
    }


def _capture(url: str, s: dict, order: int, mode: str | None) -> dict:
    c = s.get("content")
    number = int(c["simhash"], 16) if c else 0
    return {
        "url": url, "agent": s["agent"]["key"], "agent_ord": order, "completion": s["completion"], "status": s.get("status"), "final_url": s["finalUrl"],
        "content_type": s.get("contentType"), "redirects": [{"url": h["url"], "status": h["status"], "location": h["location"], "duration_ms": float(h["durationMs"])} for h in s["redirects"]],
        "signals": _signals(s["signals"]), "content": c and {"characters": c["characters"], "words": c["words"], "sha256": c["sha256"], "simhash": number - (1 << 64) if number >> 63 else number},
        "duration_ms": float(s["durationMs"]), "error": s.get("error"), "render_mode": mode,
    }


#: Names of the report's settings, as `plans.compare` compares them.
_SETTINGS = {
    "maxPages": "max_pages", "maxDepth": "max_depth", "agents": "agents", "respectRobots": "respect_robots", "queryPolicy": "query", "seeds": "seeds", "sitemapMode": "sitemap_mode",
    "sitemapUrls": "sitemap_urls", "include": "include", "exclude": "exclude", "timeoutMs": "timeout_ms", "maxBytes": "max_bytes", "maxRedirects": "max_redirects", "delayMs": "delay_ms",
    "honorCrawlDelay": "honour_delay", "rendered": "rendered", "renderedConcurrency": "rendered_concurrency", "renderedTimeoutMs": "rendered_timeout_ms",
    "renderedSettleMs": "rendered_settle_ms", "headerNames": "header_names", "urlListFiles": "url_lists", "redirects": "redirects", "audit": "options",
}


def tables(spark: SparkSession, report: dict) -> tuple[dict, DataFrame, DataFrame]:
    """(run, findings, captures) of a checked report."""
    run = {"base_url": report["baseUrl"], "truncated": report["truncated"], "generated_at": report["generatedAt"], "comparison": report.get("comparison")}
    run |= {ours: report["config"][theirs] for theirs, ours in _SETTINGS.items() if theirs in report["config"]}
    text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    findings = [
        (f.get("url"), f["code"], f["severity"], f["message"], f.get("relatedUrls", []), {k: text(v) for k, v in f.get("evidence", {}).items()}, (0, n, 0)) for n, f in enumerate(report["findings"])
    ]
    captures = [_capture(r["url"], s, n, (r.get("build") or {}).get("renderMode")) for r in report["routes"] for n, s in enumerate(r["snapshots"])]
    return run, spark.createDataFrame(findings, FINDING), spark.createDataFrame(captures, CAPTURE + ", render_mode string")


def read(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame]:
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except OSError:
        raise ValueError(f"{path}: cannot be read") from None
    return tables(spark, parse(text, path))
