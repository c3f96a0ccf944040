"""Page signals and content evidence from HTML, X-Robots-Tag headers and JSON-LD, as Arrow-batched functions."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import squash
from quarry.functions.urls import resolve, split
from quarry.functions.urls import join as join_url

_TEXT = "struct<value:string,location:string>"
_ROBOTS = "struct<value:string,location:string,audience:string,source:string>"
SIGNALS = (
    f"struct<titles:array<{_TEXT}>,descriptions:array<{_TEXT}>,canonicals:array<{_TEXT}>,robots:array<{_ROBOTS}>,h1s:array<{_TEXT}>,"
    "links:array<struct<href:string,resolved_url:string,text:string,rel:array<string>,nofollow:boolean>>,"
    "hreflangs:array<struct<language:string,href:string,resolved_url:string>>,social:array<struct<property:string,value:string,location:string>>,"
    "structured_data:array<struct<types:array<string>,ids:array<string>,sha256:string,context:string,valid:boolean,error:string>>,"
    "html_lang:string,base_href:string,content_text:string>"
)
_SILENT = {"head", "script", "style", "template", "noscript", "svg"}
_CAPS = {"types": 50, "ids": 50, "nodes": 500}


def resolved(href: str | None, base: str) -> str | None:
    """Absolute http(s) address with its fragment, as links keep it."""
    text = resolve(href, base)
    parts = split(text) if text else None
    if parts is None:
        return None
    fragment = text.partition("#")[2]
    return join_url(parts) + (f"#{fragment}" if fragment else "")


class Page(HTMLParser):
    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.base, self.lang, self.base_href = url, url, None, None
        self.out: dict[str, list] = {k: [] for k in ("titles", "descriptions", "canonicals", "robots", "h1s", "links", "hreflangs", "social", "structured_data")}
        self.templates, self.quiet, self.head, self.visible = 0, 0, False, []
        self.silent: list[str] = []
        self.open: list[tuple[str, list[str], dict]] = []
        self.script: list[str] | None = None

    @property
    def place(self) -> str:
        return "head" if self.head else "body"

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent.append(tag)
        if tag == "template":
            self.templates += 1
        if self.templates:
            return
        a = {k: v or "" for k, v in reversed(attrs)}
        if tag == "html" and self.lang is None and a.get("lang"):
            self.lang = squash(a["lang"]) or None
        elif tag == "head":
            self.head = True
        elif tag == "body":
            self.head = False
        elif tag == "base" and self.base_href is None and "href" in a:
            self.base_href = a["href"]
            self.base = resolved(a["href"], self.url) or self.url
        elif tag in ("title", "h1", "a"):
            self.open.append((tag, [], {**a, "place": self.place}))
        elif tag == "img" and a.get("alt"):
            for name, text, _ in self.open:
                if name == "a":
                    text.append(a["alt"])
        elif tag in ("script", "style"):
            self.quiet += 1
            if tag == "script" and re.match(r"\s*application/ld\+json\s*(?:;|$)", a.get("type", ""), re.I):
                self.script = []
        elif tag == "meta":
            self._meta(a)
        elif tag == "link":
            rel = set(a.get("rel", "").lower().split())
            if "canonical" in rel and "href" in a:
                self.out["canonicals"].append({"value": squash(a["href"]), "location": self.place})
            if "alternate" in rel and a.get("hreflang") and "href" in a:
                href = squash(a["href"])
                self.out["hreflangs"].append({"language": squash(a["hreflang"]), "href": href, "resolved_url": resolved(href, self.base)})

    def _meta(self, a):
        name, content = squash(a.get("name", "")).lower(), a.get("content")
        if content is None:
            return
        value = squash(content)
        if name == "description":
            self.out["descriptions"].append({"value": value, "location": self.place})
        if name in ("robots", "googlebot", "bingbot"):
            self.out["robots"].append({"value": value, "location": self.place, "audience": name, "source": "meta"})
        prop = squash(a.get("property") or a.get("name") or "").lower()
        if value and prop.startswith(("og:", "twitter:")):
            self.out["social"].append({"property": prop, "value": value, "location": self.place})

    def handle_endtag(self, tag):
        if tag in self.silent:
            while self.silent.pop() != tag:
                pass
        if tag == "template" and self.templates:
            self.templates -= 1
            return
        if self.templates:
            return
        if tag == "head":
            self.head = False
        if tag in ("script", "style") and self.quiet:
            self.quiet -= 1
            if tag == "script" and self.script is not None:
                self.out["structured_data"].append(json_ld("".join(self.script)))
                self.script = None
        if tag in ("title", "h1", "a"):
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    self._finish(*self.open.pop(k))
                    break

    def _finish(self, tag, text, a):
        value = squash("".join(text))
        if tag != "a":
            self.out["titles" if tag == "title" else "h1s"].append({"value": value, "location": a["place"]})
        elif "href" in a:
            rel = list(dict.fromkeys(a.get("rel", "").lower().split()))
            label = value or squash(a.get("aria-label", "")) or squash(a.get("title", ""))
            self.out["links"].append({"href": a["href"], "resolved_url": resolved(a["href"], self.base), "text": label, "rel": rel, "nofollow": "nofollow" in rel})

    def handle_data(self, data):
        if not self.silent:
            self.visible.append(data)
        if self.templates:
            return
        if self.script is not None:
            self.script.append(data)
        elif not self.quiet:
            for _, text, _ in self.open:
                text.append(data)


def json_ld(source: str) -> dict:
    """One block of structured data: types, ids, digest without outside white space, context state, validity."""
    out: list[str] = []
    for k, piece in enumerate(re.split(r'("(?:[^"\\]|\\.)*")', source)):
        out.append(piece if k % 2 else re.sub(r"\s+", "", piece))
    block = {"types": [], "ids": [], "sha256": hashlib.sha256("".join(out).encode("utf-8", "surrogatepass")).hexdigest(), "context": "missing", "valid": False, "error": None}
    try:
        value = json.loads(source)
    except (ValueError, RecursionError):
        return block | {"error": "invalid JSON"}
    roots = value if isinstance(value, list) else [value]
    if not roots or not all(isinstance(r, dict) for r in roots):
        return block | {"error": "not an object or an array of objects"}
    nodes, queue = [], list(roots)
    while queue and len(nodes) < _CAPS["nodes"]:
        node = queue.pop(0)
        nodes.append(node)
        inner = node.get("@graph")
        queue += [x for x in (inner if isinstance(inner, list) else [inner]) if isinstance(x, dict)]
    texts = lambda v: [squash(x) for x in (v if isinstance(v, list) else [v]) if isinstance(x, str) and squash(x)]
    block["types"] = list(dict.fromkeys(t for n in nodes for t in texts(n.get("@type"))))[: _CAPS["types"]]
    block["ids"] = list(dict.fromkeys(t for n in nodes for t in texts(n.get("@id"))))[: _CAPS["ids"]]
    contexts = [r["@context"] for r in roots if "@context" in r]

    def names_schema(v) -> bool:
        if isinstance(v, str):
            return bool(re.match(r"https?://(?:www\.)?schema\.org(?:/|$)", v.strip(), re.I))
        if isinstance(v, list):
            return any(map(names_schema, v))
        return isinstance(v, dict) and names_schema(v.get("@vocab"))

    block["context"] = "schema.org" if any(map(names_schema, contexts)) else "other" if contexts else "missing"
    block["valid"] = True
    return block


def robots_header(value: str | None) -> list[dict]:
    """Directives of an X-Robots-Tag header; a user agent named before a colon holds for the parts after it."""
    out, audience = [], "robots"
    for part in (value or "").split(","):
        m = re.match(r"\s*([a-z][a-z0-9_-]*)\s*:\s*(.*)$", part, re.I | re.S)
        text = part.strip()
        if m and m[1].lower() not in ("max-snippet", "max-image-preview", "max-video-preview", "unavailable_after"):
            audience, text = m[1].lower(), m[2].strip()
        if text:
            out.append({"value": text, "location": None, "audience": audience, "source": "header"})
    return out


def parse_page(html: str | None, url: str | None) -> dict:
    page = Page(url or "")
    page.feed(html or "")
    page.close()
    for tag, text, a in page.open:
        page._finish(tag, text, a)
    return {**page.out, "html_lang": page.lang, "base_href": page.base_href, "content_text": " ".join(page.visible)}


def _signals(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_page(h, u) for h, u in zip(html, url, strict=True)], columns=[*Page("").out, "html_lang", "base_href", "content_text"])


def signals(html: Column, url: Column) -> Column:
    """All signals of a page in one struct, from one parse; content_text is the visible text, chunks joined by blanks."""
    return F.pandas_udf(_signals, SIGNALS)(html, url)


def _headers(value: pd.Series) -> pd.Series:
    return pd.Series([robots_header(v) for v in value])


def x_robots_tag(value: Column) -> Column:
    return F.pandas_udf(_headers, f"array<{_ROBOTS}>")(value)


def nfkc(text: str) -> str:
    return unicodedata.normalize("NFKC", text)
