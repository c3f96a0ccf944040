"""Build manifests of a web framework: routes with render modes, dynamic patterns, redirects, samples."""

from __future__ import annotations

import json
import os
import re
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.patterns import build_route

LIMIT = 32 << 20
#: Strength of evidence for a render mode.
RANKS = {"partial": 5, "isr": 4, "static": 3, "dynamic": 2, "unknown": 1}
_META = re.compile(r"/(?:favicon\.ico|robots\.txt|sitemap(?:/[^/]*)?\.xml|manifest\.(?:json|webmanifest)|(?:opengraph-image|twitter-image|icon|apple-icon)[^/]*)$")
ROUTE = "pathname string, pattern string, render_mode string, revalidate_seconds double, source_manifest string, rank int, seq int"


def normalize_path(path: str) -> str:
    """A route's public path: groups in parentheses, slots and page or route tails go; no trailing slash."""
    kept = [s for s in path.split("/") if s and not (s.startswith("(") and s.endswith(")")) and not s.startswith("@")]
    if kept and kept[-1] in ("page", "route"):
        kept.pop()
    return "/" + "/".join(kept)


def internal(path: str) -> bool:
    return path.startswith(("/_", "/api/")) or path == "/api" or bool(_META.search(path))


def dynamic(path: str) -> bool:
    return "[" in path


def prerender_mode(entry: dict) -> str:
    if entry.get("experimentalPPR") or entry.get("renderingMode") == "PARTIALLY_STATIC":
        return "partial"
    revalidate = entry.get("initialRevalidateSeconds", entry.get("revalidate"))
    if revalidate is False or revalidate is None:
        return "static"
    return "isr" if isinstance(revalidate, (int, float)) and revalidate > 0 else "dynamic"


def discover(manifests: dict[str, str], base_path: str = "") -> dict:
    """routes, patterns, redirects and warnings of manifests (name -> text); a missing file is silent, a bad one a warning."""
    out: dict = {"routes": [], "patterns": [], "redirects": [], "warnings": []}

    def load(name: str):
        text = manifests.get(name)
        if text is None:
            return {}
        if len(text) > LIMIT:
            out["warnings"].append(f"{name}: too large")
            return {}
        try:
            value = json.loads(text)
        except ValueError:
            value = None
        if not isinstance(value, dict):
            out["warnings"].append(f"{name}: not a JSON object")
            return {}
        return value

    def add(path: str, mode: str, source: str, revalidate=None):
        path = base_path + normalize_path(path) if path != "/" or not base_path else base_path
        if internal(path.removeprefix(base_path) or "/"):
            return
        if dynamic(path):
            out["patterns"].append(path)
        else:
            out["routes"].append((path or "/", None, mode, revalidate, source, RANKS[mode], len(out["routes"])))

    prerender = load("prerender-manifest.json")
    for path, entry in (prerender.get("routes") or {}).items():
        if isinstance(entry, dict):
            r = entry.get("initialRevalidateSeconds")
            add(path, prerender_mode(entry), "prerender-manifest.json", float(r) if isinstance(r, (int, float)) and r is not False else None)
    for path in prerender.get("dynamicRoutes") or {}:
        out["patterns"].append(base_path + path)
    routes = load("routes-manifest.json")
    for kind, mode in (("staticRoutes", "unknown"), ("dynamicRoutes", "dynamic")):
        for entry in routes.get(kind) or []:
            if isinstance(entry, dict) and isinstance(entry.get("page"), str):
                add(entry["page"], mode, "routes-manifest.json")
    for entry in routes.get("redirects") or []:
        if isinstance(entry, dict) and isinstance(entry.get("source"), str) and isinstance(entry.get("destination"), str) and not entry.get("internal"):
            status = entry.get("statusCode") or (308 if entry.get("permanent") else 307)
            out["redirects"].append((entry["source"], entry["destination"], int(status), bool(entry.get("has") or entry.get("missing")), len(out["redirects"])))
    for name in ("app-paths-manifest.json", "app-path-routes-manifest.json", "pages-manifest.json"):
        for key, value in load(name).items():
            if key.endswith("/route"):
                continue
            add(value if name == "app-path-routes-manifest.json" and isinstance(value, str) else key, "unknown", name)
    out["patterns"] = list(dict.fromkeys(out["patterns"]))
    return out


def strongest(spark: SparkSession, found: dict) -> DataFrame:
    """One row a path: the strongest evidence, ties to the first; what stays unknown counts as dynamic."""
    rows = spark.createDataFrame(found["routes"], ROUTE)
    best = rows.groupBy("pathname").agg(F.max_by(F.struct("render_mode", "revalidate_seconds", "source_manifest"), F.struct("rank", -F.col("seq"))).alias("b"))
    mode = F.when(F.col("b.render_mode") == "unknown", "dynamic").when(F.col("b.render_mode") == "partial", "unknown").otherwise(F.col("b.render_mode"))
    return best.select("pathname", mode.alias("render_mode"), "b.revalidate_seconds", "b.source_manifest")


def redirects(spark: SparkSession, found: dict) -> DataFrame:
    """Distinct by status, source and destination; the last wins."""
    rows = spark.createDataFrame(found["redirects"], "source string, destination string, status int, conditional boolean, seq int")
    last = rows.groupBy("status", "source", "destination").agg(F.max_by("conditional", "seq").alias("conditional"))
    return last.select("source", "destination", "status", "conditional")


def sample_path(pattern: str, value) -> str | None:
    """The path of one sample: a path or address as given, a value for the only dynamic segment, or values by name."""
    if isinstance(value, str):
        text = value.strip()
        if re.match(r"https?://", text, re.I):
            text = re.sub(r"^https?://[^/?#]*", "", text, flags=re.I).partition("?")[0].partition("#")[0] or "/"
        if text.startswith("/"):
            return normalize_path(text)
        slots = [s for s in pattern.split("/") if s.startswith("[") and s.endswith("]")]
        if not text or len(slots) != 1:
            return None
        value = {slots[0].strip("[].") : [x for x in text.split("/") if x] if "..." in slots[0] else text}
    path = pattern
    for name, given in value.items():
        text = "/".join(quote(x, safe="!'()~*") for x in (given if isinstance(given, list) else [given]))
        path = re.sub(rf"/\[{{1,2}}(?:\.\.\.)?{re.escape(name)}\]{{1,2}}", lambda _: f"/{text}" if text else "", path)  # noqa: B023
    return path or "/"


def apply_samples(patterns: list[str], samples: dict[str, list]) -> tuple[list[tuple[str, str]], list[str], list[str]]:
    """(path, pattern) of samples that fit, patterns left unresolved, warnings."""
    rows, warnings = [], []
    for pattern, values in samples.items():
        if pattern not in patterns:
            warnings.append(f"{pattern}: not a pattern of the build")
            continue
        for value in values:
            path = sample_path(pattern, value)
            if path is not None and re.match(build_route(pattern), path) and "[" not in path:
                rows.append((path, pattern))
            else:
                warnings.append(f"{pattern}: sample does not fit")
    done = {p for _, p in rows}
    return rows, [p for p in patterns if p not in done], warnings


#: The manifests of a build, below its folder.
MANIFESTS = {
    "prerender-manifest.json": "prerender-manifest.json", "routes-manifest.json": "routes-manifest.json",
    "app-paths-manifest.json": "server/app-paths-manifest.json", "app-path-routes-manifest.json": "app-path-routes-manifest.json",
    "pages-manifest.json": "server/pages-manifest.json",
}


def _small(path: str, most: int) -> str | None:
    if not os.path.isfile(path) or os.path.getsize(path) > most:
        return None
    with open(path, encoding="utf-8", errors="replace") as f:
        return f.read()


def build_id(folder: str) -> str | None:
    """The text of BUILD_ID, up to a kibibyte."""
    return (_small(os.path.join(folder, "BUILD_ID"), 1 << 10) or "").strip() or None


def framework_version(root: str, folder: str) -> str | None:
    """The version in the build's diagnostics, else that of the nearest installed package above root."""

    def version(path: str, most: int, name: str | None = None) -> str | None:
        try:
            value = json.loads(_small(path, most) or "")
        except ValueError:
            return None
        fits = isinstance(value, dict) and isinstance(value.get("version"), str) and name in (None, value.get("name"))
        return value["version"] if fits else None

    found = version(os.path.join(folder, "diagnostics", "framework.json"), 16 << 10, "Next.js")
    at = os.path.abspath(root)
    while found is None:
        found = version(os.path.join(at, "node_modules", "next", "package.json"), 1 << 20)
        if os.path.dirname(at) == at:
            break
        at = os.path.dirname(at)
    return found


def read_build(root: str, directory: str = ".next", samples: dict[str, list] | None = None, base_path: str = "") -> dict:
    """The inventory of a build folder (small files, read by the driver): routes, patterns left without sample, redirects, warnings, id, version."""
    folder = os.path.join(root, directory)
    out = discover({name: text for name, path in MANIFESTS.items() if (text := _small(os.path.join(folder, path), LIMIT + 1)) is not None}, base_path)
    rows, left, warnings = apply_samples(out["patterns"], samples or {})
    for path, pattern in rows:
        out["routes"].append((path, pattern, "dynamic", None, "samples", RANKS["dynamic"], len(out["routes"])))
    return out | {"unresolved": sorted(left), "warnings": out["warnings"] + warnings, "build_id": build_id(folder), "version": framework_version(root, folder)}


def ordered_routes(routes: DataFrame) -> DataFrame:
    return routes.orderBy(F.col("pathname").cast("string collate UNICODE"))


def ordered_redirects(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*[F.col(c).cast("string collate UNICODE") for c in ("source", "destination")])
