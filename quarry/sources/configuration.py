"""Run configuration: defaults, file, overrides, strict keys."""

from __future__ import annotations

import copy
import json
import os
import re

#: Limits and defaults of a run.
DEFAULTS: dict = {
    "seeds": ["/"], "agents": ["default"], "include": [], "exclude": [], "query": "keep", "respect_robots": True,
    "limits": {"max_pages": 250, "max_depth": 8, "concurrency": 6, "timeout_ms": 15_000, "max_bytes": 2_000_000, "max_redirects": 5},
    "rendered": {"enabled": False, "concurrency": 2, "timeout_ms": 20_000, "settle_ms": 250},
    "audit": {}, "redirects": [], "headers": {}, "url_lists": [], "build": {}, "sitemaps": [],
}
#: Audit options and those of a path scope.
AUDIT = set("require_title require_description require_canonical require_h1 require_sitemap_coverage require_open_graph require_og_image max_depth max_response_ms max_redirect_hop_ms severities".split())
SCOPE = AUDIT | {"include", "exclude"}


def check_audit(audit: dict) -> None:
    """Unknown audit options and severities are errors, in path scopes too."""
    for name, part, known in (("audit", audit, AUDIT | {"paths"}), *((f"audit.paths[{k}]", p, SCOPE) for k, p in enumerate(audit.get("paths", [])))):
        if extra := set(part) - known:
            raise ValueError(f"unknown setting: {name}.{min(extra)}")
        if bad := [v for v in part.get("severities", {}).values() if v not in ("error", "warning", "info", "off")]:
            raise ValueError(f"{name}.severities: {bad[0]} is no severity")
        for k, v in part.items():
            if k.startswith("require") and not isinstance(v, bool) or k.startswith("max") and v is not None and (not isinstance(v, int) or isinstance(v, bool) or v < 0):
                raise ValueError(f"{name}.{k}: {v} is not valid")


#: Agents known by name.
AGENTS = {"default": "site-audit", "googlebot": "Googlebot", "bingbot": "bingbot", "mobile": "site-audit mobile"}


def load(path: str | None = None, overrides: dict | None = None, environment: dict | None = None) -> dict:
    """defaults <- file (JSON, or YAML where a parser is installed) <- overrides; unknown keys are errors."""
    given: dict = {}
    if path:
        text = open(path).read()  # noqa: SIM115
        if path.endswith((".yaml", ".yml")):
            import yaml

            given = yaml.safe_load(text) or {}
        else:
            given = json.loads(text)
    out = copy.deepcopy(DEFAULTS)
    for layer in (given, overrides or {}):
        for key, value in layer.items():
            if key != "base_url" and key not in DEFAULTS:
                raise ValueError(f"unknown setting: {key}")
            if isinstance(value, dict) and isinstance(out.get(key), dict) and key in ("limits", "rendered"):
                if extra := set(value) - set(out[key]):
                    raise ValueError(f"unknown setting: {key}.{min(extra)}")
                out[key].update(value)
            else:
                out[key] = value
    if not re.match(r"https?://[^/@]+", out.get("base_url") or ""):
        raise ValueError("base_url must be an http(s) address without credentials")
    check_audit(out["audit"])
    env = os.environ if environment is None else environment
    out["headers"] = {k: re.sub(r"\$\{(\w+)\}", lambda m: env[m[1]], v) for k, v in out["headers"].items()}
    return out


def headers(options: list[str]) -> dict[str, str]:
    out = {}
    for o in options:
        name, colon, value = o.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name.strip()):
            raise ValueError(f"not a header: {name}")
        out[name.strip()] = value.strip()
    return out


def agent(name: str) -> dict[str, str]:
    key = name.strip().lower()
    if key in AGENTS:
        return {"key": key, "label": key, "user_agent": AGENTS[key]}
    return {"key": "custom-" + re.sub(r"[^a-z0-9]+", "-", key).strip("-"), "label": name, "user_agent": name}


def milliseconds(text: str) -> int:
    m = re.fullmatch(r"(\d+(?:\.\d+)?)(ms|s|m)?", text)
    if m is None:
        raise ValueError(f"not a duration: {text}")
    return round(float(m[1]) * {"ms": 1, "s": 1000, "m": 60_000}[m[2] or "ms"])


def bytes_of(text: str) -> int:
    m = re.fullmatch(r"(\d+)(b|kb|mb)?", text, re.I)
    if m is None:
        raise ValueError(f"not a size: {text}")
    return int(m[1]) * {"b": 1, "kb": 1 << 10, "mb": 1 << 20}[(m[2] or "b").lower()]
