"""Options by path scope: scopes fold in the order they are declared, the last that gives a value wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.patterns import included

NAMES = ("require_title", "require_description", "require_canonical", "require_h1", "require_sitemap_coverage", "require_open_graph", "require_og_image", "max_depth", "max_response_ms", "max_redirect_hop_ms")
RANKS = {"error": 0, "warning": 1, "info": 2, "off": 9}


def effective(rows: DataFrame, options: dict) -> DataFrame:
    """rows(url, ...) with one column per option; scopes are few and compile to conditions of the scan, no join."""
    out = {}
    for name in NAMES:
        value = F.lit(options.get(name))
        for scope in options.get("paths", []):
            if scope.get(name) is not None:
                value = F.when(included(F.col("url"), scope.get("include", []), scope.get("exclude", [])), F.lit(scope[name])).otherwise(value)
        out[name] = value.cast("boolean" if name.startswith("require") else "int")
    return rows.withColumns(out)


def severity_rank(code: Column, own: Column, url: Column, options: dict) -> Column:
    """The severity rank that holds for one address: its own, the global override, then scoped ones; null is off."""
    rank = lambda text: F.element_at(F.create_map(*[F.lit(x) for k, v in RANKS.items() for x in (k, v)]), text)
    value = rank(own)

    def override(given: dict[str, str], value: Column, where: Column | None = None) -> Column:
        for c, severity in given.items():
            hit = code == c if where is None else (code == c) & where
            value = F.when(hit, F.lit(RANKS[severity])).otherwise(value)
        return value

    value = override(options.get("severities", {}), value)
    for scope in options.get("paths", []):
        if scope.get("severities"):
            value = override(scope["severities"], value, included(url, scope.get("include", []), scope.get("exclude", [])))
    return F.when(value < 9, value)
