"""Globs, robots rules, redirect patterns and build patterns, compiled on the driver to anchored expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.urls import target


def escape(text: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}\-])", r"\\\1", text)


def glob(pattern: str) -> str:
    """** any text, * any but /, ? one but /."""
    parts = re.split(r"(\*\*|\*|\?)", pattern.strip())
    return "^" + "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, escape(p)) for p in parts) + "$"


def matches_glob(url: Column, pattern: str) -> Column:
    if not pattern.strip():
        return F.lit(False)
    subject = url if re.match(r"https?://", pattern.strip(), re.I) else target(url)
    return subject.rlike(glob(pattern))


def included(url: Column, include: list[str], exclude: list[str]) -> Column:
    """Any include (none: all) and no exclude."""
    keep = F.lit(True)
    if include:
        keep = F.lit(False)
        for p in include:
            keep = keep | matches_glob(url, p)
    for p in exclude:
        keep = keep & ~matches_glob(url, p)
    return keep


def robots_rule(pattern: str) -> str:
    end = pattern.endswith("$")
    return "^" + ".*".join(escape(p) for p in pattern.removesuffix("$").split("*")) + ("$" if end else "")


def robots_rule_column(pattern: Column) -> Column:
    """The same for a column of patterns."""
    end = pattern.endswith("$")
    bare = F.when(end, F.expr("null")).otherwise(pattern)
    bare = F.coalesce(bare, F.regexp_replace(pattern, r"\$$", ""))
    quoted = F.regexp_replace(bare, r"([\\^$.|?+()\[\]{}\-])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*", ".*"), F.when(end, F.lit("$")).otherwise(F.lit("")))


def specificity(pattern: Column) -> Column:
    return F.length(F.regexp_replace(pattern, r"[*$]", ""))


def redirect_source(pattern: str) -> tuple[str, str, int]:
    """origin, expression over path and query with a group per wildcard, number of groups."""
    m = re.match(r"(https?://[^/?#]*)([^?#]*)(\?[^#]*)?$", pattern)
    if m is None:
        raise ValueError(f"not an absolute address: {pattern}")
    base, path, query = m[1], m[2] or "/", m[3] or ""
    out, groups = "", 0
    segments = path.split("/")[1:]
    for k, segment in enumerate(segments):
        if segment == "**":
            if k != len(segments) - 1:
                raise ValueError("** stands only at the end")
            # the separator belongs to the rest, so the bare parent matches too
            out += "(?:/(.*))?" if k else "/(.*)"
            groups += 1
        elif segment == "*":
            out += "/([^/]+)"
            groups += 1
        else:
            out += "/" + escape(segment)
    return base, f"^{out}{escape(query)}$" if not out.endswith("(.*))?") else f"^{out[:-6]}([^?]*))?{escape(query)}$", groups


def build_route(pattern: str) -> str:
    """[x], [...x] and [[...x]] segments of a build's route pattern: one segment, one or more, any number; a slash may end the path."""
    kinds = (("[[...", "]]", "(?:/[^?#]+)?"), ("[...", "]", "/[^?#]+"), ("[", "]", "/[^/?#]+"))
    out = ""
    for segment in filter(None, pattern.split("/")):
        out += next((text for head, tail, text in kinds if segment.startswith(head) and segment.endswith(tail)), "/" + escape(segment))
    return f"^{out}/?$" if out else "^/$"
