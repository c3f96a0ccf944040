"""robots.txt files: availability and parsed groups."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.urls import normalize

RULES = "struct<groups:array<struct<agents:array<string>,delay:double,rules:array<struct<directive:string,pattern:string>>>>,sitemaps:array<string>,warnings:array<string>>"


def parse_delay(directive: str, value: str) -> float | None:
    """Seconds of a Crawl-delay, or of a Request-rate such as 1/10, 6/m or 1/10s."""
    if directive == "crawl-delay":
        return float(value) if re.fullmatch(r"\d+(?:\.\d+)?", value) else None
    m = re.fullmatch(r"(\d+)\s*/\s*(\d*)\s*(s|m|h)?", value, re.I)
    if m is None or int(m[1]) == 0:
        return None
    period = (int(m[2]) if m[2] else 1) * {"s": 1, "m": 60, "h": 3600}[(m[3] or "s").lower()]
    return period / int(m[1])


def parse(text: str, url: str) -> dict:
    """Groups begin at a user-agent line that follows a rule; rules before any group are ignored with a warning."""
    groups, sitemaps, warnings = [], [], []
    agents: list[str] = []
    rules: list[dict] = []
    delay, begun = None, False

    def commit():
        nonlocal agents, rules, delay, begun
        if agents:
            groups.append({"agents": agents, "delay": delay, "rules": rules})
        agents, rules, delay, begun = [], [], None, False

    for number, line in enumerate(re.split(r"\r\n|\r|\n", text.removeprefix("﻿")), 1):
        name, colon, value = line.partition("#")[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon or not name:
            continue
        if name == "user-agent":
            if begun:
                commit()
            if value:
                agents = [*agents, value]
        elif name in ("allow", "disallow"):
            if not agents:
                warnings.append(f"line {number}: rule before any user agent")
                continue
            begun = True
            if value:
                rules = [*rules, {"directive": name, "pattern": value}]
        elif name in ("crawl-delay", "request-rate"):
            begun = begun or bool(agents)
            seconds = parse_delay(name, value)
            if seconds is None:
                warnings.append(f"line {number}: {name} is not valid")
            elif agents:
                delay = max(delay or 0.0, seconds)
        elif name == "sitemap":
            found = normalize(value, url)
            if found:
                sitemaps.append(found)
            else:
                warnings.append(f"line {number}: sitemap address is not valid")
        else:
            warnings.append(f"line {number}: directive {name} is ignored")
    commit()
    return {"groups": groups, "sitemaps": list(dict.fromkeys(sitemaps)), "warnings": warnings}


def availability(status, content: bytes | None, error: str | None, limit: int = 512 << 10) -> tuple[str, str | None]:
    if error is not None:
        return "unavailable", error
    if status in (404, 410):
        return "missing", None
    if status is None or not 200 <= status < 300:
        return "unavailable", "http-error"
    if content is not None and len(content) > limit:
        return "unavailable", "too-large"
    try:
        (content or b"").decode("utf-8")
    except UnicodeDecodeError:
        return "unavailable", "parse-error"
    return "available", None


def read(files: DataFrame) -> DataFrame:
    """files(origin, url, status, content binary, error) with state, reason, robots (parsed)."""

    def run(url: pd.Series, status: pd.Series, content: pd.Series, error: pd.Series) -> pd.DataFrame:
        out = []
        for u, s, c, e in zip(url, status, content, error, strict=True):
            state, reason = availability(None if pd.isna(s) else int(s), c, e)
            out.append((state, reason, parse((c or b"").decode(), u) if state == "available" else parse("", u)))
        return pd.DataFrame(out, columns=["state", "reason", "robots"])

    parsed = F.pandas_udf(run, f"struct<state:string,reason:string,robots:{RULES}>")("url", "status", "content", "error")
    return files.select("origin", "url", parsed.alias("p")).select("origin", "url", "p.*")


def rules(parsed: DataFrame) -> DataFrame:
    """origin, group_ord, agents, delay, directive, pattern; a group without rules keeps one row with an empty pattern."""
    g = parsed.select("origin", F.posexplode("robots.groups").alias("group_ord", "g"))
    none = F.array(F.struct(F.lit("allow").alias("directive"), F.lit("").alias("pattern")))
    r = g.select("origin", "group_ord", "g.agents", "g.delay", F.explode(F.when(F.size("g.rules") > 0, F.col("g.rules")).otherwise(none)).alias("r"))
    return r.select("origin", "group_ord", "agents", "delay", "r.directive", "r.pattern")
