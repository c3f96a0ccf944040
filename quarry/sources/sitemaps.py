"""Sitemap files and indexes, followed level by level over a table of captured files."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.urls import normalize
from quarry.operators.shared import cut

FILES, DEPTH, ENTRIES = 100, 4, 100_000
_ENTRY = "struct<url:string,last_modified:string,alternates:array<struct<language:string,href:string,resolved_url:string>>>"
PARSED = f"struct<kind:string,entries:array<{_ENTRY}>,children:array<string>,warnings:array<string>>"


def _name(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def parse(xml: str | None, url: str) -> dict:
    """Entries or child files, whatever the namespaces' prefixes; a bad entry is a warning, a bad file an empty result."""
    out: dict = {"kind": "invalid", "entries": [], "children": [], "warnings": []}
    try:
        if "<!DOCTYPE" in (xml or ""):
            raise ValueError("a document type is not allowed")
        root = ElementTree.fromstring((xml or "").encode())
    except (ElementTree.ParseError, ValueError) as e:
        return out | {"warnings": [f"{url}: {e}"]}
    kind = _name(root.tag)
    if kind not in ("urlset", "sitemapindex"):
        return out | {"warnings": [f"{url}: neither a sitemap nor an index"]}
    out["kind"] = kind
    for node in root:
        if _name(node.tag) != ("url" if kind == "urlset" else "sitemap"):
            continue
        loc = next((c.text or "" for c in node if _name(c.tag) == "loc"), "").strip()
        found = normalize(loc, url) if loc else None
        if found is None:
            out["warnings"].append(f"{url}: an entry has no valid address")
        elif kind == "sitemapindex":
            out["children"].append(found)
        else:
            alternates = []
            for c in node:
                if _name(c.tag) == "link" and c.get("rel") == "alternate" and c.get("hreflang") and c.get("href"):
                    alternates.append({"language": c.get("hreflang"), "href": c.get("href"), "resolved_url": normalize(c.get("href"), url)})
            last = next((c.text for c in node if _name(c.tag) == "lastmod"), None)
            out["entries"].append({"url": found, "last_modified": last and last.strip(), "alternates": alternates})
    return out


def parsed(files: DataFrame) -> DataFrame:
    """files(url, xml) with the parsed struct p."""

    def run(xml: pd.Series, url: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(x, u) for x, u in zip(xml, url, strict=True)], columns=["kind", "entries", "children", "warnings"])

    return files.select("url", F.pandas_udf(run, PARSED)("xml", "url").alias("p"))


def follow(start: DataFrame, files: DataFrame, depth: int = DEPTH, most: int = FILES, entries: int = ENTRIES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files fetched, entries, warnings) from start(url, ord): breadth-first over indexes with a visited set; the first entry of an address wins.

    Limits that are reached, and files deeper than `depth`, are warnings."""
    known = cut(parsed(files))
    level = cut(start.select("url", F.col("ord").cast("long").alias("ord")).orderBy("ord").limit(most))
    seen = level.withColumn("level", F.lit(0))
    full, late = start.limit(most + 1).count() > most, None
    for k in range(1, depth + 1):
        child = known.join(level, "url").select("ord", F.posexplode("p.children").alias("at", "child"))
        child = child.groupBy(F.col("child").alias("url")).agg(F.min(F.struct("ord", "at")).alias("place"))
        child = cut(child.join(seen.select("url"), "url", "left_anti"))
        room = most - seen.count()
        full = full or child.limit(room + 1).count() > room
        # at most `most` files, numbered in the order of their parents and of their place there
        level = child.orderBy("place").limit(max(0, room)).withColumn("ord", F.row_number().over(Window.orderBy("place")).cast("long")).select("url", "ord")
        level = cut(level)
        if level.isEmpty():
            break
        seen = cut(seen.union(level.withColumn("level", F.lit(k))))
    else:
        late = known.join(level, "url").select("ord", F.posexplode("p.children").alias("at", "child")).join(seen.select(F.col("url").alias("child")), "child", "left_anti")
        late = late.select("ord", "at", F.concat(F.lit("Not followed, too deep: "), "child").alias("warning"))
    got = seen.join(known, "url")
    rows = got.select(F.col("url").alias("sitemap_url"), "level", "ord", F.posexplode("p.entries").alias("at", "e")).select("sitemap_url", F.struct("level", "ord", "at").alias("o"), "e.*")
    first = rows.groupBy("url").agg(F.min_by(F.struct("sitemap_url", "last_modified", "alternates", "o"), "o").alias("x")).select("url", "x.*")
    first = cut(first)
    warnings = got.select("level", "ord", F.posexplode("p.warnings").alias("at", "warning"))
    spark = files.sparkSession
    more = [(10**6, 0, 0, f"Stopped at {most} files.")] if full else []
    if first.limit(entries + 1).count() > entries:
        more.append((10**6, 1, 0, f"Stopped at {entries} entries."))
    warnings = warnings.union(spark.createDataFrame(more, "level int, ord long, at int, warning string"))
    if late is not None:
        warnings = warnings.union(late.select(F.lit(depth).alias("level"), F.col("ord") + (1 << 40), "at", "warning"))
    return seen.select("url"), first.orderBy("o").limit(entries).drop("o"), warnings.orderBy("level", "ord", "at").select("warning")
