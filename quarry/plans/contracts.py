"""Redirect contracts: exact sources joined, patterns compiled and matched by origin, every expectation checked."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.patterns import redirect_source
from quarry.functions.urls import normalize, normalize_url, origin, split
from quarry.plans.rules import emit, finding

CONTRACT = "`from` string, `to` string, status int, max_hops int, kind string, source string, declared_pattern string, ord int"


def resolve(declared: list[dict], base_url: str, max_redirects: int = 5) -> list[dict]:
    """Checked contracts (from, to, status, max_hops, kind, samples) of declarations (from, to, status[, max_hops, samples]), ordered by source.

    Refused: sources of another site, addresses that are none, contracts that lead to themselves, wildcards out of place or more of them in the target,
    samples of exact contracts, of another site, with wildcards or off the pattern, hops beyond max_redirects, and two unlike contracts for a source.
    """
    done: dict[str, dict] = {}
    for n, given in enumerate(declared):

        def fail(what: str, n: int = n) -> None:
            raise ValueError(f"redirects[{n}]: {what}")

        def address(text: str, name: str) -> str:
            url = normalize(text, base_url)
            if url is None:
                fail(f"{name} is no http(s) address or path without credentials")
            return url

        source, target = address(given["from"], "from"), address(given["to"], "to")
        if split(source)[:4] != split(base_url)[:4]:
            fail("the source lies on another site")
        if source == target:
            fail("an address cannot redirect to itself")
        kind = "pattern" if is_pattern(source) else "exact"
        try:
            slots = redirect_source(source)[2]
            wanted = redirect_source(target)[2]
        except ValueError as e:
            fail(str(e))
        if "*" in re.sub(r"/(?:\*\*?)(?=/|$)", "/", source.partition("?")[0]) or "*" in source.partition("?")[2]:
            fail("a wildcard stands for a whole segment of the path")
        if "*" in re.sub(r"/(?:\*\*?)(?=/|$)", "/", target.partition("?")[0]) or "*" in target.partition("?")[2]:
            fail("a wildcard of the target stands for a whole segment of the path")
        if wanted > slots:
            fail(f"the target has {wanted} wildcards, the source {slots}")
        samples = []
        for given_sample in given.get("samples") or []:
            if kind == "exact":
                fail("samples belong to patterns")
            url = address(given_sample, "a sample")
            if split(url)[:4] != split(base_url)[:4]:
                fail("a sample lies on another site")
            if "*" in url.partition("?")[0]:
                fail("a sample is a concrete address")
            if not re.match(redirect_source(source)[1], re.sub(r"^https?://[^/?#]*", "", url)):
                fail(f"the sample {given_sample} does not match {given['from']}")
            samples.append(url)
        hops = given.get("max_hops", 1)
        if hops > max_redirects:
            fail(f"max_hops is beyond max_redirects ({max_redirects})")
        row = {"from": source, "to": target, "status": given["status"], "max_hops": hops, "kind": kind}
        before = done.get(source)
        if before is not None and any(before[k] != row[k] for k in row):
            fail(f"another contract for {source} says otherwise")
        done[source] = row | {"samples": list(dict.fromkeys([*(before or {}).get("samples", []), *samples]))}
    return [done[k] for k in sorted(done)]


def is_pattern(url: str) -> bool:
    return "*" in url


def built(redirects: DataFrame, base_url: str) -> DataFrame:
    """from, to, status, usable of a build's redirects(source, destination, status, conditional): usable ones are unconditional, exact and of this site."""
    token = r"[:*()\[\]{}]"
    r = redirects.withColumn("from", normalize_url(F.col("source"), F.lit(base_url))).withColumn("to", normalize_url(F.col("destination"), F.lit(base_url)))
    plain = lambda raw, url: url.isNotNull() & (origin(url) == origin(F.lit(base_url))) & ~raw.rlike(r"[?#]") & ~F.regexp_replace(raw, r"^https?://[^/]*", "").rlike(token)
    fit = plain(F.col("source"), F.col("from")) & plain(F.col("destination"), F.col("to")) & (F.col("from") != F.col("to")) & F.col("status").isin(301, 302, 303, 307, 308) & ~F.coalesce(F.col("conditional"), F.lit(False))
    return r.select("from", "to", "status", F.coalesce(fit, F.lit(False)).alias("usable"))


def collect(configured: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contracts, one row with `skipped`): configured contracts override the build's for the same source; of a build source with several targets none
    is kept. found(from, to, status[, usable]) come from `built`; skipped counts what cannot be a contract and every definition of such a source."""
    if "usable" not in found.columns:
        found = found.withColumn("usable", F.lit(True))
    ours = found.where("usable").join(configured.select("from").distinct(), "from", "left_anti")
    per = ours.groupBy("from").agg(F.count("*").alias("rows"), F.count_distinct("to", "status").alias("kinds"), F.min("to").alias("to"), F.min("status").alias("status"))
    kept = per.where("kinds = 1").select("from", "to", "status", F.lit(1).alias("max_hops"), F.lit("exact").alias("kind"), F.lit("build").alias("source"), F.lit(None).cast("string").alias("declared_pattern"), F.lit(0).alias("ord"))
    lost = per.where("kinds > 1").select(F.col("rows").alias("n")).union(found.where("not usable").select(F.lit(1).cast("long")))
    return configured.select(*kept.columns).unionByName(kept), lost.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("skipped"))


def ordered(contracts: DataFrame) -> DataFrame:
    return contracts.orderBy(*[F.col(c).cast("string collate UNICODE") for c in ("from", "source")])


def expand(patterns: list[dict], urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contracts for the addresses (url) and the patterns' own samples that the patterns match, and the patterns without a match.

    Each pattern is one compiled condition of the scan; a source matched by several patterns belongs to the first.
    """
    out = None
    if given := sorted({x for p in patterns for x in p.get("samples") or []}):
        urls = urls.select("url").union(urls.sparkSession.createDataFrame([(x,) for x in given], "url string")).distinct()
    for k, p in enumerate(patterns):
        base, expression, groups = redirect_source(p["from"])
        path = F.regexp_extract("url", r"^https?://[^/?#]*([^#]*)", 1)
        to = F.lit(p["to"])
        at = 0
        pieces = []
        for piece in _wildcards(p["to"]):
            if piece in ("*", "**"):
                at += 1
                pieces.append(F.regexp_extract(path, expression, min(at, groups)))
            else:
                pieces.append(F.lit(piece))
        to = F.concat(*pieces)
        one = urls.where((F.regexp_extract("url", r"^(https?://[^/?#]*)", 1) == base) & path.rlike(expression))
        one = one.select(F.col("url").alias("from"), to.alias("to"), F.lit(p["status"]).alias("status"), F.lit(p.get("max_hops", 1)).alias("max_hops"), F.lit("pattern").alias("kind"), F.lit(p.get("source", "config")).alias("source"), F.lit(p["from"]).alias("declared_pattern"), F.lit(k).alias("ord"))
        out = one if out is None else out.union(one)
    spark = urls.sparkSession
    declared = spark.createDataFrame([(p["from"], k) for k, p in enumerate(patterns)], "declared_pattern string, ord int")
    if out is None:
        return spark.createDataFrame([], CONTRACT), declared
    matched = out.select("declared_pattern").distinct()
    names = out.columns
    first = out.groupBy("from").agg(F.min_by(F.struct(*names), "ord").alias("c")).select("c.*")
    return first, declared.join(matched, "declared_pattern", "left_anti")


def _wildcards(text: str) -> list[str]:
    return [p for p in re.split(r"(\*\*|\*)", text) if p]


def audit(contracts: DataFrame, routes: DataFrame, unmatched: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, checks with outcome) of the contracts over enriched routes."""
    r = routes.select(F.col("url").alias("from"), "completion", F.col("status").alias("got"), "hops", "redirects", "final_url", "tokens", "content_type")
    c = contracts.join(r, "from", "left").withColumn("url", F.col("from"))
    done = F.col("completion") == "complete"
    unchecked = ~F.coalesce(done, F.lit(False))
    # Indexability of the page at the end of the redirects.
    page = F.col("got").between(200, 299) & (F.col("content_type").isNull() | F.col("content_type").rlike(r"(?i)^(text/html|application/xhtml\+xml)\b"))
    noindex = F.coalesce(page, F.lit(False)) & F.array_contains("tokens", "noindex")
    moved, reached = done & (F.col("hops") > 0), F.col("final_url") == F.col("to")
    first = F.get("redirects", 0)["status"]
    sick = moved & reached & (F.col("got").isNull() | ~F.col("got").between(200, 299) | noindex)
    rules = [
        finding(unchecked, "redirect-contract-unchecked", "warning", F.concat(F.lit("The source was not captured: "), F.coalesce("completion", F.lit("not-fetched"))), 0, F.array("to")),
        finding(done & (F.col("hops") == 0), "expected-redirect-missing", "error", F.concat_ws(" ", F.lit("No redirect where expected, to"), F.col("to"), F.lit("with"), F.col("status").cast("string")), 1, F.array("to"), expectedStatus=F.col("status"), actualStatus=F.col("got")),
        finding(moved & (first != F.col("status")), "redirect-status-mismatch", "error", F.concat_ws(" ", F.lit("Expected redirect status"), F.col("status").cast("string"), F.lit("but got"), first.cast("string")), 2, F.array("to"), expectedStatus=F.col("status"), actualStatus=first),
        finding(moved & ~reached, "redirect-target-mismatch", "error", F.concat_ws(" ", F.lit("Expected the end at"), F.col("to"), F.lit("but reached"), F.col("final_url")), 3, F.array_distinct(F.array("to", "final_url"))),
        finding(moved & (F.col("hops") > F.col("max_hops")), "redirect-chain", "warning", F.concat_ws(" ", F.lit("Redirects:"), F.col("hops").cast("string"), F.lit("allowed:"), F.col("max_hops").cast("string")), 4, F.transform("redirects", lambda h: h["location"])),
        finding(sick, "redirect-target-unhealthy", "error", F.when(noindex, "The target is kept from the index.").otherwise(F.concat(F.lit("The target answered with "), F.coalesce(F.col("got").cast("string"), F.lit("no status")))), 5, F.array("to"), targetStatus=F.col("got")),
    ]
    findings = emit(c, "contracts", *rules)
    if unmatched is not None:
        lost = unmatched.withColumn("url", F.col("declared_pattern"))
        findings = findings.union(emit(lost, "contracts", finding(F.lit(True), "redirect-pattern-unmatched", "info", "The pattern matched no address.", 6)))
    codes = F.array_compact(F.array(*[r["code"] for r in rules]))
    outcome = F.when(unchecked, "unchecked").when(F.size(codes) == 0, "verified").otherwise("failed")
    return findings, c.select("from", "to", "status", "kind", "declared_pattern", codes.alias("codes"), outcome.alias("outcome"))


def outcomes(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count("*").alias("contracts"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("verified", "failed", "unchecked")],
        F.count_distinct(F.when(F.col("kind") == "pattern", F.col("from"))).alias("pattern_matches"),
    )
