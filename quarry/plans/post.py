"""From raw findings to the report's: severities, de-duplication, order, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.scopes import severity_rank
from quarry.plans.rules import COLUMNS, FAMILIES

SEVERITIES = ("error", "warning", "info")


def apply_severities(findings: DataFrame, options: dict | None = None) -> DataFrame:
    """Global, then scoped overrides; a group finding takes the highest severity any member's address keeps; `off` drops."""
    options = options or {}
    members = F.when(F.col("seq.family") == FAMILIES["groups"], F.concat(F.array("url"), "related")).otherwise(F.array("url"))
    ranks = F.transform(members, lambda u: severity_rank(F.col("code"), F.col("severity"), u, options))
    rank = F.array_min(F.filter(ranks, lambda r: r.isNotNull()))
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    return findings.withColumn("__rank", rank).where("__rank is not null").withColumn("severity", F.get(names, F.col("__rank"))).select(*COLUMNS)


def deduplicate(findings: DataFrame) -> DataFrame:
    """One finding per severity, address, code and message: the last evaluated. Partial aggregates, no window."""
    last = F.max_by(F.struct("related", "evidence", "seq"), F.struct("seq", "related")).alias("x")
    f = findings.groupBy("severity", "url", "code", "message").agg(last)
    return f.select("url", "code", "severity", "message", "x.related", "x.evidence", "x.seq")


def rank():
    return F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)


def ordered(findings: DataFrame) -> DataFrame:
    """Report order: severity, address, code, message, by the root collation."""
    return findings.orderBy(rank(), *[F.coalesce(F.col(c), F.lit("")).cast("string collate UNICODE") for c in ("url", "code", "message")])


def finish(findings: DataFrame, options: dict | None = None) -> DataFrame:
    return deduplicate(apply_severities(findings, options))


def summarize(routes: DataFrame, findings: DataFrame) -> DataFrame:
    """One row of counts; robots-blocked captures count as fetched."""
    one = lambda condition: F.when(condition, 1).otherwise(0)
    counted = {
        "routes": F.lit(1), "fetched": one(F.col("completion").isNotNull()), "indexable": one(F.col("indexability") == "indexable"),
        "noindex": one(F.col("indexability") == "noindex"), "redirects": one(F.col("hops") > 0),
    }
    found = {n: one(F.col("severity") == s) for s, n in (("error", "errors"), ("warning", "warnings"), ("info", "info"))}
    found["broken_links"] = one(F.col("code") == "broken-internal-link")
    left = routes.select(*[v.alias(k) for k, v in counted.items()], *[F.lit(0).alias(k) for k in found], "depth")
    right = findings.select(*[F.lit(0).alias(k) for k in counted], *[v.alias(k) for k, v in found.items()], F.lit(0).alias("depth"))
    sums = [F.coalesce(F.sum(k), F.lit(0)).cast("long").alias(k) for k in (*counted, *found)]
    return left.union(right).agg(*sums, F.greatest(F.lit(0), F.coalesce(F.max("depth"), F.lit(0))).alias("max_depth"))


def fails(findings: DataFrame, threshold: str) -> bool:
    """Whether any finding is as severe as the threshold."""
    return not findings.where(rank() <= SEVERITIES.index(threshold)).isEmpty()


def highest(findings: DataFrame) -> DataFrame:
    return findings.groupBy("url").agg(F.min(rank()).alias("rank"), F.count("*").alias("findings"))
