"""Candidate addresses: union of inventories, normalization, merge by address."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.patterns import included
from quarry.functions.urls import candidate_url, origin

#: reference, depth, kind, source (from), detail, priority, in_sitemap, render_mode, seq
INVENTORY = "reference string, depth int, kind string, source string, detail string, priority int, in_sitemap boolean, render_mode string, seq long"


def union_inventories(*inventories: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inventories)


def merge(rows: DataFrame, base_url: str, query_policy: str = "keep", include=(), exclude=(), keep_exact: bool = True) -> DataFrame:
    """url, depth, priority, sources, in_sitemap, render_mode: one row per address of the site.

    Least depth and priority, the set of sources, the first non-null build evidence; addresses of contracts keep their
    exact query. One grouping with partial aggregates.
    """
    policy = F.when(F.lit(keep_exact) & (F.col("kind") == "contract"), F.col("reference")).otherwise(candidate_url("reference", F.lit(base_url), query_policy))
    c = rows.withColumn("url", policy).where("url is not null").where(origin(F.col("url")) == origin(F.lit(base_url)))
    c = c.where(included(F.col("url"), list(include), list(exclude)) | (F.col("kind") == "contract"))
    source = F.struct(F.col("kind"), F.col("source").alias("from"), F.col("detail"))
    return c.groupBy("url").agg(
        F.min("depth").alias("depth"),
        F.min("priority").alias("priority"),
        F.array_sort(F.collect_set(source)).alias("sources"),
        F.coalesce(F.bool_or("in_sitemap"), F.lit(False)).alias("in_sitemap"),
        F.min_by("render_mode", F.when(F.col("render_mode").isNotNull(), F.col("seq"))).alias("render_mode"),
    )
