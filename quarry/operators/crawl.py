"""Level-synchronous breadth-first search over captured links, with budgets, and shortest depths.

The driver only counts a level; frontiers, visited sets and edges stay distributed and every level is cut from its lineage.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.urls import origin
from quarry.operators.shared import cut

_MERGE = 32  # levels after which the visited set is written as one table


def depths(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, bound: int | None = None) -> DataFrame:
    """(url, depth) of every node(url): links from the nearest seed, -1 where none leads. edges(src, dst).

    Ends at the first empty level; a bound that is reached before it is an error. The edges are written once, dealt by src."""
    edges = edges.select("src", "dst").join(nodes.select(F.col("url").alias("dst")), "dst", "left_semi").distinct()
    edges = cut(edges.repartition("src"))
    seen = cut(seeds.select("url").distinct().join(nodes.select("url"), "url", "left_semi").withColumn("depth", F.lit(0)))
    level = seen
    for depth in count(1):
        level = edges.join(level.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct()
        level = cut(level.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        if bound is not None and depth > bound:
            raise ValueError(f"pages lie more than {bound} links from the seeds")
        seen = seen.union(level)
        if depth % _MERGE == 0:  # else the plan grows by every level
            seen = cut(seen.coalesce(max(1, seen.sparkSession.sparkContext.defaultParallelism)))
    return nodes.select("url").join(seen, "url", "left").select("url", F.coalesce("depth", F.lit(-1)).alias("depth"))


def crawl(candidates: DataFrame, captures: DataFrame, links: DataFrame, max_pages: int, max_depth: int) -> tuple[DataFrame, DataFrame, bool]:
    """Bounded crawl of every site at once: visited (url, depth), outbound edges (src, dst), truncated.

    candidates(url, depth, priority); captures(url, completion, status) is what fetching would return; links(src, dst).
    Budgets hold per origin. Within a level addresses go in order, so a cut is the same on every run: candidates
    deeper than max_depth or beyond max_pages set `truncated`, and a target over budget remains an outbound edge.
    Ends when no known address is left to visit, at most max_depth + 1 levels. Only the first max_pages + 1 addresses
    of a site are ranked on: up to a budget of 999 (spark.sql.optimizer.windowGroupLimitThreshold, 1000) tasks cut to them
    before the shuffle, beyond it one task ranks all fresh addresses a site has in a level.
    """
    rank = Window.partitionBy(origin(F.col("url"))).orderBy("depth", "priority", "url")
    c = cut(candidates.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= max_pages + 1))
    within = (F.col("depth") <= max_depth) & (F.col("n") <= max_pages)
    truncated = not c.where(~within).isEmpty()
    known = c.where(within).select("url", "depth", F.lit(False).alias("done"))
    open_pages = captures.where("completion = 'complete' and status between 200 and 299").select(F.col("url").alias("src"))
    usable = links.select("src", "dst").distinct().where(origin(F.col("src")) == origin(F.col("dst"))).where(~F.col("dst").rlike(r"^https?://[^/]*/cdn-cgi/l/email-protection")).join(open_pages, "src", "left_semi")
    usable = cut(usable.repartition("src"))
    outbound = usable.limit(0)
    for level in count(1):
        low = known.where(~F.col("done")).agg(F.min("depth")).first()[0]
        if low is None:
            break
        now = known.where(~F.col("done") & (F.col("depth") == low)).select(F.col("url").alias("src"))
        found = cut(usable.join(now, "src").select("src", "dst"))
        outbound = outbound.union(found)
        if level % _MERGE == 0:
            outbound = cut(outbound)
        targets = found.groupBy(F.col("dst").alias("url")).agg(F.min("src").alias("via"))
        used = known.groupBy(origin(F.col("url")).alias("o")).agg(F.count("*").alias("used"))
        order = Window.partitionBy("o").orderBy("via", "url")
        fresh = targets.join(known.select("url"), "url", "left_anti").withColumn("o", origin(F.col("url"))).withColumn("k", F.row_number().over(order))
        fits = (F.lit(low + 1) <= max_depth) & (F.col("k") + F.coalesce("used", F.lit(0)) <= max_pages)
        fresh = cut(fresh.where(F.col("k") <= max_pages + 1).join(used, "o", "left").select("url", fits.alias("fits")))
        truncated = truncated or not fresh.where(~F.col("fits")).isEmpty()
        lowered = known.join(targets.select("url", F.lit(True).alias("hit")), "url", "left")
        depth = F.when(F.col("hit"), F.least("depth", F.lit(low + 1))).otherwise(F.col("depth"))
        lowered = lowered.select("url", depth.alias("depth"), (F.col("done") | (F.col("depth") == low)).alias("done"))
        known = cut(lowered.union(fresh.where("fits").select("url", F.lit(low + 1).alias("depth"), F.lit(False).alias("done"))))
    return known.select("url", "depth"), outbound, truncated
