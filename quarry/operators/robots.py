"""Robots decisions for columns of addresses: the most specific agent groups, then the longest rule, allow winning ties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.patterns import robots_rule_column, specificity
from quarry.functions.urls import origin, target


def select_groups(rules: DataFrame, user_agent: str) -> DataFrame:
    """rules(origin, group_ord, agents array, directive, pattern) of the groups that hold for the agent."""
    agent = user_agent.lower()
    match = F.array_max(F.transform("agents", lambda a: F.when(a == "*", 0).when(F.lit(agent).contains(F.lower(a)), F.length(a)).otherwise(-1)))
    scored = rules.withColumn("match", match).where("match >= 0")
    best = scored.groupBy("origin").agg(F.max("match").alias("match"))
    return scored.join(best, ["origin", "match"])


def decide(urls: DataFrame, rules: DataFrame, availability: DataFrame, user_agent: str) -> DataFrame:
    """urls(url) with `allowed`. availability(origin, state) has a row for every audited origin: missing allows all, unavailable or null
    (not fetched) blocks all. An address of an origin without a row is another site's and is allowed.

    The join is on the origin; only an origin's own rules are tested against its paths.
    """
    chosen = select_groups(rules, user_agent).where("pattern != ''").select("origin", F.col("directive") == "allow", robots_rule_column(F.col("pattern")).alias("expression"), specificity(F.col("pattern")).alias("weight"))
    chosen = chosen.toDF("origin", "allow", "expression", "weight")
    u = urls.select("url", origin(F.col("url")).alias("origin"), target(F.col("url")).alias("path"))
    hit = u.distinct().join(chosen, "origin").where("path rlike expression").groupBy("url").agg(F.max_by("allow", F.struct("weight", "allow")).alias("won"))
    out = u.join(availability.withColumn("known", F.lit(True)), "origin", "left").join(hit, "url", "left")
    return out.select("url", F.when(F.col("known").isNull() | (F.col("state") == "missing"), True).when(F.col("state") == "available", F.coalesce("won", F.lit(True))).otherwise(False).alias("allowed"))


def delays(rules: DataFrame, agents: list[str]) -> DataFrame:
    """origin, delay: the longest crawl delay of the groups that hold for any agent. rules carry `delay`."""
    parts = [select_groups(rules, a).select("origin", "delay") for a in agents]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("origin").agg(F.max("delay").alias("delay"))


#: Fixed value: the longest delay of a robots file that is kept, in milliseconds.
MOST_DELAY = 10_000


def pacing(delays: DataFrame, configured_ms: int = 0, honoured: bool = True) -> DataFrame:
    """origin, delay_ms, robots_delay_seconds, clamped of delays(origin, delay in seconds): the configured delay or the declared one up to MOST_DELAY."""
    declared = F.col("delay").cast("double") if honoured else F.lit(None).cast("double")
    wanted = F.ceil(F.coalesce(declared, F.lit(0.0)) * 1000).cast("long")
    kept = F.greatest(F.lit(configured_ms).cast("long"), F.least(wanted, F.lit(MOST_DELAY).cast("long")))
    return delays.select("origin", kept.alias("delay_ms"), declared.alias("robots_delay_seconds"), (wanted > kept).alias("clamped"))
