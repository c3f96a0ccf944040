"""Connected components by repeated contraction, all in DataFrame joins."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BROADCAST_ROWS, remove, renamed, shared_folder, stored


def components(edges: DataFrame, limit: int = BROADCAST_ROWS, hot: int = 100_000) -> DataFrame:
    """(node, label) for every node of edges (a, b), label the smallest node of its component.

    In each round every vertex hooks onto its smallest neighbour, parents are followed to their roots, and edges are
    renamed by the roots, so the number of vertices at least halves. Aggregates are partial before the shuffle; renaming
    splits the rows of a hub or of a large component (see `renamed`), so no task gets all of them. Steps are written as Parquet:
    a checkpoint would carry the plan's size estimates along, which multiply with every join until planning alone takes minutes.
    """
    folder, steps = shared_folder(edges.sparkSession, "components"), count()
    cut = lambda rows: stored(rows, f"{folder}/{next(steps)}")
    name = lambda rows, column, table, into: renamed(rows, column, table, into, limit, hot)
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a != b").distinct()
    edges = cut(edges)
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label"))
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        root = cut(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p")))
        while True:  # pointer jumping: a turn leads three parents on and tells whether the second was a root
            jump = name(name(root, "p", root, "q"), "q", root, "r")
            jump = cut(jump.select("a", "q", "r"))
            root = jump.select("a", F.col("r").alias("p"))
            if jump.where("q != r").isEmpty():
                break
        labels = cut(name(labels, "label", root, "q").select("node", F.coalesce("q", "label").alias("label")))
        ends = name(name(edges, "a", root, "x"), "b", root, "y")
        edges = cut(ends.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    labels = stored(labels)
    remove(labels.sparkSession, folder)
    return labels
