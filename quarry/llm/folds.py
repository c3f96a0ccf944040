"""The fold rule of the learned operators, and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FOLDS = 5


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; 0 is held out. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def sampled(rows: DataFrame, groups: list[str], most: int, *label: str) -> DataFrame:
    """At most `most` distinct rows(doc_id, text, groups, label) of every group, those of smallest draw.

    Distinct (doc_id, text) are estimated first, then about three times the wanted rows are compared, however large the table; copies of
    a row meet in partial aggregates, so a row that is repeated without end is one. Rows are taken as they are, never joined by id."""
    key = F.xxhash64(*[c for c in ("doc_id", "text", *groups) if c])
    rows = rows.select("doc_id", "text", *groups, *label).withColumn("__draw", key.bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52)))
    sizes = rows.groupBy(*groups).agg(F.approx_count_distinct("__draw", 0.02).alias("__n"))
    if groups:
        near = rows.join(F.broadcast(sizes.toDF(*[f"__{g}" for g in groups], "__n")), [F.col(g) == F.col(f"__{g}") for g in groups]).drop(*[f"__{g}" for g in groups])
    else:
        near = rows.withColumn("__n", F.lit(sizes.first()[0]))
    near = near.where(F.col("__draw") < 3.0 * most / F.greatest("__n", F.lit(1))).drop("__n")
    keys = ["doc_id", *groups, "__draw", "text"]
    once = near.groupBy(*keys).agg(*[F.max(c).alias(c) for c in label]) if label else near.select(*keys).distinct()
    order = Window.partitionBy(*groups).orderBy("__draw", "doc_id", "text")
    return once.withColumn("__nth", F.row_number().over(order)).where(F.col("__nth") <= most).drop("__nth", "__draw")
