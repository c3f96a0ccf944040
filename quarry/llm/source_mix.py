"""Mixing sources to target weights, in DataFrame functions.

Tokens per source are aggregated (partial sums first, so a source with a third of all rows costs no task more);
targets follow by weight with a cap; every document is emitted floor(rate) times plus one copy if a hash of its
id and the seed falls below the fraction. Sources rank by code point, null last, and take the weights in turn.

The table of sources is far smaller than the documents; it is ranked without gathering it in one task (range
partitions and their counts) and joined by broadcast only if counted small.

Cases: a null text has size 0; a null source is a source of its own, ranked last; a source without words has rate 0
(target 0); repeated rows take the same decision, rows without id that of the empty id; texts are counted whole; an empty table gives an
empty result; `mixed` keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import BROADCAST_ROWS, cut

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources(source, ...) with `nth` from 0 in code-point order, null last, by range partitions and their counts."""
    key = F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1"))
    parts = cut(sources.withColumn("__key", key).repartitionByRange("__key").withColumn("__part", F.spark_partition_id()))
    counts = parts.groupBy("__part").count().withColumn("__before", F.sum("count").over(Window.orderBy("__part")) - F.col("count"))
    nth = F.row_number().over(Window.partitionBy("__part").orderBy("__key")) - 1
    return parts.withColumn("__nth", nth).join(F.broadcast(counts.drop("count")), "__part").withColumn("nth", F.col("__before") + F.col("__nth")).drop("__key", "__part", "__nth", "__before")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes(source, source_size) with target: weighted shares of share * total, none above cap * its size.

    Capped sources leave the pool and the excess is shared again by weight; each round is one aggregate over the sources.
    """
    table = ranked(sizes)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    table = cut(table.withColumn("weight", weight))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    pool, level = share * total, 0.0
    while True:
        # Sources below the level they would get are capped; the level only rises, so capped ones stay so.
        capped = F.col("weight") * F.lit(level) > cap * F.col("source_size")
        row = table.agg(F.sum(F.when(capped, cap * F.col("source_size"))).alias("full"), F.sum(F.when(~capped, F.col("weight"))).alias("w")).first()
        if not row.w:
            break
        new = (pool - (row.full or 0.0)) / row.w
        if new <= level:
            break
        level = new
    return table.withColumn("target", F.least(F.col("weight") * F.lit(level), cap * F.col("source_size"))).select("source", "source_size", "target")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A uniform number in [0, 1) from the id and the seed."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 8)
    return F.conv(digits, 16, 10).cast("long") / F.lit(4294967296.0)


def plan(docs: DataFrame, carry: list[str], **options) -> DataFrame:
    """d (the carried columns of every row, as a struct, so that no column name matters), size, source_size, target, copies."""
    seed = options.pop("seed", SEED)
    size = size_of(F.col("text"))
    goal = cut(targets(docs.select("source", size.alias("size")).groupBy("source").agg(F.sum("size").alias("source_size")), **options))
    goal = goal.select(F.col("source").alias("of"), "source_size", "target")
    if goal.count() <= BROADCAST_ROWS:
        goal = F.broadcast(goal)
    rows = docs.select(F.struct(*carry).alias("d"), "source", size.alias("size"), draw(F.col("doc_id"), seed).alias("draw"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(rate) + (F.col("draw") < rate - F.floor(rate)).cast("long")
    return rows.join(goal, F.col("source").eqNullSafe(F.col("of"))).select("d", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix: the documents' own columns, each row `copies` times."""
    rows = plan(docs, docs.columns, **options).where("copies > 0")
    return rows.select("d", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("d.*")


def op6(spark, sf_dir: str) -> DataFrame:
    rows = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return rows.select("d.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT *, 2.0 * source_size / w AS ratio FROM s),
-- the level at which caps and shares add up: with all sources of smaller ratio capped
lv AS (SELECT ratio, (1.5 * (SELECT sum(source_size) FROM s) - coalesce((SELECT sum(2.0 * b.source_size) FROM r b WHERE b.ratio < a.ratio), 0))
         / (SELECT sum(b.w) FROM r b WHERE b.ratio >= a.ratio) AS level FROM r a),
l AS (SELECT level FROM lv WHERE level <= ratio ORDER BY ratio LIMIT 1),
t AS (SELECT source, source_size, least(w * (SELECT level FROM l), 2.0 * source_size)::DOUBLE AS target FROM s),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
  (('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':mix-1'), 1, 8))::BIGINT / 4294967296.0) AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
