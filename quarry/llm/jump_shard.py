"""Jump consistent hashing of stable keys to shards, in DataFrame functions only (Lamping and Veach, 2014).

The 64-bit generator is carried in decimals, as the session's integers do not wrap. The jump sequence for n + 1
shards continues the one for n, so one fold gives both and a grown shard is the old one or the new one.
Slots are gapless within a shard: rows are ordered inside small parts of the shard (hash bucket of the key, then a range of the
text's CRC-32) and shifted by the parts' running counts, so no task holds a whole shard, nor all rows of one key. Rows that agree in
everything are one row with a count until the end, where the count is dealt out in chunks.

Cases: a null key hashes as 0, a text key by its 64-bit xxHash; a null text has no bytes (size 8, crc32 0); repeated rows share a
shard and get slots of their own, in whatever order; an empty table gives an empty result; `assign` keeps all other columns (one that
already has the new column's name is kept as <name>_input), the query ignores them. Texts are only measured and hashed, whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARDS, BUCKETS, PARTS, CHUNK = 24, 64, 32, 65_536
#: Fixed values of the published algorithm: multiplier of the generator, bits dropped, numerator.
MULTIPLIER, SHIFT, SPAN = 2862933555777941757, 1 << 33, float(1 << 31)
_WRAP = 1 << 64


def _dec(x: int) -> Column:
    return F.lit(str(x)).cast("decimal(38,0)")


def _step(key: Column) -> Column:
    return F.pmod(key * _dec(MULTIPLIER) + _dec(1), _dec(_WRAP)).cast("decimal(38,0)")


def _seed(key: Column) -> Column:
    """The key as an unsigned 64-bit decimal."""
    return F.pmod(F.coalesce(key.cast("long"), F.lit(0).cast("long")).cast("decimal(38,0)"), _dec(_WRAP)).cast("decimal(38,0)")


def jump(key: Column, shards: int) -> Column:
    """struct<shard int, grown int>: the shard among `shards`, and among one more."""

    def turn(s: Column, _: Column) -> Column:
        go = s["j"] <= F.lit(shards)
        b, k = s["j"], _step(s["key"])
        drawn = F.floor(k / _dec(SHIFT)).cast("double")
        j = F.floor((b + 1) * (F.lit(SPAN) / (drawn + 1))).cast("long")
        moved = F.struct(
            F.when(b < shards, b).otherwise(s["shard"]).alias("shard"), b.alias("grown"), j.alias("j"), k.alias("key")
        )
        return F.when(go, moved).otherwise(s)

    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("shard"), zero.alias("grown"), zero.alias("j"), _seed(key).alias("key"))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(shards)), start, turn, lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown"))
    )


def bucket(key: Column, buckets: int = BUCKETS) -> Column:
    """A sub-bucket of a shard from the generator's first state: bits that the shard does not use."""
    return F.pmod(F.floor(_step(_seed(key)) / _dec(1 << 20)), _dec(buckets)).cast("int")


def hashable(docs: DataFrame, key_col: str) -> Column:
    """The key as a long: text by its hash."""
    return F.xxhash64(key_col) if docs.schema[key_col].dataType.typeName() in ("string", "binary") else F.col(key_col)


def assign(docs: DataFrame, shards: int = SHARDS, key_col: str = "doc_id", into: str = "shard") -> DataFrame:
    """The rows with their shard in column `into`; nothing is shuffled."""
    if into in docs.columns:
        docs = docs.withColumnRenamed(into, f"{into}_input")
        key_col = f"{into}_input" if key_col == into else key_col
    return docs.withColumn(into, jump(hashable(docs, key_col), shards)["shard"])


def place(docs: DataFrame, shards: int = SHARDS, buckets: int = BUCKETS, parts: int = PARTS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of documents."""
    text, key = F.coalesce(F.col("text"), F.lit("")), hashable(docs, "doc_id")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        jump(key, shards).alias("s"),
        (bucket(key, buckets) * parts + F.floor(F.crc32(text.cast("binary")) / F.lit((1 << 32) // parts)).cast("int")).alias("part"),
    ).select("doc_id", "size", "text_crc32", F.col("s.shard").alias("shard"), F.col("s.grown").alias("grown_shard"), "part")
    same = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    # At most shards * buckets * parts rows, whatever the input.
    run = Window.partitionBy("shard").orderBy("part")
    counts = same.groupBy("shard", "part").agg(F.sum("n").alias("n"))
    before = F.broadcast(counts.select("shard", "part", (F.sum("n").over(run) - F.col("n")).alias("before")))
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    first = same.withColumn("nth", F.sum("n").over(order) - F.col("n")).join(before, ["shard", "part"])
    first = first.withColumn("slot", F.col("before") + F.col("nth"))
    many = first.where(F.col("n") > chunk).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(chunk).cast("long"))))
    many = many.repartition("k", "text_crc32").select("*", F.explode(F.sequence("k", F.least(F.col("k") + chunk, "n") - 1)).alias("i")).drop("k")
    few = first.where(F.col("n") <= chunk).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return few.unionByName(many).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("slot") + F.col("i")).cast("long").alias("slot"), "grown_shard"
    )


def op3(spark, sf_dir: str) -> DataFrame:
    return place(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: CRC-32 by its 256-entry table, the jump sequence and the slots in DuckDB, over whole tables.
ORACLE = """
WITH RECURSIVE t0(i, k, c) AS (
  SELECT range, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM t0 WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM t0 WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
h AS (SELECT rid, doc_id, octet_length(encode(text)) AS nb, hex(encode(text)) AS hx FROM d),
bytes AS (SELECT rid, doc_id, nb, list_transform(regexp_extract_all(hx, '..'), lambda x: ('0x' || x)::BIGINT) AS bs FROM h),
crc AS (SELECT rid, doc_id, nb, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(bs, lambda x: x::BIGINT)),
    lambda c, x: xor(c // 256, tab.tab[xor(c, x) % 256 + 1])), 4294967295) AS crc FROM bytes, tab),
ids AS (SELECT DISTINCT doc_id, CASE WHEN coalesce(doc_id, 0) < 0 THEN doc_id::HUGEINT + 18446744073709551616::HUGEINT ELSE coalesce(doc_id, 0)::HUGEINT END AS seed FROM documents),
mul AS (SELECT doc_id, seed, ((seed // 4294967296) * 2862933555777941757::HUGEINT % 4294967296 * 4294967296 + (seed % 4294967296) * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k1 FROM ids),
j(doc_id, b, b24, jj, k) AS (
  SELECT doc_id, 0::BIGINT, 0::BIGINT, floor(2147483648.0 / ((k1 // 8589934592)::DOUBLE + 1))::BIGINT, k1 FROM mul
  UNION ALL
  SELECT doc_id, jj, CASE WHEN jj < 24 THEN jj ELSE b24 END,
    floor((jj + 1) * (2147483648.0 / ((((((k // 4294967296) * 2862933555777941757::HUGEINT % 4294967296 * 4294967296 + (k % 4294967296) * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT)) // 8589934592)::DOUBLE + 1)))::BIGINT,
    ((k // 4294967296) * 2862933555777941757::HUGEINT % 4294967296 * 4294967296 + (k % 4294967296) * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT
  FROM j WHERE jj <= 24),
s AS (SELECT doc_id, max(b24) AS shard, max(b) AS grown FROM j GROUP BY doc_id)
SELECT crc.doc_id, nb + 8 AS size, crc AS text_crc32, 'key' AS law, s.shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY s.shard ORDER BY (k1 // 1048576) % 64, crc // 134217728, crc.doc_id NULLS FIRST, crc, nb) - 1 AS slot, s.grown::INTEGER AS grown_shard
FROM crc JOIN s ON crc.doc_id IS NOT DISTINCT FROM s.doc_id JOIN mul ON mul.doc_id IS NOT DISTINCT FROM s.doc_id
"""
