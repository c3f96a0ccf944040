"""URL lists: text lines with comments, diagnostics with their place, first occurrence wins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.urls import CONTROL, MAX_LENGTH, normalize_candidate, origin, resolve, split

LIMIT = 10 << 20


def classify(line: str, base: str, query_policy: str = "keep") -> tuple[str | None, str | None, str | None]:
    """(address, diagnostic code, severity) of one entry."""
    text = line.strip()
    if CONTROL.search(text) or len(text) > MAX_LENGTH:
        return None, "invalid-entry", "error"
    head = text.partition(":")[0]
    if ":" in text and head.isalnum() and head.lower() not in ("http", "https") and "/" not in head:
        return None, "unsupported-protocol", "error"
    absolute = resolve(text, base)
    parts = split(absolute) if absolute else None
    if parts is None:
        return None, "invalid-entry", "error"
    if parts[1]:
        return None, "credentials-not-allowed", "error"
    url = normalize_candidate(text, base, query_policy)
    if url is None:
        return None, "invalid-entry", "error"
    if split(url)[:4] != split(base)[:4]:
        return url, "off-origin", "warning"
    return url, None, None


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source, line, text of files, one row a line; a file over the size limit is one row with a null line and its size as text. Files are read by Spark's own reader."""
    f = spark.read.format("binaryFile").load(paths).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source"), "length", F.when(F.col("length") <= LIMIT, F.col("content")).alias("content"))
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^\\x{FEFF}", "")
    rows = f.where("content is not null").select("source", F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    return rows.union(f.where("content is null").select("source", F.lit(None).cast("int"), F.col("length").cast("string")))


def load(lines: DataFrame, base_url: str, query_policy: str = "keep") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries url, source, line; diagnostics; accepted and rejected per source) of lines(source, line, text); a null line is a file too large to read."""

    def run(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([classify(t, base_url, query_policy) for t in text], columns=["url", "code", "severity"])

    rows = lines.where(~F.ltrim("text").startswith("#") & (F.trim("text") != ""))
    rows = rows.withColumn("c", F.pandas_udf(run, "url string, code string, severity string")("text")).select("source", "line", "text", "c.*")
    large = F.col("line").isNull()
    rows = rows.withColumn("url", F.when(~large, F.col("url"))).withColumn("code", F.when(large, "source-too-large").otherwise(F.col("code"))).withColumn("severity", F.when(large, "error").otherwise(F.col("severity")))
    entries = rows.where("code is null").groupBy("url").agg(F.min(F.struct("source", "line")).alias("f")).select("url", "f.*")
    diagnostics = rows.where("code is not null").select("source", "line", "code", "severity")
    counts = rows.groupBy("source").agg(F.count_distinct(F.when(F.col("code").isNull(), F.col("url"))).alias("accepted"), F.count_if(F.col("code").isNotNull()).alias("rejected"))
    return entries, diagnostics, counts


__all__ = ["classify", "load", "origin", "read_files"]
