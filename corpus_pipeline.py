"""Corpus pipeline: documents to sharded training rows, in five stages over the operators of quarry.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs; a stage's files go once its successor is written. All but the last return the columns of documents.

Cases, for all stages: every row is judged by its own text, so rows with a null or repeated doc_id are documents of their
own; texts are read whole, however long; extra columns, whatever their names, pass through; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, jump_shard, language_id, ngram_jaccard, source_mix
from quarry.llm.common import remove, shared_folder, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay; null texts and texts without a letter go. A table without labels of languages keeps every text with a letter."""
    return language_id.known(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: that of the smallest doc_id, of rows without id an arbitrary one where no other has an id.

    Unlike texts stay, repeated ids or not; of wordless rows those that repeat an id go."""
    return ngram_jaccard.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go; an empty benchmark, or one without words, takes none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or drop out until their sources reach their targets; rows of one doc_id share their draw, null is a source of its own."""
    return source_mix.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard, 0 to 23, by its doc_id (null counts as 0). A column of that name that the rows bring along is kept as shard_input."""
    return jump_shard.assign(docs)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard", deduplicate),
    ("decontaminate", decontaminated),
    ("source_mix", mix),
    ("jump_shard", shard),
]

#: Language models and components of links have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            folder = shared_folder(spark, f"pipeline-{k}-{name}")
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
            if last is not None:
                remove(spark, last)
            last = folder
    return docs
