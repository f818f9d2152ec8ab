"""A training corpus from the documents table, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import decontaminate, exact_dedup, mixing, quality, simhash
from quernstone.storage import discard, new_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier rejects go: those that score below 0.5, texts of fewer than three bytes and null ones among them.

    Equal texts score alike, so repeated rows and ties stay or go together. Without labels all rows stay; labels that are null or of
    unknown documents are ignored. An empty table stays empty.
    """
    return quality.good_documents(docs, _table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows of one content, null and the empty text being one each, that with the smallest id stays, a null id last; of equal ids one. An empty table stays empty."""
    return exact_dedup.distinct_documents(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id stays, a null id last. Rows without words (null, empty, only signs) are in no group and stay. An empty table stays empty."""
    return simhash.near_distinct(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with passages of the benchmark go, repeated rows alike. Null and empty texts stay; null and wordless items are ignored; an empty benchmark or table changes nothing."""
    return decontaminate.clean_documents(docs, _table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows get their number of copies, in the column `copies`, one at least. A null source is one like any other; rows repeated in id and source share theirs. An empty table stays empty."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each result written to the shared folder as Parquet and read again.

    A result is removed when the next one is written; the last that is written is what the returned rows are read from.
    """
    docs, folder, last = _table(spark, sf_dir, "documents"), new_folder(spark, "pipeline"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if last is not None:
            discard(spark, last)
        last = f"{folder}/{k}"
    return STAGES[-1][1](spark, docs, sf_dir)


#: None: SQL can't express stages 1, 3 and 5.
ORACLE_SQL = None
