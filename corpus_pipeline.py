"""A training-corpus pipeline: quality rules, near-copy join, substring dedup, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm.common import dropped, table, written
from hindcast.llm.jaccard import without_near_copies
from hindcast.llm.packing import packed, public_tokenizer
from hindcast.llm.pii import key_of, pseudonymised
from hindcast.llm.quality import keep_good
from hindcast.llm.substring import without_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go; null, empty and blank texts fail. Each row is judged on its own, whatever its id."""
    return keep_good(docs)


def near_copy_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at Jaccard 0.8 over five-word shingles, the smallest id of each group stays.

    Rows without id, and those without words, stay; of equal rows of one id one stays; other texts of an id are documents
    of their own.
    """
    return without_near_copies(docs, width=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 13-word windows that start in a smaller document go; texts without such words stay as they are.

    A null text stays null, and a row without id stays whole; rows of one id with different texts are judged apart.
    """
    found = without_repeats(docs)
    removed, kept = found.columns[-3], found.columns[-1]
    text = F.when(F.col(removed) > 0, F.col(kept)).otherwise(F.col("text"))
    return _rewritten(found, text, docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms of its own format; null and empty texts stay as they are, equal rows get equal results."""
    found = pseudonymised(docs, key_of(spark, demo=True))
    return _rewritten(found, F.col("text"), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows: one row per piece, with its ids; a null or empty text is its end id alone, a repeated row is packed again."""
    return packed(docs, public_tokenizer(), with_ids=True)


def _rewritten(df: DataFrame, text, columns: list[str]) -> DataFrame:
    df = df.withColumn("text", text)
    if "n_chars" in columns:
        df = df.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType))
    return df.select(*columns)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copy_join", near_copy_join),
    ("substring_dedup", substring_dedup),
    ("pii", pii),
    ("packing", packing),
]

#: The tokenizer's ids have no SQL; the tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        dropped(before)
    return docs
