"""Documents to token ids: five stages, each a table in and a table out.

Every stage but the last returns rows of ``documents`` with all their columns; between stages the rows are written as Parquet
below ``spark.checkpoint.dir`` and read again, so a lost executor repeats one stage's tasks at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pressline.llm import bpe, decontaminate, langid, quality, simhash
from pressline.llm.frames import ship, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text has no letter, or no language with a score of a half; learned from the labelled rows of ``docs``."""
    ship(spark)
    return langid.in_a_language(docs, langid.train_without_held_out(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that fail the base rules and rows of refused hosts."""
    ship(spark)
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, that with the smallest id."""
    ship(spark)
    return simhash.one_of_each_group(docs, shingle_words=3, max_distance=2)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows of whose words a benchmark covers a twentieth or more."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids, decoded)`` of each row."""
    ship(spark)
    return bpe.coded(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language), ("quality_rules", good_quality), ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminated), ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


# No stage but the quality rules and the decontamination can be said in SQL; tests hold the rest against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
