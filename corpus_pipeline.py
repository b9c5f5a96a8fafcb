"""A corpus from raw documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir) and returns documents with the columns it was given; the last one
returns what it reads back from the token files. run() writes every stage's result as Parquet in the
shared folder and reads it again, so a lost executor never reaches back behind a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from zonewright.llm.common import read, stored
from zonewright.llm.decontaminate import remove_contaminated
from zonewright.llm.mixing import mixed
from zonewright.llm.ngram_join import one_of_each_class
from zonewright.llm.token_output import byte_bpe, token_output
from zonewright.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models score below 0.7."""
    return without_toxic(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five words, similarity 0.8."""
    return one_of_each_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    return remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, read back from the token files."""
    return token_output(docs, byte_bpe())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: Learnt scores, random rounding and encoding have no SQL; tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
