"""From documents to packed sequences: five stages, each written as Parquet and read again by the next.

Every stage takes documents with doc_id, text and source and, but for the last, returns the columns that it was given,
whatever else they are called. An empty table passes all stages; what else odd rows mean is said stage by stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import mixing, near_dup, packing, quality_rules, secrets
from tesserae.llm.common import Passing, drop_path, fresh_path, read


def passing_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go. Null and empty texts have no words and go; repeated rows are judged each."""
    return quality_rules.passing(docs)


def one_of_each_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document of least id stays: five-word shingles, similarity 0.8.

    Null and empty texts and rows with a null id are near to nothing and stay; rows with one id are one document and
    stay or go together.
    """
    return near_dup.without_near_duplicates(docs, shingle=5, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; all documents stay. A null text stays null; repeated rows are masked each."""
    return secrets.masked(docs)


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, in training order.

    Texts without words are never taken; a null source is a source of its own; repeated rows are separate documents;
    the one document at which its source's target is reached may give a copy of its first words only.
    """
    return mixing.training_order(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens. A null text is its end id alone; copies are packed each."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", passing_quality_rules),
    ("near-duplicates", one_of_each_near_copy),
    ("secrets", without_secrets),
    ("mixing", mixed_to_weights),
    ("packing", packed),
]
#: SQL has no tokenizer and no iteration to components of a given cost. The tests hold the whole against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, "pipeline-" + name.replace(" ", "-"))
        with Passing(spark):  # the stage's own tables go when its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
