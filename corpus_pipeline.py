"""Documents to token ids in five stages, each written as Parquet and read again as the next one's docs.

quality      drops documents that the classifier scores below 0.3
near_copies  keeps one document of each near-duplicate class (five words, Jaccard 0.8)
personal     replaces personal data in the texts
mixture      takes each source's share of the words in whole texts; documents taken twice come out twice
tokens       encodes the texts, with the ids, and decodes them again

Every stage takes null and empty texts, nulls in any column, repeated rows, very long texts, empty tables and
columns of any name; all but the last give the columns of documents back.  What is done with such rows
is said at each stage.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import bpe, mixture, ngram_join, pii, quality
from docweave.llm.common import remove, scratch, table

#: SQL can't express the stages; tests/llm tests each against brute force.
ORACLE_SQL = None


def _measured(docs: DataFrame) -> DataFrame:
    """docs with n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores 0.3 or more; null and empty texts are scored as empty, repeats alike."""
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class, of the smallest doc_id; texts without words, null or empty, all stay."""
    return ngram_join.keep_one(docs, size=5, percent=80)


def personal_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, entities replaced and n_chars measured again; null and empty texts stay as they are, repeats alike."""
    return _measured(pii.pseudonymise(docs, pii.EXAMPLE_KEY).select(*docs.columns))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole texts as often as the mix takes them; null and empty texts stay once; a null source is a source."""
    return _measured(mixture.mixed(docs))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of every row; null texts have no ids."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("near_copies", near_copies_stage),
    ("personal", personal_stage),
    ("mixture", mixture_stage),
    ("tokens", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; a stage's table is removed once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    place = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
        if before:
            remove(spark, before)
        before = f"{place}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
