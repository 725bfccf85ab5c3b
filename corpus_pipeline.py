"""A corpus pipeline of five stages over ``documents``; each stage's rows are written and read again by the next.

SQL cannot express the trained, randomised and tokenising stages, so there is no SQL for the whole; the tests hold each
stage against a plain version of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelore.llm import bpe, exact_dedup, jaccard_join, language_id, mixing
from sourcelore.llm.common import table
from sourcelore.session import ensure_checkpoint_dir

#: SQL cannot say what the stages do.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; those without a letter or without text go."""
    model = language_id.trained(docs)
    return language_id.identified(docs, model).where(F.col("lang_pred") != language_id.UNDETERMINED).select("row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id."""
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; null and empty texts stay."""
    return jaccard_join.without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it."""
    return mixing.mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, the token ids of each document of the mix, their number, and a digest of the text they decode to."""
    made = bpe.round_trip(docs, carried=["doc_id", "source", "lang"])
    return made.select("row.*", "ids", "n_tokens", "decoded_sha256")


STAGES = [
    ("language ID", language),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources", mix),
    ("BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what each makes is written below the shared checkpoint folder."""
    import uuid

    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
