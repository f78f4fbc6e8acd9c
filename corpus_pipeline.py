"""A corpus pipeline of five stages over ``documents``; every stage calls one operator of ``assay.llm``.

Each stage's function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.exact_dedup import drop_exact_copies
from assay.llm.mixing import mix
from assay.llm.pieces import encode_pieces
from assay.llm.shared import cut, fold, table
from assay.llm.simhash import drop_near_copies
from assay.llm.toxicity import drop_toxic, train_toxicity


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5; the model learns from labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    return drop_toxic(docs, train_toxicity(docs, labels), threshold=0.5)


def remove_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return drop_exact_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are similar at 0.8 or more, found by SimHash, the one with the smallest id."""
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for."""
    return mix(docs)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a sampled segmentation, seeded by their id and the number of the copy, that decodes to the text."""
    return encode_pieces(docs, number_copies=True)


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_exact_copies),
    ("simhash_near_dedup", remove_near_copies),
    ("mix_sources", mix_sources),
    ("sentencepiece", sample_pieces),
]

#: A trained model's scores and random segmentations have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
