"""A training corpus in five stages: quality, exact and near duplicates, benchmark passages, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run` writes each result as
Parquet and hands it, read again, to the next stage. All but the last return the columns of
``documents``. Every stage takes an empty table, null ids and texts, empty and very long texts,
repeated rows and extra columns of any name; what becomes of them is said with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.bpe import encode_decode
from plumbline.llm.common import materialise, table
from plumbline.llm.decontaminate import drop_contaminated
from plumbline.llm.exact_dedup import drop_exact_duplicates
from plumbline.llm.near_dedup import drop_near_duplicates
from plumbline.llm.quality_qda import keep_good
from plumbline.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quadratic discriminant scores below 0.3; null and empty texts go by their score of zero statistics, repeated rows share one answer."""
    return keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row with the largest id of each group of equal texts, however often it was loaded; null texts count as empty, null ids as smallest."""
    return drop_exact_duplicates(docs, one_row=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each group linked by 0.8 of their five-word shingles; rows without words or id stay."""
    return drop_near_duplicates(docs, shingle_words=5, similarity=(80, 100))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold 0.8 of a benchmark item's five-word shingles; null and empty texts stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of ids and decoded text; a null text counts as empty and has none."""
    return encode_decode(docs, tokenizer_path(), fields=("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe_tokens", bpe_tokens),
]

#: A fitted model and a tokenizer decide these rows, which SQL cannot express; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
