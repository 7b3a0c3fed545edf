"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, surrogates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rookery.llm import decontam, dedup, packing, pii, quality
from rookery.llm.common import release, settled, table
from rookery.llm.queries import PII_SECRET, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep: each row by its own text, so equal rows stay or go alike. Null and empty texts have too few
    words and go. An empty table stays empty, further columns stay as they are."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more.

    Rows go by doc_id and text, so texts that share an id, and rows without one, are judged each for itself; null and
    empty texts stay, as does one of several equal rows. An empty table stays empty.
    """
    return dedup.survivors(docs, k=5, threshold=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window: each row by its own text. Null and empty texts have no words and stay, as does
    everything if the benchmark is empty; items without id or text match nothing."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data, n_chars counted anew. Every row stays, equal rows alike; null texts stay null
    and so count no characters, empty texts and those without entities are left alone."""
    return pii.rewrite(docs, PII_SECRET)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of 4096 tokens, ids as little-endian 32-bit integers. Null and empty texts are
    the end id alone, each row is packed for itself, an empty table gives no piece."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii_surrogates", surrogates),
    ("packing", packed),
]

#: Minhashes, merges and keyed surrogates have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next; what a later stage has read is deleted."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, settled(stage(spark, docs, sf_dir), name)
        if n:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
