"""The corpus pipeline: five stages, each applied to all that the one before it kept.

quality rules -> line dedup -> n-gram Jaccard join -> mixing sources -> packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeweave.llm import jaccard, lines, mixing, packing, quality
from quakeweave.llm._common import table, written

#: No SQL: expectation-maximisation, keyed orders and tokenization are not expressible; tests/llm compares with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior rejects go."""
    return quality.kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal or near to an earlier line go, and documents of which no word is left by that."""
    out = lines.deduplicated(docs)
    return out.filter((F.size("_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each class of near duplicates stays: five-word shingles, similarity 0.8 or more."""
    return jaccard.first_of_each(docs, jaccard.SHINGLE, jaccard.PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: a row for each pass over one, the last of a source cut where its target is met."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenized documents with their sequence and offset; a document taken twice is packed twice."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
