"""From raw documents to packed training sequences: five stages, each on what the one before kept.

Stages take (spark, docs, sf_dir); each result is written as Parquet and reread as the next one's docs.
All but the last return the columns of documents. The near-duplicate stage links texts as op 3 does, by
SimHash fingerprints within 3 bits that BK-trees find, and also texts whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more, which fingerprints miss; there min-hash bands propose, the sets decide.

Nulls: a null text has no words, so the first stage rejects it; null doc_ids, sources and other columns pass
through. Empty tables pass through as empty tables. Repeated rows become one at the third stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from surgelens.llm import best_fit, line_spread, near_texts, pii_votes, repetition
from surgelens.llm.common import stored, table

#: SQL expresses neither fingerprints nor packing; tests compare with a brute-force version
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return repetition.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on many sites; the first document keeps each."""
    return line_spread.without_boilerplate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_texts.one_of_each(docs, fingerprints=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    return pii_votes.masked(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents with their sequence and place."""
    return best_fit.op4(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("personal data", personal_data), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
