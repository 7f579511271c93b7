"""From raw documents to packed training sequences: the stages and how they follow each other.

Every stage takes null ids and texts, repeated rows, empty tables and further columns, whatever their names, and all but
the last return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vintage_jobs.llm import decontam, packing, pii, quality, simhash
from vintage_jobs.llm.common import stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, accepts.

    Null and empty texts score 0 and go; repeated rows score alike; without labels of both kinds every other text gets
    the share of good labels (0.5, which is accepted, without any).
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id.

    Texts are near-duplicates at a similarity of 0.8 over five-word shingles. Candidates come from SimHash fingerprints by
    multi-index hashing, those beyond its radius from MinHash; each is verified on the shingles. Null and blank texts are copies of each other;
    of repeated rows one stays; a row without doc_id stays only where its whole group has none.
    """
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts and repeated rows stay.
    """
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; null texts stay null, and n_chars follows the text."""
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, placed in sequences; a null text packs as the empty one, its closing id alone."""
    return packing.packed(docs)


STAGES = [("quality", keep_good), ("simhash", keep_one_of_each), ("decontamination", drop_contaminated), ("pii", redact), ("packing", pack)]

#: Classifier and tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; each result but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
