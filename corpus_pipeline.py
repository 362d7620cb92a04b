"""The corpus pipeline: five stages over ``documents``, each written as Parquet before the next reads it.

Clean documents pass every stage. Stage by stage: documents that the quality classifier rejects go;
of each group of near-duplicates (five-word similarity of 0.8 or more, every link verified) the row with the
smallest id stays (a row without an id only where none has one; rows that share an id but no text are
different documents); contaminated documents go; secrets in texts are masked; and what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallylake.llm import decontaminate, neardup, packing, quality, secrets
from rallylake.llm.common import materialize, release, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that are neither junk nor toxic stay."""
    scorer = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs.select(COLUMNS), scorer).where("keep").select(COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6, with a second source of candidates and exact links: of each component the row with the smallest id stays."""
    return neardup.distinct_rows(docs.select(COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents with a twentieth or more of their words in benchmark windows go."""
    found = decontaminate.decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(COLUMNS)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: secrets are masked; the document and its other text stay."""
    return secrets.redact(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one row per piece of a document in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_masking),
    ("packing", sequence_packing),
]

#: SQL cannot express the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each stage's result is written, read again, and removed once the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            release(before)
        before = docs
    return docs
