"""A corpus pipeline: each stage takes the documents that the one before kept, as a table.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a
DataFrame.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, jaccard, langid, packing, pii
from quarry.llm.common import UID, drop_written, read_table, with_uid, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language: those without a letter.  Learns from the labelled ones among them."""
    own = docs.toDF(*(f"_q_{i}" for i in range(len(docs.columns))))  # names that the operator's columns cannot clash with
    found = langid.identify(own, langid.learnable(docs), f"_q_{docs.columns.index('text')}")
    return found.filter(F.col("lang_pred") != langid.UNDETERMINED).drop("lang_pred", "score", "bits_per_letter").toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document of the least doc_id (then the first row)."""
    rows = with_uid(docs)
    found = jaccard.near_classes(rows.select(UID, "doc_id", "text"))
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", UID)).alias("best"))
    kept = best.select(F.col(f"best.{UID}").alias(UID))
    return rows.join(kept, UID, "left_semi").drop(UID)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the benchmark contaminates."""
    rows = with_uid(docs)
    found = decontaminate.contamination(rows.select(UID, "doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    return rows.join(found.filter("contaminated").select(UID), UID, "left_anti").drop(UID)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of one window each."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("redaction", redaction),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written to the shared folder and read again."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trees, a packing plan and components of near-duplicates have no SQL form; tests/llm checks the stages by brute force.
ORACLE_SQL = None
