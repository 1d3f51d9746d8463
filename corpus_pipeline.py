"""A corpus pipeline: five operators in a row over whole documents.

Each stage takes what its predecessor kept and returns it with the columns of
documents; the last returns the packed pieces. ``run`` writes each stage as a
table in the shared folder, as a driver of the stages would.

Defined cases of every stage but the last: all columns stay, of any name;
nulls in columns other than text and doc_id change nothing; repeated rows and
very long texts are documents like any other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import packing, quality, rules, secrets, simhash
from framewright.llm.shared import fresh, materialize, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects.

    Null and empty texts are scored as one chunk of padding.
    """
    net = quality.trained(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.probability(F.col("text"), net) >= quality.THRESHOLD)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or lie far out.

    Null and empty texts fail; null languages and sources are groups.
    """
    stats, verdict = fresh(docs.columns, "stats"), fresh(docs.columns, "verdict")
    rows, _ = materialize(docs.withColumn(stats, rules.measured(F.col("text"))), "stats")
    judged = rules.judged(rows, stats, verdict)
    return judged.where(F.col(verdict)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of near copies: the smallest id.

    Five-word shingles, a similarity of 0.8 or more. Texts without words are
    copies of each other; of rows without ids one stays, if its group has none.
    """
    return simhash.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; n_chars follows the new text.

    Null texts stay null, and so does n_chars.
    """
    clean = docs.withColumn("text", secrets.redacted(F.col("text")))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs documents' tokens into sequences.

    A null or empty text is its end id alone.
    """
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("simhash_dedup", deduplicate),
    ("secret_scans", redact),
    ("best_fit_packing", pack),
]

#: Training and scoring a network, among others, have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
