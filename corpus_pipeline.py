"""A corpus cleaned and packed in five stages, each a call of one training-data operator.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; all but the last return the
columns of docs, whatever further columns there are.  Between stages the rows are written as Parquet and read again.

Rows without text, and rows whose text a stage has emptied, fail the quality rules if they come before them; later ones
stay and are packed as a lone end token.  An empty table yields an empty result of the same columns in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import op01_line_quality, op06_pii, op07_curve_packing, op09_gear_chunks, op10_setsketch
from lodestar.llm.common import materialise


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars follows the text that a stage has changed."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; boilerplate lines leave the others.  Null and empty texts are rejected; repeated rows share a
    verdict; null hosts are one host; a null doc_id is an id like others."""
    judged = op01_line_quality.line_quality(docs.select(*docs.columns)).where("kept")
    return _recounted(judged.withColumn("text", F.col("clean_text")), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies (five-word shingles, 0.8) one row stays, that of the smallest doc_id.

    Rows are judged by a key of their own, in the order of doc_id (null last), whatever ids are null or repeat: ties and
    repeated rows are copies like others, and texts that share an id are judged apart.  Rows without words all stay.
    """
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("nd_hash")]
    rows = docs.withColumn("nd_hash", F.xxhash64(*docs.columns)).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialise(rows.drop("nd_hash").withColumn("nd_row", F.monotonically_increasing_id()), "rows")
    verdict = op10_setsketch.near_duplicates(rows.select(F.col("nd_row").alias("doc_id"), "text"), width=5, threshold=0.8)
    kept = materialise(verdict.where("kept").select(F.col("doc_id").alias("nd_row")), "verdict")
    return rows.join(kept, "nd_row", "left_semi").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave all texts but that of the smallest doc_id.  All rows stay.  Texts without an id neither lose
    nor remove anything; rows of one doc_id count as one document."""
    return _recounted(op09_gear_chunks.without_spans(docs, op09_gear_chunks.repeated_spans(docs)), docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind in brackets.  All rows stay, each for itself; null text stays null."""
    return _recounted(op06_pii.redact(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences along the curve.  Null and empty texts are their end token; repeated rows are packed as
    often as they stand there; documents of equal keys come in the order of doc_id."""
    return op07_curve_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("personal data", hide_personal_data),
    ("packing", pack),
]
#: Sketches, chunk hashes, trained models and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; the pieces of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
