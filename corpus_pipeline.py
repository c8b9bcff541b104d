"""A corpus pipeline of five stages; each takes the documents its predecessor kept.

Quality classifier, line dedup, MinHash near-dedup, substring dedup, packing. A stage's
output is written as Parquet in the shared folder and read again as the next one's input.

Every stage takes nulls in any column, empty and very long texts, repeated rows and ids and an
empty table. All but the last return the columns of documents and nothing else. Rows without an
id pass all stages but the first, which scores them like any other. Null texts stay null; the
first stage scores them as empty. Rows that repeat an id are judged row by row in the first and
third stage and packed row by row; in line and substring dedup they are not compared with each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisieve.llm.common import Workspace
from lexisieve.llm.line_dedup import dedup_lines
from lexisieve.llm.minhash import near_duplicates
from lexisieve.llm.packing import pack
from lexisieve.llm.quality_model import THRESHOLD, fit, score_quality
from lexisieve.llm.substring_dedup import remove_passages

#: Models, dynamic programs and chained alignments are beyond SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, n_chars counted anew from the text."""
    return docs.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the threshold stay."""
    model = fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs, model, out="_score")
    return scored.where(F.col("_score") >= THRESHOLD).drop("_score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of lines go from the texts, single lines and one-line documents too."""
    return _recounted(dedup_lines(spark, docs, run=1), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    gone = near_duplicates(spark, docs).where(~F.col("kept")).select("doc_id", F.col("text_key").alias("_text_key")).distinct()
    return docs.withColumn("_text_key", F.xxhash64("text")).join(gone, ["doc_id", "_text_key"], "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds go from the texts."""
    return _recounted(remove_passages(spark, docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of what is left."""
    import public_tokenizers

    return pack(spark, docs, tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            ws.drop(f"stage{k - 1}")
    return docs
