"""Contiguous balanced shards from global byte-size prefix sums.

Rows are ordered by id (nulls first, ties by the checksum of the text). A document's size is
its UTF-8 bytes plus 1; a null or empty text counts 1. Per-partition totals give every document
the bytes that precede it, and the shard is the equal share in which the document's middle
byte lies: shards are contiguous and differ from an equal share by less than one document's
size on either side. Repeated ids are placed like any other rows; an empty table gives no
rows; columns beside id and text are not read. More shards than documents leave some empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, running_total


def assign_shards(
    spark: SparkSession, docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot (gapless from 0 in a shard)."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    ws = Workspace(spark, "shards")
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    # the order of rows with equal id and checksum shows in no column but slot
    placed = ws.save(running_total(ws, sized, ["doc_id", "text_crc32", "size"], "size", "sized"), "placed")
    ws.drop("sized")
    total = placed.agg(F.max(F.col("value_before") + F.col("size")).cast("decimal(38,0)").alias("_total"))
    # total is one row; twice the middle byte against twice the total, in whole numbers
    twice = (F.col("value_before") * 2 + F.col("size")).cast("decimal(28,0)")
    cut = (
        placed.crossJoin(F.broadcast(total))
        .withColumn("_scaled", (twice * F.lit(n_shards)).cast("decimal(38,0)"))
        .withColumn("shard", F.expr("cast(_scaled div (2 * _total) as int)"))
    )
    # at most n_shards rows
    firsts = cut.groupBy("shard").agg(F.min("row_no").alias("_first"))
    return cut.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row_no") - F.col("_first")).alias("slot")
    )


def shard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
