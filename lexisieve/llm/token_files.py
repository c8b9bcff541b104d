"""Token ids as Parquet list columns: files in id order, and what is read back from them.

Every text is encoded (tokenizers library, no special tokens added) and ended by one end id.
Documents are range-partitioned by id with exact boundaries, sorted (nulls first, ties by
text) and each partition is one file: dictionary-encoded ids, small row groups, and pages of
bounded rows with the page index the writer keeps, so that a reader can fetch the metadata
columns alone or the ids of a few documents. Files carry their number and each row its place.

A null or empty text is the end id alone. Repeated ids are written row by row. An empty table
gives no rows. Other columns are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import Workspace, ids_type, prepare, slices

ROW_GROUP_BYTES = 16 << 20
PAGE_ROWS = 500


def write_tokens(
    spark: SparkSession, docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0,
    row_group_bytes: int = ROW_GROUP_BYTES, id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Writes file_no, row_no, doc_id, n_tokens, ids below path, in ascending id order."""
    prepare(spark)
    named = docs.selectExpr(f"`{id_col}` as doc_id", f"cast(`{text_col}` as string) as text")
    laid = named.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()
    )
    where = F.monotonically_increasing_id()
    laid = laid.select(
        F.shiftright(where, 33).cast("int").alias("file_no"),
        where.bitwiseAND(F.lit((1 << 33) - 1)).alias("row_no"), "doc_id", "text",
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = encoder(tokenizer_path)
        for batch in batches:
            for texts in slices(batch.column(3)):
                ids, at = mine.encode(texts)
                n = len(texts)
                ends = at[1:] + np.arange(1, n + 1)
                out = np.full(len(ids) + n, end_id, dtype=np.int32)
                keep = np.ones(len(out), dtype=bool)
                keep[ends - 1] = False
                out[keep] = ids
                offsets = np.concatenate(([0], ends)).astype(np.int32)
                part = batch.slice(texts.first, n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(np.diff(offsets), pa.int32()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(out))],
                    names=["file_no", "row_no", "doc_id", "n_tokens", "ids"],
                )

    encoded = laid.mapInArrow(work, f"file_no int, row_no long, doc_id {ids_type(named)}, n_tokens int, ids array<int>")
    (
        encoded.write.mode("overwrite")
        .option("compression", "zstd")
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.row.count.limit", str(PAGE_ROWS))
        .option("parquet.enable.dictionary", "true")
        .parquet(path)
    )


def _files(spark: SparkSession, path: str, id_type: str) -> DataFrame:
    return spark.read.schema(f"file_no int, row_no long, doc_id {id_type}, n_tokens int, ids array<int>").parquet(path)


def read_metadata(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """file_no, row_no, doc_id, n_tokens: the id column, by far the largest, is not read."""
    return _files(spark, path, id_type).drop("ids")


def read_documents(spark: SparkSession, path: str, doc_ids: list, id_type: str = "bigint") -> DataFrame:
    """doc_id, n_tokens, ids of the asked documents alone.

    The filter goes to the Parquet reader: files, row groups and, by the page index, pages whose
    range of ids holds none of the asked are skipped, as rows stand in id order. Many ids
    (beyond a literal list) are better joined to read_metadata first.
    """
    return _files(spark, path, id_type).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def token_digests(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """From written files alone: doc_id, start, n_tokens, ids_crc32, file_no, row_no."""
    prepare(spark)
    files = _files(spark, path, id_type)
    # only the two metadata columns are read here; one row for each file
    totals = files.groupBy("file_no").agg(F.sum(F.col("n_tokens").cast("long")).alias("_sum"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file_no", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())],
                names=["file_no", "row_no", "doc_id", "n_tokens", "ids_crc32"],
            )

    read = files.select("file_no", "row_no", "doc_id", "ids").mapInArrow(
        work, f"file_no int, row_no long, doc_id {id_type}, n_tokens long, ids_crc32 long"
    )
    inside = Window.partitionBy("file_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    return (
        read.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(F.broadcast(totals), "file_no")
        .select("doc_id", (F.col("_before") + F.col("_inside")).alias("start"), "n_tokens", "ids_crc32", "file_no", "row_no")
    )


def token_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = f"{Workspace(spark, 'tokens').root}/files"
    write_tokens(spark, docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_digests(spark, path, ids_type(docs))
