"""Packing: padding-optimal length buckets and token-budget batches.

The lengths of all documents are counted in one global histogram. A dynamic program over its
distinct lengths picks the bucket boundaries that minimise padding (every document is padded
to the largest length of its bucket). In each bucket, in id order, a batch takes as many
documents as fit the token budget at the padded length (one at least: a document longer than
the budget is a batch of its own). A length is the number of token ids of the whole text plus
one end id where a tokenizer file is given (query and pipeline give one); without a file it is the
number of words between white space plus one end mark. So null and empty texts have length 1.
Repeated ids are packed row by row; an empty table gives no rows; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .common import Workspace, ids_type, prepare, running_total, slices

N_BUCKETS = 16
TOKEN_BUDGET = 65_536


def word_length(text: Column) -> Column:
    """Words between white space, plus 1."""
    solid = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", " "))
    return (F.length(solid) - F.length(F.replace(solid, F.lit(" "), F.lit(""))) + F.when(solid == "", 0).otherwise(1) + 1).cast("long")


def token_lengths(spark: SparkSession, named: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_tokens) of rows(doc_id, text): token ids of the text, and the end id."""
    prepare(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = encoder(tokenizer_path)
        for batch in batches:
            counts = [np.diff(mine.encode(texts)[1]) + 1 for texts in slices(batch.column(1))]
            lengths = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64())], names=["doc_id", "n_tokens"])

    return named.mapInArrow(work, f"doc_id {ids_type(named)}, n_tokens long")


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Upper lengths of at most n_buckets buckets with the least total padding.

    lengths ascend. best[k][j] is the least padded total of the first j distinct lengths in k
    buckets; the best split point never moves left as j grows (the cost is a Monge array),
    so each layer is filled by divide and conquer in O(d log d).
    """
    d = len(lengths)
    if not d:
        return []
    if d <= n_buckets:
        return [int(x) for x in lengths]
    rows = np.concatenate(([0], np.cumsum(counts.astype(np.int64)))).astype(np.float64)
    tops = lengths.astype(np.float64)
    best = np.concatenate(([0.0], rows[1:] * tops))
    choice = []
    for _ in range(1, n_buckets):
        new, split = np.full(d + 1, np.inf), np.zeros(d + 1, dtype=np.int64)
        new[0] = 0.0
        todo = [(1, d, 0, d - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(b, mid - 1) + 1)
            cost = best[i] + (rows[mid] - rows[i]) * tops[mid - 1]
            at = int(np.argmin(cost))
            new[mid], split[mid] = cost[at], i[at]
            todo += [(lo, mid - 1, a, split[mid]), (mid + 1, hi, split[mid], b)]
        best = new
        choice.append(split)
    ends, j = [], d
    for split in reversed(choice):
        if j == 0:
            break
        ends.append(int(lengths[j - 1]))
        j = int(split[j])
    if j:
        ends.append(int(lengths[j - 1]))
    return sorted(ends)


def pack(
    spark: SparkSession, docs: DataFrame, n_buckets: int = N_BUCKETS, token_budget: int = TOKEN_BUDGET,
    id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None,
) -> DataFrame:
    """One row per document: id, n_tokens, bucket, bucket_len, padding, batch, slot."""
    ws = Workspace(spark, "packing")
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if tokenizer_path is None:
        lengths = named.select("doc_id", word_length(F.col("text")).alias("n_tokens"))
    else:
        lengths = token_lengths(spark, named, tokenizer_path)
    sized = ws.save(lengths, "sized")
    # distinct lengths: bounded by the square root of twice the corpus's tokens, never by its rows
    counted = sized.groupBy("n_tokens").count().orderBy("n_tokens").toPandas()
    ends = optimal_boundaries(counted["n_tokens"].to_numpy(), counted["count"].to_numpy(), n_buckets)
    buckets = spark.createDataFrame(
        [(k, ([0] + ends)[k], e) for k, e in enumerate(ends)], "bucket int, _low long, bucket_len long"
    )
    bucketed = sized.join(
        F.broadcast(buckets), (F.col("n_tokens") > F.col("_low")) & (F.col("n_tokens") <= F.col("bucket_len"))
    ).drop("_low")
    # rows of one id are in order of length; rows equal in that too are alike
    placed = running_total(ws, bucketed, ["bucket", "doc_id", "n_tokens"], None, "bucketed")
    firsts = placed.groupBy("bucket").agg(F.min("row_no").alias("_first"))
    rank = F.col("row_no") - F.col("_first")
    fits = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.col("bucket_len")).cast("long"))
    return placed.join(F.broadcast(firsts), "bucket").select(
        "doc_id", "n_tokens", "bucket", "bucket_len", (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
        F.floor(rank / fits).cast("long").alias("batch"), (rank % fits).alias("slot"),
    )


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"))
