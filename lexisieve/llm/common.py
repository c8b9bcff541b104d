"""Shared plumbing: written intermediate tables, byte-level text hashing and Arrow slicing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of an Arrow batch and bytes of a numpy slice: what bounds a Python worker's memory.
BATCH_ROWS = 1000
SLICE_BYTES = 1 << 18

_shipped: set[str] = set()
_made: list[tuple[SparkSession, str]] = []


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, so that a batch of long texts stays small; this package for the workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        package = Path(__file__).resolve().parent.parent
        # Spark sends the archive to every executor; the driver's copy lives as long as the driver
        where = Path(tempfile.mkdtemp(prefix="lexisieve-code-")) / f"{package.name}.zip"
        with zipfile.ZipFile(where, "w") as archive:
            for source in sorted(package.rglob("*.py")):
                archive.write(source, source.relative_to(package.parent))
        context.addPyFile(str(where))


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _tidy() -> None:
    for spark, root in _made:
        try:
            _remove(spark, root)
        except Exception:  # noqa: BLE001 - the session has ended, and its tables with it
            return


#: Spark then drops the shuffle files of a query when it ends, instead of at some later collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Tables written below spark.checkpoint.dir, the folder that all executors share.

    Where that setting is unset (tests on one machine) a local temporary folder serves.
    A written table cuts the lineage and outlives lost executors.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='lexisieve-')}"
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.root = spark, f"{base.rstrip('/')}/lexisieve-{name}-{uuid.uuid4().hex}"
        _made.append((spark, self.root))
        prepare(spark)

    def save(self, df: DataFrame, label: str) -> DataFrame:
        """Writes df and reads it back. Its shuffles are of no more use then and are removed."""
        path, conf = f"{self.root}/{label}", self.spark.conf
        before = conf.get(_CLEANUP, "false")
        conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").mode("overwrite").parquet(path)
        finally:
            conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        for label in labels:
            _remove(self.spark, f"{self.root}/{label}")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a bound lambda variable is never inlined."""
    return F.transform(F.array(value), body)[0]


# ---------------------------------------------------------------- hashing of bytes

_RNG = np.random.default_rng(20240229)
_BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def powers(kind: str, n: int) -> np.ndarray:
    """Powers of the base or its inverse. Those of a slice are kept, those of a longer text are not."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = _BASE if kind == "up" else _BASE_INVERSE
        out = np.full(max(n, SLICE_BYTES + 2), base, dtype=np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if n <= SLICE_BYTES + 2:
            _powers[kind] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values (xor-shifts and odd multipliers)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Spans:
    """Hashes of any spans of one byte buffer, from one prefix sum."""

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        part = self.sums[1:]
        np.take(_BYTE_CODES, data, out=part)
        part *= powers("up", len(data))
        np.cumsum(part, out=part)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        inverse = powers("down", len(self.sums))
        return mix64((self.sums[ends] - self.sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


# ---------------------------------------------------------------- texts of Arrow batches

class Texts:
    """Consecutive texts: their bytes end to end, offsets (n + 1), and which are not null."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray, valid: np.ndarray) -> None:
        self.first, self.data, self.offsets, self.valid = first, data, offsets, valid

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words between white space, and each text's range of words."""
        if not len(self.data):
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(len(self.offsets), dtype=np.int64)
        solid = ~SPACE[self.data]
        before = np.zeros_like(solid)
        before[1:] = solid[:-1]
        edges = self.offsets[1:-1]
        before[edges[edges < len(solid)]] = False
        starts = np.flatnonzero(solid & ~before)
        after = np.zeros_like(solid)
        after[:-1] = solid[1:]
        after[edges[edges > 0] - 1] = False
        ends = np.flatnonzero(solid & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Texts]:
    """Texts of at most so many bytes together; a longer text comes alone. Nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    n, at = len(column), column.offset
    if not n:
        return
    _, where, bytes_ = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int32)[at : at + n + 1].astype(np.int64)
    data = np.frombuffer(bytes_, dtype=np.uint8) if bytes_ is not None else np.zeros(0, np.uint8)
    valid = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield Texts(lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], valid[lo:hi])
        lo = hi


_PLACE = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """A 64-bit hash of each k consecutive word hashes; of all words where there are fewer."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    total = np.full(n - k + 1, np.uint64(k), dtype=np.uint64)
    for j in range(k):
        total += words[j : n - k + 1 + j] * _PLACE[j]
    return mix64(total)


def ids_type(df: DataFrame, column: str = "doc_id") -> str:
    return df.schema[column].dataType.simpleString()


def running_total(ws: Workspace, df: DataFrame, order: list[str], value: str | None, label: str) -> DataFrame:
    """df in a global order, with row_no (from 0) and, where value names a column, value_before.

    The rows are range-partitioned, sorted and written once, each with its place and the sum before
    it in its partition; the partitions' totals (one row each) are then summed up. No window spans
    the table, and no partition is held in memory.
    """
    first = [F.col(c).asc_nulls_first() for c in order]
    amount = (F.col(value) if value else F.lit(0)).cast("long")
    laid = df.withColumn("_value", amount).repartitionByRange(*first).sortWithinPartitions(*first).withColumn("_part", F.spark_partition_id())
    n = len(df.columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = total = 0
        for batch in batches:
            mine = batch.column(n).to_numpy()
            upto = total + np.cumsum(mine)
            at = np.arange(rows, rows + len(mine))
            if len(mine):
                rows, total = rows + len(mine), int(upto[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(upto - mine)], names=[*batch.schema.names, "_at", "_inside"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema.fields)
    laid = ws.save(laid.mapInArrow(work, f"{kinds}, _at long, _inside long"), label)
    totals = laid.groupBy("_part").agg(F.count("*").alias("_rows"), F.sum("_value").alias("_sum"))
    # one row for each written partition: bounded by the number of tasks, not by the rows
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum_before"),
    )
    return laid.join(F.broadcast(totals), "_part").select(
        *df.columns,
        (F.col("_rows_before") + F.col("_at")).alias("row_no"),
        *([(F.col("_sum_before") + F.col("_inside")).alias("value_before")] if value else []),
    )
