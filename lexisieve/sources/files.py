"""Text files, snapshots, manifests and conversations as tables; and the sinks beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT = (
    "git struct<commit:string,short:string,committed:string>, arms array<string>, passes int, failures int, "
    "results map<string,struct<type:string,title:string,source:string,licence:string,url:string,author:string,"
    "outputs:map<string,string>,passes:map<string,array<string>>>>"
)


def read_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per file: path, name (without its ending), text. Files that vanish are skipped."""
    rows = spark.read.option("pathGlobFilter", glob).option("ignoreMissingFiles", "true").text(path, wholetext=True)
    where = F.col("_metadata.file_path")
    return rows.select(where.alias("path"), F.regexp_extract(where, r"([^/]+?)(?:\.[^./]*)?$", 1).alias("name"), F.col("value").alias("text"))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Result files by name: file, and the fields of a snapshot; missing ones are null."""
    rows = spark.read.schema(SNAPSHOT).option("multiLine", True).option("pathGlobFilter", "eval-*.json").json(path)
    return rows.select(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("file"), "*")


def latest(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy(F.desc("file")).limit(1)


def snapshot_texts(snapshots: DataFrame) -> DataFrame:
    """(file, doc, arm, pass, text): all passes of an arm, else its output; the source is an arm."""
    docs = snapshots.select("file", F.explode("results").alias("doc", "r"))
    arms = docs.select("file", "doc", F.explode(F.map_concat("r.outputs", F.map_from_arrays(F.array(F.lit("source")), F.array("r.source")))).alias("arm", "out"), "r.passes")
    texts = F.coalesce(F.try_element_at("passes", F.col("arm")), F.array("out"))
    return arms.select("file", "doc", "arm", F.posexplode(texts).alias("pass", "text")).where("text <> ''")


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    schema = "name string, turns array<struct<question:string,answer:string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select("name", F.posexplode("turns").alias("turn", "t")).select("name", (F.col("turn") + 1).alias("turn"), "t.*")


def snapshot_name(committed: Column, short: Column) -> Column:
    return F.concat(F.lit("eval-"), F.substring(committed, 1, 10), F.lit("-"), short, F.lit(".json"))


def write_once(df: DataFrame, path: str) -> None:
    """JSON that never overwrites an earlier result."""
    df.write.mode("errorifexists").json(path)


def report_json(summary: DataFrame, disclaimer: str) -> DataFrame:
    """One JSON text per document, with the note every report carries."""
    return summary.select(F.to_json(F.struct(F.lit(disclaimer).alias("disclaimer"), *summary.columns)).alias("value"))


def exit_status(summary: DataFrame) -> DataFrame:
    """One row: 1 if any document has a finding, else 0."""
    return summary.agg(F.when(F.coalesce(F.bool_or(F.col("total") > 0), F.lit(False)), 1).otherwise(0).alias("status"))
