"""Files beside the texts: manifest, weight annotations, an embedded vocabulary, configuration, pages."""

from __future__ import annotations

import json
import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vocabulary import Vocabulary, _numbered

# The fields of a manifest entry in order, and those that are quoted.
FIELDS = "id type title url author licence retrieved sha256 words excerpt note".split()
QUOTED = ("title", "author", "note")
CONFIG_NAME, CONFIG_BYTES, CONFIG_PARENTS = ".lexisieve.json", 8192, 32
LEVELS = ("off", "on")
_EMBEDDED = (
    "instead_of map<string,string>, phrasal map<string,string>, latin map<string,string>, british map<string,string>, marketing array<string>, "
    "hedges array<string>, frames array<string>, term_verbs array<string>, term_nouns array<string>, approved array<string>"
)


# ---------------------------------------------------------------- the manifest
def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry of the documents list: strings, words as a number, excerpt as a truth value.

    Only words may be a number: a checksum of digits alone keeps its zeros. A field given twice in an
    entry keeps the later value; unknown fields are passed by.
    """
    lines = _numbered(spark, path).withColumn("line", F.rtrim(F.regexp_replace(F.split("line", " #")[0], r"\r$", "")))
    lines = lines.where((F.trim("line") != "") & ~F.rlike("line", F.lit(r"^\s*#")))
    at = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)  # one small file
    opened = F.max(F.rlike("line", F.lit(r"^documents:\s*(\[\s*\])?\s*$")).cast("int")).over(at)
    entry = F.sum(F.rlike("line", F.lit(r"^\s*-\s+\w+:")).cast("int")).over(at)
    raw = F.trim(F.regexp_extract("line", r"^\s*(?:-\s+)?\w+:\s*(.*)$", 1))
    rows = (
        lines.select("n", "line", opened.alias("opened")).where("opened = 1").withColumn("entry", entry)
        .select("n", "entry", F.regexp_extract("line", r"^\s+(?:-\s+)?(\w+):|^-\s+(\w+):", 1).alias("a"), F.regexp_extract("line", r"^-\s+(\w+):", 1).alias("b"), raw.alias("raw"))
        .select("n", "entry", F.when(F.col("a") != "", F.col("a")).otherwise(F.col("b")).alias("field"), "raw").where("entry > 0 and field <> ''")
    )
    quoted = F.rlike("raw", F.lit(r"""^(".*"|'.*')$""")) & (F.length("raw") > 1)
    rows = rows.withColumn("value", F.when(quoted, F.expr("substring(raw, 2, length(raw) - 2)")).otherwise(F.col("raw")))
    wide = rows.groupBy("entry").pivot("field", FIELDS).agg(F.max_by("value", "n")).orderBy("entry")
    return wide.select(
        *[F.expr("try_cast(words as int)").alias("words") if f == "words" else (F.col(f) == "true").alias(f) if f == "excerpt" else F.col(f) for f in FIELDS]
    )


def entry_text(entry: dict[str, Column]) -> Column:
    """A manifest entry as lines, fields in order; a field that is null is left out."""
    def rendered(field: str) -> Column:
        value = entry[field].cast("string")
        plain = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit("'")), F.lit('"'))
        value = plain if field in QUOTED else F.when(F.contains(value, F.lit(" ")), plain).otherwise(value)
        return F.concat(F.lit(("  - " if field == "id" else "    ") + field + ": "), value)

    return F.array_join(F.array_compact(F.array(*[rendered(f) for f in FIELDS if f in entry])), "\n")


def appended(manifest: Column, entry: Column) -> Column:
    """The manifest's text with an entry after the last one; raises where it has no documents list."""
    opened = F.replace(manifest, F.lit("documents: []"), F.lit("documents:"))
    known = F.rlike(opened, F.lit(r"(?m)^documents:\s*$"))
    return F.when(known, F.concat(F.regexp_replace(opened, r"\n+$", ""), F.lit("\n"), entry, F.lit("\n"))).otherwise(
        F.raise_error(F.lit("the manifest has no documents list")).cast("string")
    )


# ---------------------------------------------------------------- weights, vocabulary
def weight_annotations(spark: SparkSession, path: str, rule: str = r"[A-Z][A-Z0-9.-]*") -> DataFrame:
    """(rule, weight, reason) of a specification: a rule's paragraph, then *Weight: 0.5.* and the reason.

    The reason runs to the next blank line; a rule's first annotation counts. Weights stay text (N/A too).
    """
    heading, note = rf"^\*\*({rule})\*\*:", r"^\s*\*Weight:\s*([0-9.]+|N/A)\.\*\s*(.*?)\s*$"
    at = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)  # one small file
    lines = _numbered(spark, path).withColumn("line", F.regexp_replace("line", r"\r$", ""))
    is_head, is_note = F.rlike("line", F.lit(heading)), F.rlike("line", F.lit(note))
    lines = lines.withColumn("head", F.last(F.when(is_head, F.col("n")), True).over(at)).where("head is not null")
    section = Window.partitionBy("head")
    lines = lines.withColumn("w", F.min(F.when(is_note, F.col("n"))).over(section)).where(F.col("n") >= F.col("w"))
    lines = lines.withColumn("end", F.min(F.when((F.trim("line") == "") & (F.col("n") > F.col("w")), F.col("n"))).over(section))
    kept = lines.where(F.col("end").isNull() | (F.col("n") < F.col("end")))
    part = F.when(F.col("n") == F.col("w"), F.regexp_extract("line", note, 2)).otherwise(F.trim("line"))
    rows = kept.groupBy("head").agg(
        F.max(F.when(F.col("n") == F.col("w"), F.regexp_extract("line", note, 1))).alias("weight"),
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", part.alias("t")))), lambda x: x["t"]), " ")).alias("reason"),
    )
    names = _numbered(spark, path).select(F.col("n").alias("head"), F.regexp_extract("line", heading, 1).alias("rule")).where("rule <> ''")
    return names.join(rows, "head").orderBy("head").select("rule", "weight", "reason")


def weights_csv(rows: DataFrame) -> DataFrame:
    """One row: the weight table as a CSV text, in the order of its rules' names."""
    quoted = lambda c: F.when(F.rlike(c, F.lit('[",\n]')), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    line = F.concat_ws(",", *[quoted(c) for c in ("rule", "weight", "reason")])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule", line.alias("l")))), lambda x: x["l"]), "\n")
    return rows.agg(F.concat(F.lit("rule,weight,reason\n"), body, F.lit("\n")).alias("csv"))


def embedded_vocabulary(spark: SparkSession, blob: str) -> Vocabulary:
    """A vocabulary from a JSON text; what it lacks is empty."""
    got = spark.createDataFrame([(blob,)], "blob string").select(F.from_json("blob", _EMBEDDED).alias("v")).select("v.*").first()
    maps = {k: dict(got[k] or {}) for k in ("instead_of", "phrasal", "latin", "british")}
    sets = {k: frozenset(got[k] or []) for k in ("marketing", "hedges", "frames", "term_verbs", "term_nouns", "approved")}
    return Vocabulary(**maps, **sets)


def strip_skill_front(text: Column) -> Column:
    """A prompt file without its front matter and the white space behind it; an open one is left alone."""
    end = F.locate("\n---", text, 4)
    cut = F.regexp_replace(F.substring(text, end + 4, F.length(text)), r"^\s+", "")
    return F.when(F.startswith(text, F.lit("---")) & (end > 0), cut).otherwise(text)


# ---------------------------------------------------------------- the driver's own files
def repo_config(start: str, name: str = CONFIG_NAME) -> dict | None:
    """The nearest readable configuration at or above a folder; a large or broken one is passed by."""
    here = Path(start).absolute()
    for folder in [here, *here.parents][:CONFIG_PARENTS]:
        try:
            raw = (folder / name).read_text(encoding="utf-8")
            if len(raw) < CONFIG_BYTES and isinstance(found := json.loads(raw), dict):
                return found
        except (OSError, ValueError):
            continue
    return None


def write_flag(path: str, level: str) -> bool:
    """Writes a level so that no reader sees a part of it; refuses unknown levels and links."""
    if level not in LEVELS or os.path.islink(path):
        return False
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, part = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as out:
        out.write(level)
    os.replace(part, path)
    return True


def sync_pages(spark: SparkSession, source: str, target: str, pattern: str = r"\.(json|html)$", but: str = "index.html") -> int:
    """Rebuilds target from the result files and pages of source, so that none that is gone stays; how many."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    to, origin = path(target), path(source)
    there, here = to.getFileSystem(conf), origin.getFileSystem(conf)
    there.delete(to, True)
    there.mkdirs(to)
    names = [x.getPath().getName() for x in here.listStatus(origin) if x.isFile()]
    copied = [n for n in names if re.search(pattern, n) and n != but]
    for n in copied:
        jvm.org.apache.hadoop.fs.FileUtil.copy(here, path(origin, n), there, path(to, n), False, conf)
    return len(copied)
