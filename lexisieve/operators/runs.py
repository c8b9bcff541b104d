"""Results of evaluation runs: cells of document and arm, pass statistics, filters, checks, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What the overview adds up for every cell.
MEASURES = (
    "total pass findings weighted words run_pass run_total fact_loss semantic_confirmed unjudged sampled_out sent_clean sent_total".split()
)
LISTED = 40


# ---------------------------------------------------------------- joins
def with_text(manifest: DataFrame, texts: DataFrame, id_col: str = "id") -> DataFrame:
    """Manifest rows with the text of the file that bears their id; a manifest is small, so it is the side sent out."""
    return texts.select(F.col("name").alias(id_col), "text").join(F.broadcast(manifest), id_col)


def cells(outputs: DataFrame, semantic: DataFrame, passes: DataFrame, keys: list[str]) -> DataFrame:
    """outputs(keys, text) with what judges and passes told of the same cell; a cell told of nowhere else keeps nulls."""
    return outputs.join(semantic, keys, "left").join(passes, keys, "left")


def backfill_unjudged(found: DataFrame, semantic_col: str = "semantic", arm_col: str = "arm", text_col: str = "text") -> DataFrame:
    """unjudged: the judging stage ran, the cell has generated text, and nothing was recorded for it.

    Whether the stage ran at all is one row: some cell of the run carries judge output.
    """
    ran = found.agg(F.coalesce(F.bool_or(F.col(semantic_col).isNotNull()), F.lit(False)).alias("_ran"))
    silent = F.col(semantic_col).isNull() & (F.col(arm_col) != "source") & (F.coalesce(F.col(text_col), F.lit("")) != "")
    return found.crossJoin(F.broadcast(ran)).withColumn("unjudged", silent & F.col("_ran")).drop("_ran")


def runs_with_page(results: DataFrame, pages: DataFrame, doc_col: str = "doc") -> DataFrame:
    """(doc, runs): of results(file, doc) the runs that have a page among pages(file), by name."""
    shown = results.select(F.regexp_replace("file", r"\.json$", "").alias("run"), doc_col).distinct()
    built = pages.select(F.regexp_replace("file", r"\.html$", "").alias("run")).distinct()
    # the runs of one document: few, as each is a committed file
    return shown.join(built, "run", "left_semi").groupBy(doc_col).agg(F.array_sort(F.collect_list("run")).alias("runs"))


def weights_differ(spec: DataFrame, stored: DataFrame) -> DataFrame:
    """(rule, weight, only_in): rows of either weight table that the other lacks, rows counted."""
    a, b = (x.select("rule", F.col("weight").cast("double").alias("weight")) for x in (spec, stored))
    return a.exceptAll(b).withColumn("only_in", F.lit("spec")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("stored")))


# ---------------------------------------------------------------- aggregates
def pass_stats(totals: DataFrame, keys: list[str]) -> DataFrame:
    """Of totals(keys, pass, total): counts by pass, passed, of, rate in whole percent, mean."""
    ok = F.count_if(F.col("total") == 0)
    by_pass = F.array_sort(F.collect_list(F.struct("pass", "total")))  # a handful of passes
    return totals.groupBy(*keys).agg(
        F.transform(by_pass, lambda x: x["total"]).alias("findings"), ok.alias("passed"), F.count("*").alias("of"),
        F.round(ok * 100.0 / F.count("*")).cast("int").alias("rate"), F.round(F.avg("total"), 1).alias("mean"),
    )


def models_of(results: DataFrame, prefix: str, author_col: str = "author") -> DataFrame:
    """One row: the distinct models that wrote documents, sorted; an author reads "model, date"."""
    author = F.coalesce(F.col(author_col), F.lit(""))
    return results.where(F.startswith(author, F.lit(prefix))).agg(F.array_sort(F.collect_set(F.split(author, ",")[0])).alias("models"))


def failures(outcomes: DataFrame) -> DataFrame:
    """One row: how many of outcomes(label, error) failed, and which."""
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    return outcomes.agg(F.count_if(failed).alias("failures"), F.array_sort(F.collect_list(F.when(failed, F.col("label")))).alias("failed"))


def stage_metering(calls: DataFrame) -> DataFrame:
    """Calls and seconds (one decimal) of each stage of calls(stage, seconds)."""
    return calls.groupBy("stage").agg(F.count("*").alias("calls"), F.round(F.sum("seconds"), 1).alias("seconds"))


def overview(measured: DataFrame) -> DataFrame:
    """All MEASURES by arm, once over real and synthetic documents and once over anchors and rotating ones.

    measured has arm, synthetic, bucket and the measures but total; one pass of grouping sets. Documents
    in no bucket count on the first axis alone.
    """
    sums = [F.sum(F.col(m).cast("double") if m == "weighted" else F.col(m).cast("bigint")).alias(m) for m in MEASURES[1:]]
    rows = measured.groupingSets([["arm", "synthetic"], ["arm", "bucket"]], "arm", "synthetic", "bucket").agg(
        F.count("*").alias("total"), *sums, F.grouping("bucket").alias("_g")
    )
    return rows.where((F.col("_g") == 1) | F.col("bucket").isNotNull()).drop("_g")


# ---------------------------------------------------------------- filters
def only_rule(found: DataFrame, rule: str) -> DataFrame:
    return found.where(F.upper("rule") == rule.upper())


def chosen_documents(docs: DataFrame, id_col: str, only: list | None = None, limit: int | None = None) -> DataFrame:
    """The named documents, and of these the first ones by id; what a user asks for, not a sample."""
    some = docs.where(F.col(id_col).isin(only)) if only else docs
    return some.orderBy(id_col).limit(limit) if limit else some


def is_synthetic(id_: Column) -> Column:
    """Generated about the project itself: told by the prefix of the id alone."""
    return F.startswith(id_, F.lit("synth-"))


def auth_failure(detail: Column) -> Column:
    """Whether an error tells of missing credentials and not of a model without an answer."""
    low = F.lower(F.coalesce(detail, F.lit("")))
    return F.contains(low, F.lit("not logged in")) | F.contains(low, F.lit("/login"))


# ---------------------------------------------------------------- order, listings
def in_summary_order(rows: DataFrame) -> DataFrame:
    """Confirmed rows first, then by how many passes saw them, then by rule."""
    return rows.orderBy(F.col("status") != "confirmed", F.desc("seen_in"), "rule")


def distinct_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def listing(found: DataFrame, id_col: str = "doc_id", most: int = LISTED, empty: str = "(none)") -> DataFrame:
    """One text for each document: its first findings by place, and how many more there are."""
    w = Window.partitionBy(id_col).orderBy(F.coalesce("line", F.lit(0)), F.coalesce("column", F.lit(0)), "rule", "message")
    placed = found.withColumn("_r", F.row_number().over(w))
    line = F.format_string("  %s line %d: %s", F.col("rule"), F.coalesce("line", F.lit(0)), F.col("message"))
    some = placed.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.when(F.col("_r") <= most, F.struct("_r", line.alias("t"))))).alias("l"), F.count("*").alias("n")
    )
    rest = F.when(F.col("n") > most, F.format_string("\n  ... and %d more", F.col("n") - most)).otherwise(F.lit(""))
    text = F.concat(F.array_join(F.transform("l", lambda x: x["t"]), "\n"), rest)
    return some.select(id_col, "n", F.when(F.col("n") == 0, F.lit(empty)).otherwise(text).alias("listing"))


def format_faults(found: Column) -> Column:
    """An array of findings as lines for a fix: the rule and message, the excerpt below."""
    return F.array_join(F.transform(found, lambda f: F.concat(F.lit("- "), f["rule"], F.lit(": "), f["message"], F.lit("\n    "), f["excerpt"])), "\n")


def build_prompt(template: str, parts: dict[str, Column]) -> Column:
    """A template with {name} places filled from columns; a place without a column raises here."""
    import re

    out, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        out += [F.lit(template[at : m.start()]), F.coalesce(parts[m.group(1)].cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*out, F.lit(template[at:]))
