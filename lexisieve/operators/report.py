"""Aggregations over findings: rankings, pivots, shares, clean sentences, overview, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import html_escape, rounded


def by_rule(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Findings, documents, weight and the first example of each rule, most frequent first."""
    return found.groupBy("rule").agg(
        F.count("*").alias("n"), F.countDistinct(id_col).alias("documents"), F.round(F.sum(F.coalesce("weight", F.lit(0.0))), 1).alias("weighted"),
        F.min_by("message", F.struct(id_col, "line", "column")).alias("example"),
    ).orderBy(F.desc("n"), "rule")


def by_arm(found: DataFrame, arms: list[str]) -> DataFrame:
    """Counts of each rule by arm, ranked by the last arm."""
    wide = found.groupBy("rule").pivot("arm", arms).count().na.fill(0)
    return wide.orderBy(F.desc(arms[-1]), "rule")


def arm_spread(totals: DataFrame, arms: list[str], id_col: str = "doc_id") -> DataFrame:
    """Of totals(id, arm, pass, total): first, least and most findings of each arm."""
    return totals.groupBy(id_col).pivot("arm", arms).agg(
        F.min_by("total", "pass").alias("first"), F.min("total").alias("least"), F.max("total").alias("most")
    )


def conforming_share(totals: DataFrame, keys: list[str]) -> DataFrame:
    return totals.groupBy(*keys).agg(
        F.count_if(F.col("total") == 0).alias("passed"), F.count("*").alias("of"),
        F.round(F.count_if(F.col("total") == 0) * 100.0 / F.count("*"), 2).alias("share"),
    )


def summary_stats(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*(keys or [])).agg(
        F.count(v).alias("n"), F.median(v).alias("median"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most")
    )


def word_table(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of hits(id, word, replacement): count, spread over documents, replacement."""
    return hits.groupBy("word").agg(F.count("*").alias("n"), F.countDistinct(id_col).alias("documents"), F.max("replacement").alias("replacement"))


def enclosing_sentence(found: DataFrame, sentence_rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each finding (id, at) with the last sentence that starts at or before it: an as-of join.

    Both sides are sorted together once within a document; no range join, no pairs.
    """
    starts = sentence_rows.select(id_col, F.col("offset").alias("at"), F.lit(0).alias("side"), "sentence_no", F.lit(None).cast("string").alias("rule"))
    marks = found.select(id_col, "at", F.lit(1).alias("side"), F.lit(None).cast("int").alias("sentence_no"), "rule")
    w = Window.partitionBy(id_col).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    return starts.unionByName(marks).withColumn("sentence_no", F.last("sentence_no", True).over(w)).where("side = 1 and sentence_no is not null").drop("side")


def clean_sentence_rate(dirty: DataFrame, sentence_rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sentences, dirty ones and the clean share of each document; dirty has (id, sentence_no)."""
    n = sentence_rows.groupBy(id_col).agg(F.count("*").alias("sentences"))
    bad = dirty.groupBy(id_col).agg(F.countDistinct("sentence_no").alias("dirty"))
    d = F.coalesce("dirty", F.lit(0))
    return n.join(bad, id_col, "left").select(id_col, "sentences", d.alias("dirty"), rounded(1 - d / F.col("sentences"), 4).alias("clean"))


def overview(cells: DataFrame, measures: list[str], first: str, second: str) -> DataFrame:
    """Totals of measures by (arm, first) and by (arm, second), in one pass of grouping sets."""
    return cells.groupingSets([[F.col("arm"), F.col(first)], [F.col("arm"), F.col(second)]], "arm", first, second).agg(
        F.count("*").alias("cells"), *[F.sum(m).alias(m) for m in measures]
    )


def mark_findings(text: Column, spans: Column) -> Column:
    """HTML with spans (at, till, rule) marked; one that overlaps an earlier one is left out."""
    def step(state: Column, x: Column) -> Column:
        body = F.concat(
            state["out"], html_escape(F.substring(text, state["pos"] + 1, x["at"] - state["pos"])), F.lit('<mark title="'), x["rule"], F.lit('">'),
            html_escape(F.substring(text, x["at"] + 1, x["till"] - x["at"])), F.lit("</mark>"),
        )
        skip = x["at"] < state["pos"]
        return F.struct(F.when(skip, state["pos"]).otherwise(x["till"]).alias("pos"), F.when(skip, state["out"]).otherwise(body).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    return F.aggregate(
        F.array_sort(spans), start, step, lambda s: F.concat(s["out"], html_escape(F.substring(text, s["pos"] + 1, F.length(text))))
    )


def findings_table(found: DataFrame, id_col: str = "doc_id", verbose: bool = False) -> DataFrame:
    """One text row per document: a header, then findings by line, column and rule."""
    place = F.format_string("%4d:%-3d %-4s %s", F.coalesce("line", F.lit(0)), F.coalesce("column", F.lit(0)), "rule", "message")
    if verbose:
        place = F.concat(place, F.lit("\n    "), F.col("excerpt"), F.lit("\n    "), F.repeat(F.lit(" "), F.col("excerpt_offset")), F.lit("^"))
    # the findings of one document: bounded by its length
    rows = F.array_sort(F.collect_list(F.struct(F.coalesce("line", F.lit(0)).alias("l"), F.coalesce("column", F.lit(0)).alias("c"), "rule", place.alias("t"))))
    countable = F.count_if(~F.coalesce("arbitrated", F.lit(False)))
    return found.groupBy(id_col).agg(
        F.concat(
            F.format_string("%d findings, %d to confirm, weight %.1f\n", countable, F.count("*") - countable, F.sum(F.coalesce("weight", F.lit(0.0)))),
            F.array_join(F.transform(rows, lambda x: x["t"]), "\n"),
        ).alias("report")
    )
