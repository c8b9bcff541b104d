"""Findings of documents, in one job: mask, segment, detect, place, enrich."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mask import prose
from ..functions.segment import lists, paragraphs, sentences
from ..functions.text import column_of, line_of, word_count
from ..sources.vocabulary import OWN, RULES, Vocabulary, rules_table
from .rules import frame_findings, list_findings, nothing, paragraph_findings, sentence_findings

EXCERPT = 90


def sentence_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per sentence: id, sentence_no, n_sentences, sentence, in_list, offset, words. No shuffle."""
    masked = docs.select(id_col, *(keep or []), sentences(prose(F.col(text_col))).alias("_s"))
    rows = masked.select(id_col, *(keep or []), F.size("_s").alias("n_sentences"), F.posexplode("_s").alias("sentence_no", "_x"))
    return rows.select(
        id_col, *(keep or []), "sentence_no", "n_sentences", F.col("_x.text").alias("sentence"), F.col("_x.in_list").alias("in_list"),
        F.col("_x.offset").alias("offset"), word_count(F.col("_x.text")).alias("words"),
    )


def findings(
    spark: SparkSession, docs: DataFrame, vocabulary: Vocabulary = OWN, id_col: str = "doc_id", text_col: str = "text", kind: Column | None = None,
    rules: list[str] | None = None,
) -> DataFrame:
    """One row per finding: id, rule, message, excerpt, line, column, excerpt_offset, severity, arbitrated, weight.

    Sentences, paragraphs and lists of a document become one array of units, exploded once;
    every unit is judged in place, so the texts are read once and never shuffled. The rules
    table (29 rows) is broadcast. Where rules are named, no other is tested, and paragraphs and
    lists are cut only if theirs are.
    """
    asked = {r for r, *_ in RULES} if rules is None else set(rules)

    def of_sentences(s: Column) -> Column:
        return F.transform(
            s,
            lambda x, i: F.struct(
                F.lit("sentence").alias("kind"), x["text"].alias("text"), x["in_list"].alias("in_list"), x["offset"].alias("offset"),
                ((i == 0) | (i == F.size(s) - 1)).alias("edge"),
            ),
        )

    base = docs.select(F.col(id_col), F.col(text_col).alias("_text"), prose(F.col(text_col)).alias("_prose"), (kind if kind is not None else F.lit("auto")).alias("_kind"))
    segmented = base.select(
        id_col, "_text", "_prose", "_kind", sentences(F.col("_prose")).alias("_s"),
        *([paragraphs(F.col("_prose")).alias("_p")] if "D2" in asked else []), *([lists(F.col("_prose")).alias("_l")] if "D7" in asked else []),
    )
    blocks = [of_sentences(F.col("_s"))] if asked - {"D2", "D7"} else []
    plain = lambda kind, text, at: F.struct(F.lit(kind).alias("kind"), text.alias("text"), F.lit(False).alias("in_list"), at.alias("offset"), F.lit(False).alias("edge"))
    if "D2" in asked:
        blocks.append(F.transform("_p", lambda p: plain("paragraph", p["text"], p["offset"])))
    if "D7" in asked:
        long_lists = F.filter("_l", lambda r: F.size(list_findings(F.col("_prose"), r)) > 0)
        blocks.append(F.transform(long_lists, lambda r: plain("list", r["head"], r["offset"])))
    units = segmented.select(id_col, "_text", "_kind", F.inline(F.concat(*blocks)))
    s = F.col("text")
    is_sentence = F.col("kind") == "sentence"
    found = (
        F.when(is_sentence, F.concat(
            sentence_findings(s, F.col("in_list"), vocabulary, F.col("_kind"), None if rules is None else asked),
            frame_findings(s, F.col("edge"), vocabulary) if "L5" in asked else nothing(),
        ))
        .when(F.col("kind") == "paragraph", paragraph_findings(s))
        .otherwise(F.array(F.struct(F.lit("D7").alias("rule"), F.lit("a list of over 7 items").alias("message"), F.lit(0).alias("at"))))
    )
    rows = units.select(id_col, "_text", s.alias("_s"), F.col("offset").alias("_offset"), F.explode(found).alias("f"))
    at = F.col("_offset") + F.col("f.at")
    return (
        rows.select(
            id_col, F.col("f.rule").alias("rule"), F.col("f.message").alias("message"), F.substring("_s", 1, EXCERPT).alias("excerpt"),
            line_of(F.col("_text"), at).alias("line"), column_of(F.col("_text"), at).alias("column"), F.col("f.at").alias("excerpt_offset"),
        )
        .join(F.broadcast(rules_table(spark)), "rule", "left")
        .select(id_col, "rule", "message", "excerpt", "line", "column", "excerpt_offset", "severity", "arbitrated", "weight")
    )


def totals(docs: DataFrame, rules: list[str], vocabulary: Vocabulary = OWN, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document, of rules of sentences alone: words, sentences, total, weighted, by_rule, dirty sentences.

    Narrow: a text is masked, cut and judged where it is read; nothing is exploded or shuffled.
    """
    kept = [id_col, *(keep or [])]
    cut = docs.select(*kept, sentences(prose(F.col(text_col))).alias("_s"))
    judged = F.transform("_s", lambda x: F.transform(sentence_findings(x["text"], x["in_list"], vocabulary, rules=set(rules)), lambda f: f["rule"]))
    found = cut.select(*kept, F.aggregate("_s", F.lit(0), lambda n, x: n + word_count(x["text"])).alias("words"), F.size("_s").alias("sentences"), judged.alias("_f"))
    every = F.flatten("_f")
    weights = F.create_map(*[F.lit(x) for rule, _, weight, _ in RULES for x in (rule, weight)])
    return found.select(
        *kept, "words", "sentences", F.size(every).alias("total"), F.aggregate(every, F.lit(0.0), lambda w, r: w + F.coalesce(F.try_element_at(weights, r), F.lit(0.0))).alias("weighted"),
        every.alias("rules"), F.size(F.filter("_f", lambda x: F.size(x) > 0)).alias("dirty"),
    )


def summary(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, sentences, total, by_rule, per_100w, weighted."""
    sized = docs.select(id_col, sentences(prose(F.col(text_col))).alias("_s")).select(
        id_col, F.aggregate("_s", F.lit(0), lambda n, x: n + word_count(x["text"])).alias("words"), F.size("_s").alias("sentences")
    )
    per_rule = found.groupBy(id_col, "rule").agg(F.count("*").alias("n"), F.sum(F.coalesce("weight", F.lit(0.0))).alias("w"))
    totals = per_rule.groupBy(id_col).agg(
        F.sum("n").alias("total"), F.sum("w").alias("weighted"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "n")))).alias("by_rule")
    )
    total = F.coalesce("total", F.lit(0))
    return sized.join(totals, id_col, "left").select(
        id_col, "words", "sentences", total.alias("total"), F.coalesce("weighted", F.lit(0.0)).alias("weighted"),
        F.coalesce("by_rule", F.create_map().cast("map<string,bigint>")).alias("by_rule"),
        F.when(F.col("words") > 0, F.round(total * 100.0 / F.col("words"), 2)).otherwise(0.0).alias("per_100w"),
    )
