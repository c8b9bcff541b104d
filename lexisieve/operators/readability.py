"""Vocabulary coverage, term consistency, and the circular scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mask import prose, without_markers
from ..functions.segment import sentences
from ..functions.text import PLAIN_WORD, rounded, syllables

SUPPORTED, INDEPENDENT = 95.0, 98.0
# Regular endings, what to put back, and whether an e may be missing.
ENDINGS = [("s", ""), ("es", ""), ("ed", ""), ("d", ""), ("ing", ""), ("ies", "y"), ("ied", "y"), ("er", ""), ("est", ""), ("ly", "")]


def stems(word: Column) -> Column:
    """The word and every form it may be an inflection of."""
    w = F.lower(F.regexp_replace(word, r"^['-]+|['-]+$", ""))
    out = [w]
    for ending, put in ENDINGS:
        fits = F.endswith(w, F.lit(ending)) & (F.length(w) > len(ending) + 2)
        stem = F.concat(F.substring(w, F.lit(1), F.length(w) - len(ending)), F.lit(put))
        out.append(F.when(fits, stem))
        if ending in ("ing", "ed"):
            out.append(F.when(fits, F.concat(stem, F.lit("e"))))
        out.append(F.when(fits & (F.length(stem) > 2) & F.rlike(stem, F.lit(r"(.)\1$")), F.substring(stem, F.lit(1), F.length(stem) - 1)))
    return F.array_distinct(F.array_compact(F.array(*out)))


def word_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    words = F.regexp_extract_all(without_markers(prose(F.col(text_col))), F.lit(PLAIN_WORD), F.lit(0))
    return docs.select(id_col, F.explode(words).alias("word"))


def known_words(*parts: DataFrame) -> DataFrame:
    """One column of distinct lower-case words."""
    out = parts[0].select(F.lower(F.col(parts[0].columns[0])).alias("known"))
    for p in parts[1:]:
        out = out.unionByName(p.select(F.lower(F.col(p.columns[0])).alias("known")))
    return out.distinct()


def coverage(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = 20) -> DataFrame:
    """One row per document: words, covered, coverage, thresholds, the top unknown words.

    Words are counted per document first; only distinct words are stemmed and looked up, once
    for the whole corpus, so the dictionary join does not grow with the running text.
    """
    counted = word_rows(docs, id_col, text_col).groupBy(id_col, "word").agg(F.count("*").alias("n"))
    distinct = counted.select("word").distinct()
    hit = (
        distinct.select("word", F.explode(stems(F.col("word"))).alias("known"))
        .join(known, "known", "left_semi").select("word").distinct()
        .unionByName(distinct.where(F.regexp_replace("word", r"^['-]+|['-]+$", "") == "")).distinct().withColumn("hit", F.lit(True))
    )
    looked = counted.join(hit, "word", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    totals = looked.groupBy(id_col).agg(F.sum("n").alias("words"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("covered"))
    unknown = looked.where(~F.col("hit")).groupBy(id_col, F.lower("word").alias("word")).agg(F.sum("n").alias("n"))
    first = Window.partitionBy(id_col).orderBy(F.desc("n"), "word")
    tops = (
        unknown.withColumn("r", F.row_number().over(first)).where(F.col("r") <= top)
        .groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "word", "n"))), lambda x: F.struct(x["word"].alias("word"), x["n"].alias("n"))).alias("unknown"))
    )
    share = rounded(F.col("covered") * 100.0 / F.col("words"), 2)
    out = docs.select(id_col).join(totals, id_col, "left").join(tops, id_col, "left")
    return out.select(
        id_col, F.coalesce("words", F.lit(0)).alias("words"), F.coalesce("covered", F.lit(0)).alias("covered"),
        F.coalesce(share, F.lit(100.0)).alias("coverage"), (share >= SUPPORTED).alias("meets_supported"),
        (share >= INDEPENDENT).alias("meets_independent"),
        F.coalesce("unknown", F.array().cast("array<struct<word:string,n:bigint>>")).alias("unknown"),
    )


def term_consistency(docs: DataFrame, routed: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = 10) -> DataFrame:
    """Clusters of words for one action: how many a document uses, and which it mixes.

    routed has (phrase, replacement); a cluster is a replacement with its one-word phrases.
    """
    members = routed.where(F.col("replacement").isNotNull() & ~F.contains("phrase", F.lit(" ")))
    clusters = (
        members.select(F.col("replacement").alias("cluster"), F.col("phrase").alias("member"))
        .unionByName(members.select(F.col("replacement").alias("cluster"), F.col("replacement").alias("member"))).distinct()
    )
    words = F.array_distinct(F.regexp_extract_all(F.lower(prose(F.col(text_col))), F.lit(PLAIN_WORD), F.lit(0)))
    used = (
        docs.select(id_col, F.explode(words).alias("member")).join(clusters, "member")
        .groupBy(id_col, "cluster").agg(F.array_sort(F.collect_set("member")).alias("used"))
    )
    split = F.filter(F.array_sort(F.collect_list(F.struct("cluster", "used"))), lambda x: F.size(x["used"]) > 1)
    per_doc = used.groupBy(id_col).agg(F.count("*").alias("clusters_in_use"), split.alias("s"))
    return docs.select(id_col).join(per_doc, id_col, "left").select(
        id_col, F.coalesce("clusters_in_use", F.lit(0)).alias("clusters_in_use"), F.coalesce(F.size("s"), F.lit(0)).alias("split_clusters"),
        F.slice(F.col("s"), 1, top).alias("detail"),
    )


def circular_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Grade, reading ease and their parts; null where there is no sentence or no word."""
    masked = docs.select(id_col, prose(F.col(text_col)).alias("_p"))
    counted = masked.select(
        id_col, F.size(sentences(F.col("_p"))).cast("double").alias("n"), F.regexp_extract_all("_p", F.lit(PLAIN_WORD), F.lit(0)).alias("w")
    ).select(id_col, "n", F.size("w").cast("double").alias("words"), F.aggregate("w", F.lit(0), lambda a, x: a + syllables(x)).cast("double").alias("syl"))
    some = (F.col("n") > 0) & (F.col("words") > 0)
    wps, spw = F.col("words") / F.col("n"), F.col("syl") / F.col("words")
    return counted.select(
        id_col,
        F.when(some, F.round(0.39 * wps + 11.8 * spw - 15.59, 2)).alias("grade"),
        F.when(some, F.round(206.835 - 1.015 * wps - 84.6 * spw, 2)).alias("reading_ease"),
        F.when(some, F.round(wps, 2)).alias("words_per_sentence"), F.when(some, F.round(spw, 2)).alias("syllables_per_word"),
    )
