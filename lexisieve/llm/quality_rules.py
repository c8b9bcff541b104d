"""Quality rules: base counts, then distribution divergence from language references.

Only DataFrame functions are used. Words are the runs between white space. The base counts of
a text: word_chars (code points in words), n_symbols, n_dup_lines (lines with a word, equal to
an earlier line), n_repeat_words (words in three-word windows that occur at least twice in the
text; windows are compared by a 64-bit hash). A document fails the base if it has fewer than
50 words or if more than half of its words are repeated.

The divergence rule compares two histograms of a document with its language's reference by
Jensen-Shannon distance (base 2, so from 0 to 1): character classes, and common words of the
language with one bin for all other words. A reference comes from all documents of the language that
pass the base: the median share of each character class (brought to a sum of 1; junk hardly moves
a median) and the mean share of each common word. Shares are rounded to whole ten-thousandths and
billionths before, so medians and sums are exact and do not depend on the order of merging. A
language with fewer than MIN_REFERENCE such documents, or none given, uses those of all languages. A distance counts only from MIN_CHARS
characters or MIN_COMMON_WORDS words on: below that a histogram says too little, and the limit for
classes is wider by 1/sqrt(characters), the scatter of a short text. The limit for words is
derived from each reference: half the distance at which a text without any common word stands
from it, or, where that is more, WORD_SCATTER times the distance that chance alone gives a text
of so many words, but always below the distance without common words. So gibberish goes at any
counted length; a text in another language than its lang goes too, one of a related language
(French as Spanish) from about 160 words on. A reference with a common share under LEAST_COMMON
cannot tell texts by common words, and its distances do not count. A document is kept if it passes
the base and no counted distance exceeds its limit.

The word lists are a parameter (common_words); a language without a list is judged by its
character classes alone.

Null texts count as empty: no words, base failed. Repeated ids are judged row by row. An empty
table gives no rows; other columns are passed by, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, let

MIN_WORDS, MOST_REPEATED = 50, 50
MIN_CHARS, MIN_COMMON_WORDS, MIN_REFERENCE = 200, 50, 20
CLASS_LIMIT = 0.18
#: The limit for words: shares of the distance of a text without common words, times of chance.
WORD_SHARE, WORD_MOST, WORD_SCATTER, LEAST_COMMON = 0.5, 0.95, 1.5, 0.05

# Character classes beside lower-case ASCII letters, by the characters they leave out.
CLASSES = {
    "upper": r"[^A-Z]+",
    "digit": r"[^0-9]+",
    "accented": r"[^\u00C0-\uFFFF]+",
    "sentence": r"[^.,;:?'\"()\-]+",
}
N_CLASSES = len(CLASSES) + 2  # and lower-case letters, and all others
SHARE_STEPS, MEAN_STEPS = 10_000, 1_000_000_000
# Frequent words of four languages.
COMMON_WORDS = {
    "en": "the of and to in a is that it for on with as be by this from or an not are at was have".split(),
    "fr": "le la les de des du un une et en que qui dans pour par sur est pas au ce il ne se plus".split(),
    "de": "der die das und in den von zu mit ist des auf nicht ein eine als auch dem sich im an er es für".split(),
    "es": "el la los las de del un una y en que por con para se es no al lo como su más o este".split(),
}
_SPACE = r"[ \t\n\x0B\f\r]+"


def _n(text: Column, but: str) -> Column:
    """Code points left when what matches is taken out."""
    return F.length(F.regexp_replace(text, but, ""))


def _repeated_words(words: Column) -> Column:
    """Positions covered by three-word windows that occur at least twice."""
    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])
    )

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(sorted_: Column) -> Column:
            last = F.size(sorted_) - 1
            here = F.filter(
                sorted_,
                lambda x, i: ((i > 0) & (sorted_[F.greatest(i - 1, F.lit(0))]["h"] == x["h"]))
                | ((i < last) & (sorted_[F.least(i + 1, last)]["h"] == x["h"])),
            )
            return F.size(F.array_distinct(F.flatten(F.transform(here, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(placed, twice))

    return F.when(n < 4, F.lit(0)).otherwise(let(windows, covered))


def _common_counts(words: Column, lang: Column, lists: dict[str, list[str]]) -> Column:
    """Counts of the language's common words, in list order, then of all other words."""
    def counted(listed: list[str]) -> Column:
        names = F.array(*[F.lit(w) for w in listed])
        longest = max(map(len, listed), default=0)
        found = F.filter(words, lambda w: (F.length(w) <= longest) & F.array_contains(names, w))
        return let(
            found,
            lambda f: F.concat(
                F.transform(names, lambda r: F.size(f) - F.size(F.array_remove(f, r))),
                F.array(F.size(words) - F.size(f)),
            ),
        )

    pairs = list(lists.items())
    return reduce(lambda rest, p: F.when(lang == p[0], counted(p[1])).otherwise(rest), pairs[1:], counted(pairs[0][1]))


def document_features(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", common_words: dict[str, list[str]] = COMMON_WORDS
) -> DataFrame:
    """Base counts and both histograms (as counts) of every document, in one narrow pass."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    body = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"),
        (F.col(lang_col) if lang_col in docs.columns else F.lit(None)).cast("string").alias("lang"),
    )
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, _SPACE, "") != "")
    tokens = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")
    # one pass over the text takes out white space, one more the lower-case letters: what is left
    # is short, and holds all other classes and the symbols
    def char_counts(solid: Column) -> Column:
        return let(
            F.regexp_replace(solid, "[a-z]+", ""),
            lambda rest: F.struct(
                F.length(solid).alias("word_chars"),
                _n(rest, r"[^#*$%&|<>]+").alias("n_symbols"),
                F.array(F.length(solid) - F.length(rest), *[_n(rest, but) for but in CLASSES.values()]).alias("class_counts"),
            ),
        )

    return body.select(
        "doc_id", "lang",
        let(words, lambda w: F.struct(F.size(w).alias("n_words"), _repeated_words(w).alias("n_repeat_words"))).alias("w"),
        let(F.regexp_replace(text, _SPACE, ""), char_counts).alias("c"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
        let(tokens, lambda t: _common_counts(t, F.col("lang"), common_words)).alias("common_counts"),
    ).select("doc_id", "lang", "w.*", "c.*", "n_dup_lines", "common_counts")


def _share(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: F.when(total > 0, x.cast("double") / total).otherwise(F.lit(0.0)))


def _js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence, in bits."""
    def half(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2.0 * a / (a + b))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: half(a, b) + half(b, a))
    total = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2.0, F.lit(0.0)))


def _word_limit(tokens: Column, listed: Column, others: Column) -> Column:
    """The largest distance allowed to a text of so many words, listed common words and a reference's share of others.

    The histogram of a text without common words meets the reference in the bin of others only.
    Chance gives n words over b + 1 bins a divergence of b / (8 n ln 2) bits on average.
    """
    none = F.log2(2.0 / (1.0 + others)) + others * F.log2(2.0 * others / (1.0 + others)) + (1.0 - others)
    farthest = F.sqrt(F.greatest(F.when(others > 0, none).otherwise(F.lit(2.0)) / 2.0, F.lit(0.0)))
    chance = F.sqrt(listed / (8.0 * math.log(2.0) * F.greatest(tokens, F.lit(1))))
    return F.least(F.greatest(WORD_SHARE * farthest, WORD_SCATTER * chance), WORD_MOST * farthest)


def judge_quality(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    common_words: dict[str, list[str]] = COMMON_WORDS,
) -> DataFrame:
    """One row per document: base counts, both distances, base_failed and kept."""
    ws = Workspace(spark, "rules")
    counted = ws.save(document_features(docs, id_col, text_col, lang_col, common_words), "features")
    in_classes = F.aggregate("class_counts", F.lit(0), lambda s, x: s + x)
    classes = F.concat("class_counts", F.array(F.greatest(F.col("word_chars") - in_classes, F.lit(0))))
    n_tokens = F.aggregate("common_counts", F.lit(0), lambda s, x: s + x)
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words").cast("long") > MOST_REPEATED * F.col("n_words").cast("long")
    )
    rated = (
        counted.withColumn("_tokens", n_tokens)
        .withColumn("class_share", _share(classes, F.aggregate(classes, F.lit(0), lambda s, x: s + x)))
        .withColumn("word_share", _share(F.col("common_counts"), F.col("_tokens")))
        .withColumn("base_failed", base_failed)
        .withColumn("_list", F.when(F.col("lang").isin(*common_words), F.col("lang")).otherwise(F.lit("")))
    )
    n_word = max(map(len, common_words.values())) + 1

    def whole(share: Column, steps: int) -> Column:
        return F.round(share * steps).cast("long")

    def references(prefix: str) -> list[Column]:
        # at most SHARE_STEPS + 1 values a class, so an exact median holds a bounded count of them
        middles = F.array(*[F.percentile(whole(F.get("class_share", F.lit(i)), SHARE_STEPS), 0.5) for i in range(N_CLASSES)])
        averages = F.array(*[
            F.sum(whole(F.get("word_share", F.lit(i)), MEAN_STEPS)).cast("double") / F.count(F.get("word_share", F.lit(i))) / MEAN_STEPS
            for i in range(n_word)
        ])
        return [
            F.count("*").alias(f"{prefix}_n"),
            let(middles, lambda m: _share(m, F.aggregate(m, F.lit(0.0), lambda s, x: s + x))).alias(f"{prefix}_class_share"),
            averages.alias(f"{prefix}_word_share"),
        ]

    good = rated.where(~F.col("base_failed"))
    by_lang = good.groupBy("lang").agg(*references("own")).where(F.col("own_n") >= MIN_REFERENCE)
    overall = good.groupBy().agg(*references("all"))  # one row
    joined = rated.join(by_lang, rated["lang"].eqNullSafe(by_lang["lang"]), "left").drop(by_lang["lang"]).crossJoin(F.broadcast(overall))
    own = F.col("own_n").isNotNull()
    class_ref = F.when(own, F.col("own_class_share")).otherwise(F.col("all_class_share"))
    word_ref = F.when(own, F.col("own_word_share")).otherwise(F.col("all_word_share"))
    class_distance = F.when(F.col("word_chars") >= MIN_CHARS, _js_distance(F.col("class_share"), class_ref))
    # a common-word list belongs to its language: without one, the words say nothing
    listed = F.size("common_counts") - 1
    others = F.get(word_ref, listed)
    telling = (F.col("_list") != "") & own & (others <= 1.0 - LEAST_COMMON)
    word_distance = F.when((F.col("_tokens") >= MIN_COMMON_WORDS) & telling, _js_distance(F.col("word_share"), word_ref))
    out = joined.withColumn("class_distance", class_distance).withColumn("word_distance", word_distance)
    allowed = CLASS_LIMIT + 1.0 / F.sqrt(F.greatest(F.col("word_chars"), F.lit(1)).cast("double"))
    passes = (F.coalesce("class_distance", F.lit(0.0)) <= allowed) & (F.coalesce("word_distance", F.lit(0.0)) <= F.coalesce(_word_limit(F.col("_tokens"), listed, others), F.lit(1.0)))
    longs = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.select("doc_id", *longs, "base_failed", (~F.col("base_failed") & passes).alias("kept"), "class_distance", "word_distance")


def quality_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_quality(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


#: The rule as a whole, in doubles; thresholds are written out.
QUALITY_RULES_SQL = r"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS x FROM documents),
split AS (SELECT doc_id, lang, x, regexp_extract_all(x, '[^ \t\n\v\f\r]+') AS w, regexp_replace(x, '[ \t\n\v\f\r]+', '', 'g') AS s,
  list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^ \t\v\f\r]')) AS l, regexp_extract_all(lower(x), '\p{L}+') AS t,
  CASE lang WHEN 'fr' THEN FR WHEN 'de' THEN DE WHEN 'es' THEN ES ELSE EN END AS listed FROM d),
grams AS (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY doc_id),
base AS (SELECT doc_id, lang, len(w) AS n_words, length(s) AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  [length(regexp_replace(s, '[^a-z]+', '', 'g')), length(regexp_replace(s, '[^A-Z]+', '', 'g')), length(regexp_replace(s, '[^0-9]+', '', 'g')),
   length(regexp_replace(s, '[^\x{C0}-\x{FFFF}]+', '', 'g')), length(regexp_replace(s, '[^.,;:?''"()\-]+', '', 'g'))] AS five,
  list_transform(listed, lambda y: len(list_filter(t, lambda z: z = y))) AS hits, len(t) AS tokens, len(listed) AS b
  FROM split LEFT JOIN repeats USING (doc_id)),
shares AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  list_transform(list_append(five, greatest(word_chars - list_sum(five), 0)), lambda y: CASE WHEN word_chars > 0 THEN y / greatest(word_chars, list_sum(five))::DOUBLE ELSE 0.0 END) AS cs,
  list_transform(list_append(hits, tokens - list_sum(hits)), lambda y: CASE WHEN tokens > 0 THEN y / tokens::DOUBLE ELSE 0.0 END) AS ws FROM base),
class_parts AS (SELECT lang, i, round(cs[i] * 10000)::BIGINT AS v FROM shares, range(1, 7) r(i) WHERE NOT base_failed),
word_parts AS (SELECT lang, i, round(ws[i] * 1000000000)::BIGINT AS v FROM shares, range(1, 27) r(i) WHERE NOT base_failed AND i <= len(ws)),
class_own AS (SELECT lang, i, quantile_cont(v, 0.5) AS m FROM class_parts GROUP BY lang, i),
class_all AS (SELECT i, quantile_cont(v, 0.5) AS m FROM class_parts GROUP BY i),
word_own AS (SELECT lang, i, sum(v)::DOUBLE / count(*) / 1000000000 AS m FROM word_parts GROUP BY lang, i),
own AS (SELECT n.lang, n.n, (SELECT list(m / nullif(z, 0) ORDER BY i) FROM (SELECT i, m, sum(m) OVER () AS z FROM class_own c WHERE c.lang IS NOT DISTINCT FROM n.lang)) AS cr,
  (SELECT list(m ORDER BY i) FROM word_own c WHERE c.lang IS NOT DISTINCT FROM n.lang) AS wr
  FROM (SELECT lang, count(*) AS n FROM shares WHERE NOT base_failed GROUP BY lang HAVING count(*) >= 20) n),
everyone AS (SELECT list(m / nullif(z, 0) ORDER BY i) AS cr FROM (SELECT i, m, sum(m) OVER () AS z FROM class_all)),
met AS (SELECT s.*, coalesce(o.cr, e.cr) AS cr, CASE WHEN s.lang IN ('en', 'fr', 'de', 'es') THEN o.wr[1:b + 1] END AS wr FROM shares s LEFT JOIN own o ON s.lang IS NOT DISTINCT FROM o.lang CROSS JOIN everyone e),
far AS (SELECT *,
  sqrt(greatest(list_sum(list_transform(list_zip(cs, cr), lambda y: CASE WHEN y[1] > 0 THEN y[1] * log2(2 * y[1] / (y[1] + y[2])) ELSE 0 END + CASE WHEN y[2] > 0 THEN y[2] * log2(2 * y[2] / (y[1] + y[2])) ELSE 0 END)) / 2, 0)) AS cd,
  sqrt(greatest(list_sum(list_transform(list_zip(ws, wr), lambda y: CASE WHEN y[1] > 0 THEN y[1] * log2(2 * y[1] / (y[1] + y[2])) ELSE 0 END + CASE WHEN y[2] > 0 THEN y[2] * log2(2 * y[2] / (y[1] + y[2])) ELSE 0 END)) / 2, 0)) AS wd,
  wr[b + 1] AS o FROM met),
edge AS (SELECT *, sqrt((log2(2 / (1 + o)) + CASE WHEN o > 0 THEN o * log2(2 * o / (1 + o)) ELSE 0 END + (1 - o)) / 2) AS none, sqrt(b / (8 * ln(2) * greatest(tokens, 1))) AS chance FROM far)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND (word_chars < 200 OR cd <= 0.18 + 1 / sqrt(greatest(word_chars, 1)))
  AND (tokens < 50 OR o IS NULL OR o > 0.95 OR wd <= least(greatest(0.5 * none, 1.5 * chance), 0.95 * none)) AS kept
FROM edge
"""
for _name, _words in COMMON_WORDS.items():
    QUALITY_RULES_SQL = QUALITY_RULES_SQL.replace(f" {_name.upper()} ", f" {_sql_list(_words)} ")
