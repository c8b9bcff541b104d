"""Queries of fidelity, readability, series, consensus, corpus and modes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import PLAIN_WORD, word_count
from ..operators import consensus, corpus, fidelity, modes, readability, report, series
from ..sources.vocabulary import OWN
from .inputs import MUTATED_SQL, SENTENCES_SQL, documents, mutated, quoted, spread
from .rule_queries import q

# ---------------------------------------------------------------- fidelity
SOURCES = [
    "Wait 30 seconds, then retry 3 times. It must not stop.",
    "Send at most five requests in 2 minutes. Every node must answer if it can.",
    "Set `max_size` in config.yaml with --force. Use LOG_LEVEL now.",
    "All rows are kept, and no file is lost before the check.",
]
REWRITES = [
    "Wait 300 seconds, then retry 3 times. It must stop.",
    "Send at most 5 requests in 2 hours. Some node may answer.",
    "Set max_size in config.yaml. Use LOG_LEVEL now.",
    "Some rows are kept, and no file is lost before the check.",
]


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source and a rewrite of every document: k mod 4 decides what the rewrite changes."""
    k = (F.col("doc_id") % 4).cast("int")
    end = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), k)
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("pair_id"), F.concat("text", F.lit("\n\n"), end(SOURCES)).alias("source"), F.concat("text", F.lit("\n\n"), end(REWRITES)).alias("rewrite")
    )


def _ends(xs: list[str]) -> str:
    return "([" + ", ".join(quoted(x) for x in xs) + "])[(doc_id % 4 + 1)::INT]"


PAIRS_SQL = f"pairs AS (SELECT doc_id AS pair_id, text || chr(10) || chr(10) || {_ends(SOURCES)} AS source, text || chr(10) || chr(10) || {_ends(REWRITES)} AS rewrite FROM documents)"
_B, _E = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def _cue(column: str, cue: str) -> str:
    inner = fidelity.CUES[cue].replace(" ", "[ ]+")
    return f"len(regexp_extract_all(regexp_replace({column}, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g'), {q('(?i)' + _B + '(?:' + inner + ')' + _E)}))"


def cue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    return p.select("pair_id", *[fidelity.cue_count(F.col(c), cue).cast("bigint").alias(f"{c}_{cue}") for c in ("source", "rewrite") for cue in fidelity.CUES])


_CUES_SELECT = "SELECT pair_id, " + ", ".join(f"{_cue(c, cue)}::BIGINT AS {c}_{cue}" for c in ("source", "rewrite") for cue in fidelity.CUES) + " FROM pairs"
CUES_SQL = f"WITH {PAIRS_SQL} {_CUES_SELECT}"

# A changed number is in the appended text only, so the multisets of the shared text cancel out.
_LOST = [
    [("number", "30", "second", "300 seconds")],
    [("unit", "2", "minute", "2 hours")],
    [], [],
]
_LOST_ROWS = ", ".join(f"({k}, '{kind}', '{v}', '{u}')" for k, rows in enumerate(_LOST) for kind, v, u, _ in rows)


def number_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = pairs(spark, sf_dir).select("pair_id", F.inline(fidelity.lost_numbers(F.col("source"), F.col("rewrite"))))
    return lost.groupBy("kind", "value", "unit").agg(F.count("*").alias("pairs"))


NUMBERS_SQL = f"""WITH lost(k, kind, value, unit) AS (VALUES {_LOST_ROWS})
SELECT kind, value, unit, count(*)::BIGINT AS pairs FROM documents JOIN lost ON doc_id % 4 = k GROUP BY ALL"""


def number_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).select("pair_id", F.inline(fidelity.numbers(F.col("source"))))
    return rows.groupBy("unit").agg(F.count("*").alias("numbers"), F.countDistinct("value").alias("values"))


_UNIT_RE = "|".join(u.replace("%", "%%") for u in fidelity._UNITS)
_UNIT_ROWS = ", ".join(f"({q(u)}, {q(name)})" for name, names in fidelity.UNIT_NAMES.items() for u in names.split())
_DIGITS_RE = rf"(?i)(?:^|[^\p{{L}}\p{{N}}_.])(\p{{Nd}}+(?:(?:\.\.|,,)\p{{Nd}}+)*)(?:[\s\p{{Z}}]*({_UNIT_RE}))?(?:$|[^\p{{L}}\p{{N}}_])"
_WORDS_RE = rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])({'|'.join(fidelity.NUMBER_WORDS)})(?:[\s\p{{Z}}]*({_UNIT_RE}))?(?:$|[^\p{{L}}\p{{N}}_])"
# every boundary character is doubled, so that one can end a number and the other begin the next
NUMBER_COUNTS_SQL = f"""WITH {PAIRS_SQL}, d AS (SELECT regexp_replace(source, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g') AS d FROM pairs),
hits AS (SELECT replace(replace(unnest(regexp_extract_all(d, {q(_DIGITS_RE)}, 1)), ',,', ''), '..', '.') AS value, unnest(regexp_extract_all(d, {q(_DIGITS_RE)}, 2)) AS u FROM d
UNION ALL SELECT list_position([{', '.join(q(w) for w in fidelity.NUMBER_WORDS)}], lower(unnest(regexp_extract_all(d, {q(_WORDS_RE)}, 1))))::VARCHAR, unnest(regexp_extract_all(d, {q(_WORDS_RE)}, 2)) FROM d),
named(u, name) AS (VALUES {_UNIT_ROWS}), plain AS (SELECT value, replace(lower(u), '%%', '%') AS u FROM hits)
SELECT coalesce(name, u, '') AS unit, count(*)::BIGINT AS numbers, count(DISTINCT value)::BIGINT AS values FROM plain LEFT JOIN named USING (u) GROUP BY 1"""


def identifier_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = pairs(spark, sf_dir).select("pair_id", F.explode(fidelity.lost_identifiers(F.col("source"), F.col("rewrite"))).alias("identifier"))
    return lost.groupBy("identifier").agg(F.count("*").alias("pairs"))


IDENTIFIERS_SQL = """SELECT identifier, count(*)::BIGINT AS pairs FROM documents, (VALUES ('--force')) AS t(identifier)
WHERE doc_id % 4 = 2 AND NOT contains(text, '--force') GROUP BY identifier
UNION ALL SELECT 'max_size', count(*)::BIGINT FROM documents WHERE doc_id % 4 = 2 HAVING count(*) > 0"""


def fidelity_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fidelity.compare(pairs(spark, sf_dir))
    kinds = F.array_sort(F.array_distinct(F.transform("findings", lambda x: x["kind"])))
    return done.select((F.col("pair_id") % 4).alias("k"), F.array_join(kinds, " ").alias("kinds"), F.col("critical").cast("bigint").alias("critical"), F.col("warnings").cast("bigint").alias("warnings"), "faithful").groupBy(
        "k", "kinds", "critical", "warnings", "faithful").agg(F.count("*").alias("pairs"))


VERDICT_SQL = f"""WITH {PAIRS_SQL}, c AS ({_CUES_SELECT}),
v AS (SELECT pair_id % 4 AS k, (rewrite_negation < source_negation)::INT AS neg, (rewrite_obligation < source_obligation AND rewrite_suggestion > source_suggestion)::INT AS mod_,
(rewrite_condition < source_condition)::INT AS cond, (rewrite_universal < source_universal AND rewrite_partial > source_partial)::INT AS scop,
CASE pair_id % 4 WHEN 0 THEN 1 ELSE 0 END AS num, CASE pair_id % 4 WHEN 1 THEN 1 ELSE 0 END AS unit_, CASE pair_id % 4 WHEN 2 THEN 2 ELSE 0 END AS ident FROM c)
SELECT k, array_to_string(list_filter([CASE WHEN cond = 1 THEN 'condition' END, CASE WHEN ident > 0 THEN 'identifier' END, CASE WHEN mod_ = 1 THEN 'modal' END, CASE WHEN neg = 1 THEN 'negation' END,
CASE WHEN num = 1 THEN 'number' END, CASE WHEN scop = 1 THEN 'scope' END, CASE WHEN unit_ = 1 THEN 'unit' END], lambda x: x IS NOT NULL), ' ') AS kinds,
(neg + mod_ + scop + num + unit_ + ident)::BIGINT AS critical, cond::BIGINT AS warnings, (neg + mod_ + scop + num + unit_ + ident) = 0 AS faithful, count(*)::BIGINT AS pairs FROM v GROUP BY ALL"""


def fix_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = fidelity.gate_fix(pairs(spark, sf_dir), "pair_id", "source", "rewrite")
    return gated.select((F.col("pair_id") % 4).alias("k"), "fix_taken", (F.col("gated") == F.col("rewrite")).alias("is_fix")).groupBy("k", "fix_taken", "is_fix").agg(F.count("*").alias("pairs"))


GATE_SQL = f"SELECT k, faithful AS fix_taken, faithful AS is_fix, sum(pairs)::BIGINT AS pairs FROM ({VERDICT_SQL}) GROUP BY ALL"

# ---------------------------------------------------------------- readability
KNOWN = "the of and to in a is that it for on with as be by this from or an not are at le la les de des el los der die das und run test file make".split()


def _known(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in KNOWN], "known string")


_STEM_ROWS = []
for _end, _put in readability.ENDINGS:
    _fits = f"ends_with(w, '{_end}') AND len(w) > {len(_end) + 2}"
    _stem = f"(left(w, len(w) - {len(_end)}) || '{_put}')"
    _STEM_ROWS.append(f"SELECT w, {_stem} AS known FROM u WHERE {_fits}")
    if _end in ("ing", "ed"):
        _STEM_ROWS.append(f"SELECT w, {_stem} || 'e' FROM u WHERE {_fits}")
    _STEM_ROWS.append(f"SELECT w, left({_stem}, len({_stem}) - 1) FROM u WHERE {_fits} AND len({_stem}) > 2 AND right({_stem}, 1) = substr({_stem}, len({_stem}) - 1, 1)")
_COVERED = rf"""w0 AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*')) AS raw FROM mutated),
ws AS (SELECT doc_id, lower(raw) AS low, regexp_replace(lower(raw), '^[''-]+|[''-]+$', '', 'g') AS w FROM w0), u AS (SELECT DISTINCT w FROM ws),
forms AS (SELECT w, w AS known FROM u UNION ALL {' UNION ALL '.join(_STEM_ROWS)}),
ok AS (SELECT DISTINCT w FROM forms WHERE known IN ({', '.join(q(w) for w in KNOWN)}) OR w = ''),
judged AS (SELECT ws.doc_id, ws.low, ok.w IS NOT NULL AS hit FROM ws LEFT JOIN ok ON ws.w = ok.w)"""


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = readability.coverage(mutated(spark, sf_dir), _known(spark))
    return out.select("doc_id", "words", "covered", "coverage", F.coalesce("meets_supported", F.lit(False)).alias("meets_supported"))


COVERAGE_SQL = f"""WITH {MUTATED_SQL}, {_COVERED}
SELECT doc_id, count(*)::BIGINT AS words, sum(hit::INT)::BIGINT AS covered, round(sum(hit::INT) * 100.0::DOUBLE / count(*), 2) AS coverage,
round(sum(hit::INT) * 100.0::DOUBLE / count(*), 2) >= 95 AS meets_supported FROM judged GROUP BY doc_id"""


def unknown_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = readability.coverage(mutated(spark, sf_dir), _known(spark), top=3)
    return out.select("doc_id", F.posexplode("unknown").alias("place", "u")).select("doc_id", F.col("place").cast("bigint").alias("place"), "u.word", "u.n")


UNKNOWN_SQL = f"""WITH {MUTATED_SQL}, {_COVERED}, c AS (SELECT doc_id, low AS word, count(*)::BIGINT AS n FROM judged WHERE NOT hit GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) - 1 AS place FROM c) SELECT doc_id, place::BIGINT AS place, word, n FROM r WHERE place < 3"""


def term_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = spark.createDataFrame([(p, r) for p, r in OWN.instead_of.items()], "phrase string, replacement string")
    out = readability.term_consistency(mutated(spark, sf_dir), routed)
    return out.select("doc_id", F.col("clusters_in_use").cast("bigint").alias("clusters_in_use"), F.col("split_clusters").cast("bigint").alias("split_clusters"))


_MEMBERS = {}
for _p, _r in OWN.instead_of.items():
    if _r is not None and " " not in _p:
        _MEMBERS.setdefault(_r, {_r}).add(_p)
_MEMBER_ROWS = ", ".join(f"({q(c)}, {q(m)})" for c, ms in _MEMBERS.items() for m in sorted(ms))
CLUSTERS_SQL = rf"""WITH {MUTATED_SQL}, members(cluster, member) AS (VALUES {_MEMBER_ROWS}),
ws AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z][A-Za-z''-]*')) AS member FROM mutated),
used AS (SELECT doc_id, cluster, count(DISTINCT member) AS n FROM ws JOIN members USING (member) GROUP BY ALL)
SELECT m.doc_id, count(cluster)::BIGINT AS clusters_in_use, count(cluster) FILTER (WHERE n > 1)::BIGINT AS split_clusters FROM mutated m LEFT JOIN used USING (doc_id) GROUP BY m.doc_id"""


def readability_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readability.circular_scores(mutated(spark, sf_dir))


SCORES_SQL = rf"""WITH {SENTENCES_SQL}, n AS (SELECT doc_id, count(*)::DOUBLE AS n FROM sent GROUP BY doc_id),
w AS (SELECT doc_id, regexp_replace(lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*'))), '^[''-]+|[''-]+$', '', 'g') AS w FROM mutated),
y AS (SELECT doc_id, CASE WHEN w = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN ends_with(w, 'e') AND len(regexp_extract_all(w, '[aeiouy]+')) > 1 AND NOT regexp_matches(w, '(le|ee|ye)$') THEN 1 ELSE 0 END) END AS k FROM w),
t AS (SELECT doc_id, count(*)::DOUBLE AS words, sum(k)::DOUBLE AS syl FROM y GROUP BY doc_id),
p AS (SELECT doc_id, words / n AS wps, syl / words AS spw FROM t JOIN n USING (doc_id))
SELECT doc_id, round(0.39::DOUBLE * wps + 11.8::DOUBLE * spw - 15.59::DOUBLE, 2) AS grade, round(206.835::DOUBLE - 1.015::DOUBLE * wps - 84.6::DOUBLE * spw, 2) AS reading_ease,
round(wps, 2) AS words_per_sentence, round(spw, 2) AS syllables_per_word FROM p"""

# ---------------------------------------------------------------- series and arms


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and semicolons-or-commas of every turn."""
    c = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return c.select("conv_id", "turn", word_count(F.col("text")).cast("bigint").alias("words"), F.regexp_count("text", F.lit("[,.]")).cast("bigint").alias("findings"))


_TURNS_SQL = r"""turns AS (SELECT conv_id, turn, len(regexp_extract_all(text, '[A-Za-z][A-Za-z''’\-]*'))::BIGINT AS words, len(regexp_extract_all(text, '[,.]'))::BIGINT AS findings FROM conversations),
y AS (SELECT *, CASE WHEN words > 0 THEN round(findings * 100.0::DOUBLE / words, 2) ELSE 0.0 END::DOUBLE AS y, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS x, count(*) OVER (PARTITION BY conv_id) AS n FROM turns),
b AS (SELECT *, CASE WHEN x <= greatest(1, n // 3) THEN 1 WHEN x <= 2 * greatest(1, n // 3) THEN 2 ELSE 3 END AS band FROM y)"""


def series_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.analyse(_turns(spark, sf_dir)).select("conv_id", "words", "findings", "per_100w", "first_third", "middle_third", "last_third", "best_turn", "worst_turn")


THIRDS_SQL = f"""WITH {_TURNS_SQL} SELECT conv_id, sum(words)::BIGINT AS words, sum(findings)::BIGINT AS findings,
CASE WHEN sum(words) > 0 THEN round(sum(findings) * 100.0::DOUBLE / sum(words), 2) ELSE 0.0 END::DOUBLE AS per_100w,
{', '.join(f"round(coalesce(avg(round(y * 100)) FILTER (WHERE band = {b}), avg(round(y * 100)))) / 100 AS {name}" for b, name in ((1, 'first_third'), (2, 'middle_third'), (3, 'last_third')))},
min(y) AS best_turn, max(y) AS worst_turn FROM b GROUP BY conv_id"""


def series_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.analyse(_turns(spark, sf_dir)).select("conv_id", F.round("slope", 2).alias("slope"), F.round("intercept", 1).alias("intercept"), F.round("residual_sd", 1).alias("residual_sd"))


SLOPE_SQL = f"""WITH {_TURNS_SQL}, f AS (SELECT conv_id, CASE WHEN max(n) >= 3 THEN regr_slope(y, x) END AS s, CASE WHEN max(n) >= 3 THEN regr_intercept(y, x) END AS i FROM b GROUP BY conv_id),
r AS (SELECT conv_id, stddev_pop(y - (i + s * x)) AS sd FROM b JOIN f USING (conv_id) GROUP BY conv_id)
SELECT conv_id, round(round(s, 4), 2) AS slope, round(round(i, 3), 1) AS intercept, round(round(sd, 3), 1) AS residual_sd FROM f JOIN r USING (conv_id)"""

ARMS = ["baseline", "treated"]


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by document, arm and pass: the treated arm has fewer, passes differ by one."""
    arms = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(k).alias("k")) for k, a in enumerate(ARMS)]))
    base = documents(spark, sf_dir).select("doc_id", "source", arms.alias("a"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pass"))
    return base.select("doc_id", "source", "a.arm", "pass", F.greatest(F.lit(0), (F.col("doc_id") * 7 + F.col("pass") * 3) % 6 - F.col("a.k") * 3).cast("bigint").alias("total"))


_CELLS_SQL = "cells AS (SELECT doc_id, source, arm, p AS pass, greatest(0, (doc_id * 7 + p * 3) % 6 - k * 3)::BIGINT AS total FROM documents, (VALUES ('baseline', 0), ('treated', 1)) AS a(arm, k), range(0, 3) AS r(p))"


def arm_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.arm_spread(_cells(spark, sf_dir), ARMS)


PIVOT_SQL = f"WITH {_CELLS_SQL} SELECT doc_id, " + ", ".join(
    f"max(total) FILTER (WHERE arm = '{a}' AND pass = 0) AS {a}_first, min(total) FILTER (WHERE arm = '{a}') AS {a}_least, max(total) FILTER (WHERE arm = '{a}') AS {a}_most" for a in ARMS
) + " FROM cells GROUP BY doc_id"


def conforming_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.conforming_share(_cells(spark, sf_dir), ["arm", "source"])


SHARE_SQL = f"WITH {_CELLS_SQL} SELECT arm, source, count(*) FILTER (WHERE total = 0)::BIGINT AS passed, count(*)::BIGINT AS of, round(count(*) FILTER (WHERE total = 0) * 100.0::DOUBLE / count(*), 2) AS share FROM cells GROUP BY ALL"


def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary_stats(_cells(spark, sf_dir), "total", ["arm"])


STATS_SQL = f"WITH {_CELLS_SQL} SELECT arm, count(total)::BIGINT AS n, median(total)::DOUBLE AS median, avg(total)::DOUBLE AS mean, min(total) AS least, max(total) AS most FROM cells GROUP BY arm"


def overview_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).withColumn("synthetic", (F.col("doc_id") % 3 == 0)).withColumn("bucket", F.when(F.col("doc_id") % 5 == 0, "anchor").otherwise("rotating"))
    return report.overview(cells, ["total"], "synthetic", "bucket")


OVERVIEW_SQL = f"WITH {_CELLS_SQL}, c AS (SELECT *, doc_id % 3 = 0 AS synthetic, CASE WHEN doc_id % 5 = 0 THEN 'anchor' ELSE 'rotating' END AS bucket FROM cells) SELECT arm, synthetic, bucket, count(*)::BIGINT AS cells, sum(total)::BIGINT AS total FROM c GROUP BY GROUPING SETS ((arm, synthetic), (arm, bucket))"


def word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = mutated(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(PLAIN_WORD), F.lit(0))).alias("word"))
    routed = spark.createDataFrame([(p, r) for p, r in OWN.instead_of.items() if " " not in p], "word string, replacement string")
    return report.word_table(hits.join(F.broadcast(routed), "word"))


_ROUTES = ", ".join(f"({q(p)}, {q(r) if r else 'NULL'})" for p, r in OWN.instead_of.items() if " " not in p)
WORDS_SQL = rf"""WITH {MUTATED_SQL}, r(word, replacement) AS (VALUES {_ROUTES}), h AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z][A-Za-z''-]*')) AS word FROM mutated)
SELECT word, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS documents, max(replacement) AS replacement FROM h JOIN r USING (word) GROUP BY word"""

# ---------------------------------------------------------------- consensus
JUDGES = ["one", "two"]


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three passes of two judges over every labelled document; the labels sway what they find."""
    lab = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = lab.select("doc_id", "quality", "toxic", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pass"), F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    mix = (F.col("doc_id") * 7 + F.col("pass") * 3 + F.col("j") * 5) % 5
    found = F.array_compact(F.array(F.when(mix < 3, F.lit('{"rule":"A1","quote":"alpha","problem":"p","confidence":"low"}')), F.when((mix > 1) | (F.col("quality") == 0), F.lit('{"rule":"W2","quote":"beta","problem":"q","confidence":"high"}'))))
    good = F.concat(F.lit('Here: {"findings":['), F.array_join(found, ","), F.lit('],"considered":[{"rule":"P1","quote":"gamma","reason":"fine"}]} done'))
    reply = F.when((F.col("doc_id") + F.col("pass")) % 11 == 0, F.lit("I see no problem")).otherwise(good)
    return rows.select("doc_id", F.get(F.array(*[F.lit(x) for x in JUDGES]), F.col("j")).alias("judge"), "pass", reply.alias("reply"))


_VOTES_SQL = """reps AS (SELECT doc_id, ['one', 'two'][j + 1] AS judge, p AS pass, (doc_id * 7 + p * 3 + j * 5) % 5 AS mix, quality, (doc_id + p) % 11 = 0 AS failed FROM labels, range(0, 3) AS r(p), range(0, 2) AS s(j)),
passes AS (SELECT doc_id, judge, count(*) FILTER (WHERE NOT failed)::BIGINT AS of FROM reps GROUP BY ALL),
f AS (SELECT doc_id, judge, pass, 'A1' AS rule FROM reps WHERE NOT failed AND mix < 3 UNION ALL SELECT doc_id, judge, pass, 'W2' FROM reps WHERE NOT failed AND (mix > 1 OR quality = 0)),
v AS (SELECT doc_id, judge, rule, count(DISTINCT pass)::BIGINT AS seen_in FROM f GROUP BY ALL),
sums AS (SELECT doc_id, judge, rule, seen_in, of, round(seen_in::DOUBLE / of, 2) AS agreement, CASE WHEN seen_in::DOUBLE / of >= 0.5 THEN 'confirmed' ELSE 'low-agreement' END AS status FROM v JOIN passes USING (doc_id, judge)
UNION ALL SELECT doc_id, judge, NULL, 0, of, NULL, 'error' FROM passes WHERE of = 0)"""


def judge_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.votes(_replies(spark, sf_dir), ["doc_id", "judge"]).select("doc_id", "judge", "rule", "seen_in", "of", "agreement", "status")


VOTES_SQL = f"WITH {_VOTES_SQL} SELECT * FROM sums"


def judge_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = consensus.votes(_replies(spark, sf_dir), ["doc_id", "judge"])
    return consensus.overlap(sums, ["doc_id"]).select("doc_id", "rule", F.col("by").alias("agreeing"), "judges", "status")


OVERLAP_SQL = f"""WITH {_VOTES_SQL}, a AS (SELECT doc_id, count(DISTINCT judge)::BIGINT AS judges FROM sums WHERE status <> 'error' GROUP BY doc_id),
c AS (SELECT doc_id, rule, count(DISTINCT judge)::BIGINT AS agreeing FROM sums WHERE status = 'confirmed' GROUP BY ALL)
SELECT doc_id, rule, agreeing, judges, CASE WHEN agreeing = judges AND judges >= 2 THEN 'overlap' ELSE 'confirmed' END AS status FROM c JOIN a USING (doc_id)"""


def judge_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.rejections(_replies(spark, sf_dir), ["doc_id", "judge"]).select("doc_id", "judge", "rule", "quote", "seen_in", "reason", "status")


REJECTIONS_SQL = f"WITH {_VOTES_SQL} SELECT doc_id, judge, 'P1' AS rule, 'gamma' AS quote, of AS seen_in, 'fine' AS reason, 'rejected' AS status FROM passes WHERE of > 0"


def rotation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.format_string("item-%03d", "item_id").alias("doc"))
    return consensus.rotation_sample(ids, "doc", ["item-001", "item-002"], 7, consensus.commit_offset(F.lit("40dbd48")))


ROTATION_SQL = """WITH ids AS (SELECT printf('item-%03d', item_id) AS doc FROM benchmark), pool AS (SELECT doc, row_number() OVER (ORDER BY doc) - 1 AS rn, count(*) OVER () AS n FROM ids WHERE doc NOT IN ('item-001', 'item-002')),
o AS (SELECT ('0x' || substr(sha256('40dbd48'), 1, 8))::BIGINT AS off)
SELECT doc, false AS anchor FROM pool, o WHERE ((rn - off % n) % n + n) % n < 7 UNION ALL SELECT doc, true FROM ids WHERE doc IN ('item-001', 'item-002')"""


def document_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    cells = documents(spark, sf_dir).select("doc_id", (d % 4).alias("countable"), (d % 3).alias("fact_losses"), (d % 2).alias("confirmed"), (d % 7 == 0).alias("unjudged"))
    return consensus.gate(cells).groupBy("pass").agg(F.count("*").alias("documents"))


GATED_SQL = "SELECT doc_id % 12 = 0 AND doc_id % 7 <> 0 AS pass, count(*)::BIGINT AS documents FROM documents GROUP BY 1"

# ---------------------------------------------------------------- corpus, modes


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("item_id")
    licence = F.get(F.array(F.lit("CC-BY-4.0"), F.lit("CC-BY-SA-4.0"), F.lit("proprietary")), (k % 3).cast("int"))
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        F.concat(F.lit("doc-"), k).alias("id"), F.lit("runbook").alias("type"), F.concat(F.lit("Title "), k).alias("title"), F.concat(F.lit("https://a.b/"), k).alias("url"),
        F.when(k % 5 == 0, F.lit("")).otherwise(F.lit("Ann")).alias("author"), licence.alias("licence"), F.lit("2024-01-01").alias("retrieved"),
        F.sha2(F.when(k % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"), "text", "item_id",
    )


def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _manifest(spark, sf_dir)
    files = m.where("item_id % 7 <> 0").select("id", F.sha2("text", 256).alias("sha256")).select(F.col("id").alias("name"), "sha256")
    return corpus.manifest_diff(m.where("item_id % 6 <> 1").select("id", "sha256"), files)


MANIFEST_SQL = """SELECT 'doc-' || item_id AS id, CASE WHEN item_id % 7 = 0 THEN 'missing' WHEN item_id % 6 = 1 THEN 'unlisted' ELSE 'changed' END AS problem FROM benchmark
WHERE (item_id % 7 = 0 AND item_id % 6 <> 1) OR (item_id % 6 = 1 AND item_id % 7 <> 0) OR (item_id % 4 = 0 AND item_id % 7 <> 0 AND item_id % 6 <> 1)"""


def manifest_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _manifest(spark, sf_dir)
    return corpus.manifest_problems(m.unionByName(m.where("item_id % 9 = 0")))


PROBLEMS_SQL = """WITH m AS (SELECT item_id FROM benchmark UNION ALL SELECT item_id FROM benchmark WHERE item_id % 9 = 0)
SELECT 'doc-' || item_id AS id, 'no author' AS problem FROM m WHERE item_id % 5 = 0 UNION ALL SELECT 'doc-' || item_id, 'licence proprietary' FROM m WHERE item_id % 3 = 2
UNION ALL SELECT 'doc-' || item_id, 'given twice' FROM benchmark WHERE item_id % 9 = 0"""


def licence_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _manifest(spark, sf_dir)
    return m.select("id", corpus.derived_licence(F.col("licence")).alias("derived"), corpus.attribution(*[F.col(c) for c in ("title", "author", "licence", "url")]).alias("credit"))


LICENCE_SQL = """WITH m AS (SELECT item_id, ['CC-BY-4.0', 'CC-BY-SA-4.0', 'proprietary'][item_id % 3 + 1] AS l FROM benchmark)
SELECT 'doc-' || item_id AS id, CASE WHEN contains(l, '-SA-') THEN l ELSE 'CC-BY-4.0' END AS derived,
'"Title ' || item_id || '"' || CASE WHEN item_id % 5 = 0 THEN '' ELSE ' by Ann' END || ', ' || l || ', https://a.b/' || item_id AS credit FROM m"""


def avoid_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = spark.createDataFrame([(p, r) for p, r in OWN.instead_of.items()] + [("number", "total")], "phrase string, replacement string")
    return corpus.avoid_index(routed)


AVOID_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({q(p)}, {q(r if p != 'number' else 'count, total')})" for p, r in OWN.instead_of.items() if r) + ") AS t(avoid, use)"


def page_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opening of each document's text, cut at a blank."""
    return documents(spark, sf_dir).select("doc_id", corpus.excerpt(F.col("text")).alias("excerpt"))


EXCERPT_SQL = r"""WITH p AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '(?m)^\s*(#{1,6}\s.*|[-=*_]{3,}|\|.*|>.*|```.*)$', '', 'g'), '\s+', ' ', 'g')) AS p FROM documents),
f AS (SELECT doc_id, CASE WHEN length(p) >= 80 THEN p END AS p FROM p)
SELECT doc_id, CASE WHEN length(p) <= 320 THEN p ELSE CASE WHEN regexp_extract(p, '^(.{0,319}) ', 1) <> '' THEN regexp_extract(p, '^(.{0,319}) ', 1) ELSE left(p, 320) END || '…' END AS excerpt FROM f"""

PROMPTS = ["/plain on", "please write the readme", "stop using plain english", "turn on plain mode", "what does normal mode do?", "hello there", "/plain off", "draft the runbook now"]


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    prompt = F.get(F.array(*[F.lit(p) for p in PROMPTS]), ((F.col("conv_id") * 3 + F.col("turn") * 5) % len(PROMPTS)).cast("int"))
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), prompt.alias("prompt"))


def mode_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.states(_prompts(spark, sf_dir)).select("session_id", "seq", "level", "emitted")


MODES_SQL = f"""WITH p AS (SELECT conv_id AS session_id, turn AS seq, (conv_id * 3 + turn * 5) % {len(PROMPTS)} AS k FROM conversations),
w AS (SELECT *, CASE k WHEN 0 THEN 'on' WHEN 2 THEN 'off' WHEN 3 THEN 'on' WHEN 6 THEN 'off' END AS wrote FROM p),
l AS (SELECT *, coalesce(last_value(wrote IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 'off') AS level FROM w)
SELECT session_id, seq, level, CASE WHEN k IN (0, 2, 6) THEN level WHEN level <> 'off' THEN 'reminder' WHEN k IN (1, 7) THEN 'one-turn' ELSE 'nothing' END AS emitted FROM l"""


def artifact_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _prompts(spark, sf_dir)
    return p.groupBy(modes.names_artifact(F.col("prompt")).alias("names_artifact")).agg(F.count("*").alias("prompts"))


ARTIFACT_SQL = f"SELECT (conv_id * 3 + turn * 5) % {len(PROMPTS)} IN (1, 7) AS names_artifact, count(*)::BIGINT AS prompts FROM conversations GROUP BY 1"

QUERIES = {
    "cue_counts": cue_counts, "number_loss": number_loss, "number_counts": number_counts, "identifier_loss": identifier_loss, "fidelity_verdict": fidelity_verdict,
    "fix_gate": fix_gate, "coverage": coverage, "unknown_words_topk": unknown_words, "term_clusters": term_clusters,
    "readability_scores": readability_scores, "series_thirds": series_thirds, "series_slope": series_slope, "arm_pivot": arm_pivot,
    "conforming_share": conforming_share, "summary_stats": summary_stats, "overview_totals": overview_totals, "word_table": word_table,
    "judge_votes": judge_votes, "judge_overlap": judge_overlap, "judge_rejections": judge_rejections, "rotation_sample": rotation_sample,
    "document_gate": document_gate, "manifest_diff": manifest_diff, "manifest_problems": manifest_problems, "licence_derivation": licence_derivation,
    "avoid_index": avoid_index, "page_excerpts": page_excerpts, "mode_states": mode_states, "artifact_trigger": artifact_trigger,
}
ORACLES = {
    "cue_counts": CUES_SQL, "number_loss": NUMBERS_SQL, "number_counts": NUMBER_COUNTS_SQL, "identifier_loss": IDENTIFIERS_SQL, "fidelity_verdict": VERDICT_SQL, "fix_gate": GATE_SQL,
    "coverage": COVERAGE_SQL, "unknown_words_topk": UNKNOWN_SQL, "term_clusters": CLUSTERS_SQL, "readability_scores": SCORES_SQL,
    "series_thirds": THIRDS_SQL, "series_slope": SLOPE_SQL, "arm_pivot": PIVOT_SQL, "conforming_share": SHARE_SQL, "summary_stats": STATS_SQL,
    "overview_totals": OVERVIEW_SQL, "word_table": WORDS_SQL, "judge_votes": VOTES_SQL, "judge_overlap": OVERLAP_SQL, "judge_rejections": REJECTIONS_SQL,
    "rotation_sample": ROTATION_SQL, "document_gate": GATED_SQL, "manifest_diff": MANIFEST_SQL, "manifest_problems": PROBLEMS_SQL,
    "licence_derivation": LICENCE_SQL, "avoid_index": AVOID_SQL, "page_excerpts": EXCERPT_SQL, "mode_states": MODES_SQL, "artifact_trigger": ARTIFACT_SQL,
}
