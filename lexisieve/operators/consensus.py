"""Judge replies: parsing, votes, overlap between judges, sampling and the document gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ITEM = "rule:string,quote:string,problem:string,fix:string,confidence:string,reason:string"
REPLY = f"findings array<struct<{_ITEM}>>, considered array<struct<rule:string,quote:string,reason:string>>"
# How long a field may be, and what a confidence counts.
LENGTHS = {"rule": 16, "quote": 200, "problem": 300, "fix": 300, "confidence": 8, "reason": 300}
CONFIDENCE = {"high": 3, "medium": 2, "low": 1}
GATE = 0.5


def parse_reply(reply: Column) -> Column:
    """(findings, considered, error): what is no JSON, or has no findings list, is an error, never clean."""
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    parsed = F.from_json(body, REPLY)
    cut = F.transform(
        parsed["findings"], lambda x: F.struct(*[F.substring(F.coalesce(x[f], F.lit("")), 1, n).alias(f) for f, n in LENGTHS.items()])
    )
    error = F.when(body == "", F.lit("no JSON object")).when(parsed["findings"].isNull(), F.lit("no findings list"))
    return F.struct(cut.alias("findings"), F.coalesce(parsed["considered"], F.array().cast("array<struct<rule:string,quote:string,reason:string>>")).alias("considered"), error.alias("error"))


def locate(quote: Column, text: Column) -> Column:
    """Offset of a quote in a text: whole, else by its first 8, 6 or 4 words; null if nowhere."""
    bare = F.regexp_replace(quote, r"^[\s\"'“”‘’]+|[\s\"'“”‘’]+$", "")
    words = F.split(bare, r"\s+")
    tries = [bare] + [F.when(F.size(words) > n, F.array_join(F.slice(words, 1, n), " ")) for n in (8, 6, 4)]
    return F.when(bare == "", F.lit(None)).otherwise(F.coalesce(*[F.nullif(F.position(t, text), F.lit(0)) for t in tries]) - 1).cast("int")


def votes(replies: DataFrame, keys: list[str], gate: float = GATE) -> DataFrame:
    """Of replies(keys, pass, reply) one row per key and rule: seen_in, of, agreement, status, best example.

    A pass whose reply is an error leaves the denominator; where every pass failed there is one
    row of status error. The best example has the highest confidence, the earliest on a tie.
    """
    read = replies.select(*keys, "pass", parse_reply(F.col("reply")).alias("r")).select(*keys, "pass", "r.*")
    passes = read.groupBy(*keys).agg(F.count_if(F.col("error").isNull()).alias("of"))
    rows = read.where("error is null").select(*keys, "pass", F.posexplode("findings").alias("pos", "f"))
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), F.lower("f.confidence")), F.lit(0))
    best = F.max_by(F.struct("f.*"), F.struct(weight, -F.col("pass"), -F.col("pos")))
    seen = rows.groupBy(*keys, F.col("f.rule").alias("rule")).agg(F.countDistinct("pass").alias("seen_in"), best.alias("b"))
    ratio = F.col("seen_in") / F.col("of")
    counted = seen.join(passes, keys).select(
        *keys, "rule", "seen_in", "of", F.round(ratio, 2).alias("agreement"),
        F.when(ratio >= gate, "confirmed").otherwise("low-agreement").alias("status"), F.col("b.quote").alias("quote"), F.col("b.problem").alias("problem"),
    )
    failed = passes.where(F.col("of") == 0).select(
        *keys, F.lit(None).cast("string").alias("rule"), F.lit(0).cast("long").alias("seen_in"), "of", F.lit(None).cast("double").alias("agreement"),
        F.lit("error").alias("status"), F.lit(None).cast("string").alias("quote"), F.lit(None).cast("string").alias("problem"),
    )
    return counted.unionByName(failed)


def rejections(replies: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates a judge considered and rejected, by rule and quote."""
    read = replies.select(*keys, "pass", parse_reply(F.col("reply")).alias("r")).where("r.error is null")
    rows = read.select(*keys, "pass", F.posexplode("r.considered").alias("pos", "c"))
    return rows.groupBy(*keys, F.col("c.rule").alias("rule"), F.col("c.quote").alias("quote")).agg(
        F.countDistinct("pass").alias("seen_in"), F.min_by("c.reason", F.struct("pass", "pos")).alias("reason")
    ).withColumn("status", F.lit("rejected"))


def overlap(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Rules that every judge (two at least) of a cell confirmed become one row of status overlap."""
    answered = summaries.where("status <> 'error'").groupBy(*keys).agg(F.countDistinct("judge").alias("judges"))
    by_rule = summaries.where("status = 'confirmed'").groupBy(*keys, "rule").agg(
        F.countDistinct("judge").alias("by"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("judge", "quote")))).alias("quotes")
    )
    return by_rule.join(answered, keys).select(
        *keys, "rule", "by", "judges", F.when((F.col("by") == F.col("judges")) & (F.col("judges") >= 2), "overlap").otherwise("confirmed").alias("status"), "quotes"
    )


def rotation_sample(ids: DataFrame, id_col: str, anchors: list[str], count: int, offset: Column) -> DataFrame:
    """Anchors, and a cyclic slice of the other ids from an offset on, in id order."""
    pool = ids.where(~F.col(id_col).isin(*anchors)).select(id_col) if anchors else ids.select(id_col)
    # the pool is a list of documents to judge by hand: small by nature
    numbered = pool.withColumn("rn", F.row_number().over(Window.orderBy(id_col)) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    chosen = numbered.where(F.pmod(F.col("rn") - F.pmod(offset, F.col("n")), F.col("n")) < count).select(id_col, F.lit(False).alias("anchor"))
    if not anchors:
        return chosen
    return chosen.unionByName(ids.where(F.col(id_col).isin(*anchors)).select(id_col, F.lit(True).alias("anchor")))


def commit_offset(commit: Column) -> Column:
    return F.conv(F.substring(F.sha2(commit, 256), 1, 8), 16, 10).cast("long")


def gate(cells: DataFrame) -> DataFrame:
    """cells(countable, fact_losses, confirmed, unjudged) with pass."""
    return cells.withColumn("pass", ~F.col("unjudged") & (F.col("countable") == 0) & (F.col("fact_losses") == 0) & (F.col("confirmed") == 0))


def judge_workers(jobs: Column, targets: Column) -> Column:
    """Texts at once, and passes at once within each, so that their product stays within jobs."""
    outer = F.greatest(F.lit(1), F.least(jobs, targets))
    return F.struct(outer.cast("int").alias("texts"), F.greatest(F.lit(1), F.floor(jobs / outer)).cast("int").alias("passes"))
