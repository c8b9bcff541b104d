"""Corpus upkeep: manifest checks, licences, ingest transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an entry needs, and which licences may be used.
REQUIRED = "id type title url author licence retrieved sha256".split()
LICENCES = "CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 MIT Apache-2.0 BSD-3-Clause".split()
SHORT, LONG = 150, 1500


def manifest_problems(manifest: DataFrame) -> DataFrame:
    """(id, problem): missing fields, ids given twice, licences outside the list."""
    missing = F.filter(F.array(*[F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(c)) for c in REQUIRED]), lambda x: x.isNotNull())
    gaps = manifest.select("id", F.explode(missing).alias("f")).select("id", F.concat(F.lit("no "), F.col("f")).alias("problem"))
    twice = manifest.groupBy("id").count().where("count > 1").select("id", F.lit("given twice").alias("problem"))
    odd = manifest.where(F.col("licence").isNotNull() & (F.trim("licence") != "") & ~F.col("licence").isin(*LICENCES)).select(
        "id", F.concat(F.lit("licence "), F.col("licence")).alias("problem")
    )
    return gaps.unionByName(twice).unionByName(odd)


def manifest_diff(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(id, problem) where manifest(id, sha256) and files(name, sha256) differ: one full join."""
    both = manifest.select("id", F.col("sha256").alias("want"), F.lit(True).alias("listed")).join(
        files.select(F.col("name").alias("id"), F.col("sha256").alias("have"), F.lit(True).alias("there")), "id", "full_outer"
    )
    problem = F.when(F.col("there").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("want") != F.col("have"), "changed")
    return both.select("id", problem.alias("problem")).where("problem is not null")


def derived_licence(licence: Column) -> Column:
    """A share-alike licence passes on; anything else lets the derived text have a plain one."""
    return F.when(F.contains(licence, F.lit("-SA-")), licence).otherwise(F.lit("CC-BY-4.0"))


def attribution(title: Column, author: Column, licence: Column, url: Column) -> Column:
    by = F.when(F.coalesce(author, F.lit("")) != "", F.concat(F.lit(" by "), author)).otherwise(F.lit(""))
    return F.concat(F.lit('"'), title, F.lit('"'), by, F.lit(", "), licence, F.lit(", "), url)


def strip_machinery(text: Column) -> Column:
    """(text, removed): without front matter, template comments and template-only lines."""
    front = r"(?s)\A---\n.*?\n---\n"
    comments = r"(?s)<!--\s*(?:body|overview|steps)\s*-->\n?"
    template = r"(?md)^\s*\{\{[<%].*[>%]\}\}\s*$\n?"
    removed = F.array_compact(
        F.array(*[F.when(F.rlike(text, F.lit(rx)), F.lit(name)) for name, rx in (("front matter", front), ("comments", comments), ("templates", template))])
    )
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, front, ""), comments, ""), template, "")
    return F.struct(out.alias("text"), removed.alias("removed"))


def cut_sections(text: Column, first: str, last: str | None = None) -> Column:
    """Lines from the heading that holds first to before the one that holds last (or the last heading)."""
    lines = F.split(text, "\n", -1)
    is_head = lambda x: F.rlike(x, F.lit(r"^(#{2,4}|={2,4})\s"))
    order = F.sequence(F.lit(0), F.size(lines) - 1)
    begin = F.get(F.filter(order, lambda i: is_head(F.get(lines, i)) & F.contains(F.lower(F.get(lines, i)), F.lit(first.lower()))), F.lit(0))
    ends = F.filter(order, lambda i: (i > begin) & is_head(F.get(lines, i)))
    if last is not None:
        stop = F.get(F.filter(ends, lambda i: F.contains(F.lower(F.get(lines, i)), F.lit(last.lower()))), F.lit(0))
    else:
        stop = F.try_element_at(ends, F.lit(-1))
    stop = F.coalesce(stop, F.size(lines))
    return F.when(begin.isNotNull(), F.array_join(F.slice(lines, begin + 1, stop - begin), "\n"))


def excerpt(text: Column, most: int = 320, least: int = 80) -> Column:
    """The first paragraph of some length without decoration, cut at a blank, with a mark."""
    parts = F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"(?md)^\s*(#{1,6}\s.*|[-=*_]{3,}|\|.*|>.*|```.*)$", ""), r"\s+", " ")))
    first = F.get(F.filter(parts, lambda p: F.length(p) >= least), F.lit(0))
    cut = F.regexp_extract(first, rf"^(.{{0,{most - 1}}}) ", 1)
    return F.when(F.length(first) <= most, first).otherwise(F.concat(F.when(cut != "", cut).otherwise(F.substring(first, 1, most)), F.lit("…")))


def ingest_flags(id_: Column, licence: Column, words: Column, is_excerpt: Column, note: Column) -> Column:
    """What is wrong with a document to be added, worst first; empty if nothing is."""
    tests = [
        (~licence.isin(*LICENCES), "licence is not in the list"), (~F.rlike(id_, F.lit("^[a-z0-9][a-z0-9-]*$")), "id is malformed"),
        (is_excerpt & (F.coalesce(note, F.lit("")) == ""), "an excerpt needs a note"),
        (words < SHORT, "short"), (words > LONG, "long"),
    ]
    return F.array_compact(F.array(*[F.when(t, F.lit(m)) for t, m in tests]))


def avoid_index(routed: DataFrame) -> DataFrame:
    """(avoid, use): each avoided phrase with all words to use for it."""
    return (
        routed.where(F.col("replacement").isNotNull()).groupBy(F.col("phrase").alias("avoid"))
        .agg(F.array_join(F.array_sort(F.collect_set("replacement")), ", ").alias("use"))
    )


def is_stale(generated: DataFrame, stored: DataFrame) -> bool:
    """Whether a stored table differs from the generated one, rows counted."""
    return not (generated.exceptAll(stored).isEmpty() and stored.exceptAll(generated).isEmpty())


def unsound_routes(routed: DataFrame, approved: DataFrame, term_verbs: DataFrame) -> DataFrame:
    """Routes whose first word is neither approved nor a term verb."""
    good = approved.select(F.col(approved.columns[0]).alias("w")).unionByName(term_verbs.select(F.col(term_verbs.columns[0]).alias("w"))).distinct()
    return routed.where(F.col("replacement").isNotNull()).withColumn("w", F.split("replacement", " ")[0]).join(good, "w", "left_anti").drop("w")
