"""Column building blocks: bound values, matches with places, words, positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[A-Za-z][A-Za-z'’\-]*"
PLAIN_WORD = r"[A-Za-z][A-Za-z'-]*"
MATCH = "array<struct<at:int,hit:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: a lambda variable is never inlined."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str | Column, group: int = 0) -> Column:
    """All matches of a pattern: array of (at, hit), at from 0; hit may be a group of it.

    A literal pattern is compiled once a task; texts without a match cost one search.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern

    def placed(wholes: Column) -> Column:
        def one(state: Column, i: Column) -> Column:
            at = state["pos"] + F.length(F.get(state["parts"], i))
            return F.struct(
                (at + F.length(F.get(wholes, i))).alias("pos"),
                state["parts"].alias("parts"),
                F.array_append(state["out"], at).alias("out"),
            )

        start = F.struct(
            F.lit(0).alias("pos"), F.split(text, regex, -1).alias("parts"), F.array().cast("array<int>").alias("out")
        )
        ats = F.aggregate(F.sequence(F.lit(0), F.size(wholes) - 1), start, one, lambda s: s["out"])
        hits = wholes if group == 0 else F.regexp_extract_all(text, regex, F.lit(group))
        return F.transform(F.arrays_zip(ats.alias("at"), hits.alias("hit")), lambda x: F.struct(x["at"].alias("at"), x["hit"].alias("hit")))

    found = let(F.regexp_extract_all(text, regex, F.lit(0)), placed)
    return F.when(F.rlike(text, regex), found).otherwise(F.array().cast(MATCH))


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match as an array of at most one (at, hit)."""
    at = F.regexp_instr(text, F.lit(pattern)) - 1
    hit = F.regexp_extract(text, pattern, group)
    one = F.array(F.struct(at.cast("int").alias("at"), hit.alias("hit")))
    return F.when(F.rlike(text, F.lit(pattern)), one).otherwise(F.array().cast(MATCH))


def letter_bounded(phrase: str) -> str:
    """A phrase that no letter touches, in any case."""
    return r"(?i)(?<![A-Za-z])" + "".join("\\" + c if not c.isalnum() and c != " " else c for c in phrase) + r"(?![A-Za-z])"


def any_of(phrases: list[str]) -> str:
    longest = sorted(set(phrases), key=lambda p: (-len(p), p))
    inner = "|".join("".join("\\" + c if not c.isalnum() and c != " " else c for c in p) for p in longest)
    return rf"(?i)(?<![A-Za-z])(?:{inner})(?![A-Za-z])"


def word_count(text: Column) -> Column:
    """Words of letters, apostrophes and hyphens; numbers are none."""
    return F.regexp_count(text, F.lit(WORD)).cast("int")


def rounded(value: Column, digits: int) -> Column:
    """A double rounded half away from zero after scaling, as DuckDB does: 1.025 * 100 is below 102.5.

    F.round looks at the decimal notation instead and gives 1.03 there.
    """
    return F.round(value * float(10 ** digits)) / float(10 ** digits)


def space_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def unicode_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\w+")).cast("int")


def line_of(text: Column, at: Column) -> Column:
    """Line of an offset, from 1; only newlines count."""
    return (F.length(F.substring(text, F.lit(1), at)) - F.length(F.replace(F.substring(text, F.lit(1), at), F.lit("\n"), F.lit(""))) + 1).cast("int")


def column_of(text: Column, at: Column) -> Column:
    """Column of an offset in its line, from 1."""
    head = F.substring(text, F.lit(1), at)
    return (F.length(F.substring_index(head, "\n", -1)) + 1).cast("int")


def offset_of(text: Column, line: Column, column: Column) -> Column:
    """Offset of a line and a column (from 1); null where there is no such place."""
    lines = F.split(text, "\n", -1)
    before = F.length(F.array_join(F.slice(lines, F.lit(1), line - 1), "\n")) + F.when(line > 1, 1).otherwise(0)
    inside = F.get(lines, line - 1)
    return F.when(
        (line >= 1) & (line <= F.size(lines)) & (column >= 1) & (column <= F.length(inside) + 1), before + column - 1
    ).cast("int")


def token_at(text: Column, at: Column) -> Column:
    """The token that starts at an offset, or the character there."""
    tail = F.substring(text, at + 1, F.lit(60))
    token = F.regexp_extract(tail, r"^[\p{L}\p{N}\-_'’]+", 0)
    return F.when(token != "", token).otherwise(F.substring(tail, 1, 1))


def syllables(word: Column) -> Column:
    """Vowel groups, less a silent final e; one at least."""
    w = F.lower(F.regexp_replace(word, r"^['-]+|['-]+$", ""))
    n = F.regexp_count(w, F.lit("[aeiouy]+"))
    silent = F.endswith(w, F.lit("e")) & (n > 1) & ~F.rlike(w, F.lit("(le|ee|ye)$"))
    return F.when(w == "", 0).otherwise(F.greatest(F.lit(1), n - F.when(silent, 1).otherwise(0))).cast("int")


def slug(heading: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(heading), r"[^a-z0-9\s-]", ""), r"[\s-]+", "-")


def html_escape(text: Column) -> Column:
    out = text
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out
