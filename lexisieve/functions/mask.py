"""Masks that hide what is not prose and keep every character position."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# The constructs that are not prose.
FRONT_MATTER = r"(?s)\A---\n.*?\n---\n"
FENCE = r"(?s)```.*?```"
BLOCK_QUOTE = r"(?md)^\s*>.*$"
URL = r"https?://\S+"
INLINE_CODE = r"`[^`\n]+`"
LIST_ITEM = r"^\s*([-*+]|\d+[.)])\s+"
QUOTED = r"[\"“]([^\"”]{3,}?)[\"”]"
NEGATED = r"(?iU)(?:\bnot\b|\bnever\b|\binstead of\b)(?:\s+\w+){0,2}[\s,:]*$"
#: A line that holds this is left out; the marker is a setting.
IGNORE_LINE = r"lint:\s*ignore"


def blank(span: Column) -> Column:
    """Spaces for every character but newlines."""
    return F.regexp_replace(span, r"[^\n]", " ")


def blank_with(span: Column, keep: str) -> Column:
    """As blank, with a marker word where the span has room for it."""
    marked = F.concat(F.lit(" " + keep), F.substring(blank(span), F.lit(len(keep) + 2), F.length(span)))
    return F.when(F.length(span) >= len(keep) + 2, marked).otherwise(blank(span))


def mask(text: Column, pattern: str, keep: str = "") -> Column:
    """All matches of a pattern blanked; the length stays."""
    def joined(hits: Column) -> Column:
        parts = F.split(text, F.lit(pattern), -1)
        pieces = F.zip_with(
            parts, hits, lambda p, m: F.concat(p, F.coalesce(blank_with(m, keep) if keep else blank(m), F.lit("")))
        )
        return F.array_join(pieces, "")

    return F.when(F.rlike(text, F.lit(pattern)), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), joined)).otherwise(text)


def mask_indented(text: Column) -> Column:
    """Blocks indented by four or more are code, unless a list is open."""
    def step(state: Column, line: Column) -> Column:
        bare = F.regexp_replace(line, r"^\s+", "")
        empty = F.trim(bare) == ""
        indent = F.length(line) - F.length(bare)
        in_list = F.when(empty | (indent >= 4), state["in_list"]).otherwise(F.rlike(line, F.lit(LIST_ITEM)))
        code = ~empty & (indent >= 4) & ~state["in_list"]
        return F.struct(
            in_list.alias("in_list"), F.array_append(state["out"], F.when(code, blank(line)).otherwise(line)).alias("out")
        )

    start = F.struct(F.lit(False).alias("in_list"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(F.split(text, "\n", -1), start, step, lambda s: F.array_join(s["out"], "\n"))
    return F.when(F.rlike(text, F.lit(r"(?md)^\s{4}")), done).otherwise(text)


def mask_ignored(text: Column, marker: str = IGNORE_LINE) -> Column:
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.when(F.rlike(x, F.lit(marker)), blank(x)).otherwise(x))
    return F.when(F.rlike(text, F.lit(marker)), F.array_join(lines, "\n")).otherwise(text)


def mask_negated_quotes(text: Column) -> Column:
    """A quotation that 'not', 'never' or 'instead of' leads to is a counter-example."""
    def joined(hits: Column) -> Column:
        parts = F.split(text, F.lit(QUOTED), -1)
        pieces = F.transform(
            parts,
            lambda p, i: F.concat(
                p,
                F.coalesce(
                    F.when(
                        # what stands before: the piece, and the quotation before it where the piece is short
                        F.rlike(F.concat(F.coalesce(F.get(hits, i - 1), F.lit("")), p), F.lit(NEGATED)),
                        blank_with(F.get(hits, i), "EXAMPLE"),
                    ).otherwise(F.get(hits, i)),
                    F.lit(""),
                ),
            ),
        )
        return F.array_join(pieces, "")

    return F.when(F.rlike(text, F.lit(QUOTED)), let(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(0)), joined)).otherwise(text)


def prose(text: Column, keep_quotes: bool = False, ignore_marker: str = IGNORE_LINE) -> Column:
    """The text with everything that is not prose masked, in the normative order."""
    steps = [
        lambda t: mask(t, FRONT_MATTER),
        lambda t: mask(t, FENCE),
        mask_indented,
        *([] if keep_quotes else [lambda t: mask(t, BLOCK_QUOTE)]),
        lambda t: mask(t, URL, "URL"),
        lambda t: mask(t, INLINE_CODE, "CODE"),
        lambda t: mask_ignored(t, ignore_marker),
        mask_negated_quotes,
    ]

    def chain(value: Column, rest: list) -> Column:
        return let(value, lambda v: chain(rest[0](v), rest[1:]) if rest else v)

    return chain(F.coalesce(text, F.lit("")), steps)


def without_markers(masked: Column) -> Column:
    return F.regexp_replace(masked, r"\b(?:CODE|URL|EXAMPLE)\b", " ")


def strip_front_matter(text: Column) -> Column:
    """Front matter cut off; a lone opening line is left alone."""
    end = F.locate("\n---", text, 4)
    return F.when(
        F.startswith(text, F.lit("---")) & (end > 0),
        F.regexp_replace(F.substring(text, end + 4, F.length(text)), r"^\n+", ""),
    ).otherwise(text)
