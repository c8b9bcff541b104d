"""Sentences, paragraphs and lists of masked prose, as arrays with offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .mask import LIST_ITEM
from .text import let

# Lines that stand alone, and where a sentence ends.
HEADING = r"^\s{0,3}#{1,6}\s"
TABLE_ROW = r"^\s*\|"
SENTENCE_END = r"(?<=[.!?:])\s+"
COMPLETE = r"(?iU)\b(complete|exhaustive|every|all)\b"
COMPLETE_WINDOW = 200


def _stands_alone(line: Column) -> Column:
    return (
        (F.trim(F.regexp_replace(line, r"\s+", " ")) == "")
        | F.rlike(line, F.lit(HEADING)) | F.rlike(line, F.lit(TABLE_ROW)) | F.rlike(line, F.lit(LIST_ITEM))
    )


def _running(lengths: Column) -> Column:
    """Sums before each length, and the total last."""
    start = F.array(F.lit(0))
    return F.aggregate(lengths, start, lambda out, n: F.array_append(out, F.element_at(out, -1) + n))


def starts_of(pieces: Column, gap: int = 0) -> Column:
    """Offsets of consecutive pieces that are gap characters apart.

    Appending copies an array at each step, so many pieces are summed in blocks of a few first.
    """
    def placed(lengths: Column) -> Column:
        n = F.size(lengths)
        width = F.ceil(F.sqrt(n.cast("double"))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1), lambda b: _running(F.slice(lengths, b * width + 1, width)))

        def joined(parts: Column) -> Column:
            firsts = _running(F.transform(parts, lambda p: F.element_at(p, -1)))
            return let(firsts, lambda at: F.flatten(F.transform(parts, lambda p, b: F.transform(F.slice(p, 1, F.size(p) - 1), lambda x: x + F.get(at, b)))))

        short = let(_running(lengths), lambda r: F.slice(r, 1, n))
        return F.when(n < 64, short).otherwise(let(blocks, joined))

    return let(F.transform(pieces, lambda p: F.length(p) + gap), placed)


def logical_lines(text: Column) -> Column:
    """Lines with wrapped prose joined: array of (line, start). Joins are one space wide."""
    def built(lines: Column) -> Column:
        def with_flags(alone: Column) -> Column:
            n = F.size(lines)
            order = F.sequence(F.lit(0), n - 1)
            heads = F.filter(order, lambda i: (i == 0) | F.get(alone, i) | F.get(alone, i - 1))

            def grouped(starts: Column) -> Column:
                return F.transform(
                    heads,
                    lambda h, k: let(
                        F.slice(lines, h + 1, F.coalesce(F.get(heads, k + 1), n) - h),
                        lambda part: F.struct(
                            F.when(
                                F.size(part) > 1,
                                F.array_join(
                                    F.transform(
                                        part,
                                        lambda x, j: F.when(j == 0, F.regexp_replace(x, r"\s+$", "")).otherwise(
                                            F.regexp_replace(x, r"^\s+|\s+$", "")
                                        ),
                                    ),
                                    " ",
                                ),
                            ).otherwise(part[0]).alias("line"),
                            F.get(starts, h).alias("start"),
                        ),
                    ),
                )

            return let(starts_of(lines, 1), grouped)

        return let(F.transform(lines, _stands_alone), with_flags)

    return let(F.split(text, "\n", -1), built)


def sentences(masked: Column) -> Column:
    """Array of (text, in_list, offset): a colon ends a sentence, a list marker is no part of one.

    Offsets are true ones, of the first character; inside a joined line they follow its joins.
    """
    def of_line(x: Column) -> Column:
        skip = (F.trim(x["line"]) == "") | F.rlike(x["line"], F.lit(HEADING)) | F.rlike(x["line"], F.lit(TABLE_ROW))

        def cut(y: Column) -> Column:
            # y holds what is the same for all sentences of the line, worked out once
            def placed(z: Column) -> Column:
                whole = F.zip_with(z["parts"], z["gaps"], lambda p, g: F.concat(p, F.coalesce(g, F.lit(""))))
                return let(
                    starts_of(whole),
                    lambda at: F.filter(
                        F.transform(
                            z["parts"],
                            lambda p, i: F.struct(
                                F.trim(p).alias("text"), y["in_list"].alias("in_list"),
                                (y["start"] + F.get(at, i) + F.length(p) - F.length(F.ltrim(p))).cast("int").alias("offset"),
                            ),
                        ),
                        lambda s: s["text"] != "",
                    ),
                )

            return let(
                F.struct(
                    F.split(y["body"], F.lit(SENTENCE_END), -1).alias("parts"),
                    F.regexp_extract_all(y["body"], F.lit(SENTENCE_END), F.lit(0)).alias("gaps"),
                ),
                placed,
            )

        body = F.regexp_replace(F.regexp_replace(x["line"], LIST_ITEM, ""), r"[\t\x0B\f\r]", " ")
        fixed = let(
            body,
            lambda b: F.struct(
                b.alias("body"), (F.length(b) < F.length(x["line"])).alias("in_list"), (x["start"] + F.length(x["line"]) - F.length(b)).alias("start")
            ),
        )
        none = F.array().cast("array<struct<text:string,in_list:boolean,offset:int>>")
        return F.when(skip, none).otherwise(let(fixed, cut))

    return F.flatten(F.transform(logical_lines(masked), of_line))


def plain_sentences(text: Column) -> Column:
    """Sentences without offsets, for counting only: no positions are carried."""
    blocks = F.regexp_replace(text, r"\n(?=[ \t]*\n)|\n(?=[ \t]*(?:[-*+]|\d+[.)])\s)", "\u0001")
    joined = F.regexp_replace(blocks, r"\s*\n\s*", " ")
    parts = F.split(joined, r"(?<=[.!?:])\s+|\s*\x01\s*")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, LIST_ITEM, "")), lambda p: F.trim(p) != "")


def paragraphs(masked: Column) -> Column:
    """Array of (text, offset): runs of lines that are not blank."""
    def cut(parts: Column) -> Column:
        gaps = F.regexp_extract_all(masked, F.lit(r"\n(?:[ \t]*\n)+"), F.lit(0))
        whole = F.zip_with(parts, gaps, lambda p, g: F.concat(p, F.coalesce(g, F.lit(""))))
        return let(
            starts_of(whole),
            lambda at: F.filter(
                F.transform(parts, lambda p, i: F.struct(p.alias("text"), F.get(at, i).alias("offset"))),
                lambda x: F.trim(F.regexp_replace(x["text"], r"\s+", " ")) != "",
            ),
        )

    return let(F.split(masked, F.lit(r"\n(?:[ \t]*\n)+"), -1), cut)


_LIST = "array<struct<items:int,head:string,offset:int>>"


def lists(masked: Column) -> Column:
    """Array of (items, head, offset): runs of top-level items; nested lines keep a run open."""
    def step(state: Column, line: Column) -> Column:
        item = F.rlike(line, F.lit(LIST_ITEM))
        top = item & ~F.rlike(line, F.lit(r"^\s"))
        closes = ~item
        run = F.when(top, state["run"] + 1).when(closes, F.lit(0)).otherwise(state["run"])
        opens = top & (state["run"] == 0)
        done = closes & (state["run"] > 0)
        ended = F.array(F.struct(state["run"].alias("items"), state["head"].alias("head"), state["at"].alias("offset")))
        return F.struct(
            run.cast("int").alias("run"),
            F.when(opens, F.regexp_replace(line, r"^\s+|\s+$", "")).otherwise(state["head"]).alias("head"),
            F.when(opens, state["pos"]).otherwise(state["at"]).cast("int").alias("at"),
            (state["pos"] + F.length(line) + 1).cast("int").alias("pos"),
            F.when(done, F.concat(state["out"], ended)).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(
        F.lit(0).alias("run"), F.lit("").alias("head"), F.lit(0).alias("at"), F.lit(0).alias("pos"),
        F.array().cast(_LIST).alias("out"),
    )
    lines = F.concat(F.split(masked, "\n", -1), F.array(F.lit("")))
    found = F.aggregate(lines, start, step, lambda s: s["out"])
    return F.when(F.rlike(masked, F.lit(r"(?md)^([-*+]|\d+[.)])\s")), found).otherwise(F.array().cast(_LIST))
