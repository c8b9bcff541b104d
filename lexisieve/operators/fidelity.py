"""What a rewrite lost: numbers, units, identifiers and cue words of its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mask import strip_front_matter
from ..functions.text import let, unicode_words

# One table of units serves twice: the pattern of a number and the one name of a unit.
# ---- Fixed values: units and their names, number words, identifier shapes, cue words.
UNIT_NAMES = {
    "ms": "ms",
    "second": "s sec secs second seconds",
    "minute": "m min mins minute minutes",
    "hour": "h hr hrs hour hours",
    "day": "day days",
    "week": "week weeks",
    "month": "month months",
    "year": "year years",
    "byte": "b byte bytes",
    "kb": "kb kib",
    "mb": "mb mib",
    "gb": "gb gib",
    "percent": "% percent",
    "times": "x times attempt attempts retry retries",
    "request": "request requests",
    "row": "row rows",
    "item": "item items",
}
OTHER_UNITS = (
    "tb char chars character characters node nodes pod pods replica replicas thread threads connection connections"
).split()
NUMBER_WORDS = "one two three four five six seven eight nine ten".split()
SPAN_IDENTIFIER = r":[a-zA-Z](?U)[\w-]*:`([^`]+)`|(?<!`)``([^`]+)``(?!`)|(?<!`)`([^`\n]+)`(?!`)"
BARE_IDENTIFIER = (
    r"(?U)(?<![\w`])((?:--?[a-zA-Z][\w-]*)|(?:[\w./-]+\.(?:py|js|ts|go|rs|java|rb|yaml|yml|json|toml|md|sh|sql))"
    r"|(?:[A-Z][A-Z0-9_]{2,}))(?![\w`])"
)
CUES = {
    "negation": "not|never|no|none|cannot|must not|do not|does not|will not|without",
    "obligation": "must|required|shall|mandatory|always|never",
    "suggestion": "should|may|might|can|could|consider|optionally",
    "condition": "if|unless|when|whenever|before|after|until|while|once",
    "universal": "every|all|each|any|always|entire|whole",
    "partial": "some|several|many|most|few|often|usually|sometimes",
}
# ---- End of fixed values.

_UNITS = sorted({u for names in UNIT_NAMES.values() for u in names.split()} | set(OTHER_UNITS), key=lambda u: (-len(u), u))
_UNIT = "|".join(_UNITS)
# A lookahead for the first letter or digit comes before the slower boundary.
NUMBER = rf"(?iU)(?=\d)(?<![\w.])(\d+(?:[.,]\d+)*)\s*({_UNIT})?(?![\w])"
NUMBER_WORD = rf"(?iU)(?=[{''.join(sorted({w[0] for w in NUMBER_WORDS}))}])\b({'|'.join(NUMBER_WORDS)})\s*({_UNIT})?(?![\w])"
# All words of all cues; where a cue has several words ("must not"), one of them is a cue by itself.
CUE_WORDS = sorted({w for words in CUES.values() for w in words.split("|") if " " not in w})
ANY_CUE = rf"(?iU)(?=[{''.join(sorted({w[0] for w in CUE_WORDS}))}])\b(?:{'|'.join(CUE_WORDS)})\b"
PAIR = "array<struct<value:string,unit:string>>"


def canonical_unit(unit: Column) -> Column:
    """One name for all spellings of a unit; an unknown one stays."""
    u = F.lower(F.coalesce(unit, F.lit("")))
    table = F.create_map(*[F.lit(x) for name, names in UNIT_NAMES.items() for s in names.split() for x in (s, name)])
    return F.coalesce(F.try_element_at(table, u), u)


def numbers(text: Column) -> Column:
    """Numbers with canonical units, digits first, then the words one to ten: array of (value, unit).

    The text is searched once for each pattern; value and unit are cut from the few matches.
    """
    def pairs(pattern: str, head: str, value) -> Column:
        return F.transform(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            lambda m: F.struct(value(F.regexp_extract(m, head, 1)).alias("value"), canonical_unit(F.regexp_extract(m, head, 2)).alias("unit")),
        )

    word_values = F.array(*[F.lit(w) for w in NUMBER_WORDS])
    return F.concat(
        pairs(NUMBER, r"(?sU)^([\d.,]+)\s*(.*)$", lambda v: F.replace(v, F.lit(","), F.lit(""))).cast(PAIR),
        pairs(NUMBER_WORD, rf"(?siU)^({'|'.join(NUMBER_WORDS)})\s*(.*)$", lambda v: F.array_position(word_values, F.lower(v)).cast("string")).cast(PAIR),
    )


def identifiers(text: Column) -> Column:
    """Distinct identifiers: code spans of three kinds, flags, file names, upper-case names."""
    spans = F.concat(*[F.regexp_extract_all(text, F.lit(SPAN_IDENTIFIER), F.lit(g)) for g in (1, 2, 3)])
    spans = F.when(F.contains(text, F.lit("`")), spans).otherwise(F.array().cast("array<string>"))
    bare = F.regexp_extract_all(text, F.lit(BARE_IDENTIFIER), F.lit(1))
    trimmed = F.transform(F.concat(spans, bare), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda x: x != "")))


def one_space(identifier: Column) -> Column:
    return F.regexp_replace(identifier, r"\s+", " ")


def cue_count(text: Column, cue: str) -> Column:
    return F.regexp_count(text, F.lit(rf"(?iU)\b(?:{CUES[cue]})\b")).cast("int")


def cue_hits(text: Column) -> Column:
    """The cue words of a text in lower case, found in one search for all cues."""
    # the search takes four more letters for i, s and k in any case
    return F.transform(F.regexp_extract_all(text, F.lit(ANY_CUE), F.lit(0)), lambda w: F.lower(F.translate(w, "\u0130\u0131\u017f\u212a", "iisk")))


def hits_of(cue: str, hits: Column) -> Column:
    """As cue_count, from the cue words of the text."""
    return F.size(F.filter(hits, lambda w: w.isin(*[c for c in CUES[cue].split("|") if " " not in c])))


def shown(value: Column, unit: Column) -> Column:
    plural = F.concat(value, F.lit(" "), unit, F.when(value.isin("1", "1.0"), F.lit("")).otherwise(F.lit("s")))
    return F.when(unit == "", value).when(unit.isin("percent", "ms", "kb", "mb", "gb", "times"), F.concat(value, F.lit(" "), unit)).otherwise(plural)


def _how_many(pairs: Column, x: Column) -> Column:
    return F.size(F.filter(pairs, lambda y: (y["value"] == x["value"]) & (y["unit"] == x["unit"])))


def lost_numbers(source: Column, rewrite: Column) -> Column:
    """Distinct source numbers the rewrite has fewer of: array of (kind, value, unit, instead)."""
    def each(s: Column) -> Column:
        def against(r: Column) -> Column:
            fewer = F.filter(F.array_distinct(s), lambda x: _how_many(r, x) < _how_many(s, x))

            def told(x: Column) -> Column:
                other_unit = F.get(F.filter(r, lambda y: (y["value"] == x["value"]) & (y["unit"] != x["unit"])), F.lit(0))
                other_value = F.get(F.filter(r, lambda y: (y["unit"] == x["unit"]) & (y["value"] != x["value"])), F.lit(0))
                return F.struct(
                    F.when(other_unit.isNotNull(), F.lit("unit")).otherwise(F.lit("number")).alias("kind"),
                    x["value"].alias("value"), x["unit"].alias("unit"),
                    F.when(other_unit.isNotNull(), shown(x["value"], other_unit["unit"]))
                    .when(other_value.isNotNull(), shown(other_value["value"], x["unit"])).alias("instead"),
                )

            return F.transform(fewer, told)

        return let(numbers(rewrite), against)

    return let(numbers(source), each)


def lost_identifiers(source: Column, rewrite: Column) -> Column:
    def against(r: Column) -> Column:
        return F.filter(identifiers(source), lambda x: ~F.array_contains(r, one_space(x)))

    return let(F.transform(identifiers(rewrite), one_space), against)


def compare(pairs: DataFrame, id_col: str = "pair_id", source_col: str = "source", rewrite_col: str = "rewrite", keep: list[str] | None = None) -> DataFrame:
    """One row per pair: words of both, findings, critical, warnings, faithful. Narrow: no shuffle."""
    s, r = F.col("_s"), F.col("_r")
    kept = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep or [])]
    names = [f"_k{i}" for i in range(len(kept))]
    base = pairs.select(id_col, *kept, strip_front_matter(F.col(source_col)).alias("_s"), strip_front_matter(F.col(rewrite_col)).alias("_r"))
    searched = base.select(
        id_col, *names, "_s", "_r", cue_hits(s).alias("_cs"), cue_hits(r).alias("_cr"), lost_numbers(s, r).alias("_n"), lost_identifiers(s, r).alias("_i")
    )
    counted = searched.select(
        id_col, *names, "_s", "_r", *[hits_of(c, F.col("_cs")).alias(f"s_{c}") for c in CUES], *[hits_of(c, F.col("_cr")).alias(f"r_{c}") for c in CUES], "_n", "_i"
    )

    def fell(c: str) -> Column:
        return F.col(f"r_{c}") < F.col(f"s_{c}")

    def rose(c: str) -> Column:
        return F.col(f"r_{c}") > F.col(f"s_{c}")

    def finding(kind: Column | str, severity: str, message: Column) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.lit(severity).alias("severity"), message.alias("message"))

    def moved(c: str) -> Column:
        return F.format_string(f"{c}: %d in the source, %d in the rewrite", F.col(f"s_{c}"), F.col(f"r_{c}"))

    cues = F.array_compact(
        F.array(
            F.when(fell("negation"), finding("negation", "critical", moved("negation"))),
            F.when(fell("obligation") & rose("suggestion"), finding("modal", "critical", moved("obligation"))),
            F.when(fell("condition"), finding("condition", "warning", moved("condition"))),
            F.when(fell("universal") & rose("partial"), finding("scope", "critical", moved("universal"))),
        )
    )
    found = F.concat(
        F.transform("_n", lambda x: finding(x["kind"], "critical", F.concat(shown(x["value"], x["unit"]), F.lit(" is missing"), F.coalesce(F.concat(F.lit("; the rewrite has "), x["instead"]), F.lit(""))))),
        F.transform("_i", lambda x: finding("identifier", "critical", F.concat(x, F.lit(" is missing")))),
        cues,
    )
    done = counted.select(id_col, *names, unicode_words(s).alias("source_words"), unicode_words(r).alias("rewrite_words"), found.alias("findings"))
    critical = F.size(F.filter("findings", lambda x: x["severity"] == "critical"))
    return done.select(
        id_col, *[F.col(n).alias(c) for n, c in zip(names, keep or [])], "source_words", "rewrite_words", "findings", critical.alias("critical"),
        (F.size("findings") - critical).alias("warnings"), (critical == 0).alias("faithful"),
    )


def gate_fix(drafts: DataFrame, id_col: str, draft_col: str, fixed_col: str) -> DataFrame:
    """The fix where it lost nothing against the draft, else the draft; and whether it was taken."""
    others = [c for c in drafts.columns if c != id_col]
    return compare(drafts, id_col, draft_col, fixed_col, keep=others).select(
        *drafts.columns, F.when(F.col("critical") > 0, F.col(draft_col)).otherwise(F.col(fixed_col)).alias("gated"), (F.col("critical") == 0).alias("fix_taken")
    )
