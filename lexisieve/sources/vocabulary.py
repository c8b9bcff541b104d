"""Dimension tables: the vocabulary and the rules, from files or from a small set of our own."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rule, severity, weight, whether a judge must confirm it.
RULES = [
    ("K1", "MUST", 0.5, False), ("K2", "MUST", 0.5, False), ("S4", "MUST", 0.8, False),
    ("L1", "MUST", 0.5, False), ("L2", "MUST", 0.5, False), ("L5", "MUST", 0.5, False),
    ("V3", "MUST", 0.3, False), ("V7", "MUST", 0.3, False), ("V8", "MUST", 0.3, False),
    ("V9", "MUST", 0.3, False), ("V10", "MUST", 0.5, False), ("G1", "MUST", 0.5, False),
    ("G4", "MUST", 0.5, False), ("G5", "MUST", 0.5, False), ("G6", "MUST", 0.5, False),
    ("G7", "MUST", 0.5, True), ("G8", "MUST", 0.5, False), ("G10", "SHOULD", 0.1, False),
    ("G11", "MUST", 0.5, True), ("G12", "MUST", 0.5, True), ("N1", "MUST", 0.5, False),
    ("N2", "MUST", 0.5, False), ("N3", "MUST", 0.5, False), ("N5", "MUST", 0.5, True),
    ("D2", "MUST", 0.5, False), ("D7", "MUST", 0.5, False), ("P1", "MUST", 0.5, False),
    ("X1", "MUST", 0.1, False), ("X5", "SHOULD", 0.1, False),
]


@dataclass(frozen=True)
class Vocabulary:
    """Phrases by kind; a map value of None means: delete the phrase."""

    instead_of: dict[str, str | None] = field(default_factory=dict)
    phrasal: dict[str, str] = field(default_factory=dict)
    latin: dict[str, str] = field(default_factory=dict)
    british: dict[str, str] = field(default_factory=dict)
    marketing: frozenset[str] = frozenset()
    hedges: frozenset[str] = frozenset()
    frames: frozenset[str] = frozenset()
    term_verbs: frozenset[str] = frozenset()
    term_nouns: frozenset[str] = frozenset()
    approved: frozenset[str] = frozenset()

    def rows(self) -> list[tuple[str, str, str | None, int]]:
        out: list[tuple[str, str, str | None, int]] = []
        for kind in ("instead_of", "phrasal", "latin", "british"):
            out += [(kind, p, r, i) for i, (p, r) in enumerate(getattr(self, kind).items())]
        for kind in ("marketing", "hedges", "frames", "term_verbs", "term_nouns", "approved"):
            out += [(kind, p, None, i) for i, p in enumerate(sorted(getattr(self, kind)))]
        return out


#: A small vocabulary of our own; load_vocabulary reads a full one.
OWN = Vocabulary(
    instead_of={
        "terminate": "stop", "initiate": "start", "in order to": "to", "order": None, "leverage": "use",
        "prior to": "before", "basically": None, "a number of": "several", "number": "count", "flag": "warn",
        "seamless": "smooth",
    },
    phrasal={"spin up": "start", "figure out": "find", "fall over": "fail"},
    latin={"e.g.": "for example", "i.e.": "that is", "etc.": "and so on", "vs": "against"},
    british={"colour": "color", "behaviour": "behavior", "optimise": "optimize"},
    marketing=frozenset({"robust", "seamless", "blazing", "powerful"}),
    hedges=frozenset({"perhaps", "likely", "somewhat likely", "it seems", "arguably"}),
    frames=frozenset({"in conclusion", "of course", "great question", "i hope this helps"}),
    term_verbs=frozenset({"merge", "deploy", "commit"}),
    term_nouns=frozenset({"flag", "queue", "container"}),
    approved=frozenset({"start", "stop", "use", "to", "before", "find", "fail", "several", "count", "warn"}),
)


def vocabulary_table(spark: SparkSession, vocabulary: Vocabulary = OWN) -> DataFrame:
    return spark.createDataFrame(vocabulary.rows(), "kind string, phrase string, replacement string, load_order int")


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule string, severity string, weight double, arbitrated boolean")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file in order. A dimension file is small: one task, one row a line."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split("value", "\n")).alias("n", "line"))


@dataclass(frozen=True)
class Entry:
    """A value of a word list: line, section, entry of the section (0 before the first), field, value, whether a list item."""

    n: int
    section: str
    entry: int
    field: str
    value: str
    item: bool


_KEY = re.compile(r"""("[^"]*"|'[^']*'|[^\s"'\[{#-][^\[{]*?|-[^\s].*?):(?:\s+(.*))?$""")
_COMMENT = re.compile(r"""(?:[^#"']|"[^"]*"?|'[^']*'?|(?<=\S)#)*""")


def _bare(value: str) -> str:
    value = value.strip()
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


def _listed(flow: str) -> list[str]:
    """The items of [a, b, "c, d"]; what stands behind the bracket does not count."""
    inner = flow.strip()[1:].split("]", 1)[0]
    return [x for x in (_bare(m) for m in re.findall(r"""\s*("[^"]*"|'[^']*'|[^,]+)""", inner)) if x]


def read_entries(text: str) -> list[Entry]:
    """All values of a word list: a subset of YAML, of sections that hold lists, maps or entries of fields.

    A section is a key without indentation. A dash before a key starts an entry; a dash before
    anything else is an item of the field above it, or of the section. Values are plain, quoted,
    flow lists (over several lines too) or block scalars, whose lines are joined by blanks. A # is a
    comment where it starts a line or follows a blank, outside quotes.
    """
    out: list[Entry] = []
    section, entry, field, depth = "", 0, "", 0
    flow: list[str] | None = None
    block: list[str] | None = None

    def put(n: int, value: str, item: bool = False) -> None:
        out.append(Entry(n, section, entry, field, value, item))

    for n, raw in enumerate(text.split("\n")):
        line = _COMMENT.match(raw.rstrip("\r")).group(0).rstrip()
        bare, indent = line.strip(), len(line) - len(line.lstrip())
        if block is not None:
            if not raw.strip() or len(raw) - len(raw.lstrip()) > depth:
                block.append(raw.strip())
                continue
            put(n, " ".join(x for x in block if x))
            block = None
        if not bare:
            continue
        if flow is not None:
            flow.append(bare)
            if "]" in bare:
                for x in _listed(" ".join(flow)):
                    put(n, x, True)
                flow = None
            continue
        opens = bare.startswith("- ")
        body = bare[2:].lstrip() if opens else bare
        key = _KEY.match(body)
        if opens and not key:
            for x in _listed(body) if body.startswith("[") else [_bare(body)]:
                put(n, x, True)
            continue
        if not key:
            continue
        name, value = _bare(key.group(1)), (key.group(2) or "").strip()
        if indent == 0 and not opens:
            section, entry, field = name, 0, ""
            if not value:
                continue
        else:
            entry += opens
            field = name
        if not value:
            continue
        if value[0] in ">|":
            block, depth = [], indent + len(bare) - len(body)
        elif value.startswith("[") and "]" not in value:
            flow = [value]
        elif value.startswith("["):
            for x in _listed(value):
                put(n, x, True)
        else:
            put(n, _bare(value))
    if block is not None:
        put(len(text.split("\n")), " ".join(x for x in block if x))
    return out


def _text_of(spark: SparkSession, path: str) -> str:
    """A dimension file as one text, through Spark's readers."""
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def entry_table(spark: SparkSession, path: str) -> DataFrame:
    """Fields of the entries of a word list in order: (place, n, section, entry, field, value, is_item); n is the line."""
    rows = [(k, e.n, e.section, e.entry, e.field, e.value, e.item) for k, e in enumerate(read_entries(_text_of(spark, path)))]
    return spark.createDataFrame(rows, "place int, n int, section string, entry int, field string, value string, is_item boolean")


def word_entries(spark: SparkSession, path: str) -> DataFrame:
    """(n, word, field, values): all fields of the approved words in order; words that are null are no entries."""
    rows = entry_table(spark, path).where("section = 'words'")
    heads = rows.where("field = 'word' and not is_item and value <> 'null'").select("entry", F.col("value").alias("word"))
    fields = rows.where("field <> 'word'").groupBy("entry", "field").agg(
        F.min("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("values")
    )
    return fields.join(heads, "entry").select("n", "word", "field", "values")


def load_vocabulary(spark: SparkSession, words_path: str, terms_path: str | None = None) -> Vocabulary:
    """A vocabulary from a word list (and a term list); dimension tables, so the driver may hold them.

    A later entry wins where a phrase is given twice; a phrase that is itself approved is no route.
    """
    rows = read_entries(_text_of(spark, words_path))
    heads = {e.entry: e.value.lower() for e in rows if e.section == "words" and e.field == "word" and not e.item}
    routes: dict[str, str | None] = {}
    for e in rows:
        if e.section == "words" and e.field == "instead_of" and e.entry in heads:
            word = heads[e.entry]
            routes[e.value.lower()] = None if word == "null" else word
    approved = frozenset(w for w in heads.values() if w != "null")

    def mapped(part: str) -> dict[str, str]:
        return {e.field.lower(): e.value for e in rows if part in e.section and e.field and not e.item}

    def listed(part: str) -> frozenset[str]:
        return frozenset(e.value.lower() for e in rows if part in e.section and e.item)

    terms = read_entries(_text_of(spark, terms_path)) if terms_path else []
    return Vocabulary(
        instead_of={p: w for p, w in routes.items() if p not in approved}, approved=approved,
        phrasal=mapped("phrasal"), latin=mapped("latin"), british=mapped("british"),
        marketing=listed("marketing"), hedges=listed("hedges"), frames=listed("frames"),
        term_nouns=frozenset(e.value.lower() for e in terms if e.section == "common_nouns" and e.item),
        term_verbs=frozenset(e.value.lower() for e in terms if e.field == "verbs"),
    )


def term_words(vocabulary: Vocabulary) -> frozenset[str]:
    """The single words of all terms, for lookups of words."""
    return frozenset(w for t in vocabulary.term_nouns | vocabulary.term_verbs for w in re.findall(r"[a-z][a-z'-]*", t))


def load_weights(spark: SparkSession, path: str) -> DataFrame:
    """rule, weight: without blank rules and rules that have none."""
    raw = spark.read.option("header", True).csv(path)
    rule, weight = raw.columns[0], next(c for c in raw.columns if "weight" in c.lower())
    return raw.select(F.trim(rule).alias("rule"), F.expr(f"try_cast(`{weight}` as double)").alias("weight")).where(
        (F.col("rule") != "") & F.col("weight").isNotNull()
    )


def load_core_words(spark: SparkSession, path: str) -> DataFrame:
    word = F.lower(F.trim(F.split(F.col("value"), "#", 2)[0]))
    return spark.read.text(path).select(word.alias("word")).where("word <> ''").distinct()
