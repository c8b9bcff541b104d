"""The mechanical rules: one narrow pass of column expressions over sentences and blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.segment import COMPLETE, COMPLETE_WINDOW, HEADING, TABLE_ROW, plain_sentences
from ..functions.text import any_of, first_match, let, letter_bounded, matches, word_count
from ..functions.mask import LIST_ITEM
from ..sources.vocabulary import Vocabulary

FINDING = "array<struct<rule:string,message:string,at:int>>"

# ---- Fixed values: word lists, tables and patterns of the rules.
IMPERATIVES = (
    "run|add|remove|check|make|set|open|close|start|stop|use|write|read|install|"
    "delete|copy|move|create|call|send|update|change|replace|do|go|see|note|click|"
    "select|enter|press|type|save|find|test|build|deploy|merge|commit|push|pull"
)
PARTICIPLES = (
    "done|made|sent|read|built|kept|held|set|put|run|written|shown|given|taken|"
    "found|got|gotten|seen|known|thrown|drawn|left|lost|meant|paid|said|told"
)
BE = "(?:am|is|are|was|were|be|been|being)"
STATE_WORDS = (
    "running missing pending outstanding existing remaining following leading trailing matching "
    "corresponding resulting interesting surprising confusing misleading willing boring"
).split()
NOT_NOMINAL = (
    "sentence sequence substance association instance reference difference evidence experience audience "
    "presence absence consequence importance distance balance chance science convenience confidence "
    "influence maintenance performance appliance compliance relevance occurrence preference moment element "
    "document argument comment component environment equipment department instrument increment segment "
    "fragment statement agreement requirement assessment question portion section fraction position "
    "condition version option function action connection collection direction solution relation proportion "
    "station nation"
).split()
ADJECTIVES = {
    "opinion": "useful correct safe unsafe wrong valid invalid",
    "size": "large small short tiny huge wide narrow",
    "age": "new old current legacy previous recent original",
    "shape": "round flat square",
    "colour": "red green blue black white grey gray yellow",
    "origin": "remote local upstream downstream external internal",
    "material": "binary digital physical virtual plastic metal wooden",
    "purpose": "backup debug test staging production temporary",
}
NOUN_RUN_BREAKS = {
    "determiners": "the a an this that these those its their his her our your my each every any some all no both",
    "prepositions and conjunctions": "of to for with in on at by from as into over under before after and or but than "
    "when if so because while not only then also during between through until within without against across about "
    "above below since upon per via",
    "relatives": "which who whom whose where",
    "auxiliaries": "is are was were be been being am has have had do does did can cannot may must will would should "
    "could might shall",
    "verbs": "use uses used make makes made set sets run runs ran state states stated write writes wrote written give "
    "gives gave given keep keeps kept put puts check checks checked read reads start starts started stop stops stopped "
    "show shows shown showed add adds added remove removes removed change changes changed measure measures measured "
    "report reports reported apply applies applied carry carries carried create creates created exist exists existed "
    "fail fails failed return returns returned come comes came go goes went gone take takes took taken know knows knew "
    "known",
}
CONTRACTION = r"(?iU)(?:\b\w+['’](?:t|re|ve|ll|m)\b)|(?:\bit['’]s\b)|(?:\blet['’]s\b)"
OPENER = r"(?iU)(?:^|[(\[,;]\s*(?:and |or |then )?)(you should|you must|please|it is necessary to)\b"
PASSIVE = rf"(?iU)\b{BE}\s+(?:\w+ed|{PARTICIPLES})\b"
PERFECT = rf"(?iU)\b(?:have|has|had)\s+(?:been\s+)?(?:\w+ed|{PARTICIPLES})\b"
STACKED = r"(?iU)\b(?:would|could|should|might|may|must|will|can)\s+(?:have|be)\s+(?:been|being)\b"
ING_VERB = rf"(?iU)\b{BE}\s+(\w+ing)\b"
LIGHT_VERB = (
    r"(?iU)\b(?:perform(?:s|ed)?|conduct(?:s|ed)?|carr(?:y|ies|ied)\s+out|make[s]?\s+use\s+of|provide[s]?)"
    r"\s+(?:a|an|the)?\s*\w+(?:tion|ment|ance|ence|sis|ing)\b"
)
NOMINAL_OF = r"(?iU)\b(\w{4,}(?:tion|ment|ance|ence))\s+of\b"
# A word is taken only where one more can follow: nothing is given back, so the loop needs no stack.
NOUN_RUN = r"(?U)\b(?:the|a|an)\s+((?:[a-z][a-z\-]*+\s++(?=[a-z][a-z\-]*\b)){2,}+[a-z][a-z\-]*)\b"
INTERIOR_PLURAL = r"^[a-z][a-z\-]*(?<![su])s$"
SHOULD = r"(?<![A-Za-z])should(?:n['’]t)?(?![A-Za-z])"
IDENTIFIER = r"(?U)\b(?:[a-z][a-z0-9]*+(?:[A-Z][a-z0-9]*+)++|[a-z][a-z0-9]*+(?:_[a-z0-9]++)++)\b"
GENDERED = r"(?i)(?<![A-Za-z])(he|him|his|she|her|hers)(?![A-Za-z])"
KEY = "MUST|SHALL|SHOULD|REQUIRED|RECOMMENDED|MAY|OPTIONAL"
MODAL_KEY, ADJECTIVE_KEY = "MUST|SHALL|SHOULD|MAY", "REQUIRED|RECOMMENDED|OPTIONAL"
ANY_KEY = rf"(?U)\b(?:{KEY})\b"
KEY_TESTS = [
    ("K1", rf"(?U)\b({KEY})\s+(never|NEVER|rarely|seldom|no longer|not\b)", "should be negated by NOT alone"),
    ("K1", rf"(?U)\b({MODAL_KEY})\s+(?!NOT\b)(\w+)\s+((?:no more than|no fewer than|no less than|not more than)\b)", "hides a prohibition"),
    ("K1", r"(?U)\b(MUST|SHALL|SHOULD)\s+(avoid|avoids|refrain|refrains|abstain|abstains)\b", "stands for a plain MUST NOT"),
    ("K1", rf"(?iU)\b(nobody|no one|no \w+|none|nothing|neither|never)\b[^.]{{0,24}}?\b({KEY})\b", "has its negation in the subject"),
    ("K1", r"(?U)\bMAY\s+NOT\b", "reads two ways"),
    ("K1", rf"(?U)\bNOT\s+({ADJECTIVE_KEY})\b", "negates an adjectival key word"),
    ("K2", rf"(?U)\b({MODAL_KEY})(?:\s+NOT)?\s+(?:be|been)\b", "names no actor"),
    ("K2", rf"(?U)\b(?:is|are|was|were|it is|It is)\s+({ADJECTIVE_KEY})\b", "names no actor"),
]
MOST_INSTRUCTION, MOST_DESCRIPTION, DASH_WORDS = 20, 25, 8
MOST_SENTENCES, MOST_ITEMS, MOST_NOUN_WORDS, MOST_ADJECTIVES = 6, 7, 3, 2
# ---- End of fixed values.


def nothing() -> Column:
    return F.array().cast(FINDING)


def _found(rule: str, hits: Column, say: Callable[[Column], Column]) -> Column:
    return F.transform(hits, lambda m: F.struct(F.lit(rule).alias("rule"), say(m["hit"]).alias("message"), m["at"].alias("at")))


def _once(rule: str, when: Column, message: Column, at: Column | int = 0) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    one = F.array(F.struct(F.lit(rule).alias("rule"), message.alias("message"), at.cast("int").alias("at")))
    return F.when(when, one).otherwise(nothing())


def _said(text: str) -> Callable[[Column], Column]:
    return lambda hit: F.concat(F.lit("'"), hit, F.lit(f"' {text}"))


def is_instruction(sentence: Column, kind: Column | None = None) -> Column:
    """Whether a sentence opens with an imperative; a kind other than auto decides instead."""
    opens = F.rlike(F.trim(sentence), F.lit(rf"(?iU)^({IMPERATIVES})\b"))
    if kind is None:
        return opens
    return F.when(kind == "instruction", True).when(kind == "description", False).otherwise(opens)


def _noun_runs(s: Column) -> Column:
    breaks = F.array(*[F.lit(w) for part in NOUN_RUN_BREAKS.values() for w in part.split()])

    def cut(run: Column) -> Column:
        words = F.split(F.trim(run), r"\s+")

        def ends(w: Column, i: Column) -> Column:
            return F.array_contains(breaks, w) & ~((i == 0) & F.endswith(w, F.lit("ed")))

        def kept(ws: Column) -> Column:
            order = F.sequence(F.lit(0), F.size(ws) - 1)
            n = F.size(ws)
            # the first breaking word is left out, the first interior plural is the last one in
            first_break = F.coalesce(F.get(F.filter(order, lambda i: ends(F.get(ws, i), i)), F.lit(0)), n)
            plural = F.coalesce(F.get(F.filter(order, lambda i: F.rlike(F.get(ws, i), F.lit(INTERIOR_PLURAL))), F.lit(0)), n)
            return F.slice(ws, F.lit(1), F.least(first_break, plural + 1, n))

        return let(words, kept)

    hits = F.zip_with(
        matches(s, NOUN_RUN), F.regexp_extract_all(s, F.lit(NOUN_RUN), F.lit(1)),
        lambda m, g: F.struct(m["at"].alias("at"), cut(g).alias("run")),
    )
    long_ = F.filter(hits, lambda x: F.size(x["run"]) > MOST_NOUN_WORDS)
    named = F.transform(long_, lambda x: F.struct(x["at"].alias("at"), F.array_join(x["run"], " ").alias("hit")))
    return F.when(F.rlike(s, F.lit(NOUN_RUN)), _found("N5", named, _said("is a noun of over 3 words"))).otherwise(nothing())


def _adjective_rules(s: Column) -> Column:
    ranks = {w: k + 1 for k, (_, ws) in enumerate(ADJECTIVES.items()) for w in ws.split()}
    table = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    names = F.array(*[F.lit(n) for n in ADJECTIVES])
    word = "[A-Za-z][A-Za-z-]*"
    guard = any_of(list(ranks)).replace("(?![A-Za-z])", "[^A-Za-z]+") + any_of(list(ranks)).replace("(?i)(?<![A-Za-z])", "")

    def ranked(ms: Column) -> Column:
        return F.transform(ms, lambda m: F.struct(m["at"].alias("at"), F.lower(m["hit"]).alias("w"), F.try_element_at(table, F.lower(m["hit"])).alias("r")))

    def judged(ws: Column) -> Column:
        order = F.sequence(F.lit(0), F.size(ws) - 1)
        known = lambda i: F.coalesce(F.get(ws, i)["r"], F.lit(0)) > 0
        pairs = F.filter(order, lambda i: known(i) & known(i + 1) & (F.get(ws, i)["r"] > F.get(ws, i + 1)["r"]))
        wrong = F.transform(
            pairs,
            lambda i: F.struct(
                F.lit("G12").alias("rule"),
                F.concat(
                    F.lit("'"), F.get(ws, i)["w"], F.lit(" "), F.get(ws, i + 1)["w"], F.lit("' is out of order: "),
                    F.get(names, F.get(ws, i + 1)["r"] - 1), F.lit(" comes before "), F.get(names, F.get(ws, i)["r"] - 1),
                ).alias("message"),
                F.get(ws, i)["at"].alias("at"),
            ),
        )
        heads = F.filter(order, lambda i: known(i) & ~((i > 0) & known(i - 1)) & known(i + 1) & known(i + 2))
        many = F.transform(
            heads,
            lambda i: F.struct(
                F.lit("G11").alias("rule"),
                F.concat(F.lit("over 2 adjectives from '"), F.get(ws, i)["w"], F.lit("' on")).alias("message"), F.get(ws, i)["at"].alias("at"),
            ),
        )
        return F.concat(many, wrong)

    return F.when(F.rlike(s, F.lit(guard)), let(ranked(matches(s, word)), judged)).otherwise(nothing())


def _phrases(rule: str, s: Column, phrases: list[str], keep: Callable[[Column], Column] | None = None, text: str = "") -> Column:
    """One finding for each phrase in a sentence, at its first place.

    One literal alternation decides whether anything is there; only then is each phrase looked
    up, so a sentence without any costs one compiled search.
    """
    if not phrases:
        return nothing()
    listed = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(letter_bounded(p)).alias("rx")) for p in sorted(phrases)])
    present = F.filter(listed, lambda x: F.rlike(s, x["rx"]))
    placed = F.transform(
        present,
        lambda x: F.struct(
            (F.regexp_instr(s, x["rx"]) - 1).cast("int").alias("at"), x["p"].alias("hit"), F.regexp_substr(s, x["rx"]).alias("seen")
        ),
    )
    if keep is not None:
        placed = F.filter(placed, lambda x: keep(x["seen"]))
    return F.when(F.rlike(s, F.lit(any_of(phrases))), _found(rule, placed, _said(text))).otherwise(nothing())


def vocabulary_spans(s: Column, v: Vocabulary) -> Column:
    """Matches of not-approved phrases that survive: array of (at, till, hit), longest first kept."""
    kind = "array<struct<at:int,till:int,hit:string>>"
    if not v.instead_of:
        return F.array().cast(kind)
    listed = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(letter_bounded(p)).alias("rx")) for p in sorted(v.instead_of)])
    spans = F.flatten(
        F.transform(
            F.filter(listed, lambda x: F.rlike(s, x["rx"])),
            lambda x: F.transform(
                matches(s, x["rx"]),
                lambda m: F.struct(m["at"].alias("at"), (m["at"] + F.length(m["hit"])).alias("till"), x["p"].alias("hit")),
            ),
        )
    )

    def size(x: Column) -> Column:
        return x["till"] - x["at"]

    longest_first = F.array_sort(
        spans,
        lambda a, b: F.when(size(a) != size(b), size(b) - size(a)).when(a["at"] != b["at"], a["at"] - b["at"])
        .when(a["hit"] < b["hit"], F.lit(-1)).when(a["hit"] > b["hit"], F.lit(1)).otherwise(F.lit(0)).cast("int"),
    )
    kept = F.aggregate(
        longest_first, F.array().cast(kind),
        lambda got, x: F.when(F.exists(got, lambda k: (x["at"] < k["till"]) & (k["at"] < x["till"])), got).otherwise(F.array_append(got, x)),
    )
    # a suppressed phrase still hides what it overlapped
    silent = sorted(v.marketing | v.term_nouns | v.term_verbs)
    left = F.filter(kept, lambda x: ~x["hit"].isin(*silent)) if silent else kept
    return F.when(F.rlike(s, F.lit(any_of(list(v.instead_of)))), left).otherwise(F.array().cast(kind))


def _vocabulary_rules(s: Column, v: Vocabulary) -> Column:
    dropped = sorted(p for p, r in v.instead_of.items() if r is None)
    def told(x: Column) -> Column:
        gone = x["hit"].isin(*dropped) if dropped else F.lit(False)
        return F.struct(
            F.when(gone, F.lit("L2")).otherwise(F.lit("V3")).alias("rule"),
            F.concat(F.lit("'"), x["hit"], F.when(gone, F.lit("' says nothing")).otherwise(F.lit("' is not approved"))).alias("message"),
            x["at"].alias("at"),
        )

    return F.transform(vocabulary_spans(s, v), told)


def _stacked_hedges(s: Column, v: Vocabulary) -> Column:
    if not v.hedges:
        return nothing()
    listed = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(letter_bounded(p)).alias("rx")) for p in sorted(v.hedges)])
    present = F.filter(listed, lambda x: F.rlike(s, x["rx"]))
    message = F.concat(F.lit("stacked hedges: "), F.array_join(F.transform(F.slice(present, 1, 3), lambda x: x["p"]), ", "))
    return F.when(F.rlike(s, F.lit(any_of(list(v.hedges)))), _once("L1", F.size(present) > 1, message)).otherwise(nothing())


def sentence_findings(s: Column, in_list: Column, v: Vocabulary, kind: Column | None = None, rules: set[str] | None = None) -> Column:
    """The findings of one sentence: array of (rule, message, at). Tests of rules not asked for are not built."""
    n = word_count(s)
    instruction = is_instruction(s, kind)
    words = F.concat(n.cast("string"), F.lit(" words"))
    ing = F.filter(
        F.zip_with(matches(s, ING_VERB), F.regexp_extract_all(s, F.lit(ING_VERB), F.lit(1)), lambda m, g: F.struct(m["at"].alias("at"), m["hit"].alias("hit"), g.alias("g"))),
        lambda x: ~F.lower(x["g"]).isin(*STATE_WORDS),
    )
    nominal = F.filter(
        F.zip_with(matches(s, NOMINAL_OF), F.regexp_extract_all(s, F.lit(NOMINAL_OF), F.lit(1)), lambda m, g: F.struct(m["at"].alias("at"), m["hit"].alias("hit"), g.alias("g"))),
        lambda x: ~F.lower(x["g"]).isin(*NOT_NOMINAL),
    )
    inflected = F.filter(matches(s, IDENTIFIER), lambda m: F.rlike(m["hit"], F.lit("(?:ing|ed)$")))
    acronym = lambda seen: ~((seen == F.upper(seen)) & ~F.contains(seen, F.lit(".")) & F.rlike(seen, F.lit("[A-Z]")))
    key_words = F.flatten(
        F.array(*[_found(rule, first_match(s, rx), _said(text)) for rule, rx, text in KEY_TESTS])
    )
    tests = [
        ("N1", _once("N1", instruction & (n > MOST_INSTRUCTION), F.concat(F.lit("an instruction of "), words))),
        ("N2", _once("N2", ~instruction & (n > MOST_DESCRIPTION), F.concat(F.lit("a description of "), words))),
        ("N3", _found("N3", matches(s, CONTRACTION), _said("is a contraction"))),
        ("P1", _found("P1", first_match(F.trim(s), OPENER, 1), _said("is no command"))),
        ("S4", _found("S4", inflected, _said("is an inflected identifier"))),
        ("G10", _found("G10", first_match(s, GENDERED), _said("is gendered: confirm it"))),
        ("X1", _once("X1", F.contains(s, F.lit(";")), F.lit("a semicolon"), F.instr(s, ";") - 1)),
        ("X5", _once("X5", F.rlike(s, F.lit("[—–]")) & (n > DASH_WORDS) & ~in_list, F.lit("a dash joins clauses"), F.regexp_instr(s, F.lit("[—–]")) - 1)),
        ("G1", F.when(instruction, _found("G1", matches(s, PASSIVE), _said("is passive"))).otherwise(nothing())),
        ("G4", _found("G4", matches(s, PERFECT), _said("is perfect tense"))),
        ("G5", _found("G5", matches(s, STACKED), _said("stacks auxiliaries"))),
        ("G6", F.when(F.rlike(s, F.lit(ING_VERB)), _found("G6", ing, _said("is an -ing main verb"))).otherwise(nothing())),
        ("G7", _found("G7", matches(s, LIGHT_VERB), _said("is a nominalization"))),
        ("G7", F.when(F.rlike(s, F.lit(NOMINAL_OF)), _found("G7", nominal, _said("is a nominalization"))).otherwise(nothing())),
        ("G11 G12", _adjective_rules(s)),
        ("G8", _phrases("G8", s, list(v.phrasal), text="is a phrasal verb")),
        ("V8", _phrases("V8", s, list(v.latin), keep=acronym, text="is a Latin abbreviation")),
        ("V7", _phrases("V7", s, list(v.british), text="is British spelling")),
        ("V9", _phrases("V9", s, list(v.marketing), text="is a marketing adjective")),
        ("V10", _once("V10", F.rlike(s, F.lit(SHOULD)), F.lit("'should' has two readings"), F.regexp_instr(s, F.lit(SHOULD)) - 1)),
        ("N5", _noun_runs(s)),
        ("K1 K2", F.when(F.rlike(s, F.lit(ANY_KEY)), key_words).otherwise(nothing())),
        ("V3 L2", _vocabulary_rules(s, v)),
        ("L1", _stacked_hedges(s, v)),
    ]
    wanted = [test for names, test in tests if rules is None or rules & set(names.split())]
    out = F.flatten(F.array(*wanted)) if wanted else nothing()
    return out if rules is None else F.filter(out, lambda f: f["rule"].isin(*rules))


def paragraph_findings(paragraph: Column) -> Column:
    """D2 of one paragraph: more than six sentences in a block without headings, tables, items."""
    head = F.trim(paragraph)
    lines = F.split(paragraph, "\n", -1)
    out = F.rlike(head, F.lit(HEADING)) | F.rlike(head, F.lit(TABLE_ROW)) | F.exists(lines, lambda x: F.rlike(F.trim(x), F.lit(LIST_ITEM)))
    n = F.size(plain_sentences(paragraph))
    return F.when(
        ~out, let(n, lambda k: _once("D2", k > MOST_SENTENCES, F.concat(F.lit("a paragraph of "), k.cast("string"), F.lit(" sentences"))))
    ).otherwise(nothing())


def list_findings(masked: Column, run: Column) -> Column:
    """D7 of one list: more than seven items, unless the text just before says it is complete."""
    start = F.greatest(F.lit(0), run["offset"] - COMPLETE_WINDOW)
    before = F.substring(masked, start + 1, run["offset"] - start)
    return _once(
        "D7", (run["items"] > MOST_ITEMS) & ~F.rlike(before, F.lit(COMPLETE)),
        F.concat(F.lit("a list of "), run["items"].cast("string"), F.lit(" items")),
    )


def frame_findings(sentence: Column, edge: Column, v: Vocabulary) -> Column:
    """L5 of the first or last sentence: the longest frame it holds (ties by name)."""
    if not v.frames:
        return nothing()
    low = F.lower(sentence)
    listed = F.array(*[F.lit(p) for p in sorted(v.frames, key=lambda p: (-len(p), p))])
    hit = F.get(F.filter(listed, lambda p: F.contains(low, p)), F.lit(0))
    return let(
        hit,
        lambda h: _once("L5", edge & h.isNotNull(), F.concat(F.lit("'"), h, F.lit("' frames and states nothing")), F.position(h, low) - 1),
    )

