"""Masks keep lengths; positions go both ways; fidelity, readability, series and votes on small cases."""

import random

from pyspark.sql import functions as F

from lexisieve.functions import text as X
from lexisieve.functions.mask import prose, strip_front_matter
from lexisieve.operators import consensus, corpus, fidelity, modes, readability, report, series


def test_masks_keep_length_and_are_idempotent(spark):
    rng = random.Random(3)
    bits = ["```", "`a b`", "https://x.y ", "> q", "\n", "\n\n", "    code", "- item", "not \"bad one\"", "---\n", " text. ", "é—", "😀", "lint: ignore"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, t string").withColumn("p", prose(F.col("t"))).withColumn("pp", prose(F.col("p")))
    for r in df.collect():
        assert len(r["p"]) == len(r["t"]), r["t"]
        assert [k for k, c in enumerate(r["p"]) if c == "\n"] == [k for k, c in enumerate(r["t"]) if c == "\n"]


def test_markers(spark):
    df = spark.createDataFrame([("See `abcdef` and `ab` at https://a.b/c now",)], "t string")
    assert df.select(prose(F.col("t"))).first()[0] == "See  CODE    and      at  URL          now"


def test_places_round_trip(spark):
    text = "ab\n\ncdé\nf"
    df = spark.createDataFrame([(text, i) for i in range(len(text))], "t string, at int")
    t, at = F.col("t"), F.col("at")
    got = df.select("at", X.line_of(t, at).alias("l"), X.column_of(t, at).alias("c")).withColumn("t", F.lit(text))
    for r in got.withColumn("back", X.offset_of(F.col("t"), F.col("l"), F.col("c"))).collect():
        assert r["back"] == r["at"]
    assert df.select(X.offset_of(t, F.lit(9), F.lit(1))).first()[0] is None
    assert df.select(X.token_at(t, F.lit(4))).first()[0] == "cdé"


def test_syllables(spark):
    words = {"the": 1, "table": 2, "make": 1, "free": 1, "readability": 5, "rhythm": 1, "--": 0, "bcd": 1}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r["w"]: r["n"] for r in df.select("w", X.syllables(F.col("w")).alias("n")).collect()} == words


def test_front_matter(spark):
    df = spark.createDataFrame([("---\na: 1\n---\n\nBody",), ("---\nno end",), ("Plain",)], "t string")
    assert [r[0] for r in df.select(strip_front_matter(F.col("t"))).collect()] == ["Body", "---\nno end", "Plain"]


CASES = [
    ("Wait 30 s.", "Wait 30 seconds.", True, []),
    ("Wait 30 seconds.", "Wait 300 seconds.", False, ["number"]),
    ("Wait 5 minutes.", "Wait 5 hours.", False, ["unit"]),
    ("Fix three bugs.", "Fix 3 bugs.", True, []),
    ("Use v3 of 3.5.", "Use v4 of 3.5.", True, []),
    ("3 retries, 3 retries", "3 attempts", False, ["number"]),
    ("It is not on.", "It is on.", False, ["negation"]),
    ("You must go.", "You should go.", False, ["modal"]),
    ("Stop if late.", "Stop.", True, ["condition"]),
    ("Every node.", "Some node.", False, ["scope"]),
    ("Use `a b` and --flag.", "Use `a  b`.", False, ["identifier"]),
    ("---\nn: 5\n---\nText", "Text", True, []),
]


def test_compare(spark):
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)], "pair_id long, source string, rewrite string")
    for r in fidelity.compare(df).collect():
        case = CASES[r["pair_id"]]
        assert r["faithful"] == case[2] and [f["kind"] for f in r["findings"]] == case[3], (case, r)


def test_a_text_is_faithful_to_itself_and_the_gate_keeps_drafts(spark):
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)], "i long, draft string, fixed string")
    assert fidelity.compare(df.withColumn("again", F.col("draft")), "i", "draft", "again").where(~F.col("faithful") | (F.size("findings") > 0)).count() == 0
    for r in fidelity.gate_fix(df, "i", "draft", "fixed").collect():
        assert r["gated"] == (r["fixed"] if CASES[r["i"]][2] else r["draft"])


def test_coverage(spark):
    known = spark.createDataFrame([(w,) for w in ("run", "stop", "carry", "make", "big")], "known string")
    docs = spark.createDataFrame([(1, "Running stopped carries making bigger XQ xq"), (2, ""), (3, "`code only here`")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in readability.coverage(docs, known).collect()}
    assert (got[1]["words"], got[1]["covered"], got[1]["unknown"][0]["word"], got[1]["unknown"][0]["n"]) == (7, 5, "xq", 2)
    assert got[2]["coverage"] == 100.0 and got[2]["meets_supported"] is None and got[3]["words"] == 0


def test_series_and_verdicts(spark):
    def turns(name, ys):
        return [(name, i, 100, y) for i, y in enumerate(ys)]

    schema = "conv_id string, turn int, words long, findings long"
    t = series.analyse(spark.createDataFrame(turns("up", [1, 2, 3, 5, 5, 7]) + turns("flat", [3, 3, 3]) + turns("two", [1, 2]), schema))
    c = series.analyse(spark.createDataFrame(turns("up", [1, 1, 1, 1, 1, 1]) + turns("flat", [3, 3, 3]) + turns("two", [1, 2]), schema))
    got = {r["conv_id"]: r["verdict"] for r in series.verdicts(t, c).collect()}
    assert got == {"up": "drifted", "flat": "held", "two": "too few turns"}
    first = t.where("conv_id = 'up'").first()
    assert (first["first_third"], first["middle_third"], first["last_third"]) == (1.5, 4.0, 6.0)


def test_votes(spark):
    good = '{"findings":[{"rule":"A1","quote":"q1","confidence":"low"}]}'
    high = 'text {"findings":[{"rule":"A1","quote":"q2","confidence":"high"},{"rule":"B2","quote":"x"}]} end'
    rows = [("d", 0, good), ("d", 1, high), ("d", 2, "no JSON"), ("d", 3, '{"other": 1}'), ("e", 0, "broken {"), ("f", 0, '{"findings": []}')]
    got = consensus.votes(spark.createDataFrame(rows, "doc string, pass int, reply string"), ["doc"], 0.6).collect()
    by = {(r["doc"], r["rule"]): r for r in got}
    assert (by["d", "A1"]["seen_in"], by["d", "A1"]["of"], by["d", "A1"]["status"], by["d", "A1"]["quote"]) == (2, 2, "confirmed", "q2")
    assert (by["d", "B2"]["agreement"], by["d", "B2"]["status"]) == (0.5, "low-agreement")
    assert by["e", None]["status"] == "error" and not [k for k in by if k[0] == "f"]


def test_locate(spark):
    text = "one two three four five six seven eight nine ten"
    quotes = ["three four", '"two three"', "one two three four five six WRONG tail", "absent", ""]
    df = spark.createDataFrame([(q,) for q in quotes], "q string")
    assert [r[0] for r in df.select(consensus.locate(F.col("q"), F.lit(text))).collect()] == [8, 4, 0, None, None]


def test_rotation_wraps(spark):
    ids = spark.createDataFrame([(f"d{i}",) for i in range(5)], "doc string")
    got = sorted(r["doc"] for r in consensus.rotation_sample(ids, "doc", ["d0"], 2, F.lit(3)).collect())
    assert got == ["d0", "d1", "d4"]


def test_corpus(spark):
    text = "## One\na\n## Two\nb\n## Three\nc"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(corpus.cut_sections(F.col("t"), "two")).first()[0] == "## Two\nb"
    assert df.select(corpus.cut_sections(F.col("t"), "one", "three")).first()[0] == "## One\na\n## Two\nb"
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert not corpus.is_stale(a, a) and corpus.is_stale(a, a.distinct())


def test_modes(spark):
    prompts = ["write the readme", "/plain", "hello", "please stop using plain english", "write the readme", "turn on plain mode", "what is normal mode?", "/plain off"]
    df = spark.createDataFrame([("s", i, p) for i, p in enumerate(prompts)], "session_id string, seq int, prompt string")
    got = [(r["level"], r["emitted"]) for r in modes.states(df).orderBy("seq").collect()]
    assert got == [("off", "one-turn"), ("on", "on"), ("on", "reminder"), ("off", "off"), ("off", "one-turn"), ("on", "reminder"), ("on", "reminder"), ("off", "off")]


def test_report_pieces(spark):
    spans = spark.createDataFrame([("a < b c", [(0, 1, "X1"), (0, 3, "N3"), (4, 5, "V3")])], "t string, s array<struct<at:int,till:int,rule:string>>")
    html = spans.select(report.mark_findings(F.col("t"), F.col("s"))).first()[0]
    assert html == '<mark title="X1">a</mark> &lt; <mark title="V3">b</mark> c'


def test_shares_round_as_in_sql(spark):
    """41 of 4,000 words are 1.025 %, which scaled is below 102.5: DuckDB says 1.02."""
    import duckdb

    docs = spark.createDataFrame([(1, "the " * 41 + "xyzzyq " * 3959)], "doc_id int, text string")
    got = readability.coverage(docs, spark.createDataFrame([("the",)], "known string")).first()
    assert (got["words"], got["covered"]) == (4000, 41)
    assert got["coverage"] == duckdb.connect().execute("SELECT round(41 * 100.0::DOUBLE / 4000, 2)").fetchone()[0] == 1.02


def test_cues_and_numbers_in_one_search(spark):
    """Cue words from one search count as each cue's own pattern does; the plan searches a text once for all cues."""
    texts = [
        "It must not stop, DO NOT go; it never may, if ıf İF unſure ſome muſt. No, none! notable no_one all-or-any",
        "You cannot and will  not, does not. Always use every one wholeé once un less unless, " * 3, "",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("h", fidelity.cue_hits(F.col("t")))
    for c in fidelity.CUES:
        for row in df.select(fidelity.cue_count(F.col("t"), c).alias("a"), fidelity.hits_of(c, F.col("h")).alias("b")).collect():
            assert row.a == row.b, c
    text = "1,200.5 rows, 3 sec. v1.2 4.5.6x 7% 8a TEN ms, fives, two\nhours ٥ minutes, sixty"
    got = spark.createDataFrame([(text,)], "t string").select(fidelity.numbers(F.col("t")).alias("n")).first().n
    assert [tuple(x) for x in got] == [("1200.5", "row"), ("3", "second"), ("4.5.6", "times"), ("7", "percent"), ("٥", "minute"), ("10", "ms"), ("5", "second"), ("2", "hour")]
    pairs = spark.createDataFrame([(1, "a", "b")], "pair_id int, source string, rewrite string")
    plan = fidelity.compare(pairs).drop("source_words", "rewrite_words")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?:after|all|always") == 2
