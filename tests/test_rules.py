"""Each rule on a sentence that breaks it and on one that does not; places; blocks."""

import pytest
from pyspark.sql import functions as F

from lexisieve.operators.findings import findings, sentence_rows, summary
from lexisieve.sources.vocabulary import RULES

PAIRS = [
    ("N1", "Run the first job and then the second job and then the third job and then the fourth job and then the fifth job now.", "Run the job."),
    ("N2", "This sentence goes on and on with one more word and one more word until it has well over the twenty five words that it may have in all.", "This is short."),
    ("N3", "It doesn't work.", "The writer's own plan works."),
    ("N3", "It’s late.", "Its time is late."),
    ("P1", "You should run it.", "Run it."),
    ("P1", "The job ends (please wait).", "You can wait."),
    ("S4", "The value was parseConfiged.", "The value of parseConfig is here."),
    ("S4", "It is max_size_ing now: max_sizeing.", "It is max_size now."),
    ("G10", "Tell him now.", "The other theme is here."),
    ("X1", "One part; another part.", "One part, another part."),
    ("X5", "The long system with many words — joins two long clauses.", "Short — dash."),
    ("G1", "Run the job that was written by the team.", "The job was written by the team."),
    ("G4", "We have finished it.", "We finished it."),
    ("G5", "It would have been lost.", "It was lost."),
    ("G6", "The worker is processing it.", "The service is running."),
    ("G7", "The creation of the file failed.", "A sequence of steps failed."),
    ("G7", "Perform the validation now.", "Validate it now."),
    ("G8", "We spin up a node.", "We spin a node."),
    ("V7", "The colour is red.", "The colours are red."),
    ("V8", "Use one, e.g. this.", "The VS Code window."),
    ("V9", "It is robust.", "It is robustness."),
    ("V10", "It should work.", "It SHOULD work."),
    ("V3", "Terminate the job.", "Stop the job."),
    ("L2", "It is basically done.", "It is done."),
    ("L1", "Perhaps it is likely.", "Perhaps it is so."),
    ("L5", "Of course. It is done. The end is here.", "It is done. It is, of course, late. The end is here."),
    ("G11", "The old new large house.", "The large house."),
    ("G12", "The small useful house.", "The useful small house."),
    ("N5", "Check the failed database connection retry handler.", "Check the database handler of the retry."),
    ("K1", "A writer MUST never stop.", "A writer MUST NOT stop."),
    ("K1", "Nobody SHOULD stop.", "A writer SHOULD stop."),
    ("K1", "A writer MAY NOT stop.", "A writer MAY avoid it."),
    ("K1", "They SHALL refrain.", "They MAY refrain."),
    ("K1", "They MUST write no more than two.", "They MUST NOT write more than two."),
    ("K1", "It is NOT REQUIRED.", "A writer MUST act."),
    ("K2", "Names MUST be kept.", "A writer MUST keep names."),
    ("K2", "It is REQUIRED that it ends.", "A writer MUST end it."),
    ("D2", "One. Two. Three. Four. Five. Six. Seven.", "One. Two. Three. Four. Five. Six."),
    ("D7", "\n".join(f"- item {i}" for i in range(8)), "The complete list:\n\n" + "\n".join(f"- item {i}" for i in range(8))),
    ("D7", "\n".join(f"- item {i}" for i in range(9)), "\n".join(["- item"] * 7 + ["  - nested"] * 5)),
]


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(2 * i + j, p[j + 1]) for i, p in enumerate(PAIRS) for j in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {}
    for r in findings(spark, docs).collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


@pytest.mark.parametrize("i", range(len(PAIRS)))
def test_pair(judged, i):
    rule = PAIRS[i][0]
    assert rule in [r["rule"] for r in judged.get(2 * i, [])], PAIRS[i]
    assert rule not in [r["rule"] for r in judged.get(2 * i + 1, [])], PAIRS[i]


def test_every_rule_has_a_pair():
    assert {p[0] for p in PAIRS} == {r[0] for r in RULES}


def test_places_and_enrichment(spark):
    docs = spark.createDataFrame([(1, "# Head\n\nAll is well.\nIt doesn't fit; so it is.")], "doc_id long, text string")
    got = {r["rule"]: r for r in findings(spark, docs).collect()}
    assert (got["N3"]["line"], got["N3"]["column"]) == (4, 4)
    assert (got["X1"]["line"], got["X1"]["column"], got["X1"]["severity"], got["X1"]["weight"]) == (4, 15, "MUST", 0.1)
    assert got["N3"]["excerpt"] == "It doesn't fit; so it is."


def test_masked_text_is_not_judged(spark):
    texts = ["```\nit doesn't;\n```", "> it doesn't;", "`it doesn't;`", "---\na: it doesn't;\n---\nFine.", "it doesn't; <!-- lint: ignore -->",
             "    it doesn't;", "Write \"this\", not \"it doesn't; fit\".", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert findings(spark, docs).where(F.col("rule").isin("N3", "X1")).count() == 0


def test_overlap_keeps_the_longest(spark):
    docs = spark.createDataFrame([(1, "In order to go, order a number of parts. The flag is seamless.")], "doc_id long, text string")
    got = sorted((r["rule"], r["message"]) for r in findings(spark, docs).where(F.col("rule").isin("V3", "L2")).collect())
    assert got == [("L2", "'order' says nothing"), ("V3", "'a number of' is not approved"), ("V3", "'in order to' is not approved")]


def test_summary_adds_up(spark):
    docs = spark.createDataFrame([(1, "It doesn't; fit. Fine."), (2, "Fine."), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in summary(docs, findings(spark, docs)).collect()}
    assert got[1]["total"] == sum(got[1]["by_rule"].values()) == 2 and got[1]["per_100w"] == 50.0
    assert got[2]["total"] == 0 and got[3]["words"] == 0 and got[3]["per_100w"] == 0.0


def test_sentences(spark):
    text = "One line\nwraps here. Then: more!\n\n- item one. And two.\n\n| a | b. |\n## Head. Line\nLast"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r["sentence"], r["in_list"], r["offset"]) for r in sentence_rows(docs).orderBy("sentence_no").collect()]
    assert got == [
        ("One line wraps here.", False, 0), ("Then:", False, 21), ("more!", False, 27), ("item one.", True, 36), ("And two.", True, 46),
        ("Last", False, text.index("Last")),
    ]


def test_noun_run_of_many_words(spark):
    """No stack overflow on a run of thousands of words; where no word can end a run, it ends before."""
    texts = [
        "Check the " + "queue priority handler " * 7000 + "value.", "Check the big queue handler value Now.", "Check the big queue handler value2 now.",
        "Check the big queue handler va-lue2 now.", "Check the big queue2 handler value now.",
    ]
    found = findings(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), rules=["N5"])
    got = {r["doc_id"]: r["message"].split("'")[1].split(" ") for r in found.collect()}
    assert len(got.pop(0)) == 21001
    assert got == {1: ["big", "queue", "handler", "value"], 3: ["big", "queue", "handler", "va-"]}


def test_long_identifiers(spark):
    """No stack overflow on an identifier of thousands of parts."""
    texts = ["The value is a" + "Bc" * 9000 + "ing.", "The value is a" + "_bc" * 9000 + "ing.", "The aBcing_ value aBced1 is a_b_ced."]
    found = findings(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), rules=["S4"])
    assert [(r["doc_id"], r["rule"], r["column"]) for r in found.orderBy("doc_id").collect()] == [(0, "S4", 14), (1, "S4", 14), (2, "S4", 29)]


def test_clean_sentence_rate_judges_once(spark, tmp_path):
    """The query shuffles nothing and cuts a text once; a text that is null has no row."""
    from lexisieve.plans.rule_queries import clean_sentences

    docs = [(0, "It doesn't work; it is late. It is fine.", "en", "a"), (24, "It is fine.", "en", "a"), (1, None, "en", "a")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = clean_sentences(spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == [(0, 3, 2, 0.3333), (24, 3, 0, 1.0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("(?<=[.!?:])") == 2
