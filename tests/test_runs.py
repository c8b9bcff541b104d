"""Run analytics, manifest files, publishing and the driver's own files: what SQL does not show."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from lexisieve.operators import modes, publish, runs
from lexisieve.operators.findings import findings, totals
from lexisieve.sources import files, manifest
from lexisieve.sources.vocabulary import OWN, read_entries
from lexisieve.plans import run_queries


def test_markdown_blocks():
    text = "# A title, here\n\nA **bold** `x < 1` and *one* N1.\nwrapped [L](a/b.md) <https://x.y> [RFC2119]\n\n**N1** (x): short.\n\n**N1**: again.\n\n- one\n  two\n- three\n\n1. a\n2) b\n\n| a | b |\n|---|---|\n| c | *d* |\n\n> q1\n> q2\n>\n> q3\n\n**t**\n: meaning\n  more\n\n---\n"
    got = publish.page_html(text).split("\n\n")
    assert got[0] == '<h1 id="a-title-here">A title, here</h1>'
    assert got[1] == (
        '<p>A <strong>bold</strong> <code>x &lt; 1</code> and <em>one</em> <a class="rule" href="#N1">N1</a>. wrapped <a href="a/b.md">L</a> '
        '<a href="https://x.y">https://x.y</a> <a href="#references">[RFC2119]</a></p>'
    )
    assert got[2] == '<p id="N1"><strong>N1</strong> (x): short.</p>' and got[3] == "<p><strong>N1</strong>: again.</p>"
    assert got[4] == "<ul><li>one two</li><li>three</li></ul>" and got[5] == "<ol><li>a</li><li>b</li></ol>"
    assert "<td><em>d</em></td>" in got[6] and got[7:11] == ["<blockquote>", "<p>q1 q2</p>", "<p>q3</p>", "</blockquote>"]
    assert got[11:] == ["<dl><dt>t</dt><dd>meaning more</dd></dl>", "<hr>"] and publish.page_html("") == ""


def test_markdown_columns(spark):
    df = spark.createDataFrame([("a *b* <c>",), (None,)], "t string")
    got = df.select(publish.markdown_inline(F.col("t")).alias("i"), publish.markdown_page(F.col("t")).alias("p")).collect()
    assert (got[0]["i"], got[0]["p"], got[1]["i"]) == ("a <em>b</em> &lt;c&gt;", "<p>a <em>b</em> &lt;c&gt;</p>", None)


def test_pages(spark):
    none = spark.createDataFrame([], "file string, date string, commit string, documents long, arms array<string>, generation string, judging string, has_page boolean")
    assert "No results yet." in publish.run_index(none).first()["page"]
    doc = [("a", "T&", "guide", "Ann", "MIT", "https://x", "credit", "x" * 90, None), ("b", "U", "guide", "Ann", "MIT", "local", "", "y" * 90, "z" * 90)]
    got = {r["id"]: r["panel"] for r in publish.example_panels(spark.createDataFrame(doc, "id string, title string, type string, author string, licence string, url string, credit string, before string, after string")).collect()}
    assert "T&amp;" in got["a"] and 'href="https://x"' in got["a"] and "Not judged" in got["a"] and "credit" in got["a"]
    assert "z" * 90 in got["b"] and "href" not in got["b"] and "attribution" not in got["b"]
    page = spark.range(1).select(publish.page_of(F.lit("<t>__TITLE__</t>__NOTE__ __DATA__"), F.lit('{"a":"<"}'), F.lit("a<b"), F.lit("n&m")).alias("p")).first()["p"]
    assert page == '<t>a&lt;b</t>n&amp;m {"a":"<"}'


def test_filters_and_order(spark):
    df = spark.createDataFrame([("synth-a", "n1", "low-agreement", 3), ("b", "N1", "confirmed", 1), ("c", "X1", "confirmed", 2)], "id string, rule string, status string, seen_in int")
    assert [r["id"] for r in runs.only_rule(df, "N1").orderBy("id").collect()] == ["b", "synth-a"]
    assert [r["id"] for r in runs.chosen_documents(df, "id", ["c", "b"], 1).collect()] == ["b"] and runs.chosen_documents(df, "id").count() == 3
    assert [r["id"] for r in runs.in_summary_order(df).collect()] == ["c", "b", "synth-a"]
    assert [r["s"] for r in df.select(runs.is_synthetic(F.col("id")).alias("s")).collect()] == [True, False, False]
    assert [r["id"] for r in runs.distinct_first(df, ["status"], ["seen_in"]).orderBy("id").collect()] == ["b", "synth-a"]
    said = spark.createDataFrame([("Not Logged In",), ("see /login",), (None,), ("busy",)], "d string")
    assert [r[0] for r in said.select(runs.auth_failure(F.col("d"))).collect()] == [True, True, False, False]


def test_faults_and_prompts(spark):
    docs = spark.createDataFrame([(1, "The parser stops; it waits. He is here.")], "doc_id long, text string")
    found = findings(spark, docs, rules=["X1", "G10"])
    assert {r["rule"] for r in found.collect()} == {"X1", "G10"}
    grouped = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rule", "message", "excerpt"))).alias("f"))
    faults = grouped.select(runs.format_faults(F.col("f")).alias("t")).first()["t"]
    assert faults.startswith("- G10: ") and "\n    The parser stops; it waits." in faults and faults.count("\n") == 3
    prompt = grouped.select(runs.build_prompt("Rules {a}, text {b}.", {"a": F.lit("x"), "b": F.lit(None)}).alias("p")).first()["p"]
    assert prompt == "Rules x, text ."
    with pytest.raises(KeyError):
        runs.build_prompt("{missing}", {})
    one = totals(docs, ["X1", "G10"]).first()
    assert (one["total"], one["dirty"], one["sentences"]) == (2, 2, 2) and abs(one["weighted"] - 0.2) < 1e-9


def test_rules_asked_for_alone_are_the_same(spark):
    docs = run_queries._cells(spark, "/root/testdata/sf0.001")
    every = findings(spark, docs, id_col="cell")
    for some in (["D2"], ["D7", "L5"], ["V3", "K1", "N5"], ["G12", "X5"]):
        want = sorted(map(repr, every.where(F.col("rule").isin(some)).collect()))
        assert sorted(map(repr, findings(spark, docs, id_col="cell", rules=some).collect())) == want


def test_manifest_text(spark, tmp_path):
    with pytest.raises(Exception, match="no documents list"):
        spark.createDataFrame([("x: 1", "e")], "m string, e string").select(manifest.appended(F.col("m"), F.col("e"))).collect()
    path = tmp_path / "m.yaml"
    path.write_text("documents:\n  # none\n  - id: a\n    words: '12'\n    sha256: 007\n    excerpt: false\n\n  - id: b\n    words: x\n    title: 'q'\n    title: last\n    colour: no\n")
    got = [tuple(r[c] for c in ("id", "words", "sha256", "excerpt", "title")) for r in manifest.read_manifest(spark, str(path)).collect()]
    assert got == [("a", 12, "007", False, None), ("b", None, None, None, "last")]
    path.write_text("documents: []\n")
    assert manifest.read_manifest(spark, str(path)).count() == 0


def test_embedded_vocabulary(spark):
    v = manifest.embedded_vocabulary(spark, json.dumps({"instead_of": {"use up": "use", "basically": None}, "hedges": ["may"]}))
    assert v.instead_of == {"use up": "use", "basically": None} and v.hedges == {"may"} and v.latin == {} and v.approved == frozenset()
    assert manifest.embedded_vocabulary(spark, "{}").rows() == []


def test_lists_of_odd_shape():
    rows = read_entries("a:\n  - \"x: y\"\n  - it's # cut\n  - [b, 'c, d']\nb:\n  k.l.: v # w\n  'q r': s\ne:\n  - f: |\n      one\n\n      two\n    g: [h,\n      i]\n  - f: j#k\n")
    assert [(e.section, e.entry, e.field, e.value, e.item) for e in rows] == [
        ("a", 0, "", "x: y", True), ("a", 0, "", "it's # cut", True), ("a", 0, "", "b", True), ("a", 0, "", "c, d", True), ("b", 0, "k.l.", "v", False), ("b", 0, "q r", "s", False),
        ("e", 1, "f", "one two", False), ("e", 1, "g", "h", True), ("e", 1, "g", "i", True), ("e", 2, "f", "j#k", False),
    ]


def test_front_matter_of_prompts(spark):
    df = spark.createDataFrame([("---\na: b\n---\n\n  Text",), ("---\nopen",), ("Text",)], "t string")
    assert [r[0] for r in df.select(manifest.strip_skill_front(F.col("t"))).collect()] == ["Text", "---\nopen", "Text"]


def test_configuration_and_flags(tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    assert manifest.repo_config(str(deep), "none.json") is None
    (tmp_path / manifest.CONFIG_NAME).write_text('{"level": "off"}')
    (tmp_path / "a" / manifest.CONFIG_NAME).write_text("{broken")
    assert manifest.repo_config(str(deep)) == {"level": "off"}
    (deep / manifest.CONFIG_NAME).write_text('{"x": "' + "y" * 9000 + '"}')
    assert manifest.repo_config(str(deep)) == {"level": "off"}
    flag = tmp_path / "state" / "flag"
    assert manifest.write_flag(str(flag), "on") and flag.read_text() == "on" and not manifest.write_flag(str(flag), "loud")
    os.symlink(flag, tmp_path / "link")
    assert not manifest.write_flag(str(tmp_path / "link"), "off") and flag.read_text() == "on" and len(list(flag.parent.iterdir())) == 1


def test_pages_are_synchronised(spark, tmp_path):
    source, target = tmp_path / "from", tmp_path / "to"
    source.mkdir(), target.mkdir()
    for name in ("eval-1.json", "eval-1.html", "index.html", "notes.txt"):
        (source / name).write_text(name)
    (target / "gone.html").write_text("old")
    assert manifest.sync_pages(spark, f"file://{source}", f"file://{target}") == 2
    assert sorted(x.name for x in target.iterdir() if not x.name.endswith(".crc")) == ["eval-1.html", "eval-1.json"]


def test_results_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([(1, 2), (2, 0)], "doc_id long, total long")
    files.write_once(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="already exists"):
        files.write_once(df, str(tmp_path / "out"))
    assert files.exit_status(df).first()["status"] == 1 and files.exit_status(df.where("total = 0")).first()["status"] == 0
    assert json.loads(files.report_json(df, "a note").orderBy("value").first()["value"]) == {"disclaimer": "a note", "doc_id": 1, "total": 2}
    named = spark.createDataFrame([("2024-05-06T07:08", "abc")], "c string, s string").select(files.snapshot_name(F.col("c"), F.col("s")).alias("n")).first()["n"]
    assert named == "eval-2024-05-06-abc.json"


def test_texts_and_conversations_are_read(spark, tmp_path):
    (tmp_path / "a.md").write_text("one\ntwo\n")
    (tmp_path / "b.txt").write_text("three")
    got = {r["name"]: r["text"] for r in files.read_texts(spark, str(tmp_path), "*.md").collect()}
    assert got == {"a": "one\ntwo\n"}
    (tmp_path / "c.json").write_text(json.dumps({"name": "deep", "turns": [{"question": "q1", "answer": "a1"}, {"question": "q2", "answer": "a2"}]}))
    got = files.read_conversations(spark, str(tmp_path / "c.json")).orderBy("turn").collect()
    assert [tuple(r) for r in got] == [("deep", 1, "q1", "a1"), ("deep", 2, "q2", "a2")]


def test_commands_and_options(spark):
    said = ["/plain on please", "/plain", "/plain loud", "/PLAIN off now", "start plain mode", "plain mode off", "what is plain mode?", "Write the Post-Mortem"]
    df = spark.createDataFrame([(s,) for s in said], "p string")
    got = [tuple(r) for r in df.select(modes.written_level(F.col("p")), modes.names_artifact(F.col("p"))).collect()]
    assert [g[0] for g in got] == ["on", "on", None, "off", "on", "off", None, None] and [g[1] for g in got] == [False] * 7 + [True]
    pick = spark.createDataFrame([("ON", "off"), ("odd", "off"), (None, None)], "e string, r string")
    assert [r[0] for r in pick.select(modes.chosen_option(F.col("e"), F.col("r"), "on", ["on", "off"])).collect()] == ["on", "off", "on"]
    assert OWN.rows()
