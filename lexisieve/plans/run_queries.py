"""Queries over evaluation runs: benchmark texts in three arms, judged by the engine, and files written and read back.

A cell is an item of benchmark in an arm and a pass; its text is the item's with a snippet that arm and pass
decide, and its findings are the engine's own.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import corpus, publish, report, runs
from ..operators.findings import findings, totals
from ..operators.series import pair_turns
from ..sources import files, manifest, vocabulary
from .inputs import MUTATED_SQL, SENTENCES_SQL, SNIPPETS, SNIPPETS_SQL, quoted
from .rule_queries import DOUBLED, N, SENTENCE_RULES, _WEIGHTS, q

ARMS = ["source", "plain", "treated"]
PASSES = 3


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see; a machine-local one only where the session runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lexisieve-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- cells with the engine's findings
def _snippet(k: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in SNIPPETS]), (k % len(SNIPPETS)).cast("int"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    arms = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(k).alias("k")) for k, a in enumerate(ARMS)]))
    rows = items.select("item_id", "text", arms.alias("a")).select("item_id", "text", "a.*", F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1))).alias("pass"))
    rows = rows.where((F.col("k") > 0) | (F.col("pass") == 0))
    text = F.concat("text", F.lit("\n\n"), _snippet(F.col("item_id") + F.col("k") * 13 + F.col("pass") * 7))
    return rows.select((F.col("item_id") * 100 + F.col("k") * 10 + F.col("pass")).alias("cell"), "item_id", "arm", "pass", text.alias("text"))


_CELL_MUTATED = f"""cells AS (SELECT item_id * 100 + k * 10 + p AS cell, item_id, arm, p AS pass,
  text || chr(10) || chr(10) || ({SNIPPETS_SQL})[((item_id + k * 13 + p * 7) % {len(SNIPPETS)} + 1)::INT] AS text
  FROM benchmark, (VALUES ('source', 0), ('plain', 1), ('treated', 2)) AS a(arm, k), range(0, {PASSES}) AS r(p) WHERE k > 0 OR p = 0),
mutated AS (SELECT cell AS doc_id, 'en' AS lang, '' AS source, text FROM cells)"""
_CELL_HITS = f"""{_CELL_MUTATED}{SENTENCES_SQL[len(MUTATED_SQL):]}, {DOUBLED}, weights(rule, w) AS (VALUES {_WEIGHTS}),
hits AS ({' UNION ALL '.join(f"SELECT '{r}' AS rule, doc_id, no, ({sql})::BIGINT AS n FROM doubled" for r, sql in SENTENCE_RULES.items())}),
found AS (SELECT doc_id, sum(n)::BIGINT AS total, sum(n * w::DOUBLE) AS weighted, count(DISTINCT no) FILTER (WHERE n > 0) AS dirty FROM hits JOIN weights USING (rule) GROUP BY doc_id),
sized AS (SELECT doc_id, sum({N})::BIGINT AS words, count(*)::BIGINT AS sentences FROM sent GROUP BY doc_id),
judged AS (SELECT c.cell, c.item_id, c.arm, c.pass, coalesce(f.total, 0)::BIGINT AS total, coalesce(f.weighted, 0)::DOUBLE AS weighted, coalesce(f.dirty, 0)::BIGINT AS dirty,
  s.words, s.sentences FROM cells c LEFT JOIN found f ON c.cell = f.doc_id LEFT JOIN sized s ON c.cell = s.doc_id)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = totals(_cells(spark, sf_dir), list(SENTENCE_RULES), id_col="cell", keep=["item_id", "arm", "pass"])
    return done.withColumn("total", F.col("total").cast("bigint"))


def pass_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.pass_stats(_judged(spark, sf_dir), ["item_id", "arm"])
    return out.withColumn("findings", F.array_join(F.transform("findings", lambda x: x.cast("string")), ","))


PASSES_SQL = f"""WITH {_CELL_HITS} SELECT item_id, arm, string_agg(total::VARCHAR, ',' ORDER BY pass) AS findings, count(*) FILTER (WHERE total = 0)::BIGINT AS passed, count(*)::BIGINT AS of,
round(count(*) FILTER (WHERE total = 0) * 100.0::DOUBLE / count(*))::INT AS rate, round(avg(total), 1)::DOUBLE AS mean FROM judged GROUP BY item_id, arm"""


def rules_by_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by arm, ranked by the last arm: the rank is a column, so that the order is compared too."""
    found = findings(spark, _cells(spark, sf_dir), id_col="cell", rules=list(SENTENCE_RULES))
    arm = F.get(F.array(*[F.lit(a) for a in ARMS]), (F.floor(F.col("cell") / 10) % 10).cast("int"))
    wide = report.by_arm(found.select("rule", arm.alias("arm")), ARMS)
    return wide.withColumn("place", F.row_number().over(Window.orderBy(F.desc(ARMS[-1]), "rule")).cast("bigint"))  # one row a rule


BY_ARM_SQL = f"""WITH {_CELL_HITS}, wide AS (SELECT rule, {', '.join(f"sum(n) FILTER (WHERE doc_id // 10 % 10 = {k})::BIGINT AS {a}" for k, a in enumerate(ARMS))} FROM hits WHERE n > 0 GROUP BY rule)
SELECT rule, {', '.join(f"coalesce({a}, 0)::BIGINT AS {a}" for a in ARMS)}, row_number() OVER (ORDER BY coalesce(treated, 0) DESC, rule) AS place FROM wide"""


def _id(item: Column) -> Column:
    return F.concat(F.when(item % 3 == 0, F.lit("synth-")).otherwise(F.lit("item-")), item)


def run_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures of the overview over the first pass of each cell; judge columns follow the item's number."""
    judged = _judged(spark, sf_dir)
    stats = runs.pass_stats(judged, ["item_id", "arm"]).select("item_id", "arm", "passed", "of")
    item = F.col("item_id")
    unjudged, loss, confirmed = item % 11 == 0, item % 4 == 1, item % 5
    one = judged.where("pass = 0").join(stats, ["item_id", "arm"])
    measured = one.select(
        "arm", runs.is_synthetic(_id(item)).alias("synthetic"), F.when(item % 5 == 0, "anchor").when(item % 5 < 3, "rotating").alias("bucket"),
        (~unjudged & (F.col("total") == 0) & ~loss & (confirmed == 0)).cast("int").alias("pass"), F.col("total").alias("findings"), "weighted", "words",
        F.col("passed").alias("run_pass"), F.col("of").alias("run_total"), loss.cast("int").alias("fact_loss"), confirmed.alias("semantic_confirmed"),
        unjudged.cast("int").alias("unjudged"), (item % 5 > 2).cast("int").alias("sampled_out"),
        (F.col("sentences") - F.col("dirty")).alias("sent_clean"), F.col("sentences").alias("sent_total"),
    )
    return runs.overview(measured).withColumn("weighted", F.round("weighted", 1))


RUN_OVERVIEW_SQL = f"""WITH {_CELL_HITS}, stats AS (SELECT item_id, arm, count(*) FILTER (WHERE total = 0) AS passed, count(*) AS n FROM judged GROUP BY ALL),
m AS (SELECT arm, item_id % 3 = 0 AS synthetic, CASE WHEN item_id % 5 = 0 THEN 'anchor' WHEN item_id % 5 < 3 THEN 'rotating' END AS bucket, j.*, passed, n FROM judged j JOIN stats USING (item_id, arm) WHERE pass = 0),
g AS (SELECT arm, synthetic, bucket, grouping(bucket) AS g, count(*)::BIGINT AS total,
  count(*) FILTER (WHERE item_id % 11 <> 0 AND total = 0 AND item_id % 4 <> 1 AND item_id % 5 = 0)::BIGINT AS pass, sum(total)::BIGINT AS findings, round(sum(weighted), 1)::DOUBLE AS weighted, sum(words)::BIGINT AS words,
  sum(passed)::BIGINT AS run_pass, sum(n)::BIGINT AS run_total, count(*) FILTER (WHERE item_id % 4 = 1)::BIGINT AS fact_loss, sum(item_id % 5)::BIGINT AS semantic_confirmed,
  count(*) FILTER (WHERE item_id % 11 = 0)::BIGINT AS unjudged, count(*) FILTER (WHERE item_id % 5 > 2)::BIGINT AS sampled_out, sum(sentences - dirty)::BIGINT AS sent_clean, sum(sentences)::BIGINT AS sent_total
  FROM m GROUP BY GROUPING SETS ((arm, synthetic), (arm, bucket)))
SELECT * EXCLUDE (g) FROM g WHERE g = 1 OR bucket IS NOT NULL"""


def finding_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first findings of each item's source text by place, and how many more: checked by length and count."""
    found = findings(spark, _cells(spark, sf_dir).where("arm = 'source'"), id_col="cell", rules=list(SENTENCE_RULES))
    out = runs.listing(found, "cell", most=2)
    return out.select("cell", "n", F.size(F.split("listing", "\n")).cast("bigint").alias("lines"), F.regexp_extract("listing", r"and (\d+) more$", 1).alias("more"))


LISTING_SQL = f"""WITH {_CELL_HITS} SELECT cell, total AS n, least(total, 2) + (total > 2)::BIGINT AS lines, CASE WHEN total > 2 THEN (total - 2)::VARCHAR ELSE '' END AS more FROM judged WHERE arm = 'source' AND total > 0"""


# ---------------------------------------------------------------- snapshots, written and read back
def _write_texts(spark: SparkSession, folder: str, texts: dict[str, str]) -> str:
    """Small files beside each other, through the file system of the shared folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(conf)
    for name, text in texts.items():
        out = fs.create(path(folder, name))
        out.write(bytearray(text.encode()))
        out.close()
    return folder


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of the benchmark as result files, read back as snapshots; a benchmark is small by nature."""
    items = [r["item_id"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id").orderBy("item_id").collect()]
    texts = {}
    for run, step in (("2024-01-02-aaaa1111", 2), ("2024-02-03-bbbb2222", 3)):
        results = {}
        for i in items[::step]:
            entry: dict = {"type": "runbook", "title": f"Title {i}", "author": f"model-{i % 3}, 2024" if i % 2 else "Ann", "source": f"Text {i}.", "outputs": {"plain": f"Plain {i}.", "treated": "" if i % 7 == 0 else f"Treated {i}."}}
            if i % 3 == 0:
                entry["passes"] = {"plain": [f"Plain {i} a.", f"Plain {i} b."]}
            results[f"doc-{i}"] = entry
        texts[f"eval-{run}.json"] = json.dumps({"git": {"commit": run[-8:], "short": run[-8:], "committed": run[:10]}, "arms": ["plain", "treated"], "passes": 2, "failures": 0, "results": results})
    return files.read_snapshots(spark, _write_texts(spark, shared_folder(spark, "snapshots"), texts))


def snapshot_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.snapshot_texts(_snapshots(spark, sf_dir))
    return rows.groupBy("file", "arm").agg(F.count("*").alias("texts"), F.countDistinct("doc").alias("documents"), F.max("pass").cast("bigint").alias("last_pass"), F.min("text").alias("first_text"))


_RUNS_SQL = """items AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS rn FROM benchmark),
results AS (SELECT 'eval-2024-01-02-aaaa1111.json' AS file, item_id FROM items WHERE rn % 2 = 0 UNION ALL SELECT 'eval-2024-02-03-bbbb2222.json', item_id FROM items WHERE rn % 3 = 0)"""
SNAPSHOT_SQL = f"""WITH {_RUNS_SQL}, t AS (SELECT file, item_id, 'source' AS arm, 0 AS pass, 'Text ' || item_id || '.' AS text FROM results
UNION ALL SELECT file, item_id, 'plain', 0, 'Plain ' || item_id || CASE WHEN item_id % 3 = 0 THEN ' a.' ELSE '.' END FROM results UNION ALL SELECT file, item_id, 'plain', 1, 'Plain ' || item_id || ' b.' FROM results WHERE item_id % 3 = 0
UNION ALL SELECT file, item_id, 'treated', 0, 'Treated ' || item_id || '.' FROM results WHERE item_id % 7 <> 0)
SELECT file, arm, count(*)::BIGINT AS texts, count(DISTINCT item_id)::BIGINT AS documents, max(pass)::BIGINT AS last_pass, min(text) AS first_text FROM t GROUP BY ALL"""


def latest_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest run, and the models that wrote its documents."""
    newest = files.latest(_snapshots(spark, sf_dir))
    authors = newest.select("file", F.explode(F.map_values("results")).alias("r")).select("file", "r.author")
    return authors.agg(F.max("file").alias("file")).crossJoin(F.broadcast(runs.models_of(authors, "model-"))).select("file", F.array_join("models", " ").alias("models"))


LATEST_SQL = f"""WITH {_RUNS_SQL} SELECT max(file) AS file, string_agg(DISTINCT 'model-' || item_id % 3, ' ' ORDER BY 'model-' || item_id % 3) FILTER (WHERE item_id % 2 = 1) AS models FROM results WHERE file LIKE '%bbbb%'"""


def pages_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _snapshots(spark, sf_dir).select("file", F.explode(F.map_keys("results")).alias("doc"))
    pages = spark.createDataFrame([("eval-2024-02-03-bbbb2222.html",), ("eval-none.html",)], "file string")
    return runs.runs_with_page(results, pages).select("doc", F.array_join("runs", " ").alias("runs"))


PAGES_SQL = f"WITH {_RUNS_SQL} SELECT 'doc-' || item_id AS doc, 'eval-2024-02-03-bbbb2222' AS runs FROM results WHERE file LIKE '%bbbb%'"


def unjudged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells joined with what judges and passes told, and those that were judged for and came back silent."""
    texts = files.snapshot_texts(_snapshots(spark, sf_dir)).where("pass = 0").drop("pass")
    keys = ["file", "doc", "arm"]
    number = F.regexp_extract("doc", r"(\d+)$", 1).cast("int")
    semantic = texts.where((F.col("arm") != "source") & (number % 5 != 0)).select(*keys, F.lit("judged").alias("semantic"))
    done = texts.where(number % 3 == 0).select(*keys, F.lit(2).alias("of"))
    found = runs.backfill_unjudged(runs.cells(texts, semantic, done, keys))
    return found.groupBy("arm", "unjudged").agg(F.count("*").alias("cells"), F.count("of").alias("with_passes"))


UNJUDGED_SQL = f"""WITH {_RUNS_SQL}, c AS (SELECT item_id, 'source' AS arm FROM results UNION ALL SELECT item_id, 'plain' FROM results UNION ALL SELECT item_id, 'treated' FROM results WHERE item_id % 7 <> 0)
SELECT arm, arm <> 'source' AND item_id % 5 = 0 AS unjudged, count(*)::BIGINT AS cells, count(*) FILTER (WHERE item_id % 3 = 0)::BIGINT AS with_passes FROM c GROUP BY ALL"""


def stage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and seconds by stage, failed ones by their label, and how many for want of credentials."""
    item = F.col("item_id")
    calls = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        F.when(item % 2 == 0, "generation").otherwise("judging").alias("stage"), (item % 7 * 0.25).cast("double").alias("seconds"), F.concat(F.lit("doc-"), item).alias("label"),
        F.when(item % 9 == 0, F.lit("Not logged in. Run /login")).when(item % 9 == 4, F.lit("no answer")).alias("error"),
    )
    lost = runs.failures(calls).select("failures", F.size("failed").cast("bigint").alias("named"), F.get("failed", F.lit(0)).alias("first_failed"))
    auth = calls.agg(F.count_if(runs.auth_failure(F.col("error"))).alias("unauthorised"))
    return runs.stage_metering(calls).crossJoin(F.broadcast(lost)).crossJoin(F.broadcast(auth))


STAGES_SQL = """WITH f AS (SELECT count(*)::BIGINT AS failures, count(*)::BIGINT AS named, min('doc-' || item_id) AS first_failed, count(*) FILTER (WHERE item_id % 9 = 0)::BIGINT AS unauthorised FROM benchmark WHERE item_id % 9 IN (0, 4))
SELECT CASE WHEN item_id % 2 = 0 THEN 'generation' ELSE 'judging' END AS stage, count(*)::BIGINT AS calls, round(sum(item_id % 7 * 0.25::DOUBLE), 1)::DOUBLE AS seconds, f.failures, f.named, f.first_failed, f.unauthorised FROM benchmark, f GROUP BY ALL"""


def paired_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with and without, paired by the text of the question and not by place."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    asked = c.select("conv_id", "turn", F.concat(F.lit(" question "), F.col("turn").cast("string")).alias("question"), F.col("text").alias("answer")).dropDuplicates(["conv_id", "turn"])
    control = asked.select("conv_id", F.concat(F.trim("question"), F.lit("  ")).alias("question"), F.concat(F.lit("control "), F.col("turn").cast("string")).alias("answer"))
    both = pair_turns(asked, control)
    return both.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("control") == F.concat(F.lit("control "), F.col("turn").cast("string"))).alias("right"))


PAIRED_SQL = "SELECT conv_id, count(DISTINCT turn)::BIGINT AS turns, count(DISTINCT turn)::BIGINT AS right FROM conversations GROUP BY conv_id"


# ---------------------------------------------------------------- dimension files, written and read back
def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest written entry by entry, read back and joined with the texts of its documents."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    k = F.col("item_id")
    fields = {
        "id": F.concat(F.lit("doc-"), k), "type": F.lit("runbook"), "title": F.concat(F.lit('The "big" title '), k), "url": F.concat(F.lit("https://a.b/"), k), "author": F.lit("Ann B"),
        "licence": F.lit("MIT"), "retrieved": F.lit("2024-01-01"), "sha256": F.lpad(k.cast("string"), 8, "0"), "words": k * 3, "excerpt": F.when(k % 2 == 0, "true").otherwise("false"), "note": F.when(k % 4 == 0, F.lit("cut # here")),
    }
    entries = [r["e"] for r in items.orderBy("item_id").select(manifest.entry_text(fields).alias("e")).collect()]  # a manifest is small by nature
    start = "# a manifest\ndocuments: []\n"
    text = spark.createDataFrame([(start, "\n".join(entries))], "m string, e string").select(manifest.appended(F.col("m"), F.col("e")).alias("t")).first()["t"]
    folder = _write_texts(spark, shared_folder(spark, "manifest"), {"MANIFEST.yaml": text})
    read = manifest.read_manifest(spark, f"{folder}/MANIFEST.yaml")
    texts = items.select(F.concat(F.lit("doc-"), k).alias("name"), "text")
    joined = runs.with_text(read, texts)
    return joined.select("id", "title", "author", "sha256", F.col("words").cast("bigint").alias("words"), "excerpt", "note", F.length("text").cast("bigint").alias("n_chars"))


MANIFEST_SCAN_SQL = """SELECT 'doc-' || item_id AS id, 'The ''big'' title ' || item_id AS title, 'Ann B' AS author, lpad(item_id::VARCHAR, 8, '0') AS sha256, (item_id * 3)::BIGINT AS words, item_id % 2 = 0 AS excerpt,
CASE WHEN item_id % 4 = 0 THEN '"cut' END AS note, length(text)::BIGINT AS n_chars FROM benchmark"""


_WORDS_FILE = """# words
meta:
  version: 1
words:
  - word: start   # a comment
    meaning: To begin: a thing.
    instead_of: [initiate, "spin up", commence,
                 get going]
    note: >
      Not of a car. See
      the list.
  - word: end
    instead_of:
      - terminate
      - "bring to an end"
  - word: null
    instead_of: [basically, start]
  - word: Stop
    instead_of: [terminate]
marketing_adjectives:
  - robust
  - seamless
phrasal_verbs:
  # each one verb
  spin up: start
  Figure out: find
latin_abbreviations:
  e.g.: for example
american_british:
  colour: color
hedges:
  - [perhaps, it seems]
response_frames:
  - "of course"
"""


def vocabulary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word list and a term list read from files: routes, approved words, terms, core words and weights."""
    folder = _write_texts(spark, shared_folder(spark, "vocabulary"), {
        "words.yaml": _WORDS_FILE, "terms.yaml": "common_nouns:\n  - queue\n  - log file\n\nterm_verbs:\n  - id: BV1\n    verbs: [merge, deploy,\n            roll back]\n",
        "core.txt": "# core\nThe\nthe # again\n\nof\n", "weights.csv": "rule,weight,reason\nN1,0.5,long\nX1,0.1,mark\n,0.3,none\nS9,N/A,\n",
    })
    v = vocabulary.load_vocabulary(spark, f"{folder}/words.yaml", f"{folder}/terms.yaml")
    listed = vocabulary.vocabulary_table(spark, v).select("kind", "phrase", "replacement")
    core = vocabulary.load_core_words(spark, f"{folder}/core.txt").select(F.lit("core").alias("kind"), F.col("word").alias("phrase"), F.lit(None).cast("string").alias("replacement"))
    weights = vocabulary.load_weights(spark, f"{folder}/weights.csv").select(F.lit("weight").alias("kind"), F.col("rule").alias("phrase"), F.col("weight").cast("string").alias("replacement"))
    odd = corpus.unsound_routes(listed.where("kind = 'instead_of'"), listed.where("kind = 'approved'").select("phrase"), listed.where("kind = 'term_verbs'").select("phrase"))
    return listed.unionByName(core).unionByName(weights).unionByName(odd.select(F.lit("unsound").alias("kind"), "phrase", "replacement"))


_VOCABULARY_ROWS = [
    ("instead_of", "initiate", "start"), ("instead_of", "spin up", "start"), ("instead_of", "commence", "start"), ("instead_of", "get going", "start"), ("instead_of", "bring to an end", "end"),
    ("instead_of", "basically", None), ("instead_of", "terminate", "stop"), ("phrasal", "spin up", "start"), ("phrasal", "figure out", "find"), ("latin", "e.g.", "for example"),
    ("british", "colour", "color"), ("marketing", "robust", None), ("marketing", "seamless", None), ("hedges", "perhaps", None), ("hedges", "it seems", None), ("frames", "of course", None),
    ("term_nouns", "queue", None), ("term_nouns", "log file", None), ("term_verbs", "merge", None), ("term_verbs", "deploy", None), ("term_verbs", "roll back", None), ("approved", "start", None),
    ("approved", "end", None), ("approved", "stop", None), ("core", "the", None), ("core", "of", None), ("weight", "N1", "0.5"), ("weight", "X1", "0.1"),
]
VOCABULARY_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({q(k)}, {q(p)}, {q(r) if r else 'NULL'})" for k, p, r in _VOCABULARY_ROWS) + ") AS t(kind, phrase, replacement)"

_SPEC = """Intro.

**N1**: An instruction is short.

*Weight: 0.5.* It costs a reader
some time.

More text.

**X1**: No semicolon.

*Weight: 0.2.* One mark.
**S9**: Judged by a person.

*Weight: N/A.* Not counted, "yet".

**Z1**: No weight here.
"""


def weight_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights read from a specification, written as CSV, read back, and compared with a stored table."""
    folder = _write_texts(spark, shared_folder(spark, "weights"), {"spec.md": _SPEC})
    rows = manifest.weight_annotations(spark, f"{folder}/spec.md")
    csv = manifest.weights_csv(rows).first()["csv"]
    back = vocabulary.load_weights(spark, f"{_write_texts(spark, folder, {'weights.csv': csv})}/weights.csv")
    differ = runs.weights_differ(back, spark.createDataFrame([("N1", 0.5), ("X1", 0.1)], "rule string, weight double"))
    return rows.unionByName(differ.select("rule", F.concat(F.col("weight").cast("string"), F.lit(" in "), "only_in").alias("weight"), F.lit("differs").alias("reason")))


WEIGHTS_SQL = """SELECT * FROM (VALUES ('N1', '0.5', 'It costs a reader some time.'), ('X1', '0.2', 'One mark.'), ('S9', 'N/A', 'Not counted, "yet".'), ('X1', '0.2 in spec', 'differs'), ('X1', '0.1 in stored', 'differs')) AS t(rule, weight, reason)"""


def word_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The appendix of approved words: their fields, block scalars and lists too."""
    folder = _write_texts(spark, shared_folder(spark, "entries"), {"words.yaml": _WORDS_FILE})
    return vocabulary.word_entries(spark, f"{folder}/words.yaml").select("word", "field", F.array_join("values", "; ").alias("value"))


ENTRIES_SQL = """SELECT * FROM (VALUES ('start', 'meaning', 'To begin: a thing.'), ('start', 'instead_of', 'initiate; spin up; commence; get going'), ('start', 'note', 'Not of a car. See the list.'),
('end', 'instead_of', 'terminate; bring to an end'), ('Stop', 'instead_of', 'terminate')) AS t(word, field, value)"""


# ---------------------------------------------------------------- pages
def run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of runs as a page: one row a run of the benchmark's items."""
    item = F.col("item_id")
    listed = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        F.format_string("eval-%05d.json", item).alias("file"), F.lit("2024-01-02").alias("date"), F.format_string("c%d", item).alias("commit"), item.cast("bigint").alias("documents"),
        F.array(F.lit("plain"), F.lit("a&b")).alias("arms"), F.when(item % 2 == 0, "m<1>").alias("generation"), F.lit(None).cast("string").alias("judging"), (item % 3 == 0).alias("has_page"),
    )
    return publish.run_index(listed)


INDEX_SQL = """SELECT '<table><thead><tr><th>Date</th><th>Commit</th><th>Documents</th><th>Arms</th><th>Models</th><th>Pages</th></tr></thead><tbody>' || string_agg(
'<tr><td>2024-01-02</td><td><code>c' || item_id || '</code></td><td class="n">' || item_id || '</td><td>plain, a&amp;b</td><td>' || CASE WHEN item_id % 2 = 0 THEN 'gen m&lt;1&gt;, judge ?' ELSE '<span class="missing">not recorded</span>' END || '</td><td>' ||
CASE WHEN item_id % 3 = 0 THEN '<a href="eval-' || lpad(item_id::VARCHAR, 5, '0') || '.html">report</a>' ELSE '<span class="missing">no page built</span>' END || '</td></tr>', '' ORDER BY item_id DESC) || '</tbody></table>' AS page FROM benchmark"""


def turn_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").cast("string").alias("name"), "turn", F.concat(F.lit("<q> & "), F.col("turn").cast("string")).alias("question"), F.col("text").alias("answer"), F.lit(None).cast("string").alias("control")
    )
    return publish.turn_panels(c).select("name", "turn", F.sha2("panel", 256).alias("digest"))


def _escaped(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = f"replace({x}, {quoted(a)}, '{b}')"
    return x


TURNS_SQL = f"""SELECT conv_id::VARCHAR AS name, turn, sha256('<div class="panel"><h3>&lt;q&gt; &amp; ' || turn || '</h3><div class="col"><div class="label">Without</div><div class="text"></div></div><div class="col"><div class="label">With</div><div class="text">' ||
{_escaped("coalesce(text, '')")} || '</div></div></div>') AS digest FROM conversations"""


def report_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of each item as JSON, arms in order: read back field by field."""
    cells = _judged(spark, sf_dir).where("pass = 0").select(F.col("item_id").alias("doc"), F.concat(F.lit("T"), F.col("item_id")).alias("title"), "arm", "total", "words")
    out = publish.report_payload(cells, ["plain", "treated", "source"])
    field = lambda p: F.get_json_object("payload", f"$.{p}")
    return out.select(F.col("doc").alias("item_id"), field("title").alias("title"), *[field(f"arms.{a}.total").cast("bigint").alias(a) for a in ARMS], F.startswith("payload", F.concat(F.lit('{"id":'), F.col("doc").cast("string"))).alias("in_order"))


PAYLOAD_SQL = f"""WITH {_CELL_HITS} SELECT item_id, 'T' || item_id AS title, {', '.join(f"max(total) FILTER (WHERE arm = '{a}') AS {a}" for a in ARMS)}, true AS in_order FROM judged WHERE pass = 0 GROUP BY item_id"""

QUERIES = {
    "pass_statistics": pass_statistics, "rules_by_arm": rules_by_arm, "run_overview": run_overview, "finding_listing": finding_listing, "snapshot_texts": snapshot_texts,
    "latest_models": latest_models, "pages_by_document": pages_by_document, "unjudged_cells": unjudged_cells, "stage_totals": stage_totals, "paired_turns": paired_turns,
    "manifest_scan": manifest_scan, "vocabulary_scan": vocabulary_scan, "weight_annotations": weight_annotations, "word_entries": word_entries, "run_index": run_index, "turn_panels": turn_panels, "report_payload": report_payload,
}
ORACLES = {
    "pass_statistics": PASSES_SQL, "rules_by_arm": BY_ARM_SQL, "run_overview": RUN_OVERVIEW_SQL, "finding_listing": LISTING_SQL, "snapshot_texts": SNAPSHOT_SQL,
    "latest_models": LATEST_SQL, "pages_by_document": PAGES_SQL, "unjudged_cells": UNJUDGED_SQL, "stage_totals": STAGES_SQL, "paired_turns": PAIRED_SQL,
    "manifest_scan": MANIFEST_SCAN_SQL, "vocabulary_scan": VOCABULARY_SQL, "weight_annotations": WEIGHTS_SQL, "word_entries": ENTRIES_SQL, "run_index": INDEX_SQL, "turn_panels": TURNS_SQL, "report_payload": PAYLOAD_SQL,
}
