"""Inputs of the registered queries, in both engines: one deterministic mutation of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One violating or clean snippet for each rule; document k gets number k mod their count.
SNIPPETS = [
    "The parser is robust; it doesn't fail.",
    "You should run the test. Please close the file, or you must wait.",
    "Run the job that was written by the team before the check is made.",
    "We have finished the work. The file would have been lost. They had been told.",
    "The node is writing its backlog. The service is running.",
    "Perform the validation of the input. The creation of the file failed. A sequence of steps ran.",
    "We spin up a node and figure out the colour of its behaviour, e.g. by hand, i.e. slowly.",
    "VS Code shows the seamless and powerful view etc. to the user vs the log.",
    "Perhaps it is likely that it fails. It is somewhat likely, arguably.",
    "In order to terminate the job, order a number of parts. The number is basically a flag.",
    "The old new large binary backup is here. Take the small red round box. A useful large tool works.",
    "A writer MUST never do it. Nobody SHOULD write it. A reader MAY NOT stop.",
    "A writer MUST write no more than two lines. They SHALL avoid it. It is NOT REQUIRED here.",
    "A file MUST be named. It is RECOMMENDED that he read it. A writer MUST NOT stop.",
    "- one\n- two\n- three\n- four\n- five\n- six\n- seven\n- eight\n- nine",
    "The complete list follows:\n\n- one\n- two\n- three\n- four\n- five\n- six\n- seven\n- eight\n- nine",
    "First. Second. Third. Fourth. Fifth. Sixth. Seventh. Eighth.",
    "The value was parseConfiged and then max_size_limiting again, as getValue says.",
    "The system — as every reader of this long line can easily see — joins two clauses here.",
    "Of course. The work is done. In conclusion, this is all we had to say about it.",
    "Use the failed database connection retry handler. Check a queue priority setting handler value.",
    "Stop the server when the queue is empty and the last of the many workers has sent every one of its open results to the log file.",
    "Wait 30 seconds, then retry 3 times. Send at most five requests in 2 minutes.",
    "Let's go. We're late and they'll wait. It's fine. The team's plan holds.",
    "The cat sat. A dog ran.",
    "She told him that her plan is his plan. The shouldness of it should hold.",
    "I hope this helps",
]


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


SNIPPETS_SQL = "[" + ", ".join(quoted(s) for s in SNIPPETS) + "]"
#: documents(doc_id, lang, text) with a snippet at the end of every text.
MUTATED_SQL = (
    "mutated AS (SELECT doc_id, lang, source, text || chr(10) || chr(10) || "
    f"({SNIPPETS_SQL})[(doc_id % {len(SNIPPETS)} + 1)::INT] AS text FROM documents)"
)
_BREAK = r"regexp_replace(regexp_replace(text, '\n(?:[ \t]*\n)+', chr(1), 'g'), '\n([-*+] )', chr(1) || '\1', 'g')"
#: Sentences of mutated text: doc_id, lang, no (from 0), s, in_list, last.
SENTENCES_SQL = MUTATED_SQL + rf""",
pieces AS (SELECT doc_id, lang, generate_subscripts(p, 1) AS k, unnest(p) AS x FROM (
  SELECT doc_id, lang, string_split(regexp_replace({_BREAK}, '\s*\n\s*', ' ', 'g'), chr(1)) AS p FROM mutated)),
bodies AS (SELECT doc_id, lang, k, regexp_matches(x, '^\s*[-*+]\s+') AS in_list,
  string_split(regexp_replace(regexp_replace(x, '^\s*[-*+]\s+', ''), '([.!?:])\s+', '\1' || chr(1), 'g'), chr(1)) AS q FROM pieces),
cut AS (SELECT doc_id, lang, k, in_list, generate_subscripts(q, 1) AS j, trim(unnest(q)) AS s FROM bodies),
sent AS (SELECT doc_id, lang, in_list, s, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS no,
  count(*) OVER (PARTITION BY doc_id) AS n_sent FROM cut WHERE s <> '')"""


def spread(df: DataFrame) -> DataFrame:
    """Dealt over all cores where the input has far fewer splits than that; else as it is.

    Work on sentences is heavy beside a read. A large input has splits enough and is not moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))


def mutate(text: Column, k: Column) -> Column:
    return F.concat(text, F.lit("\n\n"), F.get(F.array(*[F.lit(s) for s in SNIPPETS]), (k % len(SNIPPETS)).cast("int")))


def mutated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "lang", "source", mutate(F.col("text"), F.col("doc_id")).alias("text"))
