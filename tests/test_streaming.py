"""The streaming forms give what the batch forms give."""

import pandas as pd

from lexisieve.operators.findings import findings
from lexisieve.operators.modes import states
from lexisieve.streaming.live import session_levels, streaming_findings


def test_stream_of_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "It doesn't; fit."), (2, "Fine."), (3, "You should run it.")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/in")
    stream = streaming_findings(spark, spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("found").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.sql("select doc_id, rule, line, column from found").collect()))
    assert got == sorted(map(tuple, findings(spark, docs).select("doc_id", "rule", "line", "column").collect())) and got


def test_levels_live_on_between_batches(spark, tmp_path):
    prompts = ["/plain on", "hello", "stop using plain english", "hello", "turn on plain mode", "hello"]
    rows = [(f"s{k}", i, p) for k in range(2) for i, p in enumerate(prompts[k:])]
    schema = "session_id string, seq long, prompt string"
    for part in (0, 1):
        spark.createDataFrame([r for r in rows if r[1] // 3 == part], schema).coalesce(1).write.parquet(f"{tmp_path}/in/p={part}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = session_levels(source).writeStream.format("memory").queryName("levels").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.sql("select * from levels").toPandas().sort_values(["session_id", "seq"]).values.tolist()
    batch = states(spark.createDataFrame(rows, schema)).select("session_id", "seq", "level").toPandas()
    assert isinstance(batch, pd.DataFrame) and got == batch.sort_values(["session_id", "seq"]).values.tolist()
