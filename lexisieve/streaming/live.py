"""Streaming forms (extensions): findings of arriving documents, and the mode state of sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.findings import findings
from ..operators.modes import written_level
from ..sources.vocabulary import OWN, Vocabulary


def streaming_findings(spark: SparkSession, docs: DataFrame, vocabulary: Vocabulary = OWN) -> DataFrame:
    """The batch plan over a stream: narrow, so it needs no state and no watermark."""
    return findings(spark, docs, vocabulary)


def windowed_rule_counts(found: DataFrame, time_col: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Findings by rule and event-time window; windows close when the watermark passes them."""
    return found.withWatermark(time_col, late).groupBy(F.window(time_col, window), "rule").count()


def session_levels(prompts: DataFrame, initial: str = "off") -> DataFrame:
    """Of prompts(session_id, seq, prompt): each with the level after it, kept across batches.

    What a prompt writes is decided by column expressions; only the last level of a session is
    state. Rows of a session are taken in seq order within a batch.
    """
    def follow(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        level = state.get[0] if state.exists else initial
        rows = pd.concat(list(batches)).sort_values("seq")
        levels = []
        for wrote in rows["wrote"]:
            level = wrote if isinstance(wrote, str) else level
            levels.append(level)
        state.update((level,))
        yield pd.DataFrame({"session_id": rows["session_id"], "seq": rows["seq"], "level": levels})

    marked = prompts.select("session_id", "seq", written_level(F.col("prompt")).alias("wrote"))
    return marked.groupBy("session_id").applyInPandasWithState(
        follow, "session_id string, seq long, level string", "level string", "append", "NoTimeout"
    )
