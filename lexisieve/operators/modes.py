"""The on/off state that prompts drive: what a prompt asks for, and the series of states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What switches, what asks, and what names something to be written.
COMMAND = r"(?i)^\s*/plain(?:\s+(\S+))?"
OFF = r"(?i)\b(?:stop|disable|turn off|deactivate)\b.{0,20}\b(?:plain english|plain mode)\b|\bnormal mode\b|\bplain (?:english|mode) off\b"
ON = r"(?i)\b(?:start|use|enable|turn on|activate|switch to)\b.{0,20}\b(?:plain english|plain mode)\b|\bcontrolled english\b"
QUESTION = r"(?i)\b(?:what|which|how|why|when|is|does|can)\b[^?]*\?"
ARTIFACTS = (
    "release note|release notes|changelog|runbook|playbook|incident report|postmortem|post-mortem|error message|error text|"
    "user-facing message|documentation|docs page|readme|api docs|man page|help text|onboarding guide|migration guide"
).split("|")


def names_artifact(prompt: Column, more: list[str] | None = None) -> Column:
    """Whether a prompt names something that is to be written."""
    low = F.lower(prompt)
    listed = F.array(*[F.lit(a.lower()) for a in ARTIFACTS + (more or [])])
    return F.exists(listed, lambda a: F.contains(low, a))


def written_level(prompt: Column, default: str = "on") -> Column:
    """The state a prompt writes, or null: a command first, then off phrases, then on phrases."""
    argument = F.lower(F.regexp_extract(prompt, COMMAND, 1))
    asks = F.rlike(prompt, F.lit(QUESTION))
    return (
        F.when(F.rlike(prompt, F.lit(COMMAND)) & argument.isin("", "on"), F.lit(default))
        .when(F.rlike(prompt, F.lit(COMMAND)) & (argument == "off"), F.lit("off"))
        .when(~asks & F.rlike(prompt, F.lit(OFF)), F.lit("off"))
        .when(~asks & F.rlike(prompt, F.lit(ON)), F.lit("on"))
    )


def states(prompts: DataFrame, key: str = "session_id", order: str = "seq", text: str = "prompt", initial: str = "off") -> DataFrame:
    """Each prompt with the state after it and what is emitted: on, off, reminder, one-turn or nothing."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    wrote = written_level(F.col(text))
    rows = prompts.withColumn("_wrote", wrote).withColumn("level", F.coalesce(F.last("_wrote", True).over(w), F.lit(initial)))
    command = F.rlike(text, F.lit(COMMAND)) & F.col("_wrote").isNotNull()
    emitted = (
        F.when(command | (F.col("_wrote") == "off"), F.col("level"))
        .when(F.col("level") != "off", "reminder").when(names_artifact(F.col(text)), "one-turn").otherwise("nothing")
    )
    return rows.withColumn("emitted", emitted).drop("_wrote")


def chosen_option(env: Column, repo: Column, default: str, valid: list[str]) -> Column:
    """The environment's value, else the repository's, else the default; invalid ones do not count."""
    return F.coalesce(F.when(F.lower(env).isin(*valid), F.lower(env)), F.when(F.lower(repo).isin(*valid), F.lower(repo)), F.lit(default))
