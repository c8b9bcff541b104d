"""Series over turns: totals, thirds, least-squares slope, verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_turns(questions: DataFrame, answers: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Control answers matched to turns by question text, not by place; an unmatched turn raises."""
    left = questions.withColumn("_q", F.trim("question"))
    right = answers.select(id_col, F.trim("question").alias("_q"), F.col("answer").alias("control"))
    both = left.join(right, [id_col, "_q"], "left")
    checked = F.when(F.col("control").isNull(), F.raise_error(F.concat(F.lit("no control answer for: "), F.col("_q")))).otherwise(F.col("control"))
    return both.select(*questions.columns, checked.alias("control"))


def analyse(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Of turns(id, turn, words, findings) one row per series: totals, thirds, extremes, fit."""
    w = Window.partitionBy(id_col).orderBy(turn_col)
    whole = Window.partitionBy(id_col)
    y = F.when(F.col("words") > 0, F.round(F.col("findings") * 100.0 / F.col("words"), 2)).otherwise(0.0)
    placed = turns.select(id_col, "words", "findings", y.alias("y"), F.row_number().over(w).alias("x"), F.count("*").over(whole).alias("n"))
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    band = F.when(F.col("x") <= third, 1).when(F.col("x") <= 2 * third, 2).otherwise(3)
    banded = placed.withColumn("band", band)
    # whole hundredths, so that sums are exact whatever their order
    cents = F.round(F.col("y") * 100)
    means = [(F.round(F.coalesce(F.avg(F.when(F.col("band") == b, cents)), F.avg(cents))) / 100).alias(name) for b, name in ((1, "first_third"), (2, "middle_third"), (3, "last_third"))]
    fits = F.max("n") >= 3
    fitted = banded.groupBy(id_col).agg(
        F.sum("words").alias("words"), F.sum("findings").alias("findings"),
        F.when(F.sum("words") > 0, F.round(F.sum("findings") * 100.0 / F.sum("words"), 2)).otherwise(0.0).alias("per_100w"),
        *means, F.min("y").alias("best_turn"), F.max("y").alias("worst_turn"),
        F.when(fits, F.regr_slope("y", "x")).alias("_b"), F.when(fits, F.regr_intercept("y", "x")).alias("_a"),
    )
    residual = banded.join(fitted.select(id_col, "_a", "_b"), id_col).groupBy(id_col).agg(
        F.stddev_pop(F.col("y") - (F.col("_a") + F.col("_b") * F.col("x"))).alias("_sd")
    )
    return fitted.join(residual, id_col).select(
        id_col, "words", "findings", "per_100w", "first_third", "middle_third", "last_third", "best_turn", "worst_turn",
        F.round("_b", 4).alias("slope"), F.round("_a", 3).alias("intercept"), F.round("_sd", 3).alias("residual_sd"),
    )


def verdicts(treatment: DataFrame, control: DataFrame, id_col: str = "conv_id", noise: float = 1.0) -> DataFrame:
    """Whether a rate drifted, held, or the questions got harder; scatter is the residual deviation."""
    c = control.select(id_col, F.col("slope").alias("c_slope"))
    both = treatment.join(c, id_col)
    b, other = F.col("slope"), F.col("c_slope")
    verdict = (
        F.when(b.isNull() | other.isNull(), "too few turns")
        .when(b <= 0, "held").when(F.abs(b - other) < 0.01, "held, questions got harder")
        .when((b > other) & (b > F.coalesce("residual_sd", F.lit(0.0)) * noise), "drifted").otherwise("held, within scatter")
    )
    return both.select(id_col, "slope", "c_slope", verdict.alias("verdict"))
