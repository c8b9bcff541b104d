"""Connected components by repeated contraction; no component is ever gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def connected_components(ws: Workspace, edges: DataFrame, label: str) -> DataFrame:
    """(node, component) of all nodes of edges(a, b); a component is named by its smallest node.

    In each round a node points to its smallest neighbour (or itself), pointers are followed
    twice, and the edges between pointed-at nodes are what is left for the next round. A star
    is done in one round, a chain of n nodes in about log4(n). Tables are written each round, so that
    both sides of a join stand right behind their shuffles and the rows of one hub can be split.
    """
    least = ws.save(
        edges.where(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(),
        f"{label}-0",
    )
    pointers: list[DataFrame] = []
    round_ = 0
    while not least.isEmpty():
        up = (
            least.select(F.col("v").alias("node"), F.col("u").alias("near"))
            .unionAll(least.select(F.col("u").alias("node"), F.col("v").alias("near")))
            .groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("up"))
        )
        for hop in range(2):
            up = ws.save(up, f"{label}-up{round_}-{hop}")
            onward = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
            up = up.join(onward, "up").select("node", F.col("next").alias("up"))
        up = ws.save(up, f"{label}-up{round_}")
        ws.drop(f"{label}-up{round_}-0", f"{label}-up{round_}-1")
        pointers.append(up)
        left, right = (up.select(F.col("node").alias(c), F.col("up").alias(f"{c}_")) for c in "uv")
        round_ += 1
        least = ws.save(
            least.join(left, "u").join(right, "v").where(F.col("u_") != F.col("v_"))
            .select(F.least("u_", "v_").alias("u"), F.greatest("u_", "v_").alias("v")).distinct(),
            f"{label}-{round_}",
        )
    if not pointers:
        return least.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = pointers[0].select("node", F.col("up").alias("component"))
    for up in pointers[1:]:
        onward = up.select(F.col("node").alias("component"), F.col("up").alias("next"))
        out = out.join(onward, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return out
