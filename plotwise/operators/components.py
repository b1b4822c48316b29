"""Connected components of an edge table: large-star / small-star rounds over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwise.scratch import drop_table, write_table


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One half round. large: link every larger neighbour to the least one; else every smaller neighbour.

    The least neighbour is an aggregate with a map-side part, so a node with very many neighbours adds one row a task.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    near = both.where("v > u") if large else both
    moved = near.hint("merge").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (two id columns ``u``, ``v``); component is the least reachable id.

    Self links and repeated links are allowed, links with a null end are ignored, an empty table gives an empty result. Every round
    is written to the shared folder, so a lost executor never sends the job back further than one round. Nothing is collected but one
    row of sums a round.
    """
    edges = edges.where("u is not null and v is not null")
    kind = edges.schema["u"].dataType
    now = write_table(edges.where("u <> v").select("u", "v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        moved = write_table(_stars(_stars(now, True), False), "edges")
        seen = moved.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(now)
        now = moved
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    inner = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return inner.unionByName(inner.select(F.col("component").alias("node"), "component").distinct()).select(F.col("node").cast(kind), F.col("component").cast(kind))
