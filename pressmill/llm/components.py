"""Connected components of links, by alternating large-star and small-star steps on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with v < u. Each node's neighbours (larger ones, or smaller ones) go to its least one."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v")


def components(links: DataFrame, steps: Steps | None = None, tasks: int | None = None) -> DataFrame:
    """node and component, the least node it reaches, for every node of links (a, b). tasks: as Steps.store has it."""
    steps = steps or Steps(links.sparkSession)
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    measures = {"n": F.count(F.lit(1)), "sum": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    mark = None
    while True:
        edges, found = steps.store(_star(_star(edges, True), False).distinct(), tasks, **measures)
        # The same edges again: every component is a star about its least node.
        if not found["n"] or found == mark:
            break
        mark = found
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
