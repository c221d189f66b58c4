"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, written


def _moved(edges: DataFrame) -> bool:
    return bool(edges.agg(F.max("moved")).first()[0])


def _replaced(old: DataFrame | None, now: DataFrame) -> DataFrame:
    if old is not None:
        dropped(old)
    return now


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is the smallest node that it is joined with.

    First each node keeps the link to the smallest of its smaller neighbours, and the other ones are
    linked with that one instead, until no node has two smaller neighbours: a forest of pointers.
    Nodes are hashes, so links sink to the roots in a few rounds. Then each pointer is replaced by
    the pointer of the node that it leads to, until all lead to roots.

    Rows never grow in number. A root with many nodes is a hub only as the greater side of a plain
    join, which AQE splits; no window or aggregation is dealt by it. Rounds are written to the
    shared folder. No edges: no rows.
    """
    now, old = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), None
    while True:
        least = now.distinct().withColumn("m", F.min("v").over(Window.partitionBy("u")))
        kept = F.col("v") == F.col("m")
        now = written(least.select(F.when(kept, F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), (~kept).alias("moved")), "forest")
        old = _replaced(old, now)
        if not _moved(now):
            break
        now = now.select("u", "v")
    while True:
        up = now.select(F.col("u").alias("at"), F.col("v").alias("top")).hint("merge")  # as many rows as nodes: never broadcast
        now = now.join(up, F.col("v") == F.col("at"), "left").select("u", F.coalesce("top", "v").alias("v"), F.col("top").isNotNull().alias("moved"))
        now = written(now, "pointers")
        old = _replaced(old, now)
        if not _moved(now):
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
