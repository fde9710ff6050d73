"""Connected components by contraction, as Spark joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from febrile.llm.common import written


def bucket_components(rows: DataFrame, name: str) -> DataFrame:
    """node, root (the smallest node it is connected with) of the nodes of ``rows`` (node, bucket; a written table) that
    share a bucket with another; the nodes of a bucket are connected.

    Each round hooks every node to the smallest node of its buckets, follows
    the hooks to their ends and puts the ends into the buckets in the nodes' place.
    A node brings one hook, whatever the number of its buckets; buckets whose nodes
    have become one leave.  So no join gives more rows than it was given, and every
    round leaves at most half of the nodes that still have someone to meet.  Rounds
    are written to the shared folder.
    """
    links, roots, step = rows.select("node", "bucket"), None, 0
    while True:
        step += 1
        least = links.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most")
        open_links = written(links.join(least.select("bucket", "least"), "bucket"), f"{name}-open-{step}")
        hooks = open_links.groupBy("node").agg(F.min("least").alias("root")).filter("root < node")
        hooks = followed(written(hooks, f"{name}-hooks-{step}"), f"{name}-{step}")
        if hooks is None:
            break
        ends = hooks.withColumnRenamed("node", "last").withColumnRenamed("root", "further")
        if roots is not None:
            moved = roots.join(ends, F.col("root") == F.col("last"), "left").select("node", F.coalesce("further", "root").alias("root"))
            # nodes that were ends themselves until now
            hooks = moved.unionByName(hooks)
        roots = written(hooks, f"{name}-roots-{step}")
        links = open_links.join(ends, F.col("node") == F.col("last"), "left").select(F.coalesce("further", "node").alias("node"), "bucket")
        links = written(links.distinct(), f"{name}-links-{step}")
    if roots is None:
        return rows.select("node", F.col("node").alias("root")).filter(F.lit(False))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def followed(hooks: DataFrame, name: str) -> DataFrame | None:
    """``hooks`` (node, root; root < node, one row a node) with each root replaced by the end of its chain; None if there are none."""
    if not hooks.limit(1).count():
        return None
    step = 0
    while True:
        step += 1
        onward = hooks.select(F.col("node").alias("root"), F.col("root").alias("further"))
        hooks = written(hooks.join(onward, "root", "left").select("node", F.coalesce("further", "root").alias("root"),
                                                                  F.col("further").isNotNull().alias("moved")), f"{name}-follow-{step}")
        if not hooks.filter("moved").limit(1).count():
            return hooks.drop("moved")
        hooks = hooks.drop("moved")


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, root of every node of ``edges`` (a, b): an edge is in the bucket of its end b."""
    edges = edges.filter("a <> b")
    rows = edges.select(F.col("a").alias("node"), F.col("b").alias("bucket")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("bucket")))
    return bucket_components(rows, name)
