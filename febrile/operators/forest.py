"""Fitted trees as a table of nodes, and what follows from it by joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from febrile.session import ensure_checkpoint_dir, scratch_path


def node_table(model, spark: SparkSession) -> DataFrame:
    """tree, node, left, right (-1: a leaf), feature, cut, categories, gain, count, stats, prediction of a fitted tree ensemble.

    Rows with a value of ``feature`` at or below ``cut`` go left; where
    ``categories`` is not null, those whose value it holds.  ``stats`` are the
    weights of the classes at the node and ``count`` their sum.  The nodes are those
    that the model writes, so they are read by executors and not through the driver.
    """
    path = scratch_path(spark, "tree-nodes")
    model.write().save(path)
    n, split = F.col("nodeData"), F.col("nodeData.split")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        split["featureIndex"].alias("feature"), F.when(split["numCategories"] < 0, F.get(split["leftCategoriesOrThreshold"], F.lit(0))).alias("cut"),
        F.when(split["numCategories"] >= 0, split["leftCategoriesOrThreshold"]).alias("categories"), n["gain"].alias("gain"),
        F.aggregate(n["impurityStats"], F.lit(0.0), lambda a, x: a + x).alias("count"), n["impurityStats"].alias("stats"),
        n["prediction"].alias("prediction"))


def importances(nodes: DataFrame) -> DataFrame:
    """feature (number), importance: gains weighted by the rows they act on, each tree and then the forest summing to one."""
    by_tree = nodes.filter("left >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("count")).alias("gain"))
    totals = by_tree.groupBy("tree").agg(F.sum("gain").alias("total")).filter("total > 0")
    shares = by_tree.join(totals, "tree").groupBy("feature").agg(F.sum(F.col("gain") / F.col("total")).alias("share"))
    # every tree that splits brings shares that sum to one
    return shares.select("feature", (F.col("share") / F.lit(float(max(totals.count(), 1)))).alias("importance"))


def leaves(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """id, tree, stats and prediction of the leaf that each of ``rows`` (id, features array) reaches in each tree.

    All rows go down one level a round, by a join on (tree, node); a round is
    checkpointed, and the rounds end with the deepest path.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    trees = nodes.agg(F.max("tree")).first()[0]
    values = rows.select("id", "features")
    at = values.select("id", "features", F.explode(F.sequence(F.lit(0), F.lit(trees))).alias("tree")).withColumn("node", F.lit(0))
    done = None
    while True:
        met = at.join(nodes, ["tree", "node"]).checkpoint(eager=True)
        ended = met.filter("left < 0").select("id", "tree", "stats", "prediction")
        done = ended if done is None else done.unionByName(ended)
        going = met.filter("left >= 0")
        if not going.limit(1).count():
            return done
        value = F.element_at("features", F.col("feature") + 1)
        to_left = F.coalesce(F.array_contains("categories", value), value <= F.col("cut"))
        at = going.select("id", "features", "tree", F.when(to_left, F.col("left")).otherwise(F.col("right")).alias("node"))


def class_probabilities(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """id, probs: the leaves' class shares, averaged over the trees."""
    one = leaves(nodes, rows).select("id", F.posexplode(F.transform("stats", lambda x: x / F.aggregate(
        "stats", F.lit(0.0), lambda a, y: a + y))).alias("class", "share"))
    mean = one.groupBy("id", "class").agg(F.avg("share").alias("p"))
    return mean.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("class", "p"))), lambda x: x["p"]).alias("probs"))


def consistent(nodes: DataFrame) -> DataFrame:
    """One row: whether every inner node has a positive gain and two children that share out its class weights."""
    child = nodes.select("tree", F.col("node").alias("child"), F.col("stats").alias("child_stats"))
    inner = nodes.filter("left >= 0")
    pairs = inner.select("tree", "node", "gain", "stats", F.explode(F.array("left", "right")).alias("child")).join(child, ["tree", "child"], "left")
    one = pairs.select("tree", "node", "gain", F.posexplode_outer(F.arrays_zip("stats", "child_stats")).alias("class", "z"))
    sums = one.groupBy("tree", "node", "class").agg(F.first("gain").alias("gain"), F.first("z.stats").alias("own"),
                                                    F.sum("z.child_stats").alias("both"), F.count("*").alias("children"))
    fits = (F.col("gain") > 0) & (F.col("children") == 2) & (F.abs(F.col("own") - F.col("both")) <= 1e-6 * F.greatest(F.col("own"), F.lit(1.0)))
    return sums.agg(F.coalesce(F.bool_and(F.coalesce(fits, F.lit(False))), F.lit(True)).alias("consistent"))
