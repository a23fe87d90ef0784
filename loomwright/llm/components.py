"""Connected components of an edge table, by hooking and pointer jumping on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, store


def roots(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest given as (node, parent) with parent < node, one row a node; roots need no row.

    Each round halves the distance to the root; a hot parent is an ordinary join key here, with one row on its side.
    """
    table, path = store(parents.select("node", F.col("parent").alias("root")), "forest")
    while True:
        up = table.select(F.col("node").alias("__up"), F.col("root").alias("__root"))
        nxt = table.join(up, table.root == F.col("__up"), "left").select(
            "node", F.coalesce("__root", "root").alias("root"), F.col("__root").isNotNull().alias("moved")
        )
        done, new_path = store(nxt, "forest")
        moved = done.where("moved").limit(1).count()
        remove(parents.sparkSession, path)
        table, path = done.drop("moved"), new_path
        if not moved:
            return table


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): root is the smallest node reachable.

    Each round every node with a smaller neighbour hooks to its smallest one, the forest is flattened, and edges are
    drawn anew between the roots. It ends when no edge is left. Every round's tables are files in the shared folder.
    """
    spark = edges.sparkSession
    left, left_path = store(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    label, label_path = None, None
    while left.limit(1).count():
        forest = roots(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")))
        to = forest.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
        if label is None:
            nodes = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            nxt = nodes.join(to, F.col("node") == F.col("__node"), "left").select("node", F.coalesce("__root", "node").alias("root"))
        else:
            nxt = label.join(to, F.col("root") == F.col("__node"), "left").select("node", F.coalesce("__root", "root").alias("root"))
        label, old = store(nxt, "labels"), label_path
        label, label_path = label
        far = to.select(F.col("__node").alias("__n2"), F.col("__root").alias("__r2"))
        drawn = (
            left.join(to, F.col("a") == F.col("__node"), "left")
            .join(far, F.col("b") == F.col("__n2"), "left")
            .select(F.coalesce("__root", "a").alias("x"), F.coalesce("__r2", "b").alias("y"))
            .where("x <> y")
            .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
            .distinct()
        )
        nxt, nxt_path = store(drawn, "edges")
        remove(spark, left_path, *([old] if old else []))
        left, left_path = nxt, nxt_path
    if label is None:
        kind = edges.schema["a"].dataType.simpleString()
        return spark.createDataFrame([], f"node {kind}, root {kind}")
    return label


def relabelled(label: DataFrame, merged: DataFrame) -> DataFrame:
    """(node, root) after some roots have been merged to others; nodes that were alone before appear by themselves."""
    to = merged.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    old = label.join(to, F.col("root") == F.col("__node"), "left").select("node", F.coalesce("__root", "root").alias("root"))
    new = merged.join(label.select(F.col("node").alias("__old")), F.col("node") == F.col("__old"), "left_anti")
    return store(old.unionByName(new), "labels")[0]
