"""Connected components of links, as joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stash


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node that has a link; component is the smallest node that can be reached.

    Each round every node takes the smallest label of its neighbours and then the label of that
    label, so labels travel twice as far each time. Hot nodes meet in sums that are formed before
    the shuffle and in joins that adaptive execution can split. Rounds end when no label changes.
    Null ends and links of a node to itself are left out; repeated links count once.
    """
    ends = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    both = stash(ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = stash(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("heard"))
        near = labels.join(heard.withColumnRenamed("u", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        far = near.join(labels.select(F.col("node").alias("label"), F.col("label").alias("beyond")), "label", "left")
        after = stash(far.select("node", "old", F.least("label", F.coalesce("beyond", "label")).alias("label")))
        if after.filter("label <> old").isEmpty():
            return after.select("node", F.col("label").alias("component"))
        labels = after.select("node", "label")


def merged(reach: DataFrame, links: DataFrame) -> DataFrame:
    """components() of all links that gave reach and of links (a, b), from those that join its components.

    Links within a component drop out first, so that what the rounds read shrinks to what is new.
    Nodes that reach doesn't hold are components of their own until a link names them.
    """
    at = reach.select(F.col("node").alias("n"), "component")
    a, b = at.toDF("a", "ca"), at.toDF("b", "cb")
    short = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    over = components(short)
    fresh = over.join(reach.select("node"), "node", "left_anti")
    moved = reach.join(over.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return stash(moved.unionByName(fresh))
