"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def connected_components(links: DataFrame, name: str) -> DataFrame:
    """(node, component) of every node of links (a, b); component is the smallest node reachable.

    Rounds of hooking and shortcutting on parent pointers, a logarithmic number of them. Every join
    reads tables staged in the shared folder, so that its large keys can be split at run time, and
    minima are taken before rows are dealt. Null nodes and links to oneself are left out.
    """
    sound = links.where("a is not null and b is not null and a <> b")
    both = stage(sound.select("a", "b").union(sound.select("b", "a")).distinct(), f"{name}-links")
    parents = stage(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("parent")), f"{name}-parents")
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        grand = parents.join(up, "parent").select("node", "parent", "grand")
        near = both.join(grand.select(F.col("node").alias("b"), "grand"), "b").groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("near"))
        lower = grand.join(near, "node").select("node", "parent", F.least("grand", "near").alias("low"))
        hooked = lower.select(F.explode(F.array(F.struct("node", "low"), F.struct(F.col("parent").alias("node"), "low"))).alias("h")).select("h.node", "h.low")
        after = stage(hooked.groupBy("node").agg(F.min("low").alias("parent")), f"{name}-parents")
        moved = after.join(parents, (after["node"] == parents["node"]) & (after["parent"] == parents["parent"]), "left_anti").limit(1).count()
        unstage(parents)
        parents = after
        if not moved:
            unstage(both)
            return parents.select("node", F.col("parent").alias("component"))
